import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "decision", "cents", "status", "priority"] and df.count() > 0


def test_nothing_outside_imports_the_llm_subpackage():
    files = [p for p in REPO.glob("strata/**/*.py") if "llm" not in p.relative_to(REPO).parts]
    assert files and not [p for p in files if "strata.llm" in p.read_text() or "from .llm" in p.read_text()]


def test_executors_get_the_package_without_a_path(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(REPO)!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
        "print('rows', e.queries()['h1_html_blocks'](s, '/root/testdata/sf0.001').count())"
    )
    env = {"PATH": "/usr/bin:/bin:" + str(Path(sys.executable).parent), "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=240)
    assert "rows" in out.stdout, out.stderr[-600:]
