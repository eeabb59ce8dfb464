"""Fill-in-the-middle: texts cut at two places and put together again with sentinels, so that the middle comes last.

Each Arrow batch is registered with an in-process DuckDB and one SQL statement makes the whole batch: ``regexp_extract_all`` cuts a
text into units, ``sha256`` of seed and id picks the two cuts and the form, ``list_slice`` and ``array_to_string`` put the parts
together.  No Python runs for a row.  DuckDB takes some megabytes of text at a time, one thread, bounded memory (more for a single
text of many megabytes), and no disk.

A null text counts as empty, an empty or sentinel-bearing text stays ``plain``, and a null id is hashed as an empty one.  Rows are
taken by themselves, so repeated rows or ids give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES, MEMORY, A_BYTE = 8 << 20, 512 << 20, 160  # a longer text may take A_BYTE more for each of its bytes
COLUMNS = "id long, n_units long, form string, prefix_chars long, middle_chars long, output string"

#: ``t`` is the registered slice (n, id, text); the cuts and the form come from the first four groups of eight digits of the hash.
CUT = """
WITH u AS (SELECT n, id, text, regexp_extract_all(text, '{unit}') AS unit, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS h FROM t),
k AS (SELECT *, len(unit) AS n_units, contains(text, '{P}') OR contains(text, '{S}') OR contains(text, '{M}') AS marked,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n_units + 1), h2 % (n_units + 1)) AS a, greatest(h1 % (n_units + 1), h2 % (n_units + 1)) AS b,
  CASE WHEN text = '' OR marked OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT n, id, text, n_units, form, array_to_string(list_slice(unit, 1, a), '') AS pre, array_to_string(list_slice(unit, a + 1, b), '') AS mid, array_to_string(list_slice(unit, b + 1, n_units), '') AS suf FROM c)
SELECT id, n_units::BIGINT AS n_units, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  CASE form WHEN 'psm' THEN '{P}' || pre || '{S}' || suf || '{M}' || mid WHEN 'spm' THEN '{S}' || suf || '{P}' || pre || '{M}' || mid ELSE text END AS output
FROM p ORDER BY n
"""

#: The text again, from form and output alone: no text with a sentinel is ever cut, so the first of each is the one put there.
RESTORE = """
WITH f AS (SELECT *, CASE form WHEN 'psm' THEN '{S}' ELSE '{P}' END AS inner_mark FROM t),
g AS (SELECT *, substr(output, 4, strpos(output, inner_mark) - 4) AS first, substr(output, strpos(output, inner_mark) + 3) AS rest FROM f),
r AS (SELECT *, substr(rest, 1, strpos(rest, '{M}') - 1) AS second, substr(rest, strpos(rest, '{M}') + 3) AS middle FROM g)
SELECT id, n_units, form, prefix_chars, middle_chars, output, CASE form WHEN 'psm' THEN first || middle || second WHEN 'spm' THEN second || middle || first ELSE output END AS text FROM r ORDER BY n
"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _by_batch(batches: Iterator, sql: str, sized: str) -> Iterator:
    """What ``sql`` makes of each slice of each batch; slices have some SLICE_BYTES of column ``sized`` (a longer text stands alone)."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    con = duckdb.connect()
    for setting in ("threads=1", "temp_directory=''"):
        con.execute(f"SET {setting}")
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).append_column("n", pa.array(np.arange(batch.num_rows)))
        ends = np.cumsum(np.asarray(pc.binary_length(table[sized]).to_numpy(), np.int64))
        cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
        for at, to in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            size = int(ends[to - 1] - (ends[at - 1] if at else 0))
            con.execute(f"SET memory_limit='{(MEMORY + A_BYTE * max(0, size - SLICE_BYTES)) >> 20}MB'")
            con.register("t", table.slice(at, to - at))
            made = con.sql(sql).to_arrow_table()
            con.unregister("t")
            yield from made.combine_chunks().to_batches()
    con.close()


def _arrow(df: DataFrame, sql: str, sized: str, schema: str) -> DataFrame:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string()}
    want = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches):
        for made in _by_batch(batches, sql, sized):
            yield pa.RecordBatch.from_arrays([made.column(f.name).cast(f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``id, n_units, form, prefix_chars, middle_chars, output`` of every text.

    ``unit``: a pattern (RE2) that covers any text without gaps; cuts fall between its matches.  ``rate``: how many texts of a hundred
    are cut; ``spm``: how many of those, of a hundred, put the suffix first.  ``marks`` are three characters each.
    """
    if any(len(m) != 3 for m in marks):
        raise ValueError("marks have three characters each")
    p, s, m = map(_quoted, marks)
    sql = CUT.format(unit=_quoted(unit), seed=int(seed), rate=int(rate), spm=int(spm), P=p, S=s, M=m)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _arrow(rows, sql, "text", COLUMNS)


def restore(cut: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """The columns of ``fill_in_middle`` with the ``text`` that form and output alone give back."""
    p, s, m = map(_quoted, marks)
    return _arrow(cut, RESTORE.format(P=p, S=s, M=m), "output", f"{COLUMNS}, text string")
