"""Resolving the same thing across versions: keys, equi, similarity, interval and spatial joins, assignment, alignment."""

from __future__ import annotations

import bisect
import itertools

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import sequences
from strata.plans.lineage import durable


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers each group's rows from 1 on, however large a group is.

    Rows are dealt by ranges of (``by``, ``order``), so a large group lies in several parts; each is numbered by itself and goes on
    from how many rows of the group the parts before it hold.
    """
    placed = durable(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "__part").agg(F.count("*").alias("__m")).withColumn("__before", F.sum("__m").over(earlier)).where("__before is not null")
    offset = counts.select(*(F.col(c).alias(f"__{c}_of") for c in by), F.col("__part").alias("__at"), "__before")
    same = F.col("__part") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}_of"))
    row = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    found = placed.withColumn("__row", row).join(offset, same, "left")
    return found.select(*(F.col(c) for c in df.columns), (F.col("__row") + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def occurrence_keys(df: DataFrame, stem: list[str], order: list[str], name: str = "key") -> DataFrame:
    """``stem`` for the first of its kind, ``stem#2`` for the second and so on."""
    n = F.col("n")
    base = F.concat_ws("/", *stem)
    return numbered(df, stem, order, "n").withColumn(name, F.when(n == 1, base).otherwise(F.concat(base, F.lit("#"), n.cast("string"))))


def ordinal_join(a: DataFrame, b: DataFrame, on: list[str], order_a: list, order_b: list, how: str = "inner") -> DataFrame:
    """The n-th row of a value on one side meets the n-th of that value on the other (first in, first out)."""
    return numbered(a, on, order_a, "ordinal").join(numbered(b, on, order_b, "ordinal"), [*on, "ordinal"], how)


def mutual_best(scored: DataFrame, left: str, right: str, score: str, least: float, margin: float, many: dict[str, str] | None = None) -> DataFrame:
    """Pairs that are each other's best, good enough and clear of the runner-up on both sides.

    Of a side's pairs only the best two leave the tasks that score them, so the pairs themselves are neither dealt nor kept; those too
    low to be a best or a near runner-up are left out before.  ``many`` names, for ``left`` and ``right``, the column that says for how
    many rows with the same scores it stands, of which it is the first.
    """
    many = many or {}
    near = scored.where(F.col(score) >= least - max(margin, 0) - 1e-6)

    def best(side: str, other: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(side).orderBy(F.desc(score), other))
        of = F.col(many[other]) if other in many else F.lit(1)
        two = near.select(side, other, score, of.alias("__of")).withColumn("__r", place).where("__r <= 2")
        at = lambda k, c: F.max(F.when(F.col("__r") == k, F.col(c)))
        top = two.groupBy(side).agg(at(1, other).alias(other), at(1, score).alias(score), F.when(at(1, "__of") > 1, at(1, score)).otherwise(at(2, score)).alias("__next"))
        return top.where((F.col(score) >= least) & (F.col("__next").isNull() | (F.col(score) - F.col("__next") >= margin))).drop("__next")

    return best(left, right).join(best(right, left).select(left, right), [left, right]).select(left, right, score)


def mutual_best_alike(a: DataFrame, b: DataFrame, by: list[str], left: str, x: str, right: str, y: str, score: Column, least: float, margin: float) -> DataFrame:
    """``left, right, score`` as ``mutual_best`` finds them, where ``score`` is told by ``x`` and ``y`` of rows that share ``by``; keys are unique.

    Rows of a group that share ``x`` (or ``y``) are scored once.  All of them have the same best, and only the first of them can be
    the best of another, so it stands for all; where there are more, they are each other's runners-up.
    """
    kinds = lambda df, key, text, n: df.groupBy(*by, text).agg(F.min(key).alias(key), F.count("*").alias(n))
    scored = kinds(a, left, x, "__nl").join(kinds(b, right, y, "__nr"), by).select(left, right, "__nl", "__nr", score.alias("score"))
    return mutual_best(scored, left, right, "score", least, margin, {left: "__nl", right: "__nr"})


def greedy_match(scored: DataFrame, left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one pairs taken best first, ties by left and then right.

    A pair that is the best left for both its sides is what best-first order would take, so rounds of such pairs give the same
    result without one task that sees a whole block.
    """
    rest = durable(scored.where(F.col(score) >= least).select(left, right, score))
    found = None
    while not rest.isEmpty():
        rank = F.struct(F.col(score), -F.col(left), -F.col(right))
        best_l = rest.groupBy(left).agg(F.max_by(right, rank).alias("__r"))
        best_r = rest.groupBy(right).agg(F.max_by(left, rank).alias("__l"))
        taken = durable(rest.join(best_l, left).where(F.col(right) == F.col("__r")).join(best_r, right).where(F.col(left) == F.col("__l")).select(left, right, score))
        found = taken if found is None else found.unionByName(taken)
        rest = durable(rest.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti"))
    return rest if found is None else found


def greedy_match_alike(a: DataFrame, b: DataFrame, by: list[str], left: str, x: str, right: str, y: str, score: Column, least: float) -> DataFrame:
    """``left, right, score`` as ``greedy_match`` takes them, where ``score`` is told by ``x`` and ``y`` of rows that share ``by``; keys are unique.

    Rows of a group that share ``x`` (or ``y``) are one class and are scored once.  Where the best of some classes of both sides are
    all of each other and nothing else, best-first order takes the n-th of their left rows with the n-th of their right rows, so a
    round settles all of these; of other classes it takes single rows, each the first of what is best for the other.
    """

    def side(df: DataFrame, key: str, text: str, name: str) -> tuple[DataFrame, DataFrame]:
        kinds = durable(df.groupBy(*by, text).agg(F.min(key).alias(name)))
        return kinds, durable(df.join(kinds, [*by, text]).select(key, name))

    (kinds_a, mine), (kinds_b, theirs) = side(a, left, x, "__lc"), side(b, right, y, "__rc")
    rest = kinds_a.join(kinds_b, by).select("__lc", "__rc", score.alias("__s")).where(F.col("__s") >= least)
    found = None
    while True:
        first = lambda df, c, key, name: df.groupBy(c).agg(F.min(key).alias(name))
        rest = durable(rest.select("__lc", "__rc", "__s").join(first(mine, "__lc", left, "__l"), "__lc").join(first(theirs, "__rc", right, "__r"), "__rc"))
        if rest.isEmpty():
            break
        best = lambda c, name: rest.groupBy(c).agg(F.max("__s").alias(name))
        top = durable(rest.join(best("__lc", "__sl"), "__lc").join(best("__rc", "__sr"), "__rc").where("__s = __sl or __s = __sr"))
        of_l = top.where("__s = __sl").groupBy("__lc").agg(F.count("*").alias("__nl"), F.min("__r").alias("__fr"), F.min(F.expr("if(__s = __sr, __r, null)")).alias("__kr"))
        of_r = top.where("__s = __sr").groupBy("__rc").agg(F.count("*").alias("__nr"), F.min("__l").alias("__fl"), F.min(F.expr("if(__s = __sl, __l, null)")).alias("__kl"))
        edges = durable(top.where("__s = __sl and __s = __sr").join(of_l, "__lc").join(of_r, "__rc"))
        # all of one set with all of another: as many edges as the product of what each has on the other side, and none elsewhere
        whole = edges.groupBy("__kl", "__kr").agg(F.count("*").alias("n"), F.min("__nl").alias("p"), F.max("__nl").alias("p2"), F.min("__nr").alias("q"), F.max("__nr").alias("q2"), F.bool_or(F.expr("__l = __kl and __r = __kr")).alias("home"))
        whole = durable(whole.where("home and p = p2 and q = q2 and n = p * q").select("__kl", "__kr"))
        sets = edges.join(whole, ["__kl", "__kr"])
        lefts = mine.join(sets.select("__lc", "__kl", "__kr", "__s").distinct(), "__lc")
        rights = theirs.join(sets.select("__rc", "__kl", "__kr").distinct(), "__rc")
        many = ordinal_join(lefts, rights, ["__kl", "__kr"], [left], [right]).select(left, right, "__s")
        one = edges.where("__l = __fl and __r = __fr").join(whole, ["__kl", "__kr"], "left_anti").select(F.col("__l").alias(left), F.col("__r").alias(right), "__s")
        taken = durable(many.unionByName(one))
        found = taken if found is None else found.unionByName(taken)
        mine, theirs = durable(mine.join(taken.select(left), left, "left_anti")), durable(theirs.join(taken.select(right), right, "left_anti"))
    if found is None:
        found = rest.select(F.col("__l").alias(left), F.col("__r").alias(right), "__s")
    return found.withColumnRenamed("__s", "score")


def interval_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, by: list[str], bucket: float) -> DataFrame:
    """Points with the ranges [low, high) of the same key that hold them, by equal buckets of the axis."""
    axis = lambda c: F.floor(c / bucket)
    p = points.withColumn("__bucket", axis(F.col(point)))
    r = ranges.withColumn("__bucket", F.explode(F.sequence(axis(F.col(low)), axis(F.col(high)))))
    return p.join(r, [*by, "__bucket"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bucket")


def near_pairs(df: DataFrame, key: str, by: list[str], gap: float, cell: float) -> DataFrame:
    """Pairs (a < b) of rectangles x0, y0, x1, y1 of one group at most ``gap`` apart on both axes, by cells of a grid.

    Each pair is made in one cell only, the one that holds the lower corner of what the two share, so nothing is made twice.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    g = df.select(*by, F.col(key).alias("k"), "x0", "y0", "x1", "y1").withColumn("X0", F.col("x0") - gap / 2).withColumn("X1", F.col("x1") + gap / 2).withColumn("Y0", F.col("y0") - gap / 2).withColumn("Y1", F.col("y1") + gap / 2)
    g = g.select(*by, "k", *(F.col(c).alias(f"_{c}") for c in ("X0", "X1", "Y0", "Y1"))).withColumn("cx", span(F.col("_X0"), F.col("_X1"))).withColumn("cy", span(F.col("_Y0"), F.col("_Y1")))
    a = g.select(*by, "cx", "cy", F.col("k").alias("a"), *(F.col(f"_{c}").alias(f"a{c}") for c in ("X0", "X1", "Y0", "Y1")))
    b = g.select(*by, "cx", "cy", F.col("k").alias("b"), *(F.col(f"_{c}").alias(f"b{c}") for c in ("X0", "X1", "Y0", "Y1")))
    met = a.join(b, [*by, "cx", "cy"]).where("a < b and aX0 <= bX1 and bX0 <= aX1 and aY0 <= bY1 and bY0 <= aY1")
    home = (F.floor(F.greatest("aX0", "bX0") / cell) == F.col("cx")) & (F.floor(F.greatest("aY0", "bY0") / cell) == F.col("cy"))
    return met.where(home).select(*by, "a", "b")


def band_cells(items: DataFrame, bands: DataFrame, by: list[str], slack: float) -> DataFrame:
    """Items placed in all columns they overlap by more than ``slack``; a group in which two items claim a cell is refused whole."""
    met = items.join(bands, by).where((F.least("x1", "right") - F.greatest("x0", "left")) > slack)
    claims = met.groupBy(*by, "row", "col").agg(F.count("*").alias("claims"))
    refused = claims.groupBy(*by).agg((F.max("claims") > 1).alias("refused"))
    return met.join(refused, by)


def place_after_predecessor(base: DataFrame, extra: DataFrame, key: str, order: str, after: str) -> DataFrame:
    """Rows of ``extra`` go right behind the ``base`` row named in ``after`` (to the front if that is null or gone), in their own order.

    ``place_after_nearest`` looks further back where the direct predecessor is gone.
    """
    here = base.select(F.col(key), F.col(order).cast("double").alias("major"), F.lit(0).alias("minor"))
    at = base.select(F.col(key).alias(after), F.col(order).cast("double").alias("__at"))
    there = extra.join(at, after, "left").withColumn("minor", F.row_number().over(Window.partitionBy(after).orderBy(order))).select(F.col(key), F.coalesce("__at", F.lit(-1.0)).alias("major"), "minor")
    return here.unionByName(there)


def place_after_nearest(base: DataFrame, own: DataFrame, by: list[str], key: str, order: str, extra: str) -> DataFrame:
    """Rows of ``own`` marked ``extra`` go right behind their nearest predecessor in ``own`` that is in ``base`` (to the front without one).

    ``own`` is the list that they come from in its order, with rows that are gone as well: ``by, key, order, extra``.  Those behind
    the same row keep their own order.  Returns ``by, key, major, minor``; extra rows must not be in ``base``.
    """
    here = base.select(*by, key, F.col(order).cast("double").alias("major"), F.lit(0).alias("minor"))
    listed = own.select(*by, key, F.col(order).alias("__own"), F.col(extra).alias("__extra")).join(base.select(*by, key, F.col(order).cast("double").alias("__at")), [*by, key], "left")
    before = Window.partitionBy(*by).orderBy("__own", key).rowsBetween(Window.unboundedPreceding, -1)
    there = listed.withColumn("major", F.coalesce(F.last("__at", ignorenulls=True).over(before), F.lit(-1.0))).where("__extra")
    return here.unionByName(there.withColumn("minor", F.row_number().over(Window.partitionBy(*by, "major").orderBy("__own", key))).select(*by, key, "major", "minor"))


def align_groups(a: DataFrame, b: DataFrame, by: str, order: str, text: str, threshold: float = 0.5, fill: bool = False) -> DataFrame:
    """Order-keeping alignment of two versions of each group by word ratio: ``by, a_pos, b_pos, similarity``; an unpaired row has one null place.

    With ``fill``, rows left between two sure pairs are paired by place, however little their texts share.
    """

    def run(left, right):
        # an absent side comes without columns
        left, right = (d.sort_values("__pos") if len(d) else pd.DataFrame({"__by": [], "__pos": [], "__text": []}) for d in (left, right))
        x = [(t or "").lower().split() for t in left["__text"]]
        y = [(t or "").lower().split() for t in right["__text"]]
        known: dict[tuple[int, int], float] = {}

        def similar(i, j):
            if (i, j) not in known:
                known[i, j] = sequences.ratio(x[i], y[j])
            return known[i, j]

        key = (left if len(left) else right)["__by"].iloc[0]
        pairs = sequences.align(len(x), len(y), similar, threshold)
        rows = [(key, None if i is None else int(left["__pos"].iloc[i]), None if j is None else int(right["__pos"].iloc[j]), None if i is None or j is None else similar(i, j)) for i, j in (sequences.fill_by_place(pairs) if fill else pairs)]
        out = pd.DataFrame(rows, columns=[by, "a_pos", "b_pos", "similarity"])
        return out.astype({"a_pos": "Int64", "b_pos": "Int64", "similarity": "float64"})

    kind = dict(a.dtypes)[by]
    side = lambda df: df.select(F.col(by).alias("__by"), F.col(order).alias("__pos"), F.col(text).alias("__text")).groupBy("__by")
    return side(a).cogroup(side(b)).applyInPandas(run, f"{by} {kind}, a_pos long, b_pos long, similarity double")


def kept_order(df: DataFrame, by: str, was: str, now: str) -> DataFrame:
    """Marks rows of each group that kept their order (a longest increasing run of old places in the new order); the others moved."""

    def run(pdf):
        pdf = pdf.sort_values(now)
        keep = set(sequences.longest_increasing(pdf[was].tolist()))
        pdf["kept_order"] = [i in keep for i in range(len(pdf))]
        return pdf

    kinds = dict(df.dtypes)
    return df.select(by, was, now).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {was} {kinds[was]}, {now} {kinds[now]}, kept_order boolean")


def word_similarity(a: Column, b: Column) -> Column:
    """Word ratio of two texts, in Arrow batches; equal texts' is known without splitting them."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if i == j else sequences.word_ratio(i, j) for i, j in zip(x, y, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def points_in_rectangles(points: DataFrame, key: str, rectangles: DataFrame, panel: str, by: list[str], cell: float) -> DataFrame:
    """Each point (x, y) with the first rectangle, by ``panel``, that holds it; by cells of a grid."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    p = points.withColumn("__cx", F.floor(F.col("x") / cell)).withColumn("__cy", F.floor(F.col("y") / cell))
    r = rectangles.withColumn("__cx", span(F.col("x0"), F.col("x1"))).withColumn("__cy", span(F.col("y0"), F.col("y1")))
    met = p.join(r, [*by, "__cx", "__cy"]).where("x >= x0 and x <= x1 and y >= y0 and y <= y1")
    return met.groupBy(*by, key).agg(F.min(panel).alias(panel))


def crossings(pairs: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """``by, left, right, crossings`` of pairs that cross others of their group, with how many.

    A pair crosses those further on at the left whose place at the right isn't, and those before it at the left that are further on
    at the right; so of two that share a place at the right the first one counts, and those that share one at the left don't cross.
    Pairs with a null cross nothing.  A group's ranks are one array, so no pair of pairs is made.
    """

    def run(arrays: pa.Array) -> pa.Array:
        out = []
        for pairs in arrays.to_pylist():
            every = sorted(p["r"] for p in pairs)
            seen: list = []  # what the right has up to here
            told: list[int] = []
            for _, rows in itertools.groupby(pairs, key=lambda p: p["l"]):
                here = [p["r"] for p in rows]
                above = [len(seen) - bisect.bisect_right(seen, r) for r in here]
                for r in here:
                    bisect.insort(seen, r)
                told += [n + bisect.bisect_right(every, r) - bisect.bisect_right(seen, r) for n, r in zip(above, here, strict=True)]
            out.append(told)
        return pa.array(out, pa.list_(pa.int64()))

    known = pairs.dropna(subset=[*by, left, right])
    rows = known.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(left).alias("l"), F.col(right).alias("r")))).alias("rows"))
    told = rows.withColumn("n", F.arrow_udf(run, "array<long>")("rows"))
    return told.select(*by, F.explode(F.arrays_zip("rows", "n")).alias("p")).where("p.n > 0").select(*by, F.col("p.rows.l").alias(left), F.col("p.rows.r").alias(right), F.col("p.n").alias("crossings"))


def crossed_twins(pairs: DataFrame, scored: DataFrame, by: list[str], left: str, right: str, score: str, loss: float = 0.02) -> DataFrame:
    """Pairs of pairs that cross and whose partners could be swapped without loss: ``by, left_1, right_1, left_2, right_2`` (left_1 < left_2, right_1 > right_2).

    ``scored`` has the scores of the pairs and of what else could be paired; a swap loses nothing if each left row's score with the
    other's partner is at most ``loss`` below its own (a swap without both scores is none).  Found by joins along the score
    table: no more rows are made than it has.
    """
    scores = lambda a, b, s: scored.select(*by, F.col(left).alias(a), F.col(right).alias(b), F.col(score).alias(s))
    own = lambda n: pairs.select(*by, F.col(left).alias(f"left_{n}"), F.col(right).alias(f"right_{n}")).join(scores(f"left_{n}", f"right_{n}", f"own_{n}"), [*by, f"left_{n}", f"right_{n}"])
    first = own(1).join(scores("left_1", "right_2", "other_1"), [*by, "left_1"]).where((F.col("right_2") < F.col("right_1")) & (F.col("other_1") >= F.col("own_1") - loss))
    met = first.join(own(2), [*by, "right_2"]).where("left_1 < left_2")
    return met.join(scores("left_2", "right_1", "other_2"), [*by, "left_2", "right_1"]).where(F.col("other_2") >= F.col("own_2") - loss).select(*by, "left_1", "right_1", "left_2", "right_2")


def rivals(scored: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Each pair with the best score that another pair sharing either side has (null where there is none)."""
    best = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.desc(score), left, right))

    def two(df: DataFrame, side: str, name: str) -> DataFrame:
        top = df.withColumn("__r", best(side)).where("__r <= 2").groupBy(side).agg(F.max(F.when(F.col("__r") == 1, F.col(score))).alias("__1"), F.max(F.when(F.col("__r") == 2, F.col(score))).alias("__2"), F.max(F.when(F.col("__r") == 1, F.struct(left, right))).alias("__top"))
        mine = F.struct(F.col(left), F.col(right))
        return df.join(top, side).withColumn(name, F.when(mine == F.col("__top"), F.col("__2")).otherwise(F.col("__1"))).drop("__1", "__2", "__top")

    out = two(two(scored, left, "__l"), right, "__r2")
    return out.withColumn("rival", F.greatest("__l", "__r2")).drop("__l", "__r2")


def flatten_groups(nodes: DataFrame, key: str, parent: str, x: str) -> DataFrame:
    """Places of a forest's nodes added up along their parents: ``key, root, depth, x`` (a node whose parents form a ring is left out).  Any depth; keys are unique."""
    tree = nodes.select(F.col(key).alias("__k"), F.col(parent).alias("__p"), F.col(x).cast("double").alias("__x"))
    level = durable(tree.where("__p is null").select("__k", F.col("__k").alias("root"), F.lit(0).cast("long").alias("depth"), F.col("__x").alias("total")))
    found = level
    for depth in itertools.count(1):
        up = level.select(F.col("__k").alias("__p"), "root", "depth", "total")
        level = durable(tree.join(up, "__p").select("__k", "root", (F.col("depth") + 1).alias("depth"), (F.col("total") + F.col("__x")).alias("total")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
        if depth % 32 == 0:
            found = durable(found)  # keeps the plan short
    return found.select(F.col("__k").alias(key), "root", "depth", F.col("total").alias(x))


def label_moves(scored: DataFrame, label: str, slide: str, own: Column, score: str, bar: float, margin: float) -> DataFrame:
    """Whether a label's content says it moved: another slide is good enough and clear of its own (``moved``), good enough but not clear (``unsure``), or neither (``stays``)."""
    best = scored.groupBy(label).agg(F.max(F.when(own, F.col(score))).alias("own"), F.max(F.when(~own, F.col(score))).alias("best"), F.max_by(F.when(~own, F.col(slide)), F.when(~own, F.struct(F.col(score), -F.col(slide)))).alias("to"))
    good = F.coalesce(F.col("best") >= bar, F.lit(False))
    clear = F.col("best") - F.coalesce("own", F.lit(0.0)) >= margin
    return best.withColumn("verdict", F.when(good & clear, "moved").when(good & (F.col("best") > F.coalesce("own", F.lit(0.0))), "unsure").otherwise("stays"))


def units(elements: DataFrame, key: str, anchor: str) -> DataFrame:
    """Elements with those anchored to them (an anchor that is gone counts as none): ``unit, members, n``."""
    known = elements.select(F.col(key).alias("__anchor"))
    j = elements.join(known, elements[anchor] == known["__anchor"], "left").withColumn("unit", F.coalesce("__anchor", key))
    return j.groupBy("unit").agg(F.count("*").alias("n"), F.min(key).alias("first_member"), F.max(key).alias("last_member"))


def hidden_shares(pairs: DataFrame, boxes: DataFrame, key: str, least: float) -> DataFrame:
    """Of pairs (a below b in key order), those in which b would cover more than ``least`` of a."""
    side = lambda p: boxes.select(F.col(key).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    w = F.greatest(F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.lit(0.0))
    h = F.greatest(F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"), F.lit(0.0))
    return j.withColumn("share", w * h / ((F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0")))).where(F.col("share") > least).select("a", "b", "share")


def drawn_order(nodes: DataFrame, key: str, parent: str, z: str) -> DataFrame:
    """Ranks of a forest's objects from bottom to top within each root, a group before what it holds, siblings by ``z`` and then key.  Any depth; keys are unique."""
    step = F.struct(F.col(z).cast("long").alias("z"), F.col(key).cast("long").alias("k"))
    tree = nodes.select(F.col(key).alias("__k"), F.col(parent).alias("__p"), step.alias("__s"))
    level = durable(tree.where("__p is null").select("__k", F.col("__k").alias("root"), F.array("__s").alias("path")))
    found = level
    for depth in itertools.count(1):
        level = durable(tree.join(level.select(F.col("__k").alias("__p"), "root", "path"), "__p").select("__k", "root", F.concat("path", F.array("__s")).alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
        if depth % 32 == 0:
            found = durable(found)  # keeps the plan short
    return found.select(F.col("__k").alias(key), "root", F.row_number().over(Window.partitionBy("root").orderBy("path")).cast("long").alias("rank"))
