"""Robust group statistics: weighted modes, repeated furniture, common members, rank measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.plans.lineage import durable


def weighted_mode(df: DataFrame, by: list[str], value: Column, weight: Column) -> DataFrame:
    """The value of largest summed weight in each group; the smallest of those that tie."""
    sums = df.groupBy(*by, value.alias("mode")).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*by).agg(F.max_by("mode", F.struct("weight", -F.col("mode"))).alias("mode"), F.max("weight").alias("weight"))


def repeated_lines(df: DataFrame, by: str, member: str, text: str, share: float, least: int = 3) -> DataFrame:
    """Lines that at least ``least`` members of a group and ``share`` of them hold."""
    lines = df.select(by, member, F.explode(F.split(text, "\n")).alias("line")).select(by, member, F.trim("line").alias("line")).where("line <> ''").distinct()
    counts = lines.groupBy(by, "line").agg(F.count("*").alias("n_members"))
    sizes = df.groupBy(by).agg(F.countDistinct(member).alias("group_size"))
    return counts.join(sizes, by).where(F.col("n_members") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("group_size")))


def common_to_all(df: DataFrame, by: list[str], member: Column, group: Column) -> DataFrame:
    """Members that occur in every group of a partition."""
    pairs = df.select(*by, member.alias("member"), group.alias("grp")).distinct()
    total = pairs.groupBy(*by).agg(F.countDistinct("grp").alias("n_groups"))
    return pairs.groupBy(*by, "member").agg(F.count("*").alias("n_in")).join(total, by).where("n_in = n_groups")


def auc(df: DataFrame, by: list[str], positive: Column, score: Column) -> DataFrame:
    """Area under the ROC curve in each group, ties counting half; null where a class is missing.

    Ranks come from counts of each score, so that a group needs no ordering of its rows.
    """
    at = df.select(*by, score.alias("score"), positive.cast("long").alias("pos")).groupBy(*by, "score").agg(F.sum("pos").alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = at.withColumn("neg", F.col("n") - F.col("p")).withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    total = below.groupBy(*by).agg(F.sum(F.col("p") * (F.col("neg_below") + F.col("neg") / 2)).alias("wins"), F.sum("p").alias("positives"), F.sum("neg").alias("negatives"))
    return total.select(*by, "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("wins") / (F.col("positives") * F.col("negatives"))).alias("auc"))


def word_error(df_a: DataFrame, df_b: DataFrame, by: list[str], word: str) -> DataFrame:
    """Summed difference of two bags of words in each group."""
    a = df_a.groupBy(*by, word).agg(F.count("*").alias("a"))
    b = df_b.groupBy(*by, word).agg(F.count("*").alias("b"))
    both = a.join(b, [*by, word], "full_outer").na.fill(0, ["a", "b"])
    return both.groupBy(*by).agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("word_error"))


def uniform_change(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """The one value that all rows of a group were changed to, or null if there is none."""
    one = F.count_distinct(after) == 1
    return df.groupBy(*by).agg(F.when(one & (F.count(after) == F.count("*")) & F.bool_or(~F.col(before).eqNullSafe(F.col(after))), F.max(after)).alias("value"))


def census(df: DataFrame, by: list[str], value: str, item: str, examples: int = 3) -> DataFrame:
    """The most common value of a group (the smallest that tie) and its exceptions, with the first few of them."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value)))
    tops = ranked.where("__r = 1").select(*by, F.col(value).alias("usual"), F.col("n").alias("n_usual"))
    odd = df.join(tops, by).where(~F.col(value).eqNullSafe(F.col("usual")))
    w = Window.partitionBy(*by).orderBy(item)
    few = odd.withColumn("__r", F.row_number().over(w)).groupBy(*by).agg(F.count("*").alias("n_odd"), F.array_sort(F.collect_list(F.when(F.col("__r") <= examples, F.col(item)))).alias("examples"))
    return tops.join(few, by, "left").select(*by, "usual", "n_usual", F.coalesce("n_odd", F.lit(0)).alias("n_odd"), F.coalesce("examples", F.array().cast(few.schema["examples"].dataType)).alias("examples"))


def style_hash(df: DataFrame, by: list[str], *style: str) -> DataFrame:
    """An order-free hash of the distinct styles of a group."""
    one = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in style))
    return df.groupBy(*by).agg(F.sha1(F.array_join(F.array_sort(F.collect_set(one)), "\x1e")).alias("style_hash"))


def inherited_vote(df: DataFrame, by: list[str], vote: str) -> DataFrame:
    """Groups to drop: some member was looked for and absent (0), none was ever seen (1); null is no vote."""
    return df.groupBy(*by).agg(F.coalesce(F.max((F.col(vote) == 1).cast("int")), F.lit(0)).alias("seen"), F.coalesce(F.max((F.col(vote) == 0).cast("int")), F.lit(0)).alias("absent")).where("seen = 0 and absent > 0").select(*by)


def absorbed(dropped: DataFrame, gained: DataFrame, item: str, other: str, word: str, least_words: int = 6, share: float = 0.6, block: int = 16_384) -> DataFrame:
    """The other item that gained the largest share of a dropped one's distinct words of four letters or more, if that is enough.

    Nearly all items share some word with nearly all others, so no row is made for such a pair: both sides are dealt into blocks of
    about ``block``, and a task counts one block's words in another's and tells the best of each item.  Words are 64-bit hashes there.
    """

    def sets(df: DataFrame, key: str) -> DataFrame:
        return durable(df.where(F.length(word) >= 4).groupBy(F.col(key).alias("key")).agg(F.collect_set(F.xxhash64(word)).alias("words")))

    def best(mine, theirs):
        import numpy as np
        import pyarrow as pa

        keys, found, shares = [], [], []
        if mine.num_rows and theirs.num_rows:
            theirs = theirs.sort_by("key")  # nulls last
            names, lists = theirs.column("key").to_pylist(), theirs.column("words").combine_chunks()
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            order = np.argsort(flat, kind="stable")
            holders = np.repeat(np.arange(len(names)), sizes)[order]
            known, first = np.unique(flat[order], return_index=True)
            until = np.append(first[1:], len(flat))
            for key, words in zip(mine.column("key").to_pylist(), mine.column("words"), strict=True):
                words = words.values.to_numpy()
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                at = at[known[at] == words]
                if len(at):
                    times = np.bincount(np.concatenate([holders[first[k] : until[k]] for k in at]), minlength=len(names))
                    k = int(times.argmax())  # the first of those that tie
                    if times[k] / len(words) >= share:
                        keys.append(key), found.append(names[k]), shares.append(times[k] / len(words))
        return pa.table([pa.array(keys, pa.int64()), pa.array(found, pa.int64()), pa.array(shares, pa.float64())], names=["item", "other", "share"])

    mine, theirs = sets(dropped, item).where((F.size("words") >= least_words) & F.col("key").isNotNull()), sets(gained, other)
    n, m = mine.count(), theirs.count()
    rows, cols = max(-(-n // block), min(8, n // 1024), 1), max(-(-m // block), 1)
    dealt = lambda df, own, k, far, j: df.select(F.pmod(F.xxhash64("key"), F.lit(k)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(j - 1))).alias(far), F.col("key").cast("long").alias("key"), "words")
    pairs = dealt(mine, "a", rows, "b", cols).groupBy("a", "b").cogroup(dealt(theirs, "b", cols, "a", rows).groupBy("a", "b"))
    scored = pairs.applyInArrow(best, "item long, other long, share double")
    return scored.groupBy(F.col("item").alias(item)).agg(F.max_by("other", F.struct("share", -F.col("other"))).alias(other), F.max("share").alias("share"))


def big_headings(df: DataFrame, by: list[str], item: str, size: str, body: str, over_body: float = 1.3, over_next: float = 1.15) -> DataFrame:
    """A page's single largest text, if it is well above the body size and the runner-up."""
    w = Window.partitionBy(*by).orderBy(F.desc(size), item)
    ranked = df.withColumn("__r", F.row_number().over(w)).withColumn("__next", F.lead(size).over(w))
    return ranked.where((F.col("__r") == 1) & (F.col(size) >= over_body * F.col(body)) & (F.col("__next").isNull() | (F.col(size) >= over_next * F.col("__next")))).drop("__r", "__next")


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of a group and its count; of those that tie, the smallest."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).where("__r = 1").select(*by, value, "n")


def titles(df: DataFrame, by: list[str], order: str, size: str, text: str, near: float = 0.9) -> DataFrame:
    """A page's texts of nearly its largest size, joined in order."""
    top = df.groupBy(*by).agg(F.max(size).alias("__top"))
    large = df.join(top, by).where(F.col(size) >= near * F.col("__top"))
    return large.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("title"), F.max("__top").alias("size"))


def columns(df: DataFrame, by: list[str], left: str, right: str, slack: float = 0.5) -> DataFrame:
    """A column's extent and how its cells are aligned: by their left edges, right edges or centres, whichever agree."""
    middle = (F.col(left) + F.col(right)) / 2
    agree = lambda x: F.max(x) - F.min(x) <= 2 * slack
    out = df.groupBy(*by).agg(F.min(left).alias("x0"), F.max(right).alias("x1"), F.count("*").alias("n_cells"), agree(F.col(left)).alias("__l"), agree(F.col(right)).alias("__r"), agree(middle).alias("__c"))
    return out.withColumn("align", F.when(F.col("__l"), "left").when(F.col("__r"), "right").when(F.col("__c"), "center").otherwise("mixed")).drop("__l", "__r", "__c")


def median_pitch(df: DataFrame, by: list[str], place: str) -> DataFrame:
    """The middle distance between neighbours of a group, and how many there are."""
    w = Window.partitionBy(*by).orderBy(place)
    return df.withColumn("__d", F.col(place) - F.lag(place).over(w)).groupBy(*by).agg(F.median("__d").alias("pitch"), F.count("__d").alias("n_gaps"))


def shares(df: DataFrame, by: list[str], amount: Column, native: Column) -> DataFrame:
    """Total and native amounts, and the share to three places (0 where there is nothing)."""
    out = df.groupBy(*by).agg(F.sum(amount).alias("total"), F.coalesce(F.sum(F.when(native, amount)), F.lit(0)).alias("native"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("native") / F.col("total"), 3)).otherwise(0.0))
