"""Mixing sources to target weights by capped water-filling and seeded repetitions.

``targets`` splits a budget of words between sources in proportion to their weights. A source never
gets more than ``max_epochs`` times what it has; what is cut off goes to the others by weight until
nobody is above the cap. With the sources in the order of cap per unit of weight, the capped ones
are a prefix, so one running sum finds the water level instead of a loop.

``mix`` repeats documents: the whole part of a source's rate for every document, and once more for
documents in seeded order until the target is met. The order is the MD5 of seed and id. The cut
point is found from sums per (source, first hex digits of the hash) and then inside one such bin,
so no task ever holds a source, and a source with a third of all rows is spread over all its bins.

Defined cases: a null text has no words; a null source is a source of its own, last in order; null
ids share one hash, and rows with one id share their fate; an empty table gives an empty result; sources without words have target 0. Column names of the input are kept; the
operator's own columns are ``size``, ``source_size``, ``target``, ``copies`` and ``taken``, and an
input column of such a name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import free_name
from palisade.session import stored

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that name a bin within a source: 65,536 bins.
BIN_DIGITS = 4
#: The plan (one row per source) is broadcast up to so many sources.
BROADCAST_SOURCES = 20_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """``source``, ``source_size``, ``weight`` -> the same with ``target`` (double).

    The table has one row per source; it is ordered in one task, as sources are few next to rows.
    """
    everything = Window.partitionBy(F.lit(0))
    by_cap = everything.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * float(max_epochs)
    used = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(max_epochs)
    leveled = (
        sizes.withColumn("_budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("_level", (F.col("_budget") - used) / F.sum("weight").over(onward))
        .withColumn("_place", F.row_number().over(by_cap))
    )
    # The level of the first source that stays below its cap holds for all after it.
    free = F.when(F.col("_level") * F.col("weight") <= cap, F.struct("_place", "_level"))
    water = F.min(free).over(everything)["_level"]
    return leveled.withColumn(
        "target", F.coalesce(F.least(cap, water * F.col("weight")), cap)
    ).drop("_budget", "_level", "_place")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ..., cycle, 1, ... for sources in code-point order, null last."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", (place - 1) % cycle + 1)


def _plan(sized: DataFrame, max_epochs: float, share: float, cycle: int) -> DataFrame:
    """Per source: size, target, whole repetitions, and the last hash that gets one more."""
    bins = sized.groupBy("source", F.substring("key", 1, BIN_DIGITS).alias("bin")).agg(
        F.sum("size").alias("bin_size")
    )
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    plan = (
        targets(cyclic_weights(sources, cycle), max_epochs, share)
        .withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of")
    )
    same = F.col("source").eqNullSafe(F.col("of"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        bins.withColumn("before", F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
        .join(plan, same)
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest")))
        .select("of", "bin", "before", "rest")
    )
    in_bin = Window.partitionBy("of").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("before") + F.sum("size").over(in_bin) - F.col("size") / 2 <= F.col("rest")
    last = (
        sized.join(
            crossing, same & (F.substring("key", 1, BIN_DIGITS) == F.col("bin"))
        )
        .groupBy("of", "bin", "before", "rest", "key").agg(F.sum("size").alias("size"))
        .withColumn("fits", fits)
        .groupBy("of", "bin").agg(F.max(F.when(F.col("fits"), F.col("key"))).alias("key"))
        # A bin's own digits sort before all hashes in it and after all before it.
        .select(F.col("of").alias("of2"), F.coalesce("key", "bin").alias("last"))
    )
    return plan.join(last, F.col("of").eqNullSafe(F.col("of2")), "left").select(
        "of", "source_size", "target", "whole", "last"
    )


def mix(
    docs: DataFrame, max_epochs: float = 3.0, share: float = 1.0, seed: str = "mix", cycle: int = 3
) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    made = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    size = words_in(F.col("text"))
    sized = stored(docs.select("source", key.alias("key"), size.alias("size")), "mix-sizes")
    plan = stored(_plan(sized, max_epochs, share, cycle), "mix-plan")
    names = [free_name(docs.columns, c) for c in ("of", "whole", "last", "key")]
    of, whole, last, own_key = names
    plan = plan.select(
        F.col("of").alias(of), "source_size", "target", F.col("whole").alias(whole), F.col("last").alias(last)
    )
    if plan.count() <= BROADCAST_SOURCES:  # beyond, the texts go through a join by source
        plan = F.broadcast(plan)
    extra = F.coalesce(F.col(own_key) <= F.col(last), F.lit(False)).cast("long")
    return (
        docs.withColumn("size", size)
        .withColumn(own_key, key)
        .join(plan, F.col("source").eqNullSafe(F.col(of)), "left")
        .withColumn("copies", F.least(F.col(whole) + extra, F.lit(int(max_epochs))).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*names)
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    n = free_name(mixed.columns, "n")
    times = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    return mixed.withColumn(n, F.explode(times)).drop(n)
