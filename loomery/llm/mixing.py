"""Mixing sources to target weights by hash-threshold histograms.

A row's place is 60 bits of a hash of its key. Each source takes whole repeats of
itself and, for the rest of its budget, the rows below a threshold place. The
threshold comes from histograms: sizes are summed by source and the first 12 bits
of the place; only the bucket that the budget ends in is summed again by its next
12 bits; only what is left of that, some millionths of the source, is summed by
place. Larger budgets have higher thresholds, so mixes nest. Rows are filtered by
comparing places with thresholds and never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.sources.scratch import save

PLACE_BITS, STEP = 60, 12


def word_count(text: Column | str) -> Column:
    """Runs of characters other than 0x20 and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(key: Column) -> Column:
    """60 bits of the MD5 of ``key``, a string."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], volume: tuple[int, int], most: int) -> DataFrame:
    """``target`` for each row (source, source_size) of ``sizes``, one row a source.

    Sources ordered by code point, null last, have the weights in turn. They
    share ``volume`` (a fraction) of the total by weight, none above ``most``
    times its own size; what is above is shared again among the others. The
    sources that reach their limit are those of the least size for their
    weight, so one pass in that order finds them.
    """
    num, den = volume
    every = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long")
    s = sizes.select("source", "source_size", weight.alias("weight")).withColumn("full", F.col("source_size") * most)
    before = every.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    left = lambda full: num * F.col("all_size") - den * full
    s = s.withColumn("is_full", den * F.col("full") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * left(F.col("full_before")))
    full = F.coalesce(F.sum(F.when(F.col("is_full"), F.col("full"))).over(every), F.lit(0))
    open_weight = F.coalesce(F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(every), F.lit(0))
    shared = (F.col("weight") * left(full)).cast("double") / F.nullif(den * open_weight, F.lit(0)).cast("double")
    return s.select("source", "source_size", F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(shared).alias("target"))


def _below(sums: DataFrame, by: str) -> DataFrame:
    """``before``: the size of the source's rows in lower buckets, from ``base`` on."""
    lower = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(lower), F.lit(0)))


def mix_sources(
    df: DataFrame, weights: tuple[int, ...], volume: tuple[int, int], most: int, source_col: str, size: Column, key: Column, keep: list[str]
) -> DataFrame:
    """The columns ``keep``, ``__size``, ``__source_size``, ``__target``, ``__repeats``, ``__taken`` of every row.

    ``__repeats`` is how often the mix takes the row, at most ``most``;
    ``__taken`` is that times its size. The words a source takes are the nearest to its
    target that whole rows in order of their places can give, so they miss it by
    at most half a row's size. Rows of equal ``key`` in a source go together.
    The same rows give the same mix on every run.

    A null source is a source of its own; a null size counts as 0; a source
    without size has target 0. There is one row for each row of ``df``; an
    empty table gives none. No column of ``keep`` has a name with leading ``__``.

    Only a thin table of sources, sizes and places is written. The per-source
    table is broadcast only where its files are under Spark's broadcast
    threshold, and else joined by a shuffle that may split a large source.
    """
    size, place = F.coalesce(size, F.lit(0)).cast("long"), place_of(key)
    rows = save(df.select(F.col(source_col).alias("source"), size.alias("size"), place.alias("place")), "places")
    shift = PLACE_BITS - STEP
    sums = rows.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("size"))
    sums = save(sums, "histogram")
    sources = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, volume, most)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0)).cast("double")), F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("base", F.col("whole") * F.col("source_size"))
    sources = save(sources, "targets")

    # A group of rows with total s, before it b (whole repeats included), is taken if b + s / 2 <= target.
    twice, target = 2 * F.col("before"), 2 * F.col("target")
    inside = (twice + 2 * F.col("size")).cast("double") <= target
    ends_in = ~inside & (twice.cast("double") < target)
    budget = sources.select(F.col("source").alias("s"), "target", "base")
    limits = []
    found = _below(sums.join(budget, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "bucket")
    limits.append(found.where(inside).groupBy("source").agg(F.max((F.col("bucket") + 1) * (1 << shift) - 1).alias("limit")))
    edge = save(found.where(ends_in).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "target", F.col("before").alias("base")), "edge")

    second = shift - STEP
    inner = rows.withColumn("b", F.shiftright("place", shift))
    match = F.col("source").eqNullSafe(F.col("s")) & (inner["b"] == edge["b"])
    inner = inner.join(edge, match).select("source", F.shiftright("place", second).alias("bucket"), "size", "target", "base")
    inner = _below(inner.groupBy("source", "bucket", "target", "base").agg(F.sum("size").alias("size")), "bucket")
    inner = save(inner, "histogram-2")
    limits.append(inner.where(inside).groupBy("source").agg(F.max((F.col("bucket") + 1) * (1 << second) - 1).alias("limit")))
    edge = inner.where(ends_in).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "target", F.col("before").alias("base"))

    last = rows.withColumn("b", F.shiftright("place", second))
    last = last.join(edge, F.col("source").eqNullSafe(F.col("s")) & (last["b"] == edge["b"])).select("source", "place", "size", "target", "base")
    last = _below(last.groupBy("source", "place", "target", "base").agg(F.sum("size").alias("size")), "place")
    halfway = (twice + F.col("size")).cast("double") <= target
    limits.append(last.where(halfway).groupBy("source").agg(F.max("place").alias("limit")))

    limit = limits[0].unionByName(limits[1]).unionByName(limits[2]).groupBy("source").agg(F.max("limit").alias("limit"))
    limit = limit.select(F.col("source").alias("s"), "limit")
    plan = sources.join(limit, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "base")
    plan = save(plan.withColumn("limit", F.coalesce("limit", F.lit(-1).cast("long"))), "thresholds")
    plan = plan.toDF(*[f"__{c}" for c in plan.columns])
    marked = df.select(*keep, F.col(source_col).alias("__from"), size.alias("__size"), place.alias("__place"))
    mixed = marked.join(plan, F.col("__from").eqNullSafe(F.col("__source")))
    repeats = F.col("__whole") + (F.col("__place") <= F.col("__limit")).cast("long")
    mixed = mixed.select(*keep, "__size", "__source_size", "__target", repeats.alias("__repeats"))
    return mixed.withColumn("__taken", F.col("__size") * F.col("__repeats"))
