"""Joins that Spark has no operator for, and top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.sources.scratch import save


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` at or before it, by equal ``by``.

    Both sides are united and dealt into ranges of (``by``, time), each of which
    is scanned alone; what a range ends with is carried into those after it by a
    table of a row for each key and range. So a key of any size fills many
    tasks, and no pair of rows is formed. Rows of ``right`` at the same time
    must not differ in ``values``. Left rows without one, or without a time,
    have nulls; null keys equal each other.
    """
    carried = F.struct(*values)
    shape = F.struct(*left.columns)
    a = left.select(*by, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), shape.alias("__row"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("__v"))
    b = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(shape.alias("x")).schema["x"].dataType).alias("__row"), carried.alias("__v"))
    rows = a.unionByName(b).repartitionByRange(*by, "__at", "__side").withColumn("__range", F.spark_partition_id())
    rows = save(rows, "asof-ranges")
    last = rows.groupBy(*by, "__range").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__at"))).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__range").alias("__at_range"), F.last("__last", ignorenulls=True).over(before).alias("__before"))
    order = Window.partitionBy(*by, "__range").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    same = F.col("__range") == F.col("__at_range")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    value = F.when(F.col("__at").isNotNull(), F.coalesce("__v", "__before"))
    return found.join(last, same, "left").select("__row.*", *[value.getField(v).alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low`` <= ``at`` < ``high``.

    Both sides are cut into cells of ``width``: a point is in one, a range in
    all that it touches, so this is an equi-join with a filter. Take about the
    usual length of a range for ``width``.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    a = points.withColumn("__cell", cell(at))
    b = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return a.join(b, "__cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``place``; Spark limits groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def lateral_top(left: DataFrame, right: DataFrame, left_on: str, right_on: str, order: list[Column], k: int) -> DataFrame:
    """Each row of ``left`` with the first k rows of ``right`` of equal key, by a correlated lateral join.

    Rows without a match, and null keys, have none. Spark decorrelates it into a
    ranking within keys of ``right`` and an equi-join, and cuts groups before the
    shuffle. The two tables must not share names of columns.
    """
    own = right.where(F.col(right_on) == F.col(left_on).outer()).orderBy(*order).limit(k)
    return left.lateralJoin(own)


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by``, ``median``: the exact median of the values that aren't null, as ``percentile`` has it; null for none.

    Equal values are counted and dealt into ranges of (``by``, value). The
    ranges' sums tell which hold the middle of each group, and only these are
    counted through, so no task holds the values of a group.
    """
    counts = df.groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = save(counts.repartitionByRange("g", "v").withColumn("r", F.spark_partition_id()), "value-counts")
    there = counts.where("v IS NOT NULL")
    own = Window.partitionBy("g")
    sums = there.groupBy("g", "r").agg(F.sum("n").alias("n"))
    sums = sums.select("g", "r", F.sum("n").over(own).alias("total"), (F.sum("n").over(own.orderBy("r")) - F.col("n")).alias("before"), "n")
    sums = sums.withColumn("low", F.floor((F.col("total") - 1) / 2)).withColumn("high", F.ceil((F.col("total") - 1) / 2))
    middle = sums.where("before <= high AND before + n > low").select(F.col("g").alias("mg"), F.col("r").alias("mr"), "before", "low", "high")
    held = there.join(middle, F.col("g").eqNullSafe(F.col("mg")) & (F.col("r") == F.col("mr")))
    held = held.withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("g", "r").orderBy("v")))
    at = lambda place: F.max(F.when((F.col("end") - F.col("n") <= F.col(place)) & (F.col("end") > F.col(place)), F.col("v")))
    found = held.groupBy("g").agg(at("low").alias("a"), at("high").alias("b"))
    found = found.select(F.col("g").alias("fg"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * 0.5 + F.col("b") * 0.5).alias("median"))
    groups = counts.select("g").distinct()
    return groups.join(found, F.col("g").eqNullSafe(F.col("fg")), "left").select(F.col("g").alias(by), "median")
