"""Sharding by a hypergeometric communication matrix.

A uniform permutation of all rows sends a random number of each partition's rows
to each shard; these numbers follow the multivariate hypergeometric law with the
partitions' and the shards' sizes as margins. So the matrix of numbers is drawn
first, then each partition permutes its rows and deals them out by its line of the
matrix, and each shard permutes what it gets: a uniform shuffle with exact sizes.

Partitions are ranges of a row hash, not Spark's partitions, so a lost executor or
another cluster changes nothing. Partitions and shards are cut into ranges of
their permutation's hash that hold about ``range_rows`` rows each; a range is
ordered by one task, and its offset is the count of the ranges before it.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.names import named, numbered
from loomery.sources.scratch import save

PARTITIONS, HASH_BITS = 256, 32


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good: inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while left > 0 and (down > low or up < high):
        before = left
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if left == before:  # what is left is rounding
            break
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row i: how many rows of partition i go to each shard."""
    rng, left, out = random.Random(seed), list(shards), []
    for size in parts:
        row, open_, total = [], size, sum(left)
        for k, room in enumerate(left):
            total -= room
            n = hypergeometric(rng, room, total, open_)
            row.append(n)
            left[k] -= n
            open_ -= n
        out.append(row)
    return out


def _offsets(df: DataFrame, group: str, name: str) -> DataFrame:
    """``before``: how many rows of the group are in its lower ranges."""
    counts = df.groupBy(group, "__range").count()
    lower = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return save(counts.select(group, "__range", "count", F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("before")), name)


def shard_rows(df: DataFrame, shards: int, seed: int = 17, range_rows: int = 50_000) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, 0 on without gaps in each shard).

    Shards differ by at most one row. The same rows and seed give the same
    result on every run and cluster. Nulls are values like others and no column
    is taken for a key; fully equal rows are numbered, dealt out apart from one
    another and may trade places. An empty table gives none. A column of ``df``
    named ``shard`` or ``slot`` comes back with an underscore behind its name.

    Of the data only the ``PARTITIONS`` counts come to the driver. The rows
    move twice, to their partition and to their shard.
    """
    own = df.columns
    columns = [f"c{k}" for k in range(len(own))]
    keyed = df.select(*numbered(own)).withColumn("__h", F.xxhash64(F.lit(seed), *columns))
    part = F.shiftrightunsigned("__h", 56).cast("int")
    rest = F.shiftrightunsigned("__h", 24).bitwiseAND(F.lit((1 << HASH_BITS) - 1).cast("long"))
    counts = save(keyed.groupBy(part.alias("__part")).count(), "partition-counts")
    parts = [0] * PARTITIONS
    for p, n in counts.collect():
        parts[p] = n
    total = sum(parts)
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix(parts, sizes, seed)
    ends = [[sum(row[: k + 1]) for k in range(shards)] for row in matrix]

    ranges = lambda rows: max(1, -(-rows // range_rows))
    cut = lambda h, n: F.shiftright(h * n, HASH_BITS).cast("int")

    keyed = keyed.withColumn("__part", part).withColumn("__range", cut(rest, ranges(total // PARTITIONS)))
    here = Window.partitionBy("__part", "__range")
    placed = keyed.withColumn("__n", F.row_number().over(here.orderBy("__h")))  # tells equal rows apart
    placed = placed.withColumn("__r", F.row_number().over(here.orderBy(F.xxhash64("__h", "__n"), "__n")))
    placed = placed.join(_offsets(keyed.select("__part", "__range"), "__part", "partition-ranges"), ["__part", "__range"])
    rank = F.col("before") + F.col("__r") - 1
    line = F.element_at(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>"), F.col("__part") + 1)
    dealt = placed.withColumn("__rank", rank).withColumn("shard", F.size(F.filter(line, lambda end: end <= F.col("__rank"))))
    again = F.xxhash64(F.lit(seed + 1), "__h", "__n", "__part", "__rank")
    dealt = dealt.select(*columns, "shard", again.alias("__h"))
    rest = F.shiftrightunsigned("__h", 64 - HASH_BITS)
    dealt = save(dealt.withColumn("__range", cut(rest, ranges(total // shards))), "dealt")

    here = Window.partitionBy("shard", "__range").orderBy("__h", *columns)
    placed = dealt.withColumn("__r", F.row_number().over(here))
    placed = placed.join(_offsets(dealt, "shard", "shard-ranges"), ["shard", "__range"])
    return placed.select(*named(own, ("shard", "slot")), "shard", (F.col("before") + F.col("__r") - 1).cast("long").alias("slot"))

