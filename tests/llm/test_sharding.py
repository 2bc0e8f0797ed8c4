from __future__ import annotations

import random
from collections import Counter

from loomery.llm.sharding import communication_matrix, hypergeometric, shard_rows
from tests.llm.conftest import TEXTS


def test_margins():
    parts, shards = [0, 7, 31, 100, 12], [50, 50, 50]
    matrix = communication_matrix(parts, shards, 3)
    assert [sum(r) for r in matrix] == parts and [sum(c) for c in zip(*matrix, strict=True)] == shards


def test_draws_follow_the_law():
    rng = random.Random(1)
    got = Counter(hypergeometric(rng, 6, 9, 5) for _ in range(40_000))
    from math import comb

    for k in range(6):
        want = comb(6, k) * comb(9, 5 - k) / comb(15, 5)
        assert abs(got[k] / 40_000 - want) < 0.01
    large = [hypergeometric(rng, 10**9, 3 * 10**9, 10**6) for _ in range(60)]
    assert abs(sum(large) / 60 - 250_000) < 400 and len(set(large)) > 50


def check(df, got, shards):
    got = got.collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(shards)) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    return got


def test_even_gapless_and_repeatable(spark):
    df = spark.range(5003).selectExpr("id AS doc_id", "id % 10 AS size")
    got = check(df, shard_rows(df, 16, range_rows=40), 16)
    assert sorted(r.doc_id for r in got) == list(range(5003))
    again = shard_rows(df.repartition(7), 16, range_rows=40).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = shard_rows(df, 16, seed=18).collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))
    rank = {r.doc_id: (r.shard, r.slot) for r in got}
    assert sum(rank[k][0] == rank[k + 1][0] for k in range(5002)) < 450  # 313 are expected


def test_equal_rows_are_dealt_out(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "7 AS size")
    check(df, shard_rows(df, 16), 16)


def test_odd_rows(spark, odd, none):
    got = check(odd, shard_rows(odd, 4), 4)
    assert len(got) == len(TEXTS) and shard_rows(odd, 4).columns == [*odd.columns, "shard", "slot"]
    assert shard_rows(none, 16).collect() == []
