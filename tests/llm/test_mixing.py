from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from loomery.llm.mixing import mix_sources, word_count
from loomery.llm.registry import document_key
from tests.llm.conftest import SCHEMA, TEXTS


def filled(sizes, weights, volume, most):
    """Water filling by repeated resharing."""
    target, full = {}, set()
    while True:
        left = volume * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weights[s] / weight for s in sizes}
        above = {s for s in sizes if target[s] > most * sizes[s] or s not in full and sizes[s] == 0}
        if not above:
            return target
        full |= above


def mix(df):
    return mix_sources(df, (5, 2, 1), (3, 2), 2, "source", word_count("text"), document_key(), ["doc_id", "source"])


def brute(rows):
    rows = [(i, t, s, len((t or "").encode().split())) for i, t, s in rows]
    sources = sorted({s for *_, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for *_, x, n in rows if x == s) for s in sources}
    target = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, 1.5, 2)
    out = []
    for s in sources:
        own = [(int(hashlib.md5((str(i) if i is not None else "?" + (t or "")).encode()).hexdigest()[:15], 16), i, n) for i, t, x, n in rows if x == s]
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        below = whole * sizes[s]
        for place in sorted({p for p, *_ in own}):
            group = [(i, n) for p, i, n in own if p == place]
            total = sum(n for _, n in group)
            taken = 2 * below + total <= 2 * target[s]
            out += [(i, n, sizes[s], n * (whole + taken)) for i, n in group]
            below += total
    return sorted(out, key=str), target


@pytest.mark.parametrize("seed", range(3))
def test_equals_sorting(spark, seed):
    rows = [(k, "w " * ((k * 7919 + seed) % 91), f"s{(k * k + seed) % 7}" if k % 11 else None) for k in range(700)]
    rows += [(9000, "w " * 9000, "one"), (9001, None, "empty"), (9002, "a b", "É"), (9003, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    want, target = brute(rows)
    assert sorted(((r.doc_id, r["__size"], r["__source_size"], r["__taken"]) for r in got), key=str) == want
    for r in got:
        assert r["__target"] == pytest.approx(target[r.source]) and r["__taken"] <= 2 * r["__size"]
    taken = {s: sum(r["__taken"] for r in got if r.source == s) for s in target}
    for s in target:
        largest = max((r["__size"] for r in got if r.source == s), default=0)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1e-6


def test_boundary_buckets_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr("loomery.llm.mixing.STEP", 2)
    rows = [(k, "w " * (k % 9), f"s{k % 3}") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r["__size"], r["__source_size"], r["__taken"]) for r in mix(df).collect()), key=str)
    assert got == brute(rows)[0]


def test_odd_rows(spark, odd, none):
    assert mix(none).collect() == []
    assert mix(odd).count() == len(TEXTS)
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], SCHEMA)
    assert {(r["__target"], r["__taken"]) for r in mix(blank).collect()} == {(0.0, 0)}
    assert sorted(map(str, mix(odd).collect())) == sorted(map(str, mix(odd.repartition(5)).collect()))
    assert mix(odd.withColumn("__x", F.lit(1)).drop("__x")).columns[:2] == ["doc_id", "source"]
