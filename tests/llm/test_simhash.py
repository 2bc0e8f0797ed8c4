from __future__ import annotations

import random

import xxhash

from loomery.llm.simhash import fingerprint, hamming_edges, near_duplicates, one_of_each_group
from loomery.operators.components import connected_components
from tests.llm.conftest import TEXTS


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(values, budget):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= budget:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(monkeypatch):
    for _, text in TEXTS:
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)
    monkeypatch.setattr("loomery.llm.words.SLICE", 50)
    for _, text in TEXTS[:7]:
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)


def check_edges(spark, values, unit_rows):
    df = spark.createDataFrame([(signed(v),) for v in set(values)], "fp long")
    roots = connected_components(hamming_edges(df, 3, unit_rows))
    got = {r.node: r.root for r in roots.collect()}
    want = groups_of(set(values), 3)
    by_want, by_got = {}, {}
    for v in set(values):
        by_want.setdefault(want[v], set()).add(v)
        by_got.setdefault(got.get(signed(v), signed(v)), set()).add(v)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_trie_join_finds_every_link(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:60]:
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                v ^= 1 << b
            values.append(v)
    values += [0, 7, 1 << 63, (1 << 64) - 1, (1 << 64) - 8]
    check_edges(spark, values, 20_000)


def test_large_units_are_divided(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 300:  # all share their first block, many further ones
        v = base
        for b in rng.sample(range(40), rng.randrange(1, 9)):
            v ^= 1 << b
        values.add(v)
    check_edges(spark, values, 5)


def test_odd_rows_and_components(spark, odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == len(TEXTS)
    assert all(r.component_id == 1 for r in got if r.doc_id == 1)
    blank = {r.component_id for r in got if r.fp == 0}
    assert blank == {3}
    assert near_duplicates(none).collect() == []
    kept = one_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, -9), (False, 1), (False, 2), (False, 3), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert one_of_each_group(none).collect() == []


def test_equal_rows_leave_one(spark):
    df = spark.createDataFrame([(4, "a b c d e f")] * 9 + [(None, "q r s t")] * 5, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in one_of_each_group(df).collect()) == ["4", "None"]
