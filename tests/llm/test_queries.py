"""The queries that have no SQL against brute force in Python, on the smallest tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from loomery.llm import registry

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_sharding(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in rows("documents")}
    got = registry.op4_sharding(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {i: (len(t) + 1, zlib.crc32(t), "rows", None) for i, t in docs.items()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_simhash(spark):
    want = {}
    for r in rows("documents"):
        words = (r["text"] or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in runs], np.uint64)
        bits = [2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h) for b in range(64)]
        want[r["doc_id"]] = sum(1 << b for b, on in enumerate(bits) if on)
    root = {i: i for i in want}
    for _ in range(8):
        for a in want:
            for b in want:
                if (want[a] ^ want[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op10_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", root[i]) for i, f in want.items()}


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_conversation_trie", "op13_secret_scan"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, SF).select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_restored_texts_are_the_texts(spark):
    got = {r.doc_id: r.restored_sha256 for r in registry.op11_fill_in_middle(spark, SF).collect()}
    assert got == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows("documents")}
