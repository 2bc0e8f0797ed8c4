"""The upsert table against a dictionary, batch by batch."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from loomery.sources.scratch import new_path
from loomery.streaming.upserts import BATCH, UpsertTable
from loomery.streaming.events import run_upsert

SCHEMA = "k string, v long, x string"


def rows_of(table):
    return {r.k: (r.v, r.x) for r in table.state().collect()}


def merged(state, rows):
    out = dict(state)
    for k, v, x in rows:
        if k not in out or (v is not None and (out[k][0] is None or v >= out[k][0])) or (v is None and out[k][0] is None):
            out[k] = (v, x)
    return out


def files(path, root):
    at = Path(path.removeprefix("file:")) / root
    return {str(f.relative_to(at)): f.stat().st_size for f in at.rglob("*.parquet")}


def test_batches_compaction_and_reruns(spark):
    rng = random.Random(2)
    path = new_path(spark, "upserts")
    schema = spark.createDataFrame([], SCHEMA).schema
    table = UpsertTable(spark, path, schema, "k", "v", buckets=8, every=3)
    assert table.state().collect() == []
    want = {}
    for n in range(8):
        keys = [None, *(f"k{i}" for i in range(60 if n == 0 else 6))]
        rows = [(k, None if k == "k1" and n == 0 else rng.randrange(5), f"{n}{k}") for k in rng.sample(keys, len(keys) if n == 0 else 3)]
        table.write(spark.createDataFrame(rows, SCHEMA), n)
        want = merged(want, rows)
        if n in (1, 2, 5):
            before = files(path, "base")
            table.write(spark.createDataFrame(rows, SCHEMA), n)  # again, as after a failure
            assert len(files(path, "base")) == len(before)
        assert rows_of(table) == want
    assert rows_of(UpsertTable(spark, path, schema, "k", "v", buckets=8, every=3)) == want
    base = files(path, "base")
    whole, touched = ({f.split("/")[1] for f in base if f.startswith(f"{BATCH}={n}/")} for n in (2, 5))
    assert len(whole) == 8 and 0 < len(touched) < 8  # the second compaction left other buckets alone
    table.vacuum()
    assert rows_of(table) == want and min(n for _, n in table._numbered("delta")) == 3


def test_what_a_batch_writes_follows_the_batch(spark):
    path = new_path(spark, "upserts")
    table = UpsertTable(spark, path, spark.createDataFrame([], SCHEMA).schema, "k", "v", buckets=4, every=100)
    table.write(spark.createDataFrame([(f"k{i}", 1, "x" * (i % 50) + str(i)) for i in range(20_000)], SCHEMA), 0)
    table.write(spark.createDataFrame([("k5", 2, "new")], SCHEMA), 1)
    size = {n: sum(s for f, s in files(path, "delta").items() if f.startswith(f"{BATCH}={n}/")) for n in (0, 1)}
    assert size[1] < size[0] / 50
    assert rows_of(table)["k5"] == (2, "new")
    again = [("k5", v, f"v{v}") for v in range(3000)]
    table.write(spark.createDataFrame(again, SCHEMA), 2)
    assert rows_of(table)["k5"] == (2999, "v2999")


def test_a_stream_of_many_files(spark):
    path = new_path(spark, "files")
    rows = [(f"k{i % 7}", i, str(i)) for i in range(200)]
    for k in range(0, 200, 20):
        spark.createDataFrame(rows[k : k + 20], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.k: r.v for r in run_upsert(stream, "k", "v", every=4).collect()}
    assert got == {f"k{i}": max(v for v in range(200) if v % 7 == i) for i in range(7)}
    with pytest.raises(ValueError):
        UpsertTable(spark, path, spark.createDataFrame([], "k long, upsert_batch long").schema, "k", "k")
