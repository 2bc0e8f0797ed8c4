"""The stored vector index: recall, what it reads, appends and reopening."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import ivf, vectors
from loomery.operators.ivf import IvfIndex, decode, encode, kmeans
from loomery.plans import vectors as plans
from loomery.sources.scratch import new_path

SF = "/root/testdata/sf0.1"


def grouped(spark, n, groups, seed=1):
    """Vectors around ``groups`` directions."""
    rng = np.random.default_rng(seed)
    stems = rng.normal(size=(groups, 32))
    x = stems[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, 32))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x * rng.uniform(0.1, 9, size=(n, 1)))], "vec_id long, embedding array<float>")


def rows(found):
    return sorted((r.query_id, r.place, r.vec_id, round(r.score, 6)) for r in found.collect())


def test_recall_over_all_asked_of_the_table(spark):
    """Ids divisible by 100. Of the whole vectors a query sees a twentieth; codes are an eighth of a vector."""
    base, asked = plans.base(spark, SF), plans.asked(spark, SF)
    index = IvfIndex.build(base, new_path(spark, "ivf"))
    assert index.n_lists == 44
    short, lists = index._short(asked, 30, 100)
    assert short.groupBy("query_id").count().agg(F.max("count")).first()[0] <= base.count() / 20 * 44  # a hundred for each task at most
    got = vectors.recall_at_k(index.search(asked, 10, 0.67), vectors.knn(asked, base, 10)).first()
    assert got.n_queries == 20 and got.recall >= 0.9


def test_few_lists_of_vectors_in_groups(spark):
    """Where vectors lie in groups an eighth of the lists is enough, and other folders aren't read."""
    base = grouped(spark, 2500, 60)
    asked = base.where("vec_id % 100 = 0")
    index = IvfIndex.build(base, new_path(spark, "ivf"))
    got = vectors.recall_at_k(index.search(asked, 10, 6), vectors.knn(asked, base, 10)).first()
    assert got.recall >= 0.9
    one = asked.where("vec_id = 100")
    _, lists = index._short(one, 6, 100)
    read = index._read("codes", ivf.CODES, lists)
    assert len(lists) == 6 and read.count() < base.count() / 4
    assert "PartitionFilters: [folder" in read._jdf.queryExecution().toString()


def test_append_and_reopen(spark):
    base = grouped(spark, 900, 10)
    path = new_path(spark, "ivf")
    IvfIndex.build(base.where("vec_id % 3 <> 0"), path, n_lists=12)
    IvfIndex(spark, path).append(base.where("vec_id % 3 = 0").coalesce(1))
    index, asked = IvfIndex(spark, path), base.where("vec_id < 20")
    assert rows(index.search(asked, 5, 12, refine=40)) == rows(vectors.knn(asked, base, 5))
    spark.read.schema(ivf.VECTORS).parquet(f"{path}/vectors").where("vec_id = 3").withColumn("part", F.lit("broken")).write.mode("append").partitionBy("folder").parquet(f"{path}/vectors")
    assert rows(index.search(asked, 5, 12, refine=40)) == rows(vectors.knn(asked, base, 5))
    with pytest.raises(Exception, match="a vector of 2 values"):
        index.append(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_many_queries_in_blocks(spark, monkeypatch):
    base = grouped(spark, 400, 6)
    index = IvfIndex.build(base, new_path(spark, "ivf"), n_lists=7)
    whole = rows(index.search(base, 3, 2))
    monkeypatch.setattr(ivf, "BLOCK_BYTES", 40 * 8 * 32)
    monkeypatch.setattr(ivf, "BROADCAST", 0)
    assert rows(index.search(base, 3, 2)) == whole
    monkeypatch.setattr(ivf, "FOLDERS", 3)
    again = IvfIndex.build(base, new_path(spark, "ivf"), n_lists=7)
    assert rows(again.search(base, 3, 2)) == whole


def test_odd_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.1, 0.0]), (1, [2.0, 0.1, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (None, [1.0, 0.0, 0.0]), (4, [-1.0, 0.0, 5.0])], "vec_id long, embedding array<float>")
    index = IvfIndex.build(df, new_path(spark, "ivf"), n_lists=2)
    assert sorted(r[2] for r in rows(index.search(df.where("vec_id = 0"), 5, 2))) == [1, 1, 4]
    none = IvfIndex.build(df.limit(0), new_path(spark, "ivf"))
    assert none.n_lists == 0 and none.search(df, 3, 1).collect() == []


def test_codes_and_centres(spark):
    x = np.random.default_rng(4).normal(size=(50, 7))
    scale, codes = encode(x)
    assert codes.shape == (50, 4) and np.abs(decode(scale, codes, 7) - x).max() <= scale.max() / 2 + 1e-6
    found = kmeans(grouped(spark, 600, 4), 4, 10, 3)
    assert found.shape == (4, 32) and np.allclose(np.linalg.norm(found, axis=1), 1)
