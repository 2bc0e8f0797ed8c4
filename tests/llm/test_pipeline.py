from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from loomery.llm import registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.save(stage(spark, docs, SF), "test-stage")
        out.append((name, before, docs))
    return out


def test_stages_are_the_operators(spark, stages):
    columns = stages[0][1].columns
    assert all(after.columns == columns for *_, after in stages[:-1])
    assert stages[-1][2].columns == [*columns, "shard", "slot"]
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in (stages[0][1], *[s[2] for s in stages])]
    scored = {r.doc_id: r.predicted for r in registry.op8_quality_classifier(spark, SF).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if scored[i])

    from tests.llm.test_simhash import groups_of, plain_fingerprint

    texts = {r.doc_id: r.text for r in stages[0][2].collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    group = groups_of(set(prints.values()), 3)
    first = {}
    for i, p in prints.items():
        first[group[p]] = min(first.get(group[p], i), i)
    assert sorted(ids[2]) == sorted(first.values())

    from tests.llm.test_winnowing import brute

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, n, hit, _ in brute([(i, texts[i]) for i in ids[2]], items) if hit and 20 * hit >= n}
    assert sorted(ids[3]) == sorted(set(ids[2]) - bad) and bad
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in ids[4]) <= 2
    assert sorted(ids[5]) == sorted(ids[4])


def test_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() > 0


def test_clashing_names_and_no_documents(spark, odd, none, tmp_path):
    clash = ["__score", "score", "__row", "__id", "__text", "__repeats", "shard", "slot", "c0", "extra_1"]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    for name, rows in (("rows", docs), ("none", docs.limit(0))):
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{tmp_path}/{table}.parquet").write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == [c + "_" if c in ("shard", "slot") else c for c in docs.columns] + ["shard", "slot"]
        got = out.collect()
        assert all(tuple(r)[5:15] == tuple(range(10)) for r in got) and bool(got) == (name == "rows")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in place]) for r in want.fetchall())
