"""Approximate pairs, frequent lines and redaction against exact answers."""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from loomery.functions.text import EMAIL, is_ipv4, spans_of
from loomery.operators import documents
from loomery.operators.lsh import minhash_model, similar_texts_lsh
from loomery.operators.similarity import link_counts, similar_texts
from loomery.sources.scratch import new_path
from loomery.sources.tables import load_table
from tests.test_similarity import near_copies

SF = "/root/testdata/sf0.01"


def test_lsh_pairs_are_exact_and_most_are_found(spark):
    path = new_path(spark, "model")
    minhash_model(spark).save(path)
    model = PipelineModel.load(path)
    docs = load_table(spark, SF, "documents")
    exact, found = similar_texts(docs, 3), similar_texts_lsh(docs, model, 3)
    rows = lambda s: {(r.a, r.b, round(r.jaccard, 9)) for r in s.pairs.collect()}
    assert rows(found) <= rows(exact) and len(rows(found)) >= 0.9 * len(rows(exact)) > 10
    df = spark.createDataFrame(near_copies(5, 200), "doc_id long, text string")
    exact, found = similar_texts(df), similar_texts_lsh(df, model)
    assert rows(found) <= rows(exact) and len(rows(found)) >= 0.9 * len(rows(exact)) > 5
    assert link_counts(found).count() == 204
    none = similar_texts_lsh(df.limit(0), model)
    assert none.pairs.collect() == none.members.collect() == []


def test_frequent_lines(spark):
    rows = [(i, f"all\nown {i}\n \nall") for i in range(2000)] + [(1, "own 2"), (None, "own 3"), (None, "own 4\nown 3"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.line: (r.n_docs, r.n) for r in documents.boilerplate_lines(df, 2).collect()}
    assert got == {"all": (2000, 4000), "own 2": (2, 2), "own 3": (2, 3), "own 4": (2, 2)}
    assert documents.boilerplate_lines(df.limit(0), 2).collect() == []
    plan = documents.boilerplate_lines(df, 2)._jdf.queryExecution().analyzed().toString()
    assert "Join" in plan


def test_every_span_of_a_redaction(spark):
    texts = {
        "mail a.b+c@d-e.co.uk, or x@y, @z.com; é@ü.de": ["a.b+c@d-e.co.uk"],
        "hosts 10.0.0.1 255.255.255.255 256.1.1.1 1.2.3 1.2.3.4.5 01.2.3.4 0.0.0.0": ["10.0.0.1", "255.255.255.255", "0.0.0.0"],
        "both u@10.0.0.1.example.com 10.0.0.2": ["u@10.0.0.1.example.com", "10.0.0.2"],
        "👩‍👧 1.1.1.1\n1.1.1.1": ["1.1.1.1", "1.1.1.1"],
        "": [],
        "none": [],
    }
    df = spark.createDataFrame([*texts.items(), (None, None)], "text string, want array<string>").withColumn("doc_id", F.monotonically_increasing_id())
    for r in documents.redact(df).join(df.withColumnRenamed("text", "before"), "doc_id").collect():
        if r.before is None:
            assert r.text is None and r.spans == []
            continue
        assert [r.before[s.start : s.end] for s in r.spans] == r.want, r.before
        out = r.before
        for s in reversed(r.spans):
            out = out[: s.start] + f"[{s.kind.upper()}]" + out[s.end :]
        assert r.text == out


def test_spans_equal_a_regular_expression(spark):
    texts = [r.text for r in load_table(spark, SF, "documents").select("text").collect()] + ["a@b.cd" * 300, "1.2.3.4 " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", spans_of("text", EMAIL, "email").alias("s")).collect()}
    assert all(got[i] == [(m.start(), m.end(), "email") for m in re.finditer(EMAIL, t)] for i, t in enumerate(texts))
    hosts = df.select("i", spans_of("text", r"[0-9]+(?:\.[0-9]+)+", "ipv4", is_ipv4).alias("s")).where("i >= 1001").collect()
    assert [len(r.s) for r in hosts] == [500]
