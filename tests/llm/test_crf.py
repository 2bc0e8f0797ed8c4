from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from loomery.llm import registry
from loomery.llm import crf
from loomery.llm.crf import WIDTH, Field, fit, held_out, line_features, score_quality, train

SF = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    odds = rng.normal(size=8)
    field = Field(np.zeros(3 * WIDTH), rng.normal(size=(2, 2)))
    good, pairs, logs = field.marginals(odds, sizes)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for k, n in enumerate(sizes):
        total, ones = 0.0, np.zeros(n)
        each = np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=n):
            score = sum((o if s else -o) / 2 for s, o in zip(states, odds[at : at + n], strict=True))
            score += sum(field.transition[a, b] for a, b in itertools.pairwise(states))
            total += np.exp(score)
            ones += np.exp(score) * np.array(states)
            for a, b in itertools.pairwise(states):
                each[a, b] += np.exp(score)
        want += list(ones / total)
        want_pairs += each / total
        assert np.isclose(logs[k], np.log(total))
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_held_out_accuracy(spark):
    got = registry.op8_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500
    ranks = got.score.rank()
    n1 = int((got.quality == 1).sum())
    n0 = len(got) - n1
    assert (ranks[got.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.98
    assert (got.predicted == got.quality).mean() > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    fields = [train(docs, x.where(~held_out()), fit_docs=300) for x in (labels, turned)]
    assert np.array_equal(fields[0].emission, fields[1].emission)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (None, 1), (6, None), (8, 7)], "doc_id long, quality int")
    field = train(odd, labels)
    got = score_quality(odd, field, odd.columns, score_col="__score")
    assert got.columns == [*odd.columns, "__score"] and got.where("__score >= 0 AND __score <= 1").count() == odd.count()
    assert score_quality(none, field, ["doc_id"]).collect() == []
    blank = train(none, labels.limit(0))
    assert {r.score for r in score_quality(odd, blank, ["doc_id"]).collect()} == {0.5}


def test_one_label_only():
    x, _, sizes = line_features([b"a\nb", b"c"])
    assert not fit(x, sizes, np.array([1, 1])).emission.any()


def test_the_sample_is_bounded_by_rows_and_lines(spark, monkeypatch):
    held = []
    monkeypatch.setattr(crf, "fit", lambda x, sizes, labels: held.append((len(x), len(sizes))))
    docs = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b\nc").alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    train(docs, labels, fit_docs=50)
    train(docs, labels, fit_docs=50, fit_total=31)
    train(docs, labels, fit_docs=50, fit_total=1)
    assert held == [(100, 50), (30, 15), (0, 0)]


def test_a_text_of_a_million_lines(spark):
    docs = spark.range(1).select("id", F.repeat(F.lit("Some words here.\n"), 1_000_000).alias("text"))
    got = score_quality(docs, Field(np.zeros(3 * WIDTH), np.zeros((2, 2))), ["id"]).collect()
    assert [round(r.score, 6) for r in got] == [0.5]


def test_no_more_than_fit_total_lines_are_fitted_on(spark, monkeypatch):
    from loomery.llm import crf

    seen = []
    monkeypatch.setattr(crf, "fit", lambda x, sizes, labels: seen.append((len(x), sizes.sum(), len(labels))))
    docs = spark.createDataFrame([(i, "a line\n" * (i % 9 + 1)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for total in (50, 10**6, 0):
        crf.train(docs, labels, fit_total=total)
    assert 40 <= seen[0][0] <= 50 and seen[0][0] == seen[0][1] and seen[0][2] < 20
    assert seen[1][2] == 60 and seen[2] == (0, 0, 0)
