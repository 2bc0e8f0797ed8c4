from __future__ import annotations

import math
import random
from collections import Counter

from loomery.llm import registry
from loomery.llm.rules import PSEUDO, START, estimate, judge
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.01"


def figures(text):
    words = [w.decode() for w in (text or "").encode().split()]
    runs = list(zip(words, words[1:], words[2:]))  # noqa: B905
    count, covered = Counter(runs), set()
    for k, r in enumerate(runs):
        if count[r] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_figures_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.op3_quality_rules(spark, SF).collect():
        assert tuple(r)[1:7] == figures(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_verdicts_agree_with_labels(spark):
    got = registry.op3_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.99


def test_odd_rows(odd, none):
    got = judge(odd, ["doc_id"]).collect()
    want = sorted((figures(t) for _, t in TEXTS), key=str)
    assert sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert judge(none, ["doc_id"]).collect() == []


def test_em_equals_plain_em(spark):
    rows = [(0, None, 1, 40), (None, 0, None, 30), (None, None, 1, 900), (0, 0, None, 25), (None, None, None, 60), (None, 0, 1, 3)]
    got = estimate(spark.createDataFrame(rows, "a int, b int, c int, n long"), ["a", "b", "c"], rounds=12, tolerance=0)
    prior, good, bad = START.prior, [START.good[0]] * 3, [START.bad[0]] * 3
    for _ in range(12):
        sums = [[0.0] * 3 for _ in range(6)]
        for *votes, n in rows:
            like = [prior, 1 - prior]
            for v, g, b in zip(votes, good, bad, strict=True):
                for y, (p0, p1) in enumerate((g, b)):
                    like[y] *= 1 - p0 - p1 if v is None else (p0, p1)[v]
            p = like[0] / sum(like)
            for y, w in enumerate((n * p, n * (1 - p))):
                sums[y][0] += w
                for k, v in enumerate(votes):
                    if v is not None:
                        sums[2 + 2 * y + v][k] += w
        n0, n1 = sums[0][0], sums[1][0]
        share = lambda x, n, s: (x + PSEUDO * s) / (n + PSEUDO)
        prior = min(0.999, max(0.001, share(n0, n0 + n1, START.prior)))
        raw = [[share(sums[2 + 2 * y + v][k], (n0, n1)[y], (START.good, START.bad)[y][0][v]) for y in (0, 1) for v in (0, 1)] for k in range(3)]
        good = [(g0, g1) for g0, g1, _, _ in raw]
        bad = [(max(b0, g0), min(b1, g1)) for g0, g1, b0, b1 in raw]
    assert math.isclose(got.prior, prior, rel_tol=1e-9)
    assert all(math.isclose(x, y, rel_tol=1e-9) for p, q in zip(got.good + got.bad, good + bad, strict=True) for x, y in zip(p, q, strict=True))


def planted(seed, n=20_000):
    """Votes of five rules on documents of which a tenth are bad; the last rule is often wrong about good ones."""
    rng = random.Random(seed)
    false, true = (0.01, 0.02, 0.01, 0.03, 0.3), (0.7, 0.6, 0.8, 0.7, 0.35)
    docs = []
    for _ in range(n):
        bad = rng.random() < 0.1
        docs.append((bad, tuple(0 if rng.random() < (t if bad else f) else 1 if rng.random() < 0.5 else None for f, t in zip(false, true, strict=True))))
    return docs, false, true


def test_a_noisy_rule_is_found_out(spark):
    docs, false, true = planted(3)
    names = ["a", "b", "c", "d", "e"]
    patterns = spark.createDataFrame([(*v, n) for v, n in Counter(v for _, v in docs).items()], "a int, b int, c int, d int, e int, n long")
    rates = estimate(patterns, names, rounds=200)
    assert abs(rates.prior - 0.9) < 0.02
    for (g0, _), (b0, _), f, t in zip(rates.good, rates.bad, false, true, strict=True):
        assert abs(g0 - f) < 0.02 and abs(b0 - t) < 0.06
    good = {tuple(r)[:5]: r.p >= 0.5 for r in patterns.withColumn("p", rates.posterior(names)).collect()}
    right = sum(good[v] != bad for bad, v in docs)
    all_pass = sum((0 not in v) != bad for bad, v in docs)
    assert right / len(docs) > 0.97 and all_pass / len(docs) < 0.75
    assert all(good[v] for bad, v in docs if v == (1, 1, 1, 1, 0))


def test_verdicts_are_not_those_of_all_must_pass(spark):
    """Good documents on which one rule alone votes bad are kept."""
    judged = registry.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), ["doc_id"]).where("NOT base_failed")
    votes = [c for c in judged.columns if c.startswith("vote_")]
    passed = " AND ".join(f"coalesce({v}, 1) = 1" for v in votes)
    assert judged.where(f"kept AND NOT ({passed})").count() > 0


def test_clashing_names(odd):
    got = judge(odd, ["n_words", "doc_id"])
    assert got.columns[:2] == ["n_words_", "doc_id"] and {r.n_words_ for r in got.collect()} == {"x"}
