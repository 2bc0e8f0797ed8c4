from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from loomery.llm import secrets
from loomery.llm.secrets import BASE, FORMATS, Rule, TrigramIndex, listed, scan_secrets
from loomery.llm.trigrams import ANY, trigram_query
from tests.llm.conftest import TEXTS

RULES = BASE + FORMATS


def brute(text, rules=RULES):
    found = []
    for k, rule in enumerate(rules):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(rule.group)) >= rule.least]
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in sorted(found))


def check(df, rows):
    got = scan_secrets(df, ["doc_id"]).select("doc_id", listed("spans").alias("s")).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, brute(t)) for i, t in rows)
    return [r.s for r in got]


@pytest.fixture
def texts():
    rng = random.Random(11)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    letters = "abcdefXYZ0189"
    parts = [
        *("password", "PassWd", "api_key", "APIKEY", "secret", "token", " ", "=", ":", '"', "'", "\n", "é", "👩‍👧", "AKIA", "deadbeef", "x", "."),
        lambda: some(letters, rng.randrange(12)),
        lambda: some("ABCXYZ019", rng.randrange(20)),
        lambda: some("0123456789abcdef", rng.randrange(20, 50)),
        lambda: "ghp_" + some(letters, rng.randrange(30, 45)),
        lambda: f"https://me:{some(letters, 6)}@host",
        lambda: "Bearer " + some(letters, rng.randrange(10, 40)),
        lambda: "-----BEGIN RSA PRIVATE KEY-----",
        lambda: ".".join("eyJ" + some(letters, 12) for _ in range(2)) + "." + some(letters, 12),
    ]
    one = lambda: (lambda p: p() if callable(p) else p)(rng.choice(parts))
    return ["".join(one() for _ in range(rng.randrange(25))) for _ in range(600)]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_equals_a_scan_of_all_texts(spark, texts, monkeypatch, broadcast):
    monkeypatch.setattr(secrets, "BROADCAST", broadcast)
    rows = list(enumerate(texts)) + [(7, texts[0]), (None, texts[1])]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    kinds = {s.split(":")[0] for x in found for s in x.split(",")}
    assert {"assign", "access", "hex", "github", "login", "bearer", "pem", "jwt"} <= kinds


def test_matches_consume_what_a_dropped_one_covers(spark):
    rows = [(1, "token=token: abcdefgh"), (2, "token=secret=abcdefghijk"), (3, "SECRET  = 'abcdefgh'"), (4, "AKIAAKIA12345678"), (5, "K token:short")]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert found[0] == "" and found[1].startswith("assign:0:")


def test_odd_rows(spark, odd, none):
    check(odd, TEXTS)
    long = "token = abcdefgh1 " * 3000
    check(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string"), [(1, long), (2, long)])
    assert scan_secrets(none, ["doc_id"]).collect() == []
    df = spark.createDataFrame([(1, "AKIA" + "A" * 16)], "spans int, text string")
    assert scan_secrets(df, ["spans"]).first().spans_ == 1
    only_scanned = scan_secrets(df, ["text"], [Rule("hex", "[A]{5,}")]).first()
    assert [tuple(s) for s in only_scanned.spans] == [(3, 20, "hex")]


def test_index_is_asked_again(spark):
    df = spark.createDataFrame([("an abcdef here",), ("an abc here",), ("none",)], "text string")
    index = TrigramIndex(df, ["abc", "bcd", "def"])
    count = lambda pattern: index.candidates({0: trigram_query(pattern)}).count()
    assert (count("abc"), count("abcd"), count("def|abc")) == (2, 1, 2)


def test_every_match_answers_its_query(texts):
    """The trigrams asked for are in each match, for many expressions."""
    patterns = [r.pattern for r in RULES] + ["(ab|cd)?xyz", "a[bc]d+e", "(foo|b.r)baz", "(?:abc){2}d", "x{3}y*z", "[^a]bcd", "abc$", "(a|b)(c|d)(e|f)", "pass.ord"]
    samples = texts + ["xyz abxyz", "abdde acde", "foobaz bzrbaz", "abcabcd", "xxxz xxxyyz", "zbcd", "abc", "ace bdf", "pass0ord"]
    matched = 0
    for p in patterns:
        query = trigram_query(p)
        for text in samples:
            for m in re.finditer(p, text):
                matched += 1
                assert any(all(g in m.group().lower() for g in some) for some in query), (p, m.group())
    assert matched > 500
    assert trigram_query("[0-9a-f]{32,}") == ANY
    assert trigram_query("gh[op]_x") == frozenset({frozenset({"gho", "ho_", "o_x"}), frozenset({"ghp", "hp_", "p_x"})})
