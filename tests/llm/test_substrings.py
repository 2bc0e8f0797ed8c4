from __future__ import annotations

import random
import time
from collections import Counter

import pytest

from loomery.llm import substrings
from loomery.llm.substrings import remove_repeated_windows


def brute(rows, window):
    first, docs = {}, [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, words in docs:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, (order(i), s)), (order(i), s))
    out = []
    for i, words in docs:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (order(i), s):
                gone.update(range(s, s + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return Counter(out)


def result(df, window):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_windows(df, window).collect())


def test_equals_brute_force_on_shared_passages(spark):
    rng = random.Random(5)
    passages = [[f"p{rng.randrange(50)}" for _ in range(n)] for n in (20, 21, 33, 60, 19)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40))] + rng.choice(passages)
        rows.append((i, " ".join(words)))
    rows += [(500 + k, rows[3][1]) for k in range(30)]
    rows += [(700, " ".join(["same"] * 90)), (701, " ".join(["same"] * 25))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, 20) == brute(rows, 20)
    assert result(df, 14) == brute(rows, 14)


def test_every_shift_shares_an_anchor():
    for shift in range(substrings.PERIOD):
        assert any((k + a) % 13 in substrings.COVER and (k + a + shift) % 13 in substrings.COVER for a in range(1) for k in range(13))
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("repeated", [500_000, 1])
def test_many_rows_without_or_of_one_id(spark, monkeypatch, repeated):
    """Each keeps to its own anchors, so they take about as long as rows of different ids."""
    monkeypatch.setattr(substrings, "REPEATED", repeated)
    rng = random.Random(9)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(None if k % 2 else 7, " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] + [rng.choice(passages)])) for k in range(3000)]
    df = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string")
    began = time.time()
    assert result(df, 20) == brute([*rows, *rows[:50]], 20)
    assert time.time() - began < 60


def test_odd_rows(odd, none):
    from tests.llm.conftest import TEXTS

    assert result(odd, 20) == brute(TEXTS, 20)
    assert result(none, 20) == Counter()
    with pytest.raises(ValueError):
        remove_repeated_windows(odd, 13)


def test_slices_do_not_change_the_result(spark, odd, monkeypatch):
    from loomery.llm.words import hash_words, slices

    text = b" ".join(b"w%d" % k for k in range(500))
    assert list(hash_words(text)) == [h for part in slices(text, 64) for h in hash_words(part)]
