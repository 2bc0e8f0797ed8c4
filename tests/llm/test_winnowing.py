from __future__ import annotations

import random
import re

from loomery.llm.winnowing import find_contamination, is_contaminated
from tests.llm.conftest import TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        words, covered, names = words_of(text), set(), set()
        for name, t in items:
            own = words_of(t)
            n = min(len(own), window)
            keys = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
            for s in range(len(words) - n + 1 if n else 0):
                if tuple(words[s : s + n]) in keys:
                    covered.update(range(s, s + n))
                    names |= {str(name)} - {"None"}
        out.append((i, len(words), len(covered), tuple(sorted(names))))
    return sorted(out, key=str)


def result(df, bench, **more):
    found = find_contamination(df, bench, ["doc_id"], **more)
    return sorted(((r.doc_id, r["__n_words"], r["__n_hit"], tuple(r["__items"])) for r in found.collect()), key=str)


def data(spark):
    rng = random.Random(3)
    some = lambda n, k=40: [f"V{rng.randrange(k)}" for _ in range(n)]
    items = [(k, some(rng.choice((13, 14, 20, 50)))) for k in range(30)] + [(10 + k, some(n)) for k, n in enumerate((1, 3, 12, 13))]
    items += [(None, some(15)), (99, []), (7, some(18))]
    docs = []
    for i in range(80):
        words = some(rng.randrange(60), 10**6)
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1]
            s = rng.randrange(max(1, len(item)))
            words += item[s : s + rng.randrange(1, 40)] + some(rng.randrange(30), 10**6)
        docs.append((i, "; ".join(words)))
    items = [(k, " ".join(w)) for k, w in items] + [(55, None), (56, "!?")]
    docs += TEXTS + [(900, items[0][1].upper()), (900, items[1][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = data(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert result(df, bench) == want
    assert result(df, bench, block_bytes=900) == want  # by joins
    spans = lambda **more: sorted(map(str, find_contamination(df, bench, ["doc_id"], **more).select("doc_id", "__spans").collect()))
    assert spans() == spans(block_bytes=900)


def test_many_copies_and_frequent_short_items(spark):
    docs = [(i, "w " * 30 + f"u{i % 3}") for i in range(60)] + [(100, "w u0 w w"), (None, "w"), (101, "x")]
    items = [(1, "w"), (2, "w w w"), (3, "w " * 13), (None, "u0"), (4, "u1")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(df, bench) == result(df, bench, block_bytes=1) == brute(docs, items)


def test_empty_tables_and_columns(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r[2] == 0 for r in result(odd, empty))
    no_words = spark.createDataFrame([(1, ""), (2, None)], "item_id long, text string")
    assert result(odd, no_words, block_bytes=1) == result(odd, empty)
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert result(none, one, block_bytes=1) == []
    assert find_contamination(odd, one, odd.columns, block_bytes=1).count() == len(TEXTS)
    assert result(none, empty) == []
    kept = find_contamination(odd, empty, odd.columns).where(~is_contaminated()).select(*odd.columns)
    assert kept.count() == len(TEXTS) and kept.schema.simpleString() == odd.schema.simpleString()


def test_only_prints_that_an_item_may_have_are_sent(spark):
    import numpy as np

    from loomery.llm.winnowing import _filter_words, _may_be

    own = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    prints = spark.createDataFrame([(13, int(p)) for p in own], "n long, p long")
    words = _filter_words(prints, 1 << 16)
    assert len(_may_be(words, own.view(np.uint64))) == len(own)
    others = np.random.default_rng(2).integers(0, 2**64 - 1, 50_000, dtype=np.uint64)
    assert len(_may_be(words, others)) < 0.06 * len(others)
    assert len(_may_be(_filter_words(prints.limit(0), 64), others)) == 0
