from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from loomery.llm.tokens import TokenCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Plain words, and some more: 1234 don't we'll 'tis.",
    "",
    None,
    " \n\n  spaces \t\t\n",
    "a<|endoftext|>b<|endoftext|><|endoftext|>",
    "<|endoftext|>",
    "naïve façade – 漢字かな Ωмега",
    "՘֋ new letters Ɤ\U00010940 \x1c\x1d",
    "👩‍👩‍👧 emoji ​ zero",
    "word " * 30_000,
    "Plain words, and some more: 1234 don't we'll 'tis.",
]


def test_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, (None, "no id", "x", 7)], "doc_id long, text string, n_tokens string, over_limit int")
    got = {r.doc_id: r for r in count_tokens(df, PATH, max_tokens=1024, memo_entries=3).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        want = len(lib.encode(t or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 1024), t


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(df, PATH, max_tokens=8).collect() == []


def test_slices_of_long_texts(monkeypatch):
    own, lib = TokenCounter(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr("loomery.llm.tokens.SLICE", 40)
    text = "some of these words repeat " * 20
    assert own.count(text) == len(lib.encode(text, add_special_tokens=False))


def test_whole_tokens_are_proved():
    own, lib = TokenCounter(PATH), Tokenizer.from_file(PATH)
    for piece in list(own.whole)[::997]:
        assert len(lib.encode(piece, add_special_tokens=False)) == 1
