"""Token counts by the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges each on its own, so
the count of a text is the sum over its pre-tokens. Which vocabulary strings are
one token when they stand alone is proved before any text is read, by encoding
each of them; those pre-tokens count one. Only the rest is merged, once for a
worker and distinct pre-token as long as the bounded memo holds it.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published pre-token pattern of this kind of vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points for which the pattern above is compared with the library's own
#: splitter when a counter is made. A text with others goes to that splitter.
COMPARED = [(0x0000, 0x052F), (0x2010, 0x2060), (0x20A0, 0x20BF), (0x3001, 0x30FF), (0x4E00, 0x9FA5)]

#: Characters of pre-tokens held at once.
SLICE = 4_000_000


class TokenCounter:
    """Counts the tokens of texts as ``tokenizers`` does with the file at ``path``.

    No begin, end or other special tokens are added. The string of a special
    token inside a text is that one token, the library's default.
    """

    def __init__(self, path: str, memo_entries: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = sorted((t.content for t in self.lib.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.memo_entries = memo_entries
        self.whole = self._prove_whole_tokens()
        self.known = dict(self.whole)
        self.unproved = self._compare_splitters()

    def _prove_whole_tokens(self) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and encode to one token."""
        texts = [self.lib.decode([i], skip_special_tokens=False) for i in range(self.lib.get_vocab_size(with_added_tokens=False))]
        texts = [t for t in texts if t and "�" not in t and t not in self.special and self.pattern.fullmatch(t)]
        return {t: 1 for t, e in zip(texts, self.lib.encode_batch(texts, add_special_tokens=False), strict=True) if len(e) == 1}

    def _compare_splitters(self) -> re.Pattern:
        split = self.lib.pre_tokenizer.pre_tokenize_str
        same = []
        for low, high in COMPARED:
            for c in map(chr, range(low, high + 1)):
                probe = f"a{c}1!{c}{c}x"
                if [probe[s:e] for _, (s, e) in split(probe)] == self.pattern.findall(probe):
                    same.append(re.escape(c))
        return re.compile(f"[^{''.join(same)}]")

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens, in lists of bounded size."""
        if self.unproved.search(text):
            yield [text[s:e] for _, (s, e) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        elif len(text) <= SLICE:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while part := list(itertools.islice(found, SLICE // 4)):
                yield part

    def _merge(self, pieces: list[str]) -> None:
        rest = list(set(pieces).difference(self.known))
        if rest:
            if len(self.known) > len(self.whole) + self.memo_entries:
                self.known = dict(self.whole)
                rest = list(set(pieces).difference(self.known))
            encoded = self.lib.encode_batch(rest, add_special_tokens=False)
            self.known.update(zip(rest, map(len, encoded), strict=True))

    def _count_plain(self, text: str) -> int:
        n = 0
        for pieces in self._pieces(text):
            self._merge(pieces)
            n += sum(map(self.known.__getitem__, pieces))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self._count_plain(text)
        n, at = 0, 0
        for m in self.special_pattern.finditer(text):
            n += 1 + (self._count_plain(text[at : m.start()]) if m.start() > at else 0)
            at = m.end()
        return n + (self._count_plain(text[at:]) if at < len(text) else 0)


@functools.lru_cache(maxsize=2)
def counter(path: str, memo_entries: int) -> TokenCounter:
    """One for a worker process and vocabulary, so that the proof runs once."""
    return TokenCounter(path, memo_entries)


def _counting(path: str, memo_entries: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, memo_entries)
        for batch in batches:
            counts = [own.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(
    df: DataFrame, tokenizer_path: str, max_tokens: int, id_col: str = "doc_id", text_col: str = "text", memo_entries: int = 300_000
) -> DataFrame:
    """One row for each row of ``df``: the id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    One pass without a shuffle; a worker holds the vocabulary, at most
    ``memo_entries`` merged pre-tokens and one batch of texts.

    A null or empty text has 0 bytes and 0 tokens. Rows with equal or null ids
    stay rows of their own. Other columns of ``df`` are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = texts.mapInArrow(_counting(tokenizer_path, memo_entries), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
