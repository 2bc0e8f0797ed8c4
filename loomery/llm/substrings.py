"""Substring dedup: windows of words that start earlier elsewhere are cut out.

Difference-cover anchors. With period 13 and cover {0, 1, 3, 9} every difference
modulo 13 is a difference of two cover members. Short windows of 8 words are
hashed only where their position in the document, modulo 13, is in the cover.
Two equal windows of 20 words, at whatever positions, therefore hold one equal
short window that both documents hashed (it starts at most 12 words in, and
12 + 8 = 20). So:

1. anchors: 4 of 13 positions, one shuffle by their hash; repeated ones are kept;
2. extension: each window of 20 words around a repeated anchor is hashed with
   96 bits and sent by that hash; all but the earliest (document, start) are hits;
3. the hits of a document are laid over its words.

No pairs are formed. Equal hashes within one batch of a task are settled there:
only the earliest goes to the hash's partition, so a passage that a third of the
documents share costs that partition one row for each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.sources.scratch import save
from loomery.llm.words import FACTOR_A, FACTOR_B, groups, hash_words, mix, run_hashes, slices

PERIOD = 13
COVER = (0, 1, 3, 9)

#: Repeated ids (8 bytes each) that are broadcast.
REPEATED = 500_000

#: Kinds of a sent hash: alone in its batch, earliest of several there, or a later one.
ALONE, FIRST, LATER = 0, 1, 2


class _Batch:
    """The word hashes of some documents, end to end."""

    def __init__(self, texts: list[bytes]) -> None:
        each = [hash_words(t) for t in texts]
        self.sizes = np.array([len(h) for h in each], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.h = np.concatenate(each) if each else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(each)), self.sizes)
        self.pos = np.arange(len(self.h)) - self.starts[self.doc]
        self.left = self.sizes[self.doc] - self.pos


def _kinds(keys: list[np.ndarray], key_id: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, id, position; kind of each in that order)."""
    order = np.lexsort((pos, key_id, *keys[::-1]))
    n = len(order)
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    i, p = key_id[order], pos[order]
    later = (i != i[first][group]) | (p != p[first][group])
    kind = np.where(later, LATER, np.where(size[group] > 1, FIRST, ALONE))
    return order, kind


def _dealt(key: np.ndarray, kind: np.ndarray, key_id: np.ndarray) -> np.ndarray:
    """Later ones are settled; they are dealt out by their document, not by what they hold."""
    return np.where(kind == LATER, mix(key_id.view(np.uint64)), key).view(np.int64)


def _anchors(window: int) -> Callable:
    short = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = np.isin(np.arange(PERIOD), COVER)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in groups(batch.column(1)):
                b = _Batch(texts)
                at = np.flatnonzero(cover[b.pos % PERIOD] & (b.left >= short) & (b.sizes[b.doc] >= window))
                if not len(at):
                    continue
                key, pos, own = run_hashes(b.h, short, FACTOR_A)[at], b.pos[at], ids[first + b.doc[at]]
                order, kind = _kinds([key], own, pos)
                key, pos, own = key[order], pos[order], own[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_dealt(key, kind, own)), pa.array(own), pa.array(pos * 4 + kind)], ["key", "id", "at"]
                )

    return run


def _extended(window: int) -> Callable:
    """Hashes of the windows around a document's repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, anchors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
            for first, texts in groups(batch.column(1)):
                b = _Batch(texts)
                near = np.zeros(len(b.h) + 1, np.int32)
                for k, n in enumerate(b.sizes):
                    p = anchors[first + k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    p = p[p < n]  # a row of equal hash may be longer
                    np.add.at(near, b.starts[k] + np.maximum(p - PERIOD + 1, 0), 1)
                    np.add.at(near, b.starts[k] + p + 1, -1)
                at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (b.left >= window))
                if not len(at):
                    continue
                keys = [run_hashes(b.h, window, f)[at] for f in (FACTOR_A, FACTOR_B)]
                pos, own, tag = b.pos[at], ids[first + b.doc[at]], tags[first + b.doc[at]]
                order, kind = _kinds(keys, own, pos)
                pos, own, tag = pos[order], own[order], tag[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_dealt(keys[0][order], kind, own)),
                        pa.array(np.where(kind == LATER, 0, (keys[1][order] >> np.uint64(32))).astype(np.uint32).view(np.int32)),
                        pa.array(own),
                        pa.array(pos * 4 + kind),
                        pa.array(tag),
                    ],
                    ["key", "key2", "id", "at", "tag"],
                )

    return run


def _cut(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            n_words, n_removed, kept = [], [], []
            for row, data in enumerate(batch.column(1)):
                data = data.as_py() or b""
                words = [w for part in slices(data) for w in part.split()]
                n_words.append(len(words))
                if hits[row].is_valid:
                    at = hits[row].values.to_numpy(zero_copy_only=False)
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_words", "n_removed", "kept_text"],
            )

    return run


def _tagged(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``tag`` of each row: its id, or where several rows have that id a 64-bit hash of id and text.

    Ids are small numbers that compress well, so hashes take their place only
    where they must: for the ids that repeat, or for all rows if too many do.
    """
    again = save(docs.groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("id", F.lit(True).alias("again")), "repeated-ids")
    n, own = again.count(), F.xxhash64("id", "text")
    if n == 0:
        return docs.withColumn("tag", F.col("id"))
    if n > REPEATED:
        return docs.withColumn("tag", own)
    return docs.join(F.broadcast(again), "id", "left").withColumn("tag", F.when(F.col("again"), own).otherwise(F.col("id"))).drop("again")


def remove_repeated_windows(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every word that a window covers whose words also start earlier.

    Earlier: in a smaller id, or in the same document at an earlier start;
    windows are judged on the input. The first step runs when this is called, and
    its anchors are written to the shared folder. One row for each row of ``df``: the id,
    ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by a space).

    ``window`` is at least 14 words. A null or empty text has no words. A null
    id is later than all others (ids are 64-bit integers; the largest of them
    counts as equal to null). Rows that share an id start equally early, so
    neither is cut for the other's sake; each row has its own anchors and hits,
    found by a hash of id and text. Other columns of ``df`` are not read.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    last = F.lit(2**63 - 1)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.col(text_col).cast("binary").alias("text"))

    docs = _tagged(docs)

    sent = docs.select("tag", "text").mapInArrow(_anchors(window), "key long, id long, at long")
    times = F.count(F.lit(1)).over(Window.partitionBy("key"))
    repeated = sent.withColumn("times", times).where((F.col("times") > 1) | (F.col("at") % 4 != ALONE))
    position = F.shiftright("at", 2).cast("int")
    anchors = save(repeated.groupBy(F.col("id").alias("tag")).agg(F.collect_set(position).alias("anchors")), "anchors")

    # both joins shuffle the texts by their tags, so that is done once
    near = docs.join(anchors, "tag").select("id", "text", "tag", "anchors")
    windows = near.mapInArrow(_extended(window), "key long, key2 int, id long, at long, tag long")
    earlier = F.rank().over(Window.partitionBy("key", "key2").orderBy("id", "at"))
    hits = windows.withColumn("place", earlier).where((F.col("place") > 1) | (F.col("at") % 4 == LATER))
    hits = hits.groupBy("tag").agg(F.collect_set(position).alias("hits"))

    whole = docs.join(hits, "tag", "left").select("id", "text", "hits")
    cut = whole.mapInArrow(_cut(window), "id long, n_words long, n_removed long, kept_text binary")
    return cut.select(
        F.nullif("id", last).alias(id_col), "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text")
    )
