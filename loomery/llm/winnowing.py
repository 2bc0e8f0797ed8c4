"""Benchmark decontamination by winnowing.

Of each run of 9 consecutive 5-word hashes the least is kept (the rightmost of
equals), so of 13 consecutive words always the same 5-word hash is kept, wherever
they stand: documents and items that share 13 words share a fingerprint. Hits are
then extended: every 13-word window around a shared fingerprint is compared with
the items' windows by a 128-bit hash. An item of fewer words is one window, and
runs of its length are compared at every position.

Items of up to a bounded measured size are broadcast and the documents stream past
them without a shuffle. Beyond it the fingerprints of both sides are joined, once
for each distinct text; only texts with a shared one are read again, and the
windows around it are joined with the items' windows. That is three passes over the
documents whatever the benchmark's size, and no item passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.sources.scratch import save
from loomery.llm.words import FACTOR_A, FACTOR_B, groups, hash_words, mix, run_hashes

#: A table of bits for the items' prints has at most 2 to the power of this, that is 16 MB.
FILTER_BITS = 27
#: Digits, a-z and all bytes of other characters stay, A-Z is lowered, the rest parts words.
TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def word_hashes(data: bytes) -> np.ndarray:
    return hash_words(data.translate(TABLE))


def run_hash_at(h: np.ndarray, at: np.ndarray, n: int, factor: int) -> np.ndarray:
    """What run_hashes gives at the positions ``at``."""
    out, by = h[at], np.uint64(factor)
    for k in range(1, n):
        out = out * by + h[at + k]
    return mix(out)


def winnow(h: np.ndarray, left: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints; ``left`` is how many words the text has from each on."""
    grams = run_hashes(h, gram, FACTOR_A)
    m, span = len(h) - window + 1, window - gram + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least, place = grams[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, span):
        other = grams[k : k + m]
        lower = other <= least
        least[lower] = other[lower]
        place[lower] = k
    kept = np.zeros(len(h), bool)
    whole = np.flatnonzero(left[:m] >= window)
    kept[whole + place[whole]] = True
    at = np.flatnonzero(kept)
    return at, grams[at]


def prints_of(h: np.ndarray, left: np.ndarray, n: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) by which windows of ``n`` words are found: fingerprints, or all runs of a shorter item's length."""
    if n == window:
        return winnow(h, left, gram, n)
    runs = run_hashes(h, n, FACTOR_A)
    at = np.flatnonzero(left[: len(runs)] >= n)
    return at, runs[at]


def near_prints(h: np.ndarray, left: np.ndarray, n: int, gram: int, window: int, prints: np.ndarray) -> np.ndarray:
    """Starts of the runs of ``n`` words that hold one of ``prints``."""
    at, own = prints_of(h, left, n, gram, window)
    at = at[np.isin(own, prints)]
    if n < window:
        return at
    near = np.zeros(len(h) + 1, np.int32)
    np.add.at(near, np.maximum(at - (n - gram), 0), 1)
    np.add.at(near, at + 1, -1)
    return np.flatnonzero((np.cumsum(near)[:-1] > 0) & (left >= n))


class Block:
    """Fingerprints and windows of some items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, gram: int) -> None:
        self.window, self.gram = window, gram
        self.names = [name for name, _ in items]
        prints: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            h = word_hashes(text)
            n = min(len(h), window)
            if n == window:
                prints.append(winnow(h, len(h) - np.arange(len(h)), gram, window)[1])
            if n:
                a, b = (run_hashes(h, n, f) for f in (FACTOR_A, FACTOR_B))
                found.setdefault(n, []).append((a, b, np.full(len(a), k)))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        #: By length: sorted windows (two hashes), and for each its items from..to.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in found.items():
            a, b, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((k, b, a))
            a, b, k = a[order], b[order], k[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            once = np.concatenate(([True], ~(same & (k[1:] == k[:-1]))))
            a, b, k = a[once], b[once], k[once]
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            self.windows[n] = (a[new], b[new], np.append(new, len(k)), k)

    def hits(self, h: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, numbers in ``windows``): windows of the items in texts laid end to end."""
        for n, (a, b, _, _) in self.windows.items():
            at = near_prints(h, left, n, self.gram, self.window, self.prints if n == self.window else a)
            if not len(at):
                continue
            x, y = run_hash_at(h, at, n, FACTOR_A), run_hash_at(h, at, n, FACTOR_B)
            # equal first hashes with different second ones are next to each other
            low, high = np.searchsorted(a, x, "left"), np.searchsorted(a, x, "right")
            place = np.full(len(at), -1)
            while (open_ := (low < high) & (place < 0)).any():
                i = np.flatnonzero(open_)
                right = b[low[i]] == y[i]
                place[i[right]] = low[i][right]
                low[i] += 1
            at, place = at[place >= 0], place[place >= 0]
            if len(at):
                yield n, at, place

    def items_of(self, n: int, place: int) -> list[str]:
        _, _, bounds, items = self.windows[n]
        return [self.names[i] for i in items[bounds[place] : bounds[place + 1]].tolist() if self.names[i] is not None]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _past(block) -> Callable:
    """Puts spans, items and the number of words in the place of each document's ``__text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        for batch in batches:
            *columns, column = batch.columns
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            names: list[set[str]] = [set() for _ in range(batch.num_rows)]
            n_words = np.zeros(batch.num_rows, np.int64)
            for first, texts in groups(column):
                each = [word_hashes(t) for t in texts]
                sizes = np.array([len(x) for x in each], np.int64)
                n_words[first : first + len(texts)] = sizes
                starts = np.concatenate(([0], np.cumsum(sizes)))
                doc = np.repeat(np.arange(len(each)), sizes)
                left = starts[1:][doc] - np.arange(len(doc))
                cover = np.zeros(len(doc) + 1, np.int32)
                for n, at, place in own.hits(np.concatenate(each), left):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + n, -1)
                    for d, p in np.unique(np.stack([doc[at], place]), axis=1).T.tolist():
                        names[first + d].update(own.items_of(n, p))
                inside = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
                breaks = np.zeros(len(doc) + 1, bool)
                breaks[starts] = True
                begins = np.flatnonzero(inside[1:] & (~inside[:-1] | breaks))
                ends = np.flatnonzero(inside[:-1] & (~inside[1:] | breaks))
                for d, s, e in zip(doc[begins].tolist(), begins.tolist(), ends.tolist(), strict=True):
                    spans[first + d].append({"start": s - int(starts[d]), "end": e - int(starts[d])})
            state = [pa.array(spans, SPANS), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(n_words)]
            yield pa.RecordBatch.from_arrays([*columns, *state], [*batch.schema.names[:-1], "__spans", "__items", "__n_words"])

    return run


def _words_left(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = word_hashes(text or b"")
    return h, len(h) - np.arange(len(h))


def _rows(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Parts of equal columns end to end; a column of one value in a part is repeated."""
    columns = []
    for k in range(len(names)):
        values = [np.full(len(part[-1]), part[k]) if np.ndim(part[k]) == 0 else part[k] for part in parts]
        values = np.concatenate(values) if values else np.empty(0, np.int64)
        columns.append(pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)))
    return pa.RecordBatch.from_arrays(columns, names)


def _item_windows(window: int) -> Callable:
    """(item, text) to (item, n, a, b): the distinct windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                h = word_hashes(text or b"")
                if n := min(len(h), window):
                    a, b = np.unique(np.stack([run_hashes(h, n, f) for f in (FACTOR_A, FACTOR_B)]), axis=1)
                    found = _rows([(n, a, b)], ["n", "a", "b"])
                    item = pa.array([batch.column(0)[k].as_py()] * len(a), pa.string())
                    yield pa.RecordBatch.from_arrays([item, *found.columns], ["item", "n", "a", "b"])

    return run


def _item_prints(window: int, gram: int) -> Callable:
    """(text) to (n, p): what its windows are found by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h, left = _words_left(text)
                if n := min(len(h), window):
                    yield _rows([(n, np.unique(prints_of(h, left, n, gram, window)[1]))], ["n", "p"])

    return run


def _filter_words(prints: DataFrame, bits: int) -> np.ndarray:
    """A bit for each print of ``prints`` (n, p) in a table of ``bits``, a power of two; built by the tasks, 64 bits a row."""
    place = F.col("p").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = prints.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def _may_be(words: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The ``prints`` whose bit is set."""
    place = prints & np.uint64(64 * len(words) - 1)
    return prints[(words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]


def _text_prints(lengths: list[int], window: int, gram: int, held: Broadcast) -> Callable:
    """(x, y, text) to (x, y, n, p) for all lengths of windows, only prints that an item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (x, y), text in zip(keys, batch.column(2).to_pylist(), strict=True):
                h, left = _words_left(text)
                yield _rows([(x, y, n, _may_be(words, np.unique(prints_of(h, left, n, gram, window)[1]))) for n in lengths], ["x", "y", "n", "p"])

    return run


def _text_windows(window: int, gram: int) -> Callable:
    """(x, y, text, prints of n and p) to (x, y, start, n, a, b): the windows around shared prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, text, prints in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h, left = _words_left(text)
                parts = []
                for n in sorted({r["n"] for r in prints}):
                    own = np.array([r["p"] for r in prints if r["n"] == n], np.int64).view(np.uint64)
                    at = near_prints(h, left, n, gram, window, own)
                    parts.append((x, y, at, n, run_hash_at(h, at, n, FACTOR_A), run_hash_at(h, at, n, FACTOR_B)))
                yield _rows(parts, ["x", "y", "start", "n", "a", "b"])

    return run


def _joined(texts: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """``x, y, __spans, __items`` of the ``texts`` (x, y, text) with windows of ``items`` (item, text)."""
    windows = save(items.mapInArrow(_item_windows(window), "item string, n long, a long, b long"), "item-windows")
    prints = save(items.select("text").mapInArrow(_item_prints(window, gram), "n long, p long").distinct(), "item-prints")
    lengths = sorted(r.n for r in prints.select("n").distinct().collect())  # at most ``window`` numbers
    bits = 1 << max(6, min(FILTER_BITS, (16 * prints.count()).bit_length()))
    held = texts.sparkSession.sparkContext.broadcast(_filter_words(prints, bits))
    own = texts.mapInArrow(_text_prints(lengths, window, gram, held), "x long, y long, n long, p long")
    shared = own.join(prints, ["n", "p"], "left_semi").groupBy("x", "y").agg(F.collect_set(F.struct("n", "p")).alias("prints"))
    shared = save(shared, "shared-prints")
    near = texts.join(shared, ["x", "y"]).groupBy("x", "y").agg(F.first("text").alias("text"), F.first("prints").alias("prints"))
    near = near.mapInArrow(_text_windows(window, gram), "x long, y long, start long, n long, a long, b long")
    key = ["n", "a", "b"]
    hits = save(near.join(windows.select(*key).distinct(), key, "left_semi"), "hit-windows")
    own_text = Window.partitionBy("x", "y").orderBy("start", "end")
    spans = hits.select("x", "y", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    earlier = F.max("end").over(own_text.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("start") > earlier).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(own_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("x", "y", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    names = hits.select("x", "y", *key).distinct().join(windows.where("item IS NOT NULL").distinct(), key).select("x", "y", "item").distinct()
    names = names.groupBy("x", "y").agg(F.sort_array(F.collect_list("item")).alias("__items"))
    return save(spans.join(names, ["x", "y"], "left"), "hit-texts")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    window: int = 13,
    gram: int = 5,
    block_bytes: int = 4 << 20,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The columns ``keep`` and ``__n_words``, ``__n_hit``, ``__items``, ``__spans`` of each row of ``docs``.

    A window is ``window`` consecutive words of an item, or all of a shorter
    item. The spans are the merged word ranges [start, end) of a document that
    windows cover, ``__n_hit`` is their words, ``__items`` the ids, sorted as
    strings, of the items that have a window there.

    Items of at most ``block_bytes`` (texts and ids) are broadcast, more are
    joined. Null texts have no words. An item without an id hits but is not
    listed; rows of equal item id are one item in the list. Rows of ``docs``
    with equal or null ids stay rows of their own. Other columns are not read,
    and no column of ``keep`` has a name with leading ``__``.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    size = items.agg(F.sum(16 + F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0]
    few = (size or 0) <= block_bytes
    block = Block([(r["item"], bytes(r["text"] or b"")) for r in items.collect()] if few else [], window, gram)
    key = [] if few else [F.xxhash64(text).alias("__x"), F.xxhash64(F.lit(1), text).alias("__y")]
    schema = [*[f"`{c}` {kinds[c]}" for c in keep], *(["__x long", "__y long"] if key else [])]
    schema += ["__spans array<struct<start: bigint, end: bigint>>", "__items array<string>", "__n_words long"]
    found = docs.select(*keep, *key, text.alias("__text")).mapInArrow(_past(spark.sparkContext.broadcast(block)), ", ".join(schema))
    if not few:
        hits = _joined(docs.select(*[k.alias(c) for k, c in zip(key, "xy", strict=True)], text.alias("text")), items, window, gram)
        hits = hits.toDF("__x", "__y", "__own_spans", "__own_items")
        own = [F.coalesce(f"__own_{c}", f"__{c}").alias(f"__{c}") for c in ("spans", "items")]
        found = found.join(hits, ["__x", "__y"], "left").select(*keep, *own, "__n_words")
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(*keep, "__n_words", n_hit.alias("__n_hit"), "__items", "__spans")


def is_contaminated() -> Column:
    """Hit, and at least one word in twenty is."""
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))
