"""SimHash near-dedup: fingerprints joined with themselves by a binary trie.

Fingerprints are reduced to the distinct ones first, so a group of copies is one
fingerprint however large it is. Four tries hold each fingerprint rotated by 0,
16, 32 and 48 bits: of two fingerprints that differ in at most 3 bits, one of the
four 16-bit blocks is equal, so in one of the tries the two share the first 16
levels. The subtrees at level 16 are the units of work, dealt out by a shuffle.

In a unit, pairs of trie nodes are walked together from the top. A pair carries
the bits in which its two paths differ so far and is dropped once they exceed the
budget. Nodes are ranges of the sorted fingerprints, so a whole level of pairs is
a few array operations. A unit of more than ``unit_rows`` fingerprints is first
divided, by the same walk over its next 8 levels, into pairs of subtrees that
become units of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.components import connected_components
from loomery.llm.names import named, numbered
from loomery.sources.scratch import save
from loomery.llm.words import slices

BITS, BLOCK, SPLIT = 64, 16, 8

#: Pairs of nodes walked at once.
FRONTIER = 1 << 20


def shingle_hashes(data: bytes, n: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the runs of ``n`` words joined by spaces; of all words, if fewer."""
    held: list[bytes] = []
    total = 0
    for part in slices(data):
        words = held + part.split()
        total += len(words) - len(held)
        if len(words) >= n:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            runs = [line[s:e] for s, e in zip(begins[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
            yield np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in runs), np.uint64, len(runs))
        held = words[max(0, len(words) - n + 1) :]
    if 0 < total < n:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprint(data: bytes, n: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    ones, total = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(data.lower(), n, seed):  # bytes.lower() changes A-Z only
        total += len(h)
        for at in range(0, len(h), 1 << 16):
            part = h[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def _fingerprints(n: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"", n, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


class Trie:
    """A binary trie over sorted 64-bit values, several tries end to end.

    A node is a range of positions; its children are parted by the number of
    zeros that the next bit has before each position.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.zeros: dict[int, np.ndarray] = {}

    def zeros_before(self, bit: int) -> np.ndarray:
        if bit not in self.zeros:
            zero = (self.values >> np.uint64(bit)) & np.uint64(1) == 0
            self.zeros[bit] = np.concatenate(([0], np.cumsum(zero)))
        return self.zeros[bit]

    def linked(self, pairs: tuple[np.ndarray, ...], budget: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Position pairs of different leaves under ``pairs`` that differ in at most ``budget`` bits.

        pairs: ranges [a0, a1) and [b0, b1), equal or disjoint, and the bits in
        which their paths differ above bit ``top``.
        """
        stack = [(top, pairs)]
        while stack:
            bit, pairs = stack.pop()
            if len(pairs[0]) > FRONTIER:
                half = len(pairs[0]) // 2
                stack += [(bit, tuple(x[half:] for x in pairs)), (bit, tuple(x[:half] for x in pairs))]
                continue
            a0, a1, b0, b1, err = pairs
            if bit < 0:
                yield a0, b0
                continue
            before = self.zeros_before(bit)
            am, bm = a0 + (before[a1] - before[a0]), b0 + (before[b1] - before[b0])
            more = err < budget
            out = []
            for p0, p1, q0, q1, e, ok in (
                (a0, am, b0, bm, err, True),
                (am, a1, bm, b1, err, True),
                (a0, am, bm, b1, err + 1, more),
                (am, a1, b0, bm, err + 1, more & (a0 != b0)),  # of a node with itself, the mirror image
            ):
                live = ok & (p1 > p0) & (q1 > q0) & ((p0 != q0) | (p1 - p0 > 1))
                out.append((p0[live], p1[live], q0[live], q1[live], e[live]))
            merged = tuple(np.concatenate(x) for x in zip(*out, strict=True))
            if len(merged[0]):
                stack.append((bit - 1, merged))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions the least one that the pairs connect it with."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _links(depth: int, budget: int) -> Callable:
    """Edges that span the components of each unit; a unit's rows come together."""
    rest = BITS - BLOCK - SPLIT * depth
    ready = 1 << 16

    def solve(turn: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch | None:
        side = (value >> np.uint64(rest)).view(np.int64) != a
        order = np.lexsort((value, side, b, a, turn))
        turn, a, b, value, side = turn[order], a[order], b[order], value[order], side[order]
        unit = (turn[1:] != turn[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new = np.flatnonzero(np.concatenate(([True], unit | (side[1:] != side[:-1]))))
        end = np.append(new[1:], len(value))
        own = np.concatenate(([0], np.cumsum(unit)))[new]
        alone = np.flatnonzero(a[new] == b[new])
        left = np.flatnonzero(own[1:] == own[:-1])
        x, y = np.concatenate((alone, left)), np.concatenate((alone, left + 1))
        x, y = x[live := (x != y) | (end[x] - new[x] > 1)], y[live]
        if not len(x):
            return None
        differ = (a[new[x]] ^ b[new[x]]).view(np.uint64)
        err = np.unpackbits(differ.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1, dtype=np.int64)
        label = spanning(len(value), Trie(value).linked((new[x], end[x], new[y], end[y], err), budget, rest - 1))
        at = np.flatnonzero(label != np.arange(len(label)))
        by = (BLOCK * turn[at]).astype(np.uint64)
        back = lambda v: ((v >> by) | (v << ((np.uint64(BITS) - by) % np.uint64(BITS)))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back(value[at])), pa.array(back(value[label[at]]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(x[0]) for x in held) < ready:
                continue
            turn, a, b, value = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.flatnonzero((turn[1:] != turn[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last unit may go on in the next batch
            held = [(turn[cut:], a[cut:], b[cut:], value[cut:])]
            if cut and (found := solve(turn[:cut], a[:cut], b[:cut], value[:cut].view(np.uint64))):
                yield found
        if held:
            turn, a, b, value = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(turn) and (found := solve(turn, a, b, value.view(np.uint64))):
                yield found

    return run


def hamming_edges(fps: DataFrame, budget: int = 3, unit_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect the distinct values ``fp`` as links of at most ``budget`` bits do.

    An edge stands for a chain of links: each unit gives a spanning forest of
    its linked pairs, never the pairs themselves. ``budget`` is at most 3.
    """
    if not 0 <= budget < BITS // BLOCK:
        raise ValueError("the equal block is only certain for a budget of at most 3 bits")
    turned = lambda t: F.shiftleft("fp", t).bitwiseOR(F.shiftrightunsigned("fp", BITS - t))
    tries = F.array(*[F.struct(F.lit(k).alias("turn"), turned(BLOCK * k).alias("value")) for k in range(BITS // BLOCK)])
    top = F.shiftrightunsigned("value", BITS - BLOCK)
    units = fps.select(F.inline(tries)).select("turn", top.alias("a"), top.alias("b"), "value")
    masks = [m for m in range(1 << SPLIT) if m.bit_count() <= budget]
    out, key = [], ["turn", "a", "b"]
    for depth in range((BITS - BLOCK) // SPLIT + 1):
        large = save(units.groupBy(*key).count().where(F.col("count") > unit_rows).select(*key), "large-units")
        last = large.isEmpty()
        small = units if last else units.join(large, key, "left_anti")
        small = small.repartition(*key).sortWithinPartitions(*key)
        out.append(small.mapInArrow(_links(depth, budget), "a long, b long"))
        if last:
            break
        rest = BITS - BLOCK - SPLIT * (depth + 1)
        own, mask = F.shiftrightunsigned("value", rest), F.col("mask").cast("long")
        other = own.bitwiseXOR(mask).bitwiseXOR(F.shiftleft(F.col("a").bitwiseXOR(F.col("b")), SPLIT))
        divided = units.join(large, key, "left_semi").select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
        divided = divided.select("turn", "value", own.alias("own"), other.alias("other"))
        divided = divided.where(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= budget)
        units = divided.select("turn", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "value")
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(
    df: DataFrame, budget: int = 3, shingle: int = 3, seed: int = 42, unit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``df``: the id, ``fp`` (64 bits as a long) and ``component_id``.

    Fingerprints link at ``budget`` or fewer differing bits; ``component_id`` is
    the smallest id that links reach. A null, empty or blank text has
    fingerprint 0, which links like any other. Null ids are never the smallest,
    so a component of null ids alone has a null ``component_id``. Repeated rows
    and ids get equal results. Other columns of ``df`` are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = save(texts.mapInArrow(_fingerprints(shingle, seed), f"id {kind}, fp long"), "fingerprints")
    first = save(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = connected_components(hamming_edges(first.select("fp"), budget, unit_rows))
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    found = first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    found = save(found, "fingerprint-components")  # so that the last join can split a fingerprint of many rows
    return prints.join(found, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each_group(df: DataFrame, budget: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``df`` with the smallest id in each component of near duplicates.

    Ids order first, nulls last, then a hash of the whole row, so that rows
    that share an id are still told apart; of fully equal rows one stays. An
    empty table gives none, and columns may have any names.
    """
    own = df.columns
    columns = [f"c{k}" for k in range(len(own))]
    rows = df.select(*numbered(own))
    key, text = (columns[own.index(c)] for c in (id_col, text_col))
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(*columns).alias("row"))
    found = near_duplicates(rows.select(rank.alias("rank"), F.col(text).alias("text")), budget, shingle, seed, id_col="rank", text_col="text")
    first = save(found.where(F.col("rank") == F.col("component_id")).groupBy("rank").count(), "kept-rows")
    chosen = rows.select("*", F.xxhash64(*columns).alias("row"))
    names = first.select(F.col("rank.row").alias("of_row"), F.col("rank.id").alias("of_id"))
    match = (chosen["row"] == names["of_row"]) & F.col(key).eqNullSafe(F.col("of_id"))
    kept = chosen.join(names, match, "left_semi")
    if not first.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["row", key])
    return kept.select(*named(own))
