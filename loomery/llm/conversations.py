"""Conversations as a prefix trie, by an external mergesort that knows common prefixes.

1. Turns are known by 128 bits of hash of role and text, so texts are read once
   and never shuffled. A sort by ranges of (conversation, turn) gives each turn
   its place; a conversation of any length is dealt over many tasks.
2. A conversation is a sequence of turns in segments of ``SEGMENT``; equal
   segments behind equal beginnings become one, with their number, before
   anything is sorted. Ranges of sequences are dealt to tasks, which sort them
   into runs with common prefix lengths and merge these (``lcp_merge``). Ranges
   part anywhere, so conversations that share a beginning fill many tasks.
3. What the merged stream leaves is finished. Nodes at the ends of a range, at
   most the turns of two segments for a task, are put together by their key.
4. Segments further on are worked first; what lies below a segment's last node
   goes into the merge of the segments before it. Conversations of up to
   ``SEGMENT`` turns need one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomery.llm.lcp_merge import FIELDS, Entry, LoserTree, packed, sorted_run, walk
from loomery.sources.scratch import save

#: Turns of a sequence that are sorted as one value.
SEGMENT = 512
#: Turns and sequences that a task merges, about.
TASK_TURNS = 200_000
#: Sequences of a run.
RUN = 4096
#: Rows of open nodes (some 50 bytes each) that are broadcast.
BROADCAST = 200_000
#: Bytes of ids in a block.
BLOCK = 1 << 20

Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Trie(NamedTuple):
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end_x, end_y; ``ends``: end_x, end_y, conv_id."""

    nodes: DataFrame
    ends: DataFrame


def _hashes(*of: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(*of), F.xxhash64(F.lit(1), *of)


def placed_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``conv, rank, x, y, chars`` of each turn; ``conv, n`` of each conversation).

    By turn, null first; turns of equal number by their hashes. The ranks come
    from the places within sorted ranges and how many turns lie in those before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    x, y = _hashes(role, text)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", x.alias("x"), y.alias("y"), F.length(text).alias("chars"))
    order = ["conv", "turn", "x", "y"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = save(rows.select("conv", "x", "y", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns-in-order")
    spans = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = save(spans.select("conv", "part", (F.col("first") - before).alias("first"), "m"), "turn-ranges")
    ranked = rows.join(spans.drop("m"), ["conv", "part"]).select("conv", (F.col("at") - F.col("first")).alias("rank"), "x", "y", "chars")
    return ranked, spans.groupBy("conv").agg(F.sum("m").alias("n"))


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(``conv, pos, x, y, chars`` of all turns; ``conv, length`` of all conversations).

    A conversation c begins with the first h turns of conversation c - c % group,
    h = crc32(c) % most, and goes on with its own behind its first h.
    """
    ranked, counts = placed_turns(turns)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    convs = counts.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"), h)
    lengths = counts.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = save(convs.select("conv", "base", "n", "h", "taken"), "conversations")
    own = ranked.join(convs.select("conv", "h", "taken"), "conv").where("rank >= h")
    own = own.select("conv", (F.col("rank") - F.col("h") + F.col("taken")).alias("pos"), "x", "y", "chars")
    first = ranked.where(F.col("rank") < most - 1).withColumnRenamed("conv", "base")
    lent = first.join(convs.select("conv", "base", "taken"), "base").where("rank < taken").select("conv", F.col("rank").alias("pos"), "x", "y", "chars")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return own.unionByName(lent), convs.select("conv", length.alias("length"))


def _segments(turns: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """``conv, level, turns, p_x, p_y, g_x, g_y``: segments with keys of what lies before them, and of that with them.

    The last segment of a conversation has fewer than ``size`` turns, so it may be empty.
    """
    rows = turns.select("conv", F.floor(F.col("pos") / size).cast("int").alias("level"), F.struct("pos", "x", "y", "chars").alias("t"))
    rows = rows.groupBy("conv", "level").agg(F.array_sort(F.collect_list("t")).alias("t"))
    rows = rows.select("conv", "level", F.transform("t", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["chars"].alias("chars"))).alias("turns"))
    empty = lengths.where(F.col("length") % size == 0).select("conv", (F.col("length") / size).cast("int").alias("level"), F.array().cast(rows.schema["turns"].dataType).alias("turns"))
    rows = rows.unionByName(empty)
    own = F.struct(*[h.alias(c) for h, c in zip(_hashes("turns"), ("x", "y"), strict=True)])
    rows = save(rows.withColumn("own", own), "segments")

    def keyed(some: DataFrame, before: Column, upto: Column) -> DataFrame:
        some = some.withColumns({"before": before, "upto": upto})
        keys = [h.alias(f"{c}_{a}") for c, of in (("p", "before"), ("g", "upto")) for h, a in zip(_hashes(of), "xy", strict=True)]
        return some.select("conv", "level", "turns", *keys)

    alone = (F.col("level") == 0) & (F.size("turns") < size)
    none = F.array().cast("array<struct<x:bigint,y:bigint>>")
    path = Window.partitionBy("conv").orderBy("level")
    several = keyed(
        rows.where(~alone),
        F.collect_list("own").over(path.rowsBetween(Window.unboundedPreceding, -1)),
        F.collect_list("own").over(path.rowsBetween(Window.unboundedPreceding, 0)),
    )
    return keyed(rows.where(alone), none, F.array("own")).unionByName(several)


def _entries(batch: pa.RecordBatch, size: int) -> list[Entry]:
    turns = batch.column("turns")
    flat = turns.flatten()
    tokens = list(map(packed, flat.field("x").to_pylist(), flat.field("y").to_pylist()))
    chars, lengths = flat.field("chars").to_pylist(), turns.value_lengths().to_pylist()
    own = zip(*(batch.column(c).to_pylist() for c in ("p_x", "p_y", "g_x", "g_y", "n", "least", "children", "leaves", "saved", "end_x", "end_y")), strict=True)
    found, at = [], 0
    for m, (px, py, gx, gy, n, least, children, leaves, saved, ex, ey) in zip(lengths, own, strict=True):
        ends = (gx, gy) if m < size else None if ex is None else (ex, ey)
        below = (children or 0, leaves or 0, saved or 0)
        found.append(Entry([packed(px, py), *tokens[at : at + m]], [0, *chars[at : at + m]], n, least, below, ends))
        at += m
    return found


def _merger(size: int, schema: pa.Schema) -> Arrow:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = [], []
        for batch in batches:
            held += _entries(batch, size)
            if len(held) >= RUN:
                runs.append(sorted_run(held))
                held = []
        if held:
            runs.append(sorted_run(held))
        rows = []
        for row in walk(LoserTree(runs)):
            rows.append(row)
            if len(rows) == RUN:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _joined(rows: DataFrame) -> DataFrame:
    """Open nodes put together: ``FIELDS`` without ``above``, whole figures."""
    one = rows.groupBy("key").agg(
        F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        F.min("least").alias("least"),
        *[F.max(c).alias(c) for c in ("chars", "end_x", "end_y", "root_x", "root_y", "parent_key")],
        F.first("above").alias("above"),
    )
    one = save(one, "open-nodes")
    kids = one.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    one = save(one.join(kids, "key", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).drop("kids"), "open-nodes")
    leaves = F.when((F.col("children") == 0) & (F.col("leaves") == 0), 1).otherwise(F.col("leaves"))
    saved = F.col("saved") + (F.col("n") - 1) * F.col("chars")
    up = one.select(F.explode(F.concat("above", F.array("key"))).alias("key"), leaves.alias("leaves"), saved.alias("saved"))
    up = up.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return save(one.drop("above", "leaves", "saved").join(up, "key"), "open-nodes")


def _level(sequences: DataFrame, size: int, tasks: int) -> DataFrame:
    """The nodes of one level's tries, each with ``parent_conv``; roots have theirs null."""
    kind = ", ".join(f"{c} {t}" for c, t in FIELDS.items())
    schema = to_arrow_schema(StructType.fromDDL(kind))
    dealt = sequences.repartitionByRange(tasks, "p_x", "p_y", "turns")
    raw = save(dealt.mapInArrow(_merger(size, schema), kind), "trie-rows")
    whole = _joined(raw.where("key IS NOT NULL"))
    plain = ["depth", "n", "least", "children", "leaves", "saved", "end_x", "end_y", "root_x", "root_y", "parent_conv"]
    parents = whole.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_conv"))
    parents = F.broadcast(parents) if parents.count() <= BROADCAST else parents
    below = raw.where("key IS NULL AND parent_key IS NOT NULL").drop("parent_conv").join(parents, "parent_key", "left")
    inner = raw.where("key IS NULL AND parent_key IS NULL")
    found = inner.select(plain).unionByName(below.select(plain))
    return found.unionByName(whole.drop("parent_conv").join(parents, "parent_key", "left").select(plain))


def prefix_trie(turns: DataFrame, lengths: DataFrame, size: int = SEGMENT, task_turns: int = TASK_TURNS) -> Trie:
    """The trie of conversations given as ``conv, pos, x, y, chars`` and ``conv, length``.

    ``x`` and ``y`` are a turn's hash; places go from 0 to length - 1.
    """
    segments = save(_segments(turns, lengths, size), "keyed-segments")
    keys = ["level", "p_x", "p_y", "g_x", "g_y"]
    distinct = segments.groupBy(*keys).agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"))
    distinct = save(distinct, "sequences")
    sizes = {r.level: r.m for r in distinct.groupBy("level").agg(F.sum(F.size("turns") + 1).alias("m")).collect()}
    nothing = distinct.sparkSession.createDataFrame([], "g_x long, g_y long, children long, leaves long, saved long, end_x long, end_y long")
    nodes, below = [], nothing
    for level in sorted(sizes, reverse=True):
        tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-sizes[level] // task_turns))
        own = distinct.where(F.col("level") == level).join(below, ["g_x", "g_y"], "left")
        found = save(_level(own, size, tasks), "trie-nodes")
        is_root = F.col("depth") == 0
        nodes.append((found.where(~is_root) if level else found).withColumn("depth", F.col("depth") + level * size))
        if level:
            below = found.where(is_root).select(F.col("root_x").alias("g_x"), F.col("root_y").alias("g_y"), "children", "leaves", "saved", "end_x", "end_y")
    if not nodes:
        nodes = [_level(distinct.join(nothing, ["g_x", "g_y"], "left"), size, 1)]
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    names = {"least": "conv_id", "depth": "depth", "parent_conv": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    out = out.select(*[F.col(c).cast("long").alias(n) for c, n in names.items()], "end_x", "end_y")
    ends = segments.where(F.size("turns") < size).select(F.col("g_x").alias("end_x"), F.col("g_y").alias("end_y"), F.col("conv").alias("conv_id"))
    return Trie(out, ends)


def conversation_trie(turns: DataFrame, group: int = 100, most: int = 6, size: int = SEGMENT, task_turns: int = TASK_TURNS) -> Trie:
    """The prefix trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    A null role or text is an empty one; null turns come first, and rows of
    equal turn stand in the order of a hash of role and text, repeated rows
    each for itself. Rows without a conv_id belong to no conversation. Further
    columns are not read. An empty table gives no nodes, not even a root.
    """
    return prefix_trie(*rebuilt(turns, group, most), size, task_turns)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end_x, end_y, conv_id) as blocks of comma-joined ids."""
    key, ids, held, rows = None, [], 0, []

    def block() -> dict:
        return {"end_x": key[0], "end_y": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}

    schema = pa.schema([("end_x", pa.int64()), ("end_y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for x, y, conv in zip(*(batch.column(c).to_pylist() for c in ("end_x", "end_y", "conv_id")), strict=True):
            if ids and (key != (x, y) or held >= BLOCK):
                rows.append(block())
                ids, held = [], 0
            key = (x, y)
            ids.append(conv)
            held += 8
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if ids:
        yield pa.RecordBatch.from_pylist([block()], schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks as one digest for each key; a block is held at a time."""
    key, digest = None, hashlib.sha256()
    schema = pa.schema([("end_x", pa.int64()), ("end_y", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        rows = []
        for x, y, ids in zip(*(batch.column(c) for c in ("end_x", "end_y", "ids")), strict=True):
            own = (x.as_py(), y.as_py())
            if key != own:
                if key is not None:
                    rows.append(dict(zip(schema.names, (*key, digest.hexdigest()), strict=True)))
                key, digest = own, hashlib.sha256(ids.as_py().encode())
            else:
                digest.update(b"," + ids.as_py().encode())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, digest.hexdigest()), strict=True))], schema)


def with_digests(trie: Trie) -> DataFrame:
    """The nodes with ``ends_sha256``: of the ids that end there, ascending, joined by commas; of an empty text for none.

    Ids are sorted by ranges of (node, id), so many at one node fill many tasks
    and leave them as blocks of about a megabyte; only these meet in one task,
    since the digest takes them one after the other.
    """
    order = ["end_x", "end_y", "conv_id"]
    blocks = trie.ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, "end_x long, end_y long, first long, ids string")
    blocks = blocks.repartition("end_x", "end_y").sortWithinPartitions("end_x", "end_y", "first")
    digests = blocks.mapInArrow(_hashed, "end_x long, end_y long, ends_sha256 string")
    ended = trie.nodes.where("end_x IS NOT NULL").join(digests, ["end_x", "end_y"], "left").drop("end_x", "end_y")
    others = trie.nodes.where("end_x IS NULL").drop("end_x", "end_y").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return ended.unionByName(others)
