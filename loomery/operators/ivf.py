"""An inverted-file index of vectors that is stored, reopened, appended to and read in part.

Centres come from k-means whose rounds are Spark jobs: a task sums its vectors
by nearest centre and only sums are shuffled. There are about the square root
of as many lists as vectors. A vector goes into the list of its nearest centre,
as a code of four bits a dimension in one table and whole in another; both are
folders by list, and a row's number joins them. A search ranks by codes what
stands in the lists nearest to each query and compares whole vectors only of
the best; folders of other lists aren't opened.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.vector import cosine
from loomery.operators.vectors import BLOCK_BYTES, _batch, _blocks, _one_block, _vectors, best
from loomery.sources.scratch import save

SHORT = "query_id long, vec_id long, list_id int, part string, row long, score double"
CODED = ["list_id", "folder", "scale", "code"]
VECTORS = "vec_id long, embedding array<float>, list_id int, part string, row long, folder int"
CODES = "vec_id long, list_id int, scale float, code binary, part string, row long, folder int"
KEPT = pa.schema([("vec_id", pa.int64()), ("list_id", pa.int32()), ("part", pa.string()), ("row", pa.int64())])
#: Rows of a short list (some 60 bytes each) that are broadcast.
BROADCAST = 200_000
#: Lists by folder; beyond it neighbouring lists share one.
FOLDERS = 1024


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; zero vectors stay."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of each vector, its values as 4-bit integers, two in a byte)."""
    scale = np.abs(vectors).max(1, initial=0) / 7
    values = np.rint(vectors / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8) + 8
    if values.shape[1] % 2:
        values = np.pad(values, ((0, 0), (0, 1)), constant_values=8)
    return scale, (values[:, ::2] << 4 | values[:, 1::2]).astype(np.uint8)


def decode(scale: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    values = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, :size].astype(np.float32) - 8
    return values * scale.astype(np.float32)[:, None]


def kmeans(points: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most ``k`` unit centres of ``points`` (vec_id, embedding), by ``rounds`` jobs of partial sums."""
    spark = points.sparkSession
    first = points.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(k)
    found = [r.embedding for r in first.collect()]
    if not found:
        return np.empty((0, 0))
    centres = _units(np.array(found, np.float64))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            total, count = np.zeros_like(own), np.zeros(len(own), np.int64)
            for batch in batches:
                vectors = _units(_batch(batch)[1])
                if len(vectors):
                    near = (vectors @ own.T).argmax(1)
                    np.add.at(total, near, vectors)
                    count += np.bincount(near, minlength=len(own))
            there = np.flatnonzero(count)
            width = own.shape[1]
            pos = pa.array(np.tile(np.arange(width, dtype=np.int32), len(there)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(there, width)), pos, pa.array(total[there].ravel())], ["centre", "pos", "value"])

        found = points.mapInArrow(sums, "centre long, pos int, value double").groupBy("centre", "pos").agg(F.sum("value").alias("value")).toArrow()
        centres = centres.copy()
        centres[found["centre"].to_numpy(), found["pos"].to_numpy()] = found["value"].to_numpy()
        centres = _units(centres)
        held.unpersist()
    return centres


class IvfIndex:
    """An index at ``path``, in a folder that driver and executors share.

    ``build`` makes one, ``IvfIndex(spark, path)`` opens it again, ``append``
    adds vectors to it. Rows without an id or a vector, and zero vectors, are
    nobody's neighbours and aren't indexed. An id may be added again; each row
    is a neighbour of its own.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        self.size, self.n_lists = meta["size"], meta["n_lists"]
        rows = spark.read.parquet(f"{path}/centres").orderBy("list_id").collect()
        self.centres = np.array([r.centre for r in rows], np.float64).reshape(len(rows), self.size)

    @classmethod
    def build(cls, df: DataFrame, path: str, n_lists: int | None = None, fit_rows: int = 64, rounds: int = 8, seed: int = 7) -> IvfIndex:
        """Index all of ``df`` (vec_id, embedding) with ``n_lists``, by default the square root of its rows.

        Centres are fitted on at most ``fit_rows`` vectors a list, those that a
        hash of the id puts first; the fit is spread over tasks. Every vector is
        indexed. The driver holds the centres alone.
        """
        spark, rows = df.sparkSession, _vectors(df)
        n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        n_lists = n_lists or max(1, math.isqrt(n))
        share = min(1.0, n_lists * fit_rows / max(n, 1))
        sample = rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        centres = kmeans(sample, n_lists, rounds, seed)
        made = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list_id int, centre array<double>")
        made.coalesce(1).write.parquet(f"{path}/centres")
        meta = json.dumps({"size": size, "n_lists": len(centres)})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
        index = cls(spark, path)
        index.append(df)
        return index

    @property
    def _folder(self) -> int:
        """Lists in a folder."""
        return max(1, -(-self.n_lists // FOLDERS))

    def append(self, df: DataFrame) -> None:
        """Add the vectors of ``df``. Whole vectors are written before codes, and both name their ``part``, so what a broken write left is never found."""
        held, size, folder = self.spark.sparkContext.broadcast(self.centres), self.size, self._folder

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vectors = _batch(batch)
                if len(ids) and vectors.shape[1] != size:
                    raise ValueError(f"a vector of {vectors.shape[1]} values in an index of {size}")
                keep = np.flatnonzero(np.linalg.norm(vectors, axis=1) > 0) if len(ids) else np.empty(0, np.int64)
                if not len(keep):
                    continue
                units = _units(vectors[keep])
                lists = np.concatenate([(units[k : k + 4096] @ held.value.T).argmax(1) for k in range(0, len(units), 4096)]).astype(np.int32)
                scale, codes = encode(units)
                own = [batch.column(c).take(pa.array(keep)) for c in ("vec_id", "embedding")]
                made = [pa.array(lists), pa.array(lists // folder), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *made], ["vec_id", "embedding", *CODED])

        kind = "vec_id long, embedding array<float>, list_id int, folder int, scale float, code binary"
        rows = _vectors(df).withColumn("embedding", F.col("embedding").cast("array<float>")).mapInArrow(coded, kind)
        rows = save(rows.withColumns({"part": F.lit(uuid.uuid4().hex), "row": F.monotonically_increasing_id()}), "vectors-coded")
        for name, columns in (("vectors", VECTORS), ("codes", CODES)):
            dealt = rows.select(*[c.split()[0] for c in columns.split(", ")]).hint("rebalance", "folder").sortWithinPartitions("folder", "list_id", "vec_id")
            dealt.write.mode("append").partitionBy("folder").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str, lists: np.ndarray | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        folders = None if lists is None else sorted({int(k) // self._folder for k in lists})
        return rows if folders is None else rows.where(F.col("folder").isin(folders))

    def search(self, queries: DataFrame, k: int, probes: int | float, refine: int = 10) -> DataFrame:
        """``query_id, vec_id, score, place``: the k nearest others by cosine, of those found.

        ``probes`` is a number of lists, or a share of them. The codes in the
        lists nearest to a query give its ``refine`` * k best; of these the
        whole vectors are compared.
        """
        n = math.ceil(probes * self.n_lists) if isinstance(probes, float) else min(probes, self.n_lists)
        short, lists = self._short(queries, n, refine * k + 1)  # a query finds itself
        short = save(best(short.where("query_id <> vec_id"), refine * k).drop("place", "score"), "ivf-short")
        few = short.count() <= BROADCAST
        whole = self._read("vectors", VECTORS, lists).join(F.broadcast(short) if few else short, ["vec_id", "list_id", "part", "row"])
        asked = _vectors(queries).toDF("query_id", "q")
        found = whole.join(F.broadcast(asked) if few else asked, "query_id")
        return best(found.select("query_id", "vec_id", cosine("q", "embedding").alias("score")).where("score IS NOT NULL"), k)

    def _short(self, queries: DataFrame, probes: int, most: int) -> tuple[DataFrame, np.ndarray | None]:
        """(``SHORT`` rows by codes, the lists that they are of)."""
        asked, context, centres, size = _vectors(queries), self.spark.sparkContext, self.centres, self.size
        if _blocks(asked, BLOCK_BYTES) <= 1:
            ids, vectors = _one_block(asked)
            units = _units(vectors.reshape(len(ids), -1)) if len(ids) else np.empty((0, size))
            near = _nearest(units, centres, probes)
            held = context.broadcast((ids, units, near))

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, units, near = held.value
                keeper = _Keeper(ids, most)
                for batch in batches:
                    of = batch.column("list_id").to_numpy()
                    for one in np.unique(of):
                        who, rows = np.flatnonzero((near == one).any(1)), np.flatnonzero(of == one)
                        if len(who):
                            keeper.add(who, units[who], batch.take(pa.array(rows)), size)
                yield keeper.rows()

            lists = np.unique(near)
            return self._read("codes", CODES, lists).drop("folder").mapInArrow(scan, SHORT), lists
        held = context.broadcast(centres)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vectors = _batch(batch)
                near = _nearest(_units(vectors), held.value, probes) if len(ids) else np.empty((0, probes), np.int64)
                take = pa.array(np.repeat(np.arange(len(ids)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("embedding").take(take), pa.array(near.ravel().astype(np.int32))], ["vec_id", "embedding", "list_id"])

        kind = asked.schema["embedding"].dataType.simpleString()
        left = save(asked.mapInArrow(spread, f"vec_id long, embedding {kind}, list_id int"), "ivf-probes")
        right = self._read("codes", CODES, None).drop("folder")
        per = max(1, BLOCK_BYTES // (8 * max(size, 1)))
        blocks = lambda rows, name: rows.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
        sizes = F.broadcast(blocks(left, "n_i").join(blocks(right, "n_j"), "list_id"))  # a row a list
        own = lambda n: F.pmod(F.xxhash64("vec_id", "row", "part"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = left.withColumns({"row": F.lit(0), "part": F.lit("")}).join(sizes, "list_id").select("vec_id", "embedding", "list_id", own("n_i").alias("i"), every("n_j").alias("j"))
        right = right.join(sizes, "list_id").select("vec_id", "list_id", "scale", "code", "part", "row", own("n_j").alias("j"), every("n_i").alias("i"))

        def cell(some: pa.Table, among: pa.Table) -> pa.Table:
            ids, vectors = _batch(some)
            keeper = _Keeper(ids, most)
            if len(ids):
                keeper.add(np.arange(len(ids)), _units(vectors), among.combine_chunks(), size)
            return pa.Table.from_batches([keeper.rows()])

        keys = ["list_id", "i", "j"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, SHORT), None


def _nearest(units: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` lists nearest to each vector."""
    if not len(units) or not len(centres):
        return np.empty((len(units), 0), np.int64)
    return np.argsort(-(units @ centres.T), axis=1, kind="stable")[:, :probes]


class _Keeper:
    """The ``most`` best by code of each query."""

    def __init__(self, ids: np.ndarray, most: int) -> None:
        self.ids, self.most = ids, most
        self.q, self.score, self.kept = np.empty(0, np.int64), np.empty(0, np.float32), KEPT.empty_table()

    def add(self, who: np.ndarray, units: np.ndarray, rows: pa.RecordBatch | pa.Table, size: int) -> None:
        n = rows.num_rows
        if not n:
            return
        rows = pa.table([rows.column(c) for c in KEPT.names], schema=KEPT), rows
        codes = np.frombuffer(b"".join(rows[1].column("code").to_pylist()), np.uint8).reshape(n, -1)
        scores = units.astype(np.float32) @ decode(rows[1].column("scale").to_numpy(), codes, size).T
        cut = min(n, self.most)
        top = np.argpartition(-scores, cut - 1, axis=1)[:, :cut]
        q = np.concatenate([self.q, np.repeat(who, cut)])
        score = np.concatenate([self.score, np.take_along_axis(scores, top, 1).ravel()])
        kept = pa.concat_tables([self.kept, rows[0].take(pa.array(top.ravel()))])
        order = np.lexsort((-score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[place < self.most]
        self.q, self.score, self.kept = q[order], score[order], kept.take(pa.array(order))

    def rows(self) -> pa.RecordBatch:
        kept = self.kept.combine_chunks()
        own = [kept.column(c).combine_chunks() if kept.num_rows else pa.array([], KEPT.field(c).type) for c in KEPT.names]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.q].astype(np.int64)), *own, pa.array(self.score.astype(np.float64))], ["query_id", *KEPT.names, "score"])
