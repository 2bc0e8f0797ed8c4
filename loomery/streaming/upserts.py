"""A keyed state that micro-batches are merged into: deltas by batch, buckets by key, compaction.

``delta/upsert_batch=<n>/upsert_bucket=<b>`` holds the latest version of each
key of batch n, so what a batch writes follows the batch and not the state.
Every so many batches the buckets that deltas touched, and only these, are
merged into ``base/upsert_batch=<n>/upsert_bucket=<b>``; a manifest, written
last, says which of these holds for each bucket and up to which batch. Readers
merge that with the deltas since. A batch that runs again after a failure
writes the same files again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

BATCH, BUCKET = "upsert_batch", "upsert_bucket"


class UpsertTable:
    """The state at ``path`` of rows of ``schema``; the greatest ``version`` of a ``key`` holds, of equal ones that of the later batch.

    A null key is a key; a null version is less than all others. Of rows of one
    key and version in one batch the one with the greatest hash holds. One
    stream writes; ``buckets`` stays as it was when the table was begun.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, version: str, buckets: int = 32, every: int = 8) -> None:
        if {BATCH, BUCKET} & set(schema.fieldNames()):
            raise ValueError(f"columns named {BATCH} or {BUCKET}")
        self.spark, self.path, self.schema, self.key, self.version = spark, path, schema, key, version
        self.buckets, self.every = buckets, every

    def write(self, batch: DataFrame, number: int) -> None:
        """The sink for foreachBatch."""
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        rows = self._latest(batch.select(*self.schema.fieldNames(), F.lit(number).alias(BATCH), bucket.alias(BUCKET)))
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/delta/{BATCH}={number}")
        if (number + 1) % self.every == 0:
            self.compact(number)

    def state(self) -> DataFrame:
        """The rows that hold now: of the base and of the deltas since."""
        manifest = self._manifest()
        base = [f"{BATCH}={n}/{BUCKET}={b}" for b, n in manifest["of"].items()]
        deltas = [name for name, n in self._numbered("delta") if n > manifest["batch"]]
        return self._latest(self._read("base", base).unionByName(self._read("delta", deltas))).select(*self.schema.fieldNames())

    def compact(self, number: int) -> None:
        """Merge the deltas up to batch ``number`` into the buckets that they touch."""
        manifest = self._manifest(before=number)
        deltas = [name for name, n in self._numbered("delta") if manifest["batch"] < n <= number]
        touched = sorted({b for name in deltas for _, b in self._numbered("delta", name)})
        base = [f"{BATCH}={manifest['of'][str(b)]}/{BUCKET}={b}" for b in touched if str(b) in manifest["of"]]
        rows = self._latest(self._read("base", base).unionByName(self._read("delta", deltas)))
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/base/{BATCH}={number}")
        line = json.dumps({"batch": number, "of": manifest["of"] | {str(b): number for b in touched}})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{BATCH}={number}")

    def vacuum(self) -> None:
        """Remove what neither the last two manifests nor a re-run of the last batch reads. Readers of older states must have ended."""
        last = self._manifest()
        before = self._manifest(before=last["batch"])
        for name, n in self._numbered("delta"):
            if n <= before["batch"]:
                self._delete("delta", name)
        for name, n in self._numbered("base"):
            for bucket, b in self._numbered("base", name):
                if n not in (last["of"].get(str(b)), before["of"].get(str(b))):
                    self._delete("base", name, bucket)
        for name, n in self._numbered("manifest"):
            if n < before["batch"]:
                self._delete("manifest", name)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key, with its bucket. Partial maxima form before the shuffle, so that a key of many versions is no burden."""
        columns = self.schema.fieldNames()
        order = F.struct(F.col(self.version), F.col(BATCH), F.xxhash64(*columns))
        best = rows.groupBy(BUCKET, F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*columns), order).alias("r"))
        return best.select("r.*", BUCKET)

    def _read(self, root: str, folders: list[str]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(BATCH, LongType()), StructField(BUCKET, IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{root}").parquet(*[f"{self.path}/{root}/{f}" for f in folders])

    def _manifest(self, before: int | None = None) -> dict:
        """The last manifest, of a batch under ``before``; ``of`` has the batch that each bucket's base was written by."""
        names = [name for name, n in self._numbered("manifest") if before is None or n < before]
        found = [json.loads(r.value) for r in self.spark.read.text([f"{self.path}/manifest/{n}" for n in names]).collect()] if names else []
        return max(found, key=lambda m: m["batch"], default={"batch": -1, "of": {}})

    def _at(self, *names: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbered(self, *names: str) -> list[tuple[str, int]]:
        """(name, number) of the folders ``<column>=<number>`` in a folder, in order."""
        at, files = self._at(*names)
        found = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()] if files.exists(at) else []
        return sorted(((f, int(f.split("=")[1])) for f in found if "=" in f), key=lambda x: x[1])

    def _delete(self, *names: str) -> None:
        at, files = self._at(*names)
        files.delete(at, True)
