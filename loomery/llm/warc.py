"""WARC archives: a monolithic gzip normaliser and what stands before and after it.

``write_monolithic`` writes records as whole-file gzip streams, the form from
which no record can be read alone. ``normalise`` inflates such a file once, front
to back, writes every record as a gzip member of its own, and beside the archive
an index with a line ``offset length record-id`` for each record.
``read_records`` seeks by that index.

Tasks write through pyarrow's file systems into the shared folder, each attempt
under names of its own. What counts is the list of files that a Spark write
commits, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.sources.scratch import new_path, save

CHUNK, GZIP = 1 << 20, 31
ID = "urn:x-page:"
# Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """A response, or a revisit that repeats the response's HTTP header without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    named = lambda i: ID + urllib.parse.quote(str(i), safe="")
    own = named(page_id) if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{named(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a header, names in lower case."""
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, in chunks."""
    inflater, used = zlib.decompressobj(GZIP), False
    while data := stream.read(CHUNK):
        while data:
            out = inflater.decompress(data, CHUNK * 4)
            used = True
            if out:
                yield out
            if inflater.eof:
                data, inflater, used = inflater.unused_data, zlib.decompressobj(GZIP), False
            else:
                data = inflater.unconsumed_tail
    if used:
        raise ValueError("a gzip stream ends early")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC stream; one record and one chunk are held at once."""
    held = bytearray()
    need = -1
    for chunk in chunks:
        held += chunk
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held.strip():
        raise ValueError("a WARC stream ends within a record")


def parse(raw: bytes) -> tuple[str, dict[str, str], dict[str, str], bytes]:
    """(type, WARC fields, HTTP fields, payload)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = fields(head)
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return named["warc-type"], named, fields(http), payload


def _writing(folder: str, most_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out, path, done = None, "", []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, html, digest, refers_to = (v.as_py() for v in row)
                if out is None:
                    path, size, n = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, deflate = store.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP)
                raw = record(page_id, url, html or b"", digest, refers_to)
                out.write(deflate.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= most_bytes:
                    out.write(deflate.flush())
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return run


def _normalising(folder: str, skip_damaged: bool) -> Callable:
    def rewritten(store: fs.FileSystem, path: str, name: str) -> int:
        offset, lines = 0, []
        with store.open_input_stream(path, compression=None) as stream, store.open_output_stream(name, compression=None) as out:
            for raw in split_records(inflate(stream)):
                deflate = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                member = deflate.compress(raw) + deflate.flush()
                out.write(member)
                lines.append(f"{offset} {len(member)} {fields(raw[: raw.find(b'\r\n\r\n')])['warc-record-id']}\n")
                offset += len(member)
        with store.open_output_stream(f"{name}.idx", compression=None) as out:
            out.write("".join(lines).encode())
        return len(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                name = f"{at}/{uuid.uuid4().hex}.warc.gz"
                try:
                    done.append((path, name, f"{name}.idx", rewritten(store, path, name), None))
                except (zlib.error, ValueError, KeyError) as error:  # what a damaged file gives
                    if not skip_damaged:
                        raise ValueError(f"{path} is damaged: {error}") from error
                    store.delete_file(name)
                    done.append((path, None, None, 0, str(error)))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["source", "path", "index_path", "records", "error"])

    return run


def _reading(folder: str) -> Callable:
    names = ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(index, compression=None) as stream:
                    places = [line.split(" ", 2) for line in stream.read().decode().splitlines()]
                rows, size = [], 0
                with store.open_input_file(path) as file:
                    for offset, length, own in places:
                        file.seek(int(offset))
                        kind, warc, http, payload = parse(zlib.decompress(file.read(int(length)), GZIP))
                        digest = warc["warc-payload-digest"].removeprefix("sha256:")
                        if warc["warc-record-id"] != own or kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path} at {offset} is not the record that its index names")
                        refers = warc.get("warc-refers-to")
                        rows.append((own.strip("<>"), kind, int(http["content-length"]), digest, refers and refers.strip("<>"), payload))
                        size += len(payload)
                        if size >= 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)

    return run


TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def _dealt(files: DataFrame) -> DataFrame:
    """A task for each file, up to some thousands."""
    return files.repartition(max(1, min(files.count(), 5000)))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_monolithic(pages: DataFrame, folder: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Write (page_id, url, html, digest, refers_to) as WARC files of one gzip stream each.

    Returns the table of files, ``path`` and ``records``. A task starts another
    file after ``most_bytes`` of records. A null ``refers_to`` makes a response.
    """
    return save(pages.mapInArrow(_writing(folder, most_bytes), "path string, records long"), "monolithic")


def normalise(files: DataFrame, folder: str, skip_damaged: bool = False) -> DataFrame:
    """Rewrite whole-file gzip WARCs with a member for each record and a sidecar index.

    Files that have members already, or several records to a member, do as well.
    Returns ``source``, ``path``, ``index_path``, ``records`` and ``error``. A
    file that ends early or isn't one of records raises with its path; with
    ``skip_damaged`` it has its ``error`` and no path, and read_records() leaves
    it out.
    """
    schema = "source string, path string, index_path string, records long, error string"
    return save(_dealt(files).select("path").mapInArrow(_normalising(folder, skip_damaged), schema), "normalised")


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """One row for each record that the indexes name, read by its offset and verified."""
    schema = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    return _dealt(files.where("path IS NOT NULL")).select("path", "index_path").mapInArrow(_reading(folder), schema)


def archive_pages(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of ``pages``, normalise the archives and read them back.

    Returns ``page_id``, ``record_type``, ``payload_bytes``, ``payload_digest``,
    ``refers_to`` and ``payload`` (empty for revisits). Among equal payloads of
    at least ``least_bytes`` bytes the smallest id is a response, others revisit
    it; smaller payloads are responses.

    Ids may be of any type that casts to text and back. A null html is an empty
    payload. Rows that share the smallest id are all
    responses; a row without an id is a response unless a row with an id has its
    payload. Other columns are not read. The payloads move once, to be joined by
    digest with the digests that repeat; a repeated digest of many rows is split
    or its side broadcast. The monolithic files are deleted when rewritten.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= least_bytes
    repeats = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = save(repeats.where("n > 1").select("digest", "first"), "repeated-payloads")
    joined = rows.join(repeats, "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = joined.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))
    first, second = new_path(spark, "warc-monolithic"), new_path(spark, "warc")
    files = normalise(write_monolithic(joined, first), second)
    delete(spark, first)
    own = lambda c: F.when(F.startswith(F.col(c), F.lit(ID)), F.url_decode(F.substring(F.col(c), len(ID) + 1, 1 << 20))).cast(kind)
    records = read_records(files, second)
    return records.select(own("record_id").alias("page_id"), "record_type", "payload_bytes", "payload_digest", own("refers_to").alias("refers_to"), "payload")
