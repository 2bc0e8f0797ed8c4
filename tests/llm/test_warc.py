from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from loomery.llm.warc import archive_pages, inflate, parse, record, split_records

BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [
    (5, "http://a/1", BIG),
    (3, "http://a/2", BIG),
    (9, None, BIG),
    (None, "http://a/3", BIG),
    (3, "http://a/2", BIG),
    (10, "http://a/ü ä\r\nX: y", "short"),
    (11, "http://a/5", "short"),
    (12, "http://a/6", None),
    (13, "http://a/7", ""),
    (14, "http://a/8", "\r\n\r\nWARC/1.1\r\n\r\n" * 20),
    (15, "http://a/9", "é" * 50),
    (16, "http://a/9", "é" * 50),
    (17, "http://a/10", "e" * 99),
    (18, "http://a/10", "e" * 99),
    (None, "http://a/11", "only without an id " * 30),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    got = archive_pages(df).collect()
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == payload and p is not None]
        first = min(same) if same and len(payload) >= 100 else i
        revisit = first != i
        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None, b"" if revisit else payload))
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_any_gzip_members_are_inflated():
    raws = [record(k, f"http://x/{k}", b"payload %d" % k * k, "d", None if k % 2 else 1) for k in range(1, 30)]
    stream = gzip.compress(b"".join(raws[:10])) + b"".join(map(gzip.compress, raws[10:]))
    assert list(split_records(inflate(io.BytesIO(stream)))) == raws
    assert parse(raws[0])[3] == b"payload 1" and parse(raws[1])[0] == "revisit"
    with pytest.raises((ValueError, EOFError)):
        list(split_records(inflate(io.BytesIO(stream[:-9]))))


def test_ids_of_any_characters(spark):
    ids = ["a b", "x\r\ny: z", "<1>", "ü+%41", "", "a b c"]
    df = spark.createDataFrame([(i, None, BIG if k % 2 else "short") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in archive_pages(df).collect()}
    assert got == {i: ("revisit", min(ids[1::2])) if k % 2 and i != min(ids[1::2]) else ("response", None) for k, i in enumerate(ids)}


def test_damaged_files_are_named(spark):
    import zlib
    from pathlib import Path

    from loomery.llm.warc import normalise, read_records
    from loomery.sources.scratch import new_path

    folder = Path(new_path(spark, "damaged").removeprefix("file:"))
    folder.mkdir(parents=True)
    whole = gzip.compress(b"".join(record(k, None, b"text", hashlib.sha256(b"text").hexdigest(), None) for k in range(3)))
    broken = {"cut": whole[:-30], "noise": b"no gzip", "torn": gzip.compress(zlib.decompress(whole, 31)[:-9]), "good": whole}
    for name, data in broken.items():
        (folder / name).write_bytes(data)
    files = spark.createDataFrame([(str(folder / n),) for n in broken], "path string")
    out = new_path(spark, "normalised")
    done = {Path(r.source).name: (r.records, r.error) for r in normalise(files, out, skip_damaged=True).collect()}
    assert done["good"] == (3, None) and all(done[n][0] == 0 and done[n][1] for n in ("cut", "noise", "torn"))
    assert read_records(normalise(files, out, skip_damaged=True), out).count() == 3
    with pytest.raises(Exception, match="is damaged"):
        normalise(files, out)


def test_a_long_page(spark):
    html = "<p>" + "words " * 3_000_000
    row = archive_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert row.payload_bytes == len(html) and row.payload_digest == hashlib.sha256(html.encode()).hexdigest()
