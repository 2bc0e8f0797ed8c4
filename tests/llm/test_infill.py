from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomery.llm.infill import fill_in_middle, restored
from tests.llm.conftest import TEXTS


def brute(i, text):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), out


def check(df, rows, **given):
    made = fill_in_middle(df, ["doc_id"], **given)
    got = made.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got) == Counter((i, *brute(i, t), t or "") for i, t in rows)
    return got


def test_equals_brute_force(spark):
    rng = random.Random(3)
    chars = ["a", "Bc", " ", "\n", "1", "é", "漢", "👩‍👧", "<", "P>", "<S", ">", "'", "\\", "\0"]
    rows = [(i, "".join(rng.choices(chars, k=rng.randrange(40)))) for i in range(400)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_marked_and_odd_rows(spark, odd, none):
    rows = [(i, t) for i in range(4) for t in ("a <P> b", "<S>", "x<M>", "<P", "plain text")] + [(None, None), (9, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    check(odd, TEXTS, part_bytes=7)
    assert fill_in_middle(none, ["doc_id"]).collect() == []


def test_kept_columns_and_markers(spark):
    df = spark.createDataFrame([(1, "one two", 5, [1])], "doc_id long, text string, n int, form array<int>")
    row = fill_in_middle(df, ["n", "form", "text"], markers=("[[p", "[[s", "[[m")).first()
    assert (row.n_, row.form_, row.text, row.n) == (5, [1], "one two", 3)
    for wrong in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "a", "b"), ("aa", "a", "b")):
        with pytest.raises(ValueError):
            fill_in_middle(df, ["n"], markers=wrong)
