"""Fill-in-middle: texts cut into prefix, middle and suffix by DuckDB inside Arrow batches.

A text is a row of units: runs of the letters A to Z, and single other
characters. Where it is cut, whether it stays plain and in which order the parts
stand follow from a hash of its id, so reruns and retried tasks agree. A batch
is registered with an in-memory DuckDB in parts of bounded size, one SQL
statement makes the examples, and its Arrow result goes back; no row is touched
in Python and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.names import named, numbered

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Bytes of text that DuckDB is given at once, or one text. Lists of units take some 20 to 40 times as much.
PART = 4 << 20
#: What is returned beside the kept columns.
MADE = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
ARROW = {"long": pa.int64(), "string": pa.string()}


def _statement(plain_percent: int, spm_percent: int, seed: int, markers: tuple[str, str, str]) -> str:
    """The SQL over ``part`` (place, id, text)."""
    quoted = ["'" + m.replace("'", "''") + "'" for m in markers]
    p, s, m = quoted
    marked = " OR ".join(f"contains(text, {q})" for q in quoted)
    draw = [f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT" for k in range(4)]
    return f"""
    SELECT place, n, form,
           CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           CASE form WHEN 'plain' THEN text
                     WHEN 'psm' THEN concat({p}, prefix, {s}, suffix, {m}, middle)
                     ELSE concat({s}, suffix, {p}, prefix, {m}, middle) END AS output
    FROM (SELECT place, n, form, text,
                 array_to_string(list_slice(units, 1, least(one, two)), '') AS prefix,
                 array_to_string(list_slice(units, least(one, two) + 1, greatest(one, two)), '') AS middle,
                 array_to_string(list_slice(units, greatest(one, two) + 1, n), '') AS suffix
          FROM (SELECT place, text, units, len(units)::BIGINT AS n,
                       {draw[0]} % (len(units) + 1) AS one, {draw[1]} % (len(units) + 1) AS two,
                       CASE WHEN text = '' OR {marked} OR {draw[2]} % 100 >= {100 - plain_percent} THEN 'plain'
                            WHEN {draw[3]} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
                FROM (SELECT place, text, regexp_extract_all(text, '{UNIT}') AS units, sha256('{seed}:' || id) AS h FROM part)))"""


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of at most about ``size`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _maker(statement: str, kept: int, part_bytes: int) -> Callable:
    names = [f"c{k}" for k in range(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        con.execute("SET temp_directory = ''")  # nothing goes to the executor's own disk
        try:
            for batch in batches:
                for rows in _parts(batch, part_bytes):
                    place = pa.array(np.arange(rows.num_rows, dtype=np.int64))
                    con.register("part", pa.table([place, rows.column("id"), rows.column("text")], names=["place", "id", "text"]))
                    made = con.execute(statement).to_arrow_table()
                    con.unregister("part")
                    own = [rows.column(c).take(made.column("place").combine_chunks()) for c in names]
                    new = [made.column(c).cast(ARROW[t]).combine_chunks() for c, t in MADE.items()]
                    yield from pa.table([*own, *new], names=[*names, *MADE]).to_batches()
        finally:
            con.close()

    return run


def _check(markers: tuple[str, str, str]) -> None:
    """Markers must be found again: none may hold another, or end as another (or itself) begins."""
    for a in markers:
        for k, b in enumerate(markers):
            inside = a != b and a in b or markers.index(b) != k
            if not a or inside or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} can't be told apart")


def fill_in_middle(
    df: DataFrame,
    keep: Iterable[str],
    plain_percent: int = 10,
    spm_percent: int = 20,
    seed: int = 1,
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = PART,
) -> DataFrame:
    """One row for each row of ``df``: the columns of ``keep`` and an example of its text.

    ``n`` units, the ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (code points; null if plain) and the ``output``: prefix,
    suffix, middle behind their markers (psm), suffix before prefix (spm) or the
    text as it is. An empty text, or one that holds a marker, is plain.

    A null text is an empty one and a null id draws as an empty one. Rows of
    equal id draw alike, so equal rows give equal examples. A kept column with
    the name of a result gets an underscore behind it. An empty table gives
    none. A task holds one batch and the units of ``part_bytes`` of text, or of
    one text.
    """
    keep = list(keep)
    _check(markers)
    rows = df.select(*numbered(keep), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)] + [f"{c} {t}" for c, t in MADE.items()]
    made = rows.mapInArrow(_maker(_statement(plain_percent, spm_percent, seed, markers), len(keep), part_bytes), ", ".join(kinds))
    return made.select(*named(keep, MADE), *MADE)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an ``output`` of this ``form`` was made from."""
    pieces = F.split(output, "|".join(map(re.escape, markers)), -1)
    first, second, third = (F.get(pieces, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))
