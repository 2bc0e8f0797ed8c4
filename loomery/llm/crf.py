"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its emission reads features of the line itself and of
the lines before and after it; transitions say how likely neighbours agree.
Forward-backward gives each line's marginal probability of being good, and the
mean of these, weighted by the lines' lengths, is the score of the document.

The field is fitted on a bounded sample of labelled rows: every line of a sample
document carries the document's label. Labels, languages, sources and ids are
never features.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.words import groups
from loomery.sources.scratch import save

UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
SYMBOLS, MARKS, ENDS = b"#*$%&|<>@^~_=+\\{}[]", b"!?", (b".", b"!", b"?", b":", b'"')

#: Ratios also enter as whether they exceed each of these.
STEPS = np.array([0.01, 0.05, 0.15, 0.4])
RATIOS, PLAIN = 6, 7
WIDTH = PLAIN + RATIOS * (1 + len(STEPS))


#: Lines whose figures are held as Python numbers at once.
LINES = 20_000


def _raw(text: bytes) -> tuple[list[np.ndarray], list[int]]:
    """Of each line: six ratios, then seven plain values, in blocks of lines; and the lines' weights."""
    blocks, rows, weights, seen = [], [], [], set()
    for line in text.split(b"\n"):
        n = len(line)
        words = line.split()
        k = len(words)
        upper, lower = n - len(line.translate(None, UPPER)), n - len(line.translate(None, LOWER))
        same = sum(map(operator.eq, words, words[1:]))
        again = bool(k) and line in seen
        seen.add(line)
        rows.append(
            (
                upper / max(1, upper + lower),
                (n - len(line.translate(None, SYMBOLS))) / max(1, n),
                (n - len(line.translate(None, MARKS))) / max(1, n),
                (n - len(line.translate(None, DIGITS))) / max(1, n),
                same / max(1, k),
                1 - len(set(words)) / k if k else 0.0,
                1.0,
                np.log1p(n) / 8,
                np.log1p(k) / 8,
                min(n / max(1, k), 40) / 10,
                float(again),
                float(line.rstrip().endswith(ENDS)),
                float(k == 0),
            )
        )
        weights.append(max(1, n))
        if len(rows) == LINES:
            blocks.append(np.array(rows, np.float32))
            rows = []
    if rows:
        blocks.append(np.array(rows, np.float32))
    return blocks, weights


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their weights, the number of lines of each text)."""
    rows, weights, sizes = [], [], []
    for text in texts:
        r, w = _raw(text)
        rows += r
        weights += w
        sizes.append(len(w))
    raw = np.concatenate(rows) if rows else np.empty((0, RATIOS + PLAIN), np.float32)
    steps = (raw[:, :RATIOS, None] > STEPS).reshape(len(raw), RATIOS * len(STEPS))
    return np.hstack((raw, steps.astype(np.float32))), np.array(weights, np.float64), np.array(sizes, np.int64)


def with_neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after, zeros at the ends."""
    ends = np.cumsum(sizes)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - sizes] = 0
    after[ends - 1] = 0
    return np.hstack((x, before, after))


@dataclass
class Field:
    """Log odds of good per line are x @ emission; transition[i, j] scores state i before j."""

    emission: np.ndarray
    transition: np.ndarray

    def marginals(self, odds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) of each line, expected transitions, log normaliser of each text)."""
        order = np.argsort(-sizes, kind="stable")
        length, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
        longest = int(length[0]) if len(length) else 0
        live = np.searchsorted(-length, -np.arange(longest), "left")  # texts of more than t lines
        unary = np.exp(np.stack((-odds, odds), 1) / 2)
        t = np.exp(self.transition)
        forward, scale = np.empty((len(odds), 2)), np.empty(len(odds))
        state = None
        for k in range(longest):
            at = start[: live[k]] + k
            state = unary[at] if k == 0 else (state[: live[k]] @ t) * unary[at]
            norm = state.sum(1)
            state = state / norm[:, None]
            forward[at], scale[at] = state, norm
        backward = np.ones((len(odds), 2))
        pairs = np.zeros((2, 2))
        for k in range(longest - 1, 0, -1):
            at = start[: live[k]] + k
            ahead = backward[at] * unary[at] / scale[at][:, None]
            pairs += t * (forward[at - 1].T @ ahead)
            backward[at - 1] = ahead @ t.T
        good = forward[:, 1] * backward[:, 1]
        total = np.add.reduceat(np.log(scale), np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)
        return good / (good + forward[:, 0] * backward[:, 0]), pairs, total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, weights, sizes = line_features(texts)
        odds = np.clip(with_neighbours(x, sizes) @ self.emission, -30, 30)
        good = self.marginals(odds, sizes)[0]
        first = np.cumsum(sizes) - sizes
        return np.clip(np.add.reduceat(good * weights, first) / np.add.reduceat(weights, first), 0, 1)


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.08, shrink: float = 1e-4) -> Field:
    """Maximum likelihood by Adam, every text weighing the same. Without both labels: scores of 0.5."""
    field = Field(np.zeros(3 * WIDTH), np.zeros((2, 2)))
    if len(set(labels.tolist())) < 2:
        return field
    x = with_neighbours(x, sizes).astype(np.float64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    share = 1 / sizes[text] / len(sizes)
    y = labels[text].astype(np.float64)
    runs = sizes - 1
    want = np.array([[runs[labels == 0].sum(), 0], [0, runs[labels == 1].sum()]], np.float64)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        field = Field(theta[:-4], theta[-4:].reshape(2, 2))
        good, pairs, _ = field.marginals(np.clip(x @ field.emission, -30, 30), sizes)
        slope = np.concatenate((x.T @ ((y - good) * share), ((want - pairs) / max(1, runs.sum())).ravel())) - shrink * theta
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, found, labels = [], [], []
        for text, label, most, place in zip(*batch.columns, strict=True):
            text = text.as_py() or b""
            if text.count(b"\n") < most.as_py():
                places.append(place.as_py())
                found.append(line_features([text])[0].tobytes())
                labels.append(label.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found, pa.binary()), pa.array(labels, pa.int32())], ["place", "x", "label"])


def _scoring(field: Field, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [field.scores(texts) for _, texts in groups(batch.column(0))]
            scores = pa.array(np.concatenate(parts) if parts else np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], [*batch.schema.names[1:], name])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    fit_docs: int = 4000,
    fit_lines: int = 400,
    fit_total: int = 250_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Field:
    """Fit the field on at most ``fit_docs`` labelled documents of at most ``fit_lines`` lines, ``fit_total`` lines in all.

    The sample is the same on each run: the rows that a hash of id and text
    puts first, of the ids that a hash of the id puts first. These bounds hold
    however often an id or a row is repeated, and bound what comes to the driver.
    Rows without an id or with a label other than 0 and 1 are left out.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64(id_col), id_col, "label").limit(fit_docs)
    place = F.xxhash64(id_col, text_col).alias("place")
    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("text"), place).join(F.broadcast(sample), id_col)
    rows = rows.select("text", "label", F.lit(fit_lines).alias("most"), "place").mapInArrow(_sampled, "place long, x binary, label int")
    rows = save(rows.orderBy("place", "label").limit(fit_docs).withColumn("row", F.monotonically_increasing_id()), "fit-sample")
    sizes = rows.select("row", (F.octet_length("x") / (4 * WIDTH)).cast("long").alias("n")).orderBy("row").collect()
    n = int(np.searchsorted(np.cumsum([r.n for r in sizes]), fit_total, "right"))
    rows = rows.where(F.col("row") <= sizes[n - 1].row).orderBy("row").collect() if n else []  # no more comes to the driver
    x = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    sizes = np.array([len(a) for a in x[:n]], np.int64)
    return fit(np.concatenate(x[:n]) if n else np.empty((0, WIDTH)), sizes, np.array([r.label for r in rows[:n]], np.int64))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: CRC32 of the id's digits is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score_quality(df: DataFrame, field: Field, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` and the score, 0 to 1, of each row of ``df``; one pass, no shuffle.

    A null text counts as empty, and an empty text is one empty line, so each
    row has a score. ``score_col`` must not be the name of a column in ``keep``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(F.col(text_col).cast("binary").alias("__text"), *keep)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{score_col}` double"])
    return rows.mapInArrow(_scoring(field, score_col), schema)
