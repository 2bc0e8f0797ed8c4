"""Quality rules by weak supervision, in DataFrame functions only.

Rules look at a document's base figures and vote good (1), bad (0) or abstain
(null). Expectation-maximisation over all documents that the base rules leave
estimates how common good ones are and how often each rule is right about good
and about bad ones; the posterior probability of good then decides, instead of
all rules having to pass. A rule that votes bad where no other rule sees anything
wrong comes out as one that is often wrong about good documents, and loses its
weight; so each kind of junk needs two rules that look at it from two sides.

What EM reads is the table of vote patterns with their counts, at most 3 to the
power of the number of rules however many documents there are; each round is one
aggregate of it, and only the rules' rates come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.names import named, numbered
from loomery.sources.scratch import save

SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Words of the repeated windows.
RUN = 3
#: A word without a letter or digit.
BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"


def base_figures(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the figures of each row's text; a null text has no words.

    All figures are array expressions over the row, so there is no shuffle and
    a row's cost is that of sorting its own windows, only where some repeat.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(*keep, text.alias("__t"))
    words = F.array_remove(F.split("__t", SPACES), "")
    lines = F.filter(F.split("__t", "\n"), lambda line: line.rlike(WORD))
    rows = rows.select(
        *keep,
        words.alias("__w"),
        lines.alias("__l"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("__t", F.lit(r"[^\p{L}\x20\x09-\x0D]")).cast("long").alias("n_others"),
        F.regexp_count("__t", F.lit(BARE)).cast("long").alias("n_bare"),
        F.regexp_count("__t", F.lit(r"\.(?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_stops"),
    )
    figures = ["n_symbols", "n_marks", "n_upper", "n_others", "n_bare", "n_stops"]
    windows = F.transform(
        F.slice("__w", F.lit(1), F.greatest(F.size("__w") - (RUN - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)),
    )
    rows = rows.select(
        *keep,
        *figures,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        windows.alias("__h"),
    )
    figures += ["n_words", "word_chars", "n_distinct_words", "n_lines", "n_dup_lines"]
    repeat = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*keep, *figures, F.when(repeat, placed).alias("__s"))
    same = lambda x, k: x["h"] == F.get("__s", k)["h"]
    twice = F.filter("__s", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    rows = rows.select(*keep, *figures, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__p"))
    reach = F.transform("__p", lambda p, k: F.least(F.lit(RUN), F.get("__p", k + 1) - p))  # least() skips a null
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select(*keep, *figures, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column | None = None
    good: Column | None = None

    def vote(self) -> Column:
        says = F.lit(None).cast("int") if self.good is None else F.when(self.good, 1)
        return says if self.bad is None else F.when(self.bad, 0).otherwise(says)


def default_rules() -> list[Rule]:
    """Eight signs of junk, each silent otherwise, two of prose, and the share of letters, which is either."""
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    chars = F.nullif(F.col("word_chars"), F.lit(0)).cast("double")
    upper, stops, letters = F.col("n_upper") / chars, F.col("n_stops") / words, 1 - F.col("n_others") / chars
    return [
        Rule("symbols", bad=F.col("n_symbols") / words >= 0.15),
        Rule("bare", bad=F.col("n_bare") / words >= 0.1),
        Rule("letters", bad=letters < 0.85, good=letters >= 0.9),
        Rule("marks", bad=F.col("n_marks") / words >= 0.4),
        Rule("upper", bad=upper >= 0.3),
        Rule("repeats", bad=F.col("n_repeat_words") / words >= 0.3),
        Rule("lines", bad=F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)) >= 0.4),
        Rule("variety", bad=F.col("n_distinct_words") / words <= 0.15),
        Rule("word_length", bad=~(F.col("word_chars") / words).between(2.5, 12)),
        Rule("case", good=upper.between(0.001, 0.08)),
        Rule("sentences", good=stops.between(1 / 60, 1 / 3)),
    ]


@dataclass(frozen=True)
class Rates:
    """Share of good documents, and per rule P(votes bad), P(votes good) among good and among bad ones."""

    prior: float
    good: tuple[tuple[float, float], ...]
    bad: tuple[tuple[float, float], ...]

    def posterior(self, votes: list[str]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (g0, g1), (b0, b1) in zip(votes, self.good, self.bad, strict=True):
            silent = math.log(max(1 - g0 - g1, 1e-9) / max(1 - b0 - b1, 1e-9))
            odds = odds + F.when(F.col(name) == 0, math.log(g0 / b0)).when(F.col(name) == 1, math.log(g1 / b1)).otherwise(silent)
        return 1 / (1 + F.exp(-odds))


#: Rates at the start, by which rules are mostly right; also what each rule's pseudo-votes say.
START = Rates(0.8, ((0.02, 0.5),), ((0.4, 0.2),))
PSEUDO = 5.0


def estimate(patterns: DataFrame, votes: list[str], rounds: int = 60, tolerance: float = 1e-5) -> Rates:
    """EM over ``patterns`` (the votes and ``n``).

    Each rate holds ``PSEUDO`` votes at its start, so none reaches 0 or 1. All
    that is asked of a rule is that it isn't worse than chance, or good and bad
    could trade places: its bad votes come no less often from bad documents
    than from good ones, its good votes no more often.
    """
    rates = Rates(START.prior, START.good * len(votes), START.bad * len(votes))
    (s0, s1), (t0, t1) = START.good[0], START.bad[0]
    share = lambda x, n, start: (x + PSEUDO * start) / (n + PSEUDO)
    for _ in range(rounds):
        p = patterns.withColumn("__good", rates.posterior(votes))
        weights = (F.col("n") * F.col("__good"), F.col("n") * (1 - F.col("__good")))
        sums = [F.sum(w) for w in weights]
        sums += [F.sum(F.when(F.col(v) == side, w)) for v in votes for w in weights for side in (0, 1)]
        got = [x or 0.0 for x in p.agg(*sums).first()]
        good, bad = [], []
        for k in range(len(votes)):
            g0, g1, b0, b1 = got[2 + 4 * k : 6 + 4 * k]
            g0, g1, b0, b1 = share(g0, got[0], s0), share(g1, got[0], s1), share(b0, got[1], t0), share(b1, got[1], t1)
            good.append((g0, g1))
            bad.append((max(b0, g0), min(b1, g1)))
        after = Rates(min(0.999, max(0.001, share(got[0], got[0] + got[1], START.prior))), tuple(good), tuple(bad))
        flat = lambda r: [r.prior, *(x for pair in (*r.good, *r.bad) for x in pair)]
        moved = max(abs(x - y) for x, y in zip(flat(rates), flat(after), strict=True))
        rates = after
        if moved < tolerance:
            break
    return rates


def judge(df: DataFrame, keep: list[str], text_col: str = "text", rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """``keep``, the base figures, ``base_failed``, the votes, ``p_good`` and ``kept`` for each row.

    ``base_failed``: under 50 words, or over half of the words in repeated
    windows. ``kept``: not base_failed and ``p_good`` at least ``least``.

    A null or empty text has no words, so it is base_failed and most rules
    abstain. Repeated rows count and are judged like any. An empty table gives
    none. A column of ``keep`` whose name the result has itself comes back with
    an underscore behind it. The figures are written once as a thin table, which
    EM and the result read.
    """
    rules = default_rules() if rules is None else rules
    votes = [f"vote_{r.name}" for r in rules]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own = [f"c{k}" for k in range(len(keep))]
    rows = df.select(*numbered(keep), F.col(text_col).alias("text"))
    figures = base_figures(rows, own).withColumn("base_failed", failed)
    figures = save(figures.select("*", *[r.vote().alias(v) for r, v in zip(rules, votes, strict=True)]), "figures")
    patterns = figures.where("NOT base_failed").groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))
    rates = estimate(save(patterns.coalesce(1), "vote-patterns"), votes)
    judged = figures.withColumn("p_good", rates.posterior(votes))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
    found = judged.columns[len(keep) :]
    return judged.select(*named(keep, found), *found)
