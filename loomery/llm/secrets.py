"""Secret scans by an inverted index of trigrams.

1. Of each rule's regular expression a Boolean query is derived: alternatives of
   trigrams that every match holds (``trigrams``), of which the rarest are asked
   for. A rule without a mandatory trigram is matched with every text.
2. The index lists, for each trigram that a query names, the texts that hold it
   (in any case of letters); texts are known by 128 bits of hash, so copies are
   listed once. It is a written table and can be asked for further rules whose
   trigrams it has.
3. An alternative's postings are intersected by a grouping of texts; its
   trigrams all being there makes a text a candidate of the rule.
4. Only candidates are matched, in the row, by Spark's own functions: the parts
   between matches and the matches give every span.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.names import named, numbered
from loomery.llm.trigrams import ANY, Query, trigram_query
from loomery.sources.scratch import save

#: Candidate texts (24 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group has ``least`` characters.

    Java reads the pattern, and it may hold what trigram_query() can read; case
    is given in classes of letters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(word: str) -> str:
    """A pattern for the letters of ``word`` in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))

BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]{32,}", least=32),
)

#: Formats that services publish for their keys.
FORMATS = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("npm", "npm_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bearer", rf"{any_case('bearer')}\x20[A-Za-z0-9._~+/-]{{20,}}"),
    Rule("login", r"://[A-Za-z0-9._~%+-]{1,64}:[A-Za-z0-9._~%+!$&*-]{3,64}@"),
)


#: Letters of usual texts, the commonest first; other characters are rarer.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"


def selective(query: Query, most: int = 3) -> Query:
    """``query`` with each alternative asking for at most ``most`` trigrams, those of rare characters; what answers ``query`` answers it."""
    rank = lambda gram: (-sum(COMMON.index(c) if c in COMMON else len(COMMON) for c in gram), gram)
    return frozenset(frozenset(sorted(grams, key=rank)[:most]) for grams in query)


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("__x"), F.xxhash64(F.lit(1), text).alias("__y")]


class TrigramIndex:
    """Postings ``gram, __x, __y``: the texts that hold each trigram of ``grams``, in either case."""

    def __init__(self, texts: DataFrame, grams: Iterable[str]) -> None:
        self.grams = sorted(set(grams))
        held = lambda text: F.array_compact(F.array(*[F.when(F.contains(text, F.lit(g)), F.lit(k)) for k, g in enumerate(self.grams)])).cast("array<int>")
        # as an element, the text is put into lower case once, not again for each trigram
        held = F.get(F.transform(F.array(F.lower("text")), held), F.lit(0))
        rows = texts.select(*_keys(F.col("text")), held.alias("held"))
        self.postings = save(rows.select(F.explode_outer("held").alias("gram"), "__x", "__y").where("gram IS NOT NULL"), "trigram-index")

    def candidates(self, queries: dict[int, Query]) -> DataFrame:
        """``__x, __y, rules``: for each text a bit for every rule whose query it answers. Asks of 63 rules at most."""
        place = {g: k for k, g in enumerate(self.grams)}
        alternatives = [(rule, sorted(place[g] for g in some)) for rule, query in queries.items() for some in sorted(query, key=sorted)]
        asked = [(gram, n, rule, bit, len(grams)) for n, (rule, grams) in enumerate(alternatives) for bit, gram in enumerate(grams)]
        asked = self.postings.sparkSession.createDataFrame(asked, "gram int, alternative int, rule int, bit int, size int")
        met = self.postings.join(F.broadcast(asked), "gram").groupBy("__x", "__y", "alternative", "rule", "size")
        met = met.agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).where(F.bit_count("bits") == F.col("size"))
        return met.groupBy("__x", "__y").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """``start, kind, end`` of each match, by the text's parts between matches; code points, end exclusive."""
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.zip_with(F.arrays_zip(between.alias("gap"), found.alias("found")), secret, lambda p, s: F.struct(p["gap"].alias("gap"), p["found"].alias("found"), s.alias("secret")))

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["found"]), F.lit(0))
        own = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        spans = F.when(F.length(part["secret"]) >= rule.least, F.concat(done["spans"], own)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))
    return F.aggregate(parts, start, step, lambda done: done["spans"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def scan_secrets(df: DataFrame, keep: Iterable[str], rules: Iterable[Rule] = BASE + FORMATS, text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the columns of ``keep`` and ``spans``.

    ``spans`` is an array of (start, end, kind) by start, then as the rules
    stand; matches of one rule don't overlap, those of several may. A null or
    empty text has none. Rows of equal texts, whatever their ids, are found
    alike; a kept column named ``spans`` comes back with an underscore. An
    empty table gives none. At most 63 rules.

    Texts are read twice: for the index, and to be matched. They are shuffled
    only if more texts than ``BROADCAST`` are candidates.
    """
    keep, rules = list(keep), list(rules)
    if len(rules) > 63:
        raise ValueError("at most 63 rules at once")
    queries = {k: selective(trigram_query(r.pattern)) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    rows = df.select(*numbered(keep), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *_keys(F.col("text")))
    index = TrigramIndex(df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), {g for q in indexed.values() for some in q for g in some})
    found = save(index.candidates(indexed), "secret-candidates")
    few = found.count() <= BROADCAST
    rows = rows.join(F.broadcast(found) if few else found, ["__x", "__y"], "left")
    text, parts = F.col("text"), []
    for k, rule in enumerate(rules):
        is_candidate = F.col("rules").bitwiseAND(F.expr(f"shiftleft(1L, {k})")) != 0 if k in indexed else text.rlike(rule.pattern)
        parts.append(F.when(is_candidate, _spans(text, rule, k)).otherwise(_none()))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(
        F.array_sort(reduce(lambda a, b: F.concat(a, b), parts)),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["kind"]).alias("kind")),
    )
    return rows.select(*named(keep, ["spans"]), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each of ``spans``, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
