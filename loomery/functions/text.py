"""Text expressions: terms, HTML and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
GAPS = r"[ \t\n\r\f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TERM), F.lit(0))


def html_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column | str) -> Column:
    """The targets of double-quoted ``href`` attributes."""
    return F.regexp_extract_all(_col(html), F.lit(r'(?i)href="([^"]*)"'), F.lit(1))


def html_text(html: Column | str) -> Column:
    """Text without scripts, styles, comments and tags; gaps are one space."""
    out = F.regexp_replace(_col(html), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, GAPS, " "))


def url_part(url: Column | str, part: str) -> Column:
    """``PROTOCOL``, ``HOST``, ``PATH`` or ``QUERY``; null where there is none or the URL is malformed."""
    return F.try_parse_url(_col(url), F.lit(part))


# An address of mail by its usual characters, and four numbers of an IPv4 address.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"[0-9]+(?:\.[0-9]+)+"


def spans_of(text: Column | str, pattern: str, kind: str, valid=lambda found: F.lit(True)) -> Column:
    """Array of (start, end, kind) of the matches that are ``valid``; code points, end exclusive. A null text has none.

    The text's parts between matches, and the matches, give every place.
    """
    text = F.coalesce(_col(text), F.lit(""))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["found"]), F.lit(0))
        own = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
        holds = part["found"].isNotNull() & valid(part["found"])
        return F.struct(end.alias("at"), F.when(holds, F.concat(done["spans"], own)).otherwise(done["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda done: done["spans"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def is_ipv4(found: Column) -> Column:
    """Four numbers of 0 to 255 without leading zeros."""
    return found.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")


def settled(*kinds: Column) -> Column:
    """The spans of several kinds without those that meet a span of a kind before them; by start."""
    meets = lambda s, o: (s["start"] < o["end"]) & (o["start"] < s["end"])
    keep = lambda done, more: F.concat(done, F.filter(more, lambda s: ~F.exists(done, lambda o: meets(s, o))))
    return F.array_sort(reduce(keep, kinds))


def personal_spans(text: Column | str) -> Column:
    """Addresses of mail, then of IPv4 hosts, in a text."""
    return settled(spans_of(text, EMAIL, "email"), spans_of(text, IPV4, "ipv4", is_ipv4))


def redacted(text: Column | str, spans: Column) -> Column:
    """The text with each of ``spans``, which are in order and apart, replaced by its kind in brackets."""
    text = _col(text)
    piece = lambda at, n: F.substring(text, at + F.lit(1), n)

    def step(done: Column, s: Column) -> Column:
        out = F.concat(done["out"], piece(done["at"], s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(s["end"].alias("at"), out.alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda d: F.concat(d["out"], piece(d["at"], F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
