"""Queries over documents, pages, labels and conversations, and their SQL."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text as fn
from loomery.operators import documents as ops
from loomery.operators import lsh, similarity
from loomery.sources.scratch import new_path
from loomery.sources.tables import load_table, write_table

QUERY = ["the", "with", "der"]
TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ops.top(ops.bm25(docs(spark, sf_dir), QUERY), "score", "doc_id", 10)
    return best.select("doc_id", F.round("score", 6).alias("score"), "place")


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "documents-by-lang")
    write_table(docs(spark, sf_dir), path, ["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [ops.keyword_search(docs(spark, sf_dir), QUERY[:2], m).select("doc_id", F.lit(m).alias("mode")) for m in ("all", "any", "none")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(fn.html_links("html")).alias("pos", "link"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"host": "HOST", "path": "PATH", "scheme": "PROTOCOL"}
    return load_table(spark, sf_dir, "pages").select("page_id", *[fn.url_part("url", p).alias(n) for n, p in parts.items()])


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return ops.upsert(events.where("event_type <> 'view'"), events.where("event_type = 'view'"), "user_id", "event_id")


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_texts(docs(spark, sf_dir)).pairs.withColumn("jaccard", F.round("jaccard", 6))


def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a model that was stored and loaded again."""
    path = new_path(spark, "minhash-model")
    lsh.minhash_model(spark).save(path)
    return lsh.similar_texts_lsh(docs(spark, sf_dir), PipelineModel.load(path)).pairs.withColumn("jaccard", F.round("jaccard", 6))


def redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.redact(docs(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", spans.alias("spans"), F.md5("text").alias("text_md5"))


QUERIES = {
    "d1_load_table": lambda s, d: docs(s, d).select("doc_id", "lang", "source", "n_chars"),
    "d2_tokenize": lambda s, d: ops.tokenize(docs(s, d)),
    "d3_term_stats": lambda s, d: ops.term_stats(docs(s, d)),
    "d3_doc_lengths": lambda s, d: ops.doc_lengths(docs(s, d)),
    "d4_bm25": lambda s, d: ops.bm25(docs(s, d), QUERY).select("doc_id", F.round("score", 6).alias("score")),
    "d4_bm25_top": bm25_top,
    "d5_tfidf": lambda s, d: ops.tfidf(docs(s, d)).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight")),
    "d6_keyword_search": search_modes,
    "d7_phrase_search": lambda s, d: ops.phrase_search(docs(s, d), ["of", "the"]),
    "d8_chunk": lambda s, d: ops.chunk(docs(s, d), 500, 50),
    "d10_near_dup": lambda s, d: similarity.link_counts(similarity.similar_texts(docs(s, d))),
    "d10_near_dup_pairs": near_pairs,
    "d11_near_dup_lsh": lsh_pairs,
    "d12_boilerplate_lines": lambda s, d: ops.boilerplate_lines(docs(s, d), 5),
    "d14_redact": redactions,
    "d16_html_text": lambda s, d: load_table(s, d, "pages").select("page_id", fn.html_text("html").alias("text")),
    "d16_html_title": lambda s, d: load_table(s, d, "pages").select("page_id", fn.html_title("html").alias("title")),
    "d16_html_links": links,
    "d17_url_parts": url_parts,
    "d18_doc_stats": lambda s, d: ops.doc_stats(docs(s, d)),
    "d19_label_report": lambda s, d: ops.label_report(docs(s, d), load_table(s, d, "labels")),
    "d20_dialogue": lambda s, d: ops.dialogue(load_table(s, d, "conversations")),
    "d21_upsert": upserted,
    "d22_write_table": written,
}

BM25 = f"""
  SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents)
        WHERE term IN ('the', 'with', 'der') GROUP BY doc_id, term)
  JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY term) USING (term)
  JOIN (SELECT doc_id, len({TERMS}) AS dl FROM documents) USING (doc_id),
  (SELECT count(*) AS n, avg(len({TERMS})) AS avgdl FROM documents) GROUP BY doc_id"""

#: Shingle sets, their classes, and pairs of similar classes, met by a join of all shingles.
SIMILAR = r"""WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
  members AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, s FROM sets),
  classes AS (SELECT class_id AS c, len(s) AS n, unnest(s) AS x FROM members WHERE doc_id = class_id),
  met AS (SELECT p.c AS a, q.c AS b, p.n + q.n AS total, count(*) AS common FROM classes p JOIN classes q ON p.x = q.x AND p.c < q.c GROUP BY ALL),
  pairs AS (SELECT a, b, common / (total - common)::DOUBLE AS jaccard FROM met WHERE 9 * common >= 4 * total)"""

HOST = "{0}(\\.{0}){{3}}".format("(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])")


def _spans_sql(pattern: str, kind: str, valid: str) -> str:
    at = "coalesce(list_sum(list_transform({0}[1:{1}], lambda x: length(x))), 0)"
    gaps, found = f"string_split_regex(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}')"
    start = at.format(gaps, "i") + " + " + at.format(found, "i - 1")
    span = f"{{'start': ({start})::BIGINT, 'end': ({start} + length({found}[i]))::BIGINT, 'kind': '{kind}', 'ok': {valid.replace('FOUND', f'{found}[i]')}}}"
    return f"list_filter(list_transform(range(1, len({found}) + 1), lambda i: {span}), lambda s: s.ok)"


REDACT = f"""WITH one AS (SELECT doc_id, text, {_spans_sql(fn.EMAIL, "email", "true")} AS mails,
      {_spans_sql(fn.IPV4, "ipv4", f"regexp_full_match(FOUND, '{HOST}')")} AS hosts FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    both_kinds AS (SELECT doc_id, text, list_sort(mails || list_filter(hosts, lambda h: len(list_filter(mails, lambda m: m.start < h."end" AND h.start < m."end")) = 0)) AS s FROM one)
  SELECT doc_id, coalesce(array_to_string(list_transform(s, lambda x: x.kind || ':' || x.start || ':' || x."end"), ','), '') AS spans,
    md5(coalesce(array_to_string(list_transform(range(1, len(s) + 1), lambda i:
      text[coalesce(s[i - 1]."end", 0) + 1 : s[i].start] || '[' || upper(s[i].kind) || ']'), ''), '') || text[coalesce(s[-1]."end", 0) + 1 :]) AS text_md5 FROM both_kinds"""

ORACLE_SQL = {
    "d1_load_table": "SELECT doc_id, lang, source, n_chars FROM documents",
    "d2_tokenize": f"SELECT doc_id, (unnest(range(len(t))))::INT AS pos, unnest(t) AS term FROM (SELECT doc_id, {TERMS} AS t FROM documents)",
    "d3_term_stats": f"""SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df
        FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY term""",
    "d3_doc_lengths": f"SELECT doc_id, len({TERMS})::BIGINT AS n_terms FROM documents",
    "d4_bm25": f"SELECT doc_id, round(score, 6) AS score FROM ({BM25})",
    "d4_bm25_top": f"""SELECT doc_id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS place
        FROM ({BM25}) ORDER BY score DESC, doc_id LIMIT 10""",
    "d5_tfidf": f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY doc_id, term)
        SELECT doc_id, term, tf, round(tf * ln(n::DOUBLE / df), 6) AS weight
        FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) USING (term), (SELECT count(*) AS n FROM documents)""",
    "d6_keyword_search": f"""WITH t AS (SELECT doc_id, list_contains({TERMS}, 'the') AS a, list_contains({TERMS}, 'with') AS b FROM documents)
        SELECT doc_id, 'all' AS mode FROM t WHERE a AND b UNION ALL SELECT doc_id, 'any' FROM t WHERE a OR b
        UNION ALL SELECT doc_id, 'none' FROM t WHERE NOT (a OR b)""",
    "d7_phrase_search": f"""SELECT doc_id, count(*) AS n_hits FROM (
          SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS after
          FROM (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (SELECT doc_id, {TERMS} AS t FROM documents)))
        WHERE term = 'of' AND after = 'the' GROUP BY doc_id""",
    "d8_chunk": """SELECT doc_id, pos::INT AS pos, substr(text, pos * 450 + 1, 500) AS chunk FROM (
          SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 500) / 450.0), 0)::BIGINT + 1)) AS pos FROM documents WHERE length(text) > 0)""",
    "d10_near_dup": f"""{SIMILAR} SELECT doc_id, class_id, count(a) AS n_links FROM members LEFT JOIN pairs ON class_id IN (a, b) GROUP BY doc_id, class_id""",
    "d10_near_dup_pairs": f"{SIMILAR} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs",
    "d12_boilerplate_lines": r"""SELECT line, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT doc_id) >= 5""",
    "d14_redact": REDACT,
    "d16_html_text": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
          regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
          '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages""",
    "d16_html_title": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages",
    "d16_html_links": """SELECT page_id, (unnest(range(len(l))))::INT AS pos, unnest(l) AS link
        FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS l FROM pages)""",
    "d17_url_parts": r"""SELECT page_id, nullif(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), '') AS host,
        regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '^([a-zA-Z]+)://', 1), '') AS scheme FROM pages""",
    "d18_doc_stats": f"""SELECT lang, source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, max(length(text))::INT AS max_chars,
        sum(len({TERMS}))::BIGINT AS n_terms FROM documents GROUP BY lang, source""",
    "d19_label_report": "SELECT lang, quality, toxic, count(*) AS n_docs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, quality, toxic",
    "d20_dialogue": r"""SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
        FROM conversations GROUP BY conv_id""",
    "d21_upsert": """SELECT user_id, event_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "d22_write_table": "SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang",
}
