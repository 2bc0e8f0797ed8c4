"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.conversations import conversation_trie, with_digests
from loomery.llm.crf import held_out, score_quality, train
from loomery.llm.infill import fill_in_middle, restored
from loomery.llm.lines import dedup_lines
from loomery.llm.mixing import mix_sources, word_count
from loomery.llm.rules import judge
from loomery.llm.secrets import BASE, FORMATS, Rule, listed, scan_secrets
from loomery.sources.tables import load_table as table
from loomery.llm.sharding import shard_rows
from loomery.llm.simhash import near_duplicates
from loomery.llm.substrings import remove_repeated_windows
from loomery.llm.tokens import count_tokens
from loomery.llm.warc import archive_pages
from loomery.llm.winnowing import find_contamination, is_contaminated


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents"), threshold=0.8, shingle=5)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *figures, "base_failed", "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return shard_rows(rows, shards=16).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def document_key() -> Column:
    """The id in digits; for a row without an id, its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.coalesce("text", F.lit(""))))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, (5, 2, 1), (3, 2), 2, "source", word_count("text"), document_key(), ["doc_id"])
    return mixed.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '?' || coalesce(text, ''))), 1, 15))::BIGINT AS place
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM docs GROUP BY source),
ordered AS (
  SELECT *, 2 * source_size AS full_size, sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight,
         coalesce(sum(2 * source_size) OVER before, 0)::BIGINT AS full_before, coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before
  FROM sizes WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT *, 2 * full_size * (all_weight - weight_before) <= weight * (3 * all_size - 2 * full_before) AS is_full FROM ordered),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN full_size::DOUBLE
              ELSE (weight * (3 * all_size - 2 * coalesce(sum(full_size) FILTER (is_full) OVER (), 0)::BIGINT))::DOUBLE
                   / nullif(2 * coalesce(sum(weight) FILTER (NOT is_full) OVER (), 0)::BIGINT, 0)::DOUBLE END AS target
  FROM filled),
wholes AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS n FROM targets),
groups AS (
  SELECT source, place, sum(size)::BIGINT AS s,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below
  FROM docs GROUP BY source, place)
SELECT doc_id, size, source_size, target,
       (size * (n + (2 * (n * source_size + below) + s <= 2 * target)::INT))::BIGINT AS taken
FROM docs JOIN wholes w ON docs.source IS NOT DISTINCT FROM w.source
JOIN groups g ON docs.source IS NOT DISTINCT FROM g.source AND docs.place = g.place
"""


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), least_bytes=100).drop("payload")


OP6_SQL = """
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS bytes, sha256(coalesce(html, '')) AS digest,
             min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_windows(table(spark, sf_dir, "documents"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS s FROM docs)),
hits AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, rank() OVER (PARTITION BY w ORDER BY doc_id, s) AS place FROM windows) WHERE place > 1),
cut AS (SELECT DISTINCT doc_id, s + k AS p FROM (SELECT doc_id, s, unnest(range(20)) AS k FROM hits)),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM placed ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train(docs, labels.where(~held_out()))
    scored = score_quality(docs, field, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], window=13)
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, words, least(len(words), 13) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
  WHERE len(words) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[s + 1 : s + n], ' ') AS w
  FROM (SELECT item_id, n, words, unnest(range(len(words) - n + 1)) AS s FROM items)),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(words[s + 1 : s + n], ' ') AS w
  FROM (SELECT doc_id, n, words, unnest(range(len(words) - n + 1)) AS s
        FROM docs, (SELECT DISTINCT n FROM items) WHERE len(words) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM doc_windows JOIN item_windows USING (n, w)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words)) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), budget=3, shingle=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"], plain_percent=10, spm_percent=20, seed=1)
    again = restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM docs),
cut AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(units[greatest(a, b) + 1:n], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(conversation_trie(table(spark, sf_dir, "conversations"), group=100, most=6))


OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS r
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
drawn AS (SELECT c, n, c - c % 100 AS b, {CRC32} % 6 AS h FROM sizes),
convs AS (SELECT drawn.c, drawn.b, h, least(h, coalesce(s.n, 0)) AS taken, least(h, coalesce(s.n, 0)) + greatest(drawn.n - h, 0) AS size
          FROM drawn LEFT JOIN sizes s ON s.c = drawn.b),
turns AS (
  SELECT convs.c, r AS pos, role, text FROM convs JOIN t ON t.c = convs.b WHERE r < h
  UNION ALL SELECT convs.c, r - h + taken, role, text FROM convs JOIN t ON t.c = convs.c WHERE r >= h),
paths AS (
  SELECT c, pos + 1 AS d, length(text) AS chars, array_to_string(list(md5(role) || md5(text)) OVER (PARTITION BY c ORDER BY pos), '') AS path FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n, min(chars) AS chars, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size) AS ends
  FROM paths JOIN convs USING (c) GROUP BY d, path),
linked AS (
  SELECT n.*, p.conv_id AS parent, p.path AS parent_path FROM nodes n
  LEFT JOIN paths own ON own.c = n.conv_id AND own.d = n.d - 1 LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = own.path),
kids AS (SELECT parent_path AS path, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY parent_path),
below AS (
  SELECT a.path, sum((n.n - 1) * n.chars)::BIGINT AS saved, count(*) FILTER (k.n_children IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k ON k.path = n.path JOIN paths a ON a.c = n.conv_id AND a.d <= n.d GROUP BY a.path)
SELECT conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves AS n_leaves,
       saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM linked LEFT JOIN kids USING (path) JOIN below USING (path)
"""
_BYTE = "list_reduce(list_concat([xor(a, x)], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
CRC32 = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda a, x: {_BYTE}), 4294967295)"
OP12_SQL = OP12_SQL.replace("{CRC32}", CRC32)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"], BASE + FORMATS)
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.sha2(listed(of([r.kind for r in BASE])), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, listed(F.col("spans")).alias("spans"))


def _spans_sql(number: int, rule: Rule) -> str:
    """The spans of a rule in each text, found without an index."""
    pattern = rule.pattern.replace("'", "''")
    own = f"regexp_extract_all(text, '{pattern}')"
    gaps = f"string_split_regex(text, '{pattern}')"
    secret = f"regexp_extract_all(text, '{pattern}', {rule.group})"
    at = f"list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({own}[1:i - 1], lambda x: length(x))), 0)"
    span = f"{{'start': ({at})::BIGINT, 'kind': {number}, 'end': ({at} + length({own}[i]))::BIGINT, 'ok': length({secret}[i]) >= {rule.least}}}"
    return f"CASE WHEN regexp_matches(text, '{pattern}') THEN list_filter(list_transform(range(1, len({own}) + 1), lambda i: {span}), lambda s: s.ok) ELSE [] END"


def _listed_sql(spans: str, names: list[str]) -> str:
    kinds = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"coalesce(array_to_string(list_transform({spans}, lambda s: {kinds}[s.kind + 1] || ':' || s.start || ':' || s.\"end\"), ','), '')"


_ALL_SPANS = " || ".join(f"({_spans_sql(k, r)})" for k, r in enumerate(BASE + FORMATS))
_KINDS = [r.kind for r in BASE + FORMATS]
OP13_SQL = f"""
SELECT doc_id, len(list_filter(spans, lambda s: s.kind = 0)) AS n_assign, len(list_filter(spans, lambda s: s.kind = 1)) AS n_access,
       len(list_filter(spans, lambda s: s.kind = 2)) AS n_hex,
       sha256({_listed_sql("list_filter(spans, lambda s: s.kind < 3)", _KINDS)}) AS base_sha256, {_listed_sql("spans", _KINDS)} AS spans
FROM (SELECT doc_id, list_sort({_ALL_SPANS}) AS spans FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_source_mixing": op5_source_mixing,
    "op6_warc_normaliser": op6_warc_normaliser,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op5_source_mixing": OP5_SQL,
    "op6_warc_normaliser": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_secret_scan": OP13_SQL,
}
