"""Documents: terms, ranking, search, chunks, reports, dialogues, versions.

Arrays made from a text are exploded by the outer functions: the inner ones add
a filter on the array's size that works the array out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import personal_spans, redacted
from loomery.functions.text import terms as terms_of
from loomery.sources.scratch import save


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, pos, term``: every term of every text in its place."""
    return docs.select(id_col, F.posexplode_outer(terms_of(text_col)).alias("pos", "term")).where("term IS NOT NULL")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, term, tf``. Partial counts form before the shuffle."""
    terms = docs.select(id_col, F.explode_outer(terms_of(text_col)).alias("term")).where("term IS NOT NULL")
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, tf, df``: occurrences and documents of each term.

    A text is split once; its terms, and its different terms beside them, are
    counted in one shuffle, by term.
    """
    each = docs.select(terms_of(text_col).alias("t"))
    each = each.select(F.posexplode(F.array("t", F.array_distinct("t"))).alias("once", "terms"))
    each = each.select("once", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    return each.groupBy("term").agg(F.count_if(F.col("once") == 0).alias("tf"), F.count_if(F.col("once") == 1).alias("df"))


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.size(terms_of(text_col)).cast("long").alias("n_terms"))


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of the documents with a term of ``query``.

    Term counts are taken within the row, so the texts are read once and never
    move; the global aggregate, whose single row is broadcast, and the scores
    read the thin table of lengths and counts.
    """
    query = list(dict.fromkeys(query))
    times = lambda q: F.size(F.filter("t", lambda x: x == q))
    rows = docs.select(id_col, terms_of(text_col).alias("t"))
    rows = rows.select(id_col, F.size("t").alias("dl"), *[times(q).alias(f"tf{k}") for k, q in enumerate(query)])
    rows = save(rows, "query-counts")
    count = [F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")]
    stats = rows.agg(*count, *[F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(query))])
    score = F.lit(0.0)
    for k in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        tf = F.col(f"tf{k}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = F.greatest(F.lit(0), *[F.col(f"tf{k}") for k in range(len(query))]) > 0
    return rows.where(hit).join(F.broadcast(stats)).select(id_col, score.alias("score"))


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, term, tf, weight``: tf times ln(documents / documents with the term). Texts are read once."""
    found = save(postings(docs, id_col, text_col), "postings")
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    weight = F.col("tf") * F.log(F.col("n") / F.col("df"))
    return found.join(frequency, "term").join(F.broadcast(total)).select(id_col, "term", "tf", weight.alias("weight"))


def keyword_search(docs: DataFrame, query: list[str], mode: str = "all", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of the documents with all, any or none of the terms; a filter within the row."""
    has = [F.array_contains("t", q) for q in query]
    every, some = F.lit(True), F.lit(False)
    for h in has:
        every, some = every & h, some | h
    rows = docs.select(id_col, terms_of(text_col).alias("t"))
    return rows.where({"all": every, "any": some, "none": ~some}[mode]).select(id_col)


def phrase_search(docs: DataFrame, phrase: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_hits``: how often the terms of ``phrase`` follow each other."""
    rows = docs.select(id_col, terms_of(text_col).alias("t"))

    def here(x: Column, i: Column) -> Column:
        out = x == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            out = out & F.coalesce(F.get("t", i + k) == word, F.lit(False))
        return out

    return rows.select(id_col, F.size(F.filter("t", here)).cast("long").alias("n_hits")).where("n_hits > 0")


def chunk(docs: DataFrame, size: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, pos, chunk``: pieces of ``size`` characters that share ``overlap`` with the one before.

    The last piece ends with the text. Null and empty texts have none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    n, step = F.length(text_col), size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    rows = docs.where(n > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return rows.select(id_col, "pos", F.substring(F.col(text_col), F.col("pos") * step + 1, F.lit(size)).alias("chunk"))


def boilerplate_lines(docs: DataFrame, min_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line, n_docs, n``: lines with a word that stand in ``min_docs`` documents or more, and how often they stand anywhere.

    Lines are known by 128 bits of hash. They are counted by line and document
    first, so that a line in all documents is dealt over tasks, and then by line,
    with partial sums. Only lines that are found are fetched as text, in a second
    reading. Rows of one id are one document; rows without an id are one as well.
    """
    lines = docs.select(id_col, F.explode_outer(F.split(text_col, "\n")).alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    x, y = F.xxhash64("line"), F.xxhash64(F.lit(1), "line")
    each = lines.groupBy(x.alias("x"), y.alias("y"), id_col).agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n")).where(F.col("n_docs") >= min_docs)
    found = save(found, "frequent-lines")
    few = found.count() <= 500_000  # 32 bytes each
    texts = lines.select(x.alias("x"), y.alias("y"), "line").join(F.broadcast(found) if few else found, ["x", "y"])
    return texts.groupBy("x", "y", "n_docs", "n").agg(F.first("line").alias("line")).select("line", "n_docs", "n")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans, text``: personal spans (start, end, kind) of each text and the text without them. A null text stays null and has no spans."""
    rows = docs.select(id_col, F.col(text_col).alias("text"), personal_spans(text_col).alias("spans"))
    return rows.select(id_col, "spans", redacted("text", F.col("spans")).alias("text"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """Documents, characters and terms by language and source."""
    rows = docs.select("lang", "source", F.length("text").alias("chars"), F.size(terms_of("text")).alias("n_terms"))
    return rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("chars").alias("n_chars"), F.max("chars").alias("max_chars"), F.sum("n_terms").alias("n_terms")
    )


def label_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by language and label, those without a label included."""
    joined = docs.select("doc_id", "lang").join(labels, "doc_id", "left")
    return joined.groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n_docs"))


def dialogue(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, transcript``: a conversation's turns in order, a line for each."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return grouped.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("transcript"))


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the latest version of each key; of equal versions, that of ``updates``.

    An aggregate, so that a key with many versions is reduced before the shuffle.
    """
    columns = base.columns
    rows = base.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    latest = F.max_by(F.struct(*columns), F.struct(version, "__new"))
    return rows.groupBy(F.col(key).alias("__key")).agg(latest.alias("r")).select("r.*")


def top(df: DataFrame, score: str, id_col: str, k: int) -> DataFrame:
    """The ``k`` best rows and their ``place``, ties by id. Only ``k`` rows reach the ranking."""
    best = df.orderBy(F.desc(score), F.asc(id_col)).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), F.asc(id_col))))
