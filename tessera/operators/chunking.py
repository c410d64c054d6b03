"""Documents to chunks: line classes, heading lineage, paragraphs as islands, short paragraphs merged, tidying folds.

All stages but the last are windows over (doc_id, ord) that share one partitioning by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import folds

#: Words under which a paragraph joins the one before; words under which neighbours merge; words that merging never exceeds.
MIN_WORDS, TINY, MOST = 15, 10, 300


def lines_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ord, line), from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.lines(F.coalesce(F.col(text_col), F.lit("")))).alias("ord", "line"))


def _by_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("ord")


def with_lineage(units: DataFrame) -> DataFrame:
    """h1, h2, h3 in force at each unit; a heading ends what is under its level. Needs kind, level and text."""
    w = _by_doc()
    head = lambda k: (F.col("kind") == "heading") & (F.col("level") == k)
    out = units.withColumn("g1", F.sum(head(1).cast("int")).over(w)).withColumn("g2", F.sum((head(1) | head(2)).cast("int")).over(w))
    last = lambda k, *by: F.last(F.when(head(k), F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id", *by).orderBy("ord"))
    return out.withColumn("h1", last(1)).withColumn("h2", last(2, "g1")).withColumn("h3", last(3, "g1", "g2")).drop("g1", "g2")


def paragraphs(units: DataFrame, lead: Column | None = None) -> DataFrame:
    """Runs of text units as one paragraph, key-values and lists alone; (doc_id, ord, chunk_type, text, h1, h2, h3)."""
    w = _by_doc()
    text = F.col("kind") == "text"
    joined = units.withColumn("island", F.sum((~text | (F.lag("kind").over(w) != "text") | F.lag("kind").over(w).isNull()).cast("int")).over(w)).filter(F.col("kind").isin("text", "kv", "list"))
    parts = joined.groupBy("doc_id", "island").agg(
        F.min("ord").alias("ord"), F.min_by("kind", "ord").alias("kind"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"), *[F.min_by(h, "ord").alias(h) for h in ("h1", "h2", "h3")]
    )
    body = F.array_join(F.transform("parts", lambda x: F.btrim(x["text"])), " ")
    kind = F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind"))
    return parts.select("doc_id", "ord", kind.alias("chunk_type"), F.when(F.col("h3").isNotNull(), F.concat(F.col("h3"), F.lit(": "), body)).otherwise(body).alias("text"), "h1", "h2", "h3")


def merge_short(chunks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A paragraph of few words joins the paragraph before it, which keeps its own headings."""
    w = _by_doc()
    joins = (F.col("chunk_type") == "paragraph") & (F.lag("chunk_type").over(w) == "paragraph") & (T.word_count("text") < min_words)
    marked = chunks.withColumn("g", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    out = marked.groupBy("doc_id", "g").agg(
        F.min("ord").alias("ord"), F.min_by("chunk_type", "ord").alias("chunk_type"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"), *[F.min_by(h, "ord").alias(h) for h in ("h1", "h2", "h3")]
    )
    return out.select("doc_id", "ord", "chunk_type", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"), "h1", "h2", "h3")


def number(chunks: DataFrame) -> DataFrame:
    """chunk_id from 0, tables first."""
    order = Window.partitionBy("doc_id").orderBy((F.col("chunk_type") != "table").cast("int"), "ord")
    return chunks.withColumn("chunk_id", F.row_number().over(order) - 1)


def chunk_markdown(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_level: int = 3) -> DataFrame:
    """Chunks of Markdown or plain text: (doc_id, ord, chunk_id, chunk_type, text, h1, h2, h3, headings_path).

    Documents are dealt by id while they are whole; all that follows keeps that partitioning, so texts are shuffled once.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition("doc_id")
    kinds = lines_of(whole).withColumn("kind", T.line_kind("line", max_level)).filter("kind <> 'skip'")
    level = F.when(F.col("kind") == "heading", T.heading_level("line", max_level))
    units = kinds.select("doc_id", "ord", "kind", level.alias("level"), F.when(F.col("kind") == "heading", T.heading_text("line", max_level)).otherwise(F.btrim("line")).alias("text"))
    out = number(merge_short(paragraphs(with_lineage(units))))
    return out.withColumn("headings_path", T.headings_path(F.col("h1"), F.col("h2"), F.col("h3")))


def merge_tiny(chunks: DataFrame, min_words: int = TINY, most: int = MOST) -> DataFrame:
    """One pass from left to right: neighbours merge unless both are large, either is a table, their headings differ or
    the result is too long. Merged text is cleaned again, so this is a fold over each document's chunks; what else a chunk
    has is that of the first one. Null texts merge with nothing."""
    columns = ["doc_id", "ord", *[c for c in chunks.columns if c not in ("doc_id", "ord")]]
    rows = chunks.select(*columns)
    return folds.fold(rows, ["doc_id"], ["ord"], lambda: folds.MergeTiny(min_words, most, columns), rows.schema).select(*chunks.columns)


def fuse_lists(chunks: DataFrame) -> DataFrame:
    """Adjacent lists become one."""
    w = _by_doc()
    marked = chunks.withColumn("g", F.sum(F.when((F.col("chunk_type") == "list") & (F.lag("chunk_type").over(w) == "list"), 0).otherwise(1)).over(w))
    others = [c for c in chunks.columns if c not in ("doc_id", "ord", "text")]
    out = marked.groupBy("doc_id", "g").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"), *[F.min_by(c, "ord").alias(c) for c in others])
    return out.withColumn("text", F.array_join(F.transform("parts", lambda x: x["text"]), "\n")).select(*chunks.columns)


def tidy(chunks: DataFrame) -> DataFrame:
    """Clean, key-values to paragraphs, drop noise, fuse lists, merge tiny neighbours, drop noise again."""
    kind = F.when(F.col("chunk_type") == "kv", "paragraph").otherwise(F.col("chunk_type"))
    # Exploded from one, so that the filter takes the text as it is made once and doesn't make it anew.
    cleaned = chunks.withColumn("text", F.explode(F.array(T.cleaned_again("text")))).withColumn("chunk_type", kind)
    return merge_tiny(fuse_lists(cleaned.filter(T.is_meaningful("text")))).filter(T.is_meaningful("text"))


def with_metadata(chunks: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """Dates, references, entities, policy tags, metric terms and change notes found in the text."""
    v = vocabulary or {}
    tags = T.policy_tags("text")
    return chunks.withColumns(
        {
            "metric_terms": T.terms_in("text", v["metrics"]) if v.get("metrics") else F.array().cast("array<string>"),
            "doc_refs": T.doc_refs("text"),
            "entities": T.entities("text", v.get("products")),
            "mentioned_dates": T.dates("text"),
            "policy_tags": F.array_union(tags, T.terms_in("text", v["policy_tags"])) if v.get("policy_tags") else tags,
            "is_change_note": T.is_change_note("text"),
            "word_count": T.word_count("text"),
        }
    )


def section_index(chunks: DataFrame) -> DataFrame:
    """By document and heading path: chunk ids, distinct types and words."""
    return chunks.groupBy("doc_id", "headings_path").agg(
        F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("chunk_type")).alias("chunk_types"), F.sum(T.word_count("text")).alias("total_words")
    )


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def chunk_uuid() -> Column:
    """A name for a chunk that doesn't change from run to run."""
    return F.sha2(F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col("ord").cast("string"), F.col("text")), 256)


