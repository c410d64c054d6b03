"""Rules that documents of the reference describe: access, completeness, cross-references, times, and diverse results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The levels of confidentiality that a role may read.
ROLES = {"public": ["public"], "internal": ["public", "internal"], "restricted": ["public", "internal", "restricted"]}


def may_read(confidentiality: Column, role: str) -> Column:
    """Whether a role may read a chunk; an unknown role reads what is public, and so is a chunk without a level."""
    return F.coalesce(confidentiality, F.lit("public")).isin(ROLES.get(role, ["public"]))


def completeness(columns: list[str], kinds: dict[str, str]) -> Column:
    """The share of the columns that have a value (arrays: an element), from 0 to 1."""
    has = lambda c: (F.size(c) > 0) if kinds[c].startswith("array") else F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return reduce(lambda a, b: a + b, [F.coalesce(has(c), F.lit(False)).cast("int") for c in columns]) / len(columns)


def cross_references(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, ref, target_id): references of chunks (doc_refs) to targets (doc_id, target_id, label) of the
    same document whose label they name, case ignored. An equi-join; a chunk that names a target twice links it once."""
    named = chunks.select("doc_id", "chunk_id", F.explode(F.array_distinct(F.transform("doc_refs", lambda r: F.lower(r)))).alias("ref"))
    return named.join(targets.select("doc_id", "target_id", F.lower("label").alias("ref")), ["doc_id", "ref"]).select("doc_id", "chunk_id", "ref", "target_id").distinct()


def temporal_neighbours(chunks: DataFrame, by: str, time: str, id_col: str) -> DataFrame:
    """Each chunk with the ids of the chunk before and after it in its period, by time: what shares its period without
    pairing all of it."""
    w = Window.partitionBy(by).orderBy(time, id_col)
    return chunks.withColumn("earlier", F.lag(id_col).over(w)).withColumn("later", F.lead(id_col).over(w))


def by_temporal_relevance(hits: DataFrame, year: int, dates: str = "mentioned_dates", order: str = "ord") -> DataFrame:
    """``hits`` with ``temporal_relevance``, 1 / (1 + years to the nearest year named), zero without one; best first."""
    years = F.filter(F.transform(F.coalesce(F.col(dates), F.array().cast("array<string>")), lambda d: F.regexp_extract(d, r"(\d{4})", 1).try_cast("int")), lambda y: y.isNotNull())
    gap = F.array_min(F.transform(years, lambda y: F.abs(y - year)))
    return hits.withColumn("temporal_relevance", F.coalesce(1 / (1 + gap), F.lit(0.0))).orderBy(F.desc("temporal_relevance"), order)


def diversified(hits: DataFrame, by: str, each: int, order: str = "ord") -> DataFrame:
    """Hits so that the first of every group come before the second of any: ``each`` of a group at most."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order))
    return hits.withColumn("turn", n).filter(F.col("turn") <= each).orderBy("turn", F.desc("score"), order)
