"""Tables of contents: parsing, hierarchy, and the as-of join that gives chunks their section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def parse_toc(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, ord, section, title, page, level, prev_title, next_title) of the lines of each document's first TOC."""
    first = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).filter("_n = 1")
    lines = first.select("doc_id", F.posexplode(F.split(text_col, "\n")).alias("ord", "line")).withColumn("t", T.toc_line("line")).filter("t IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("ord")
    return lines.select("doc_id", "ord", "t.*").withColumn("prev_title", F.lag("title").over(w)).withColumn("next_title", F.lead("title").over(w))


def hierarchy(toc: DataFrame) -> DataFrame:
    """Sections of the first level with the titles of the second under them; a second without a first is left out."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    marked = toc.filter("level <= 2").withColumn("parent", F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(w)).filter("parent IS NOT NULL")
    return marked.groupBy("doc_id", "parent").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 2, F.struct("ord", "title")))), lambda x: x["title"]).alias("children"))


#: Parts of time into which a key's rows are dealt.
BUCKETS = 64


def _seconds(df: DataFrame, time: str) -> Column:
    """A time or number as a double that doesn't change their order."""
    kind = df.schema[time].dataType.typeName()
    return F.col(time).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(time).cast("double")


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, latest: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Each row of ``left`` with a value of the rows of ``right`` that have its key and come at or before its time: that of the
    last one (of equal times, the greatest), or, unless ``latest``, the greatest of all.

    Both sides are one table; a key's rows are dealt into buckets of time, whose bounds are quantiles of all times, and the
    value is found by a running window in each bucket and carried from bucket to bucket by a window over one row a bucket.
    So a key of very many rows is spread over ``buckets`` tasks. Null keys are equal; rows of ``left`` without a time have a
    null value, null values of ``right`` count for nothing.
    """
    none = F.lit(None).cast(right.schema[value].dataType)
    a = left.select("*", _seconds(left, left_time).alias("_t"), F.lit(1).alias("_side"), none.alias("_v"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != by else F.col(by) for f in left.schema]
    b = right.select(*blank, _seconds(right, right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v")).filter("_t IS NOT NULL AND _v IS NOT NULL")
    both = a.unionByName(b)
    bounds = sorted(set(both.select("_t").approxQuantile("_t", [k / buckets for k in range(1, buckets)], 0.25 / buckets)))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("_t"))) if bounds else F.lit(0)
    rows = both.withColumn("_bucket", F.when(F.col("_t").isNull(), -1).otherwise(place))
    found = F.struct("_t", "_v") if latest else F.struct("_v")
    rows = rows.withColumn("_f", F.when(F.col("_side") == 0, found))
    within = Window.partitionBy(by, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(by, "_bucket").agg(F.max("_f").alias("_f")).withColumn("_c", F.max("_f").over(before))
    carried = carried.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), "_c")
    run = rows.withColumn("_m", F.max("_f").over(within)).filter("_side = 1")
    joined = run.join(carried, run[by].eqNullSafe(carried["_by"]) & (run["_bucket"] == carried["_b"]), "left")
    best = F.when(F.col("_t").isNotNull(), F.greatest("_m", "_c")["_v"])
    return joined.withColumn(value, best).select(*dict.fromkeys([*left.columns, value]))


def section_as_of(chunks: DataFrame, toc: DataFrame) -> DataFrame:
    """Each chunk with the last listed section that begins on its page or before; without a page on either side, the first
    section whose title its heading path holds.

    Pages are found as of, without pairs of chunks and sections; only chunks or sections that have no page are paired, within
    their document.
    """
    c = chunks.select("doc_id", "chunk_id", "page", "headings_path")
    section = F.struct("title", "prev_title", "next_title").alias("s")
    listed = toc.select("doc_id", F.col("page").alias("t_page"), F.struct(F.col("ord").alias("o"), section).alias("listed"), F.col("ord").alias("t_ord"), "title", section)
    paged = as_of(c, listed, "doc_id", "page", "t_page", "listed", latest=False)
    unpaged = c.filter("page IS NULL").join(listed, "doc_id").unionByName(c.filter("page IS NOT NULL").join(listed.filter("t_page IS NULL"), "doc_id"))
    named = unpaged.filter(F.col("headings_path").contains(F.col("title"))).groupBy("doc_id", "chunk_id").agg(F.min_by("s", "t_ord").alias("_b"))
    best = paged.join(named, ["doc_id", "chunk_id"], "left").withColumn("s", F.coalesce(F.col("listed.s"), F.col("_b")))
    return best.select("doc_id", "chunk_id", F.col("s.title").alias("toc_title"), F.col("s.prev_title").alias("toc_prev"), F.col("s.next_title").alias("toc_next"))
