"""Sources and sinks: document files by format, parsed-document JSON, collections, conversation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Formats by file extension.
FORMATS = {"md": "markdown", "html": "html", "json": "json"}
_PROV = "ARRAY<STRUCT<page_no: INT, bbox: STRUCT<l: DOUBLE, t: DOUBLE, r: DOUBLE, b: DOUBLE>>>"
_CELL = "STRUCT<start_row_offset_idx: INT, end_row_offset_idx: INT, start_col_offset_idx: INT, end_col_offset_idx: INT, text: STRING, column_header: BOOLEAN, row_header: BOOLEAN, row_section: BOOLEAN>"
PARSED = f"texts ARRAY<STRUCT<text: STRING, label: STRING, prov: {_PROV}>>, tables ARRAY<STRUCT<self_ref: STRING, label: STRING, prov: ARRAY<STRUCT<page_no: INT>>, data: STRUCT<table_cells: ARRAY<{_CELL}>>>>"


def files(spark: SparkSession, path: str, pattern: str = "*.{md,html,json}", recursive: bool = False) -> DataFrame:
    """(path, file_name, stem, format, content): whole files; an unknown extension has the format null."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    full = raw.select(F.expr("_metadata.file_path").alias("path"), F.expr("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return full.select("path", "file_name", F.regexp_replace("file_name", r"\.[^.]+$", "").alias("stem"), F.element_at(known, ext).alias("format"), "content")


def with_companions(found: DataFrame) -> DataFrame:
    """Markdown files with the JSON of the same stem, if there is one; JSON alone is left out."""
    js = found.filter("format = 'json'").select("stem", F.col("content").alias("companion"))
    return found.filter("format = 'markdown'").join(js, "stem", "left")


def with_folders(found: DataFrame) -> DataFrame:
    """folder_path, folder_hierarchy and folder_depth of each file."""
    out = found.withColumn("folder_path", T.folders("path"))
    return out.withColumn("folder_hierarchy", F.array_join("folder_path", "/")).withColumn("folder_depth", F.size("folder_path"))


def parsed(docs: DataFrame, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, parsed): parsed-document JSON; what can't be parsed is null."""
    return docs.select(F.col(id_col).alias("doc_id"), F.from_json(content, PARSED, {"mode": "PERMISSIVE"}).alias("parsed"))


def json_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ord, page, bbox): one row for each different text, at its first place with its last values."""
    rows = docs.select("doc_id", F.posexplode("parsed.texts").alias("ord", "t")).withColumn("text", F.btrim("t.text")).filter("text <> ''")
    first = F.get("t.prov", F.lit(0))
    value = F.struct(F.nullif(first["page_no"], F.lit(0)).alias("page"), first["bbox"].alias("bbox"))
    return rows.groupBy("doc_id", "text").agg(F.min("ord").alias("ord"), F.max_by(value, "ord").alias("v")).select("doc_id", "text", "ord", "v.page", "v.bbox")


def json_cells(docs: DataFrame) -> DataFrame:
    """The cells of all tables: (doc_id, table_id, label, page, ord, start_row, …)."""
    t = docs.select("doc_id", F.posexplode("parsed.tables").alias("n", "t"))
    unnamed = F.concat(F.lit("#/tables/"), F.col("n").cast("string"))
    c = t.select("doc_id", F.coalesce("t.self_ref", unnamed).alias("table_id"), F.col("t.label").alias("label"), F.get("t.prov", F.lit(0))["page_no"].alias("page"), F.posexplode("t.data.table_cells").alias("ord", "c"))
    names = {"start_row": "start_row_offset_idx", "end_row": "end_row_offset_idx", "start_col": "start_col_offset_idx", "end_col": "end_col_offset_idx", "text": "text"}
    flags = [F.coalesce(f"c.{f}", F.lit(False)).alias(f) for f in ("column_header", "row_header", "row_section")]
    return c.select("doc_id", "table_id", "label", "page", "ord", *[F.col(f"c.{v}").alias(k) for k, v in names.items()], *flags)


def page_of(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Chunks with the page and box of the text that equals theirs, in whole or after the first colon; else of the first
    text that holds theirs or is held by it. The second join is within a document."""
    t = texts.select("doc_id", "text", "ord", "page", "bbox")
    short = F.btrim(F.regexp_replace("text", r"(?s)^[^:]*:", ""))
    c = chunks.withColumn("_short", F.when(F.col("text").contains(":"), short))
    a = t.select("doc_id", "text", F.struct("page", "bbox").alias("_a"))
    b = t.select("doc_id", F.col("text").alias("_short"), F.struct("page", "bbox").alias("_b"))
    exact = c.join(a, ["doc_id", "text"], "left").join(b, ["doc_id", "_short"], "left").withColumn("_e", F.coalesce("_a", "_b")).drop("_a", "_b", "_short")
    rest = exact.filter("_e IS NULL").select("doc_id", "chunk_id", "text").alias("c").join(t.alias("t"), "doc_id").filter(F.col("c.text").contains(F.col("t.text")) | F.col("t.text").contains(F.col("c.text")))
    fuzzy = rest.groupBy("doc_id", "chunk_id").agg(F.min_by(F.struct("t.page"), F.col("t.ord")).alias("_f"))
    return exact.join(fuzzy, ["doc_id", "chunk_id"], "left").withColumn("page", F.coalesce("_e.page", "_f.page")).withColumn("bbox", F.col("_e.bbox")).drop("_e", "_f")


class Collection:
    """A table of points in Parquet, parted by method; the vectors' size is checked on writing."""

    def __init__(self, spark: SparkSession, path: str, dim: int) -> None:
        self.spark, self.path, self.dim = spark, path, dim

    def create(self, points: DataFrame) -> None:
        """Fails if the collection exists."""
        self._checked(points).write.mode("errorifexists").partitionBy("method").parquet(self.path)

    def append(self, points: DataFrame) -> None:
        self._checked(points).write.mode("append").partitionBy("method").parquet(self.path)

    def _checked(self, points: DataFrame) -> DataFrame:
        bad = F.raise_error(F.concat(F.lit(f"vectors must have {self.dim} numbers, not "), F.coalesce(F.size("embedding").cast("string"), F.lit("null"))))
        return points.withColumn("embedding", F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(bad.cast("array<float>")))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def by_method(self, method: str, limit: int = 10_000) -> DataFrame:
        return self.read().filter(F.col("method") == method).orderBy("chunk_id").limit(limit)

    def point(self, method: str, chunk_id: int) -> DataFrame:
        """The point with the first ten numbers of its vector."""
        return self.read().filter((F.col("method") == method) & (F.col("chunk_id") == chunk_id)).limit(1).withColumn("embedding", F.slice("embedding", 1, 10))

    def info(self) -> DataFrame:
        return self.read().groupBy("method").agg(F.count(F.lit(1)).alias("points"))

    def delete_method(self, method: str) -> None:
        """Drops a method's partition."""
        self._delete(f"{self.path}/method={method}")

    def drop(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def export_by_method(points: DataFrame) -> DataFrame:
    """(method, texts) in order; written with ``write.json`` it is the simple export."""
    return points.groupBy("method").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]).alias("texts"))


def export_detailed(points: DataFrame) -> DataFrame:
    """(method, chunk_id, document, page, chunk_type, words, text), a row per point: the detailed export, which is written
    with ``write.partitionBy("method").json`` so that no method's texts meet in one row."""
    has = set(points.columns)
    out = [F.col(c) if c in has else F.lit(None).cast("string").alias(c) for c in ("method", "chunk_id", "document", "page", "chunk_type")]
    return points.select(*out, T.word_count("text").alias("words"), "text")


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log, empty if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
