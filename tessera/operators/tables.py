"""Tables: cells to matrices, headers, rows packed greedily into groups, chunk texts and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.functions import text as T
from tessera.operators import folds

#: Words of a table chunk, and words that a header counts for.
MAX_WORDS, HEADER_WORDS = 300, 3
#: What names a table: ids repeat from document to document.
KEYS = ["doc_id", "table_id"]


def cell_matrix(cells: DataFrame) -> DataFrame:
    """Spans filled, later cells over earlier ones: (doc_id, table_id, row, col, text, column_header, row_header, row_section).

    Takes (doc_id, table_id, ord, start_row, end_row, start_col, end_col, text, column_header, row_header, row_section).
    """
    body = F.struct("ord", "text", "column_header", "row_header", "row_section")
    span = lambda a, b: F.explode(F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1)).otherwise(F.array(F.col(a))))
    rows = cells.select(*KEYS, body.alias("c"), "start_col", "end_col", span("start_row", "end_row").alias("row"))
    spread = rows.select(*KEYS, "row", "c", span("start_col", "end_col").alias("col"))
    return spread.groupBy(*KEYS, "row", "col").agg(F.max_by("c", "c.ord").alias("c")).select(*KEYS, "row", "col", "c.text", "c.column_header", "c.row_header", "c.row_section")


def rows_of(matrix: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, cells, section, header): cells in column order."""
    return matrix.groupBy(*KEYS, "row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("cells"),
        F.bool_or(F.coalesce("row_section", F.lit(False))).alias("section"),
        F.bool_and(F.coalesce("column_header", F.lit(False))).alias("header"),
    )


def group_rows(rows: DataFrame, max_words: int = MAX_WORDS, header_words: int = HEADER_WORDS) -> DataFrame:
    """(doc_id, table_id, group, rows): rows in order; a group ends before a section row and where it would get too long.

    A fold over a table's rows: what a row does depends on all before it.
    """
    heads = rows.filter("header").groupBy(*KEYS).agg(F.max(F.size("cells")).alias("headers"))
    body = rows.filter(~F.col("header")).join(heads, KEYS, "left")
    return _grouped(body, F.coalesce("headers", F.lit(0)) * header_words, [], max_words)


def _grouped(body: DataFrame, base: Column, others: list[str], max_words: int) -> DataFrame:
    """Rows without headers in groups, with other columns that all rows of a table share."""
    words = T.word_count(F.concat_ws(" ", "cells")).cast("int").alias("words")
    body = body.select(*KEYS, "row", "cells", "section", words, base.cast("int").alias("base"), *others)
    kinds = [body.schema[c] for c in ("row", "cells", "section", "words")]
    schema = StructType([body.schema[k] for k in KEYS] + [StructField("group", IntegerType()), StructField("rows", ArrayType(StructType(kinds))), *(body.schema[c] for c in others)])
    return folds.fold(body, KEYS, ["row"], lambda: folds.GroupRows(max_words), schema)


def table_text(title: Column, headers: Column, rows: Column) -> Column:
    """A title line, the headers over a rule, and the rows, cells parted by bars."""
    body = F.array_join(F.transform(rows, lambda r: F.array_join(r["cells"], " | ")), "\n")
    head = F.when(F.size(headers) > 0, F.concat(F.array_join(headers, " | "), F.lit("\n---")))
    return F.concat_ws("\n", F.concat(F.lit("Table: "), title), head, body)


def titled_chunks(rows: DataFrame, min_words: int = 3, max_words: int = MAX_WORDS, header_words: int = HEADER_WORDS) -> DataFrame:
    """What :func:`table_chunks` makes, of rows (doc_id, table_id, row, cells, section, header, label) that have their table's
    title: windows over rows that are dealt by document once, so that what makes the rows runs once."""
    table = Window.partitionBy(*KEYS)
    order = Window.partitionBy("doc_id").orderBy(F.length("table_id"), "table_id")
    whole = rows.repartition("doc_id").withColumns(
        {
            "headers": F.min_by("cells", F.when(F.col("header"), F.col("row"))).over(table),
            "widest": F.max(F.when(F.col("header"), F.size("cells"))).over(table),
            "table_no": F.dense_rank().over(order),
        }
    )
    title = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Table "), F.col("table_no").cast("string")))
    body = whole.filter(~F.col("header")).withColumns({"title": title, "headers": F.coalesce("headers", F.array().cast("array<string>"))})
    out = _grouped(body, F.coalesce("widest", F.lit(0)) * header_words, ["table_no", "title", "headers"], max_words)
    out = out.withColumn("text", F.explode(F.array(table_text(F.col("title"), F.col("headers"), F.col("rows")))))
    return out.filter(T.word_count("text") >= min_words).select(*KEYS, "table_no", "title", "group", "text")


def table_chunks(matrix: DataFrame, titles: DataFrame, min_words: int = 3) -> DataFrame:
    """(doc_id, table_id, table_no, title, group, text): titles (doc_id, table_id, label) or "Table n", n by order among
    the document's tables (ids of one document differ in their number alone)."""
    rows = rows_of(matrix)
    headers = rows.filter("header").groupBy(*KEYS).agg(F.min_by("cells", "row").alias("headers"))
    order = Window.partitionBy("doc_id").orderBy(F.length("table_id"), "table_id")
    numbered = matrix.select(*KEYS).distinct().withColumn("table_no", F.row_number().over(order))
    title = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Table "), F.col("table_no").cast("string")))
    named = numbered.join(titles.select(*KEYS, "label"), KEYS, "left").withColumn("title", title).drop("label")
    out = group_rows(rows).join(named, KEYS).join(headers, KEYS, "left")
    text = table_text(F.col("title"), F.coalesce("headers", F.array().cast("array<string>")), F.col("rows"))
    return out.withColumn("text", text).filter(T.word_count("text") >= min_words).select(*KEYS, "table_no", "title", "group", "text")


def cell_samples(rows: DataFrame) -> DataFrame:
    """At most ten "header: cell" of the first five rows, the header by its place."""
    headers = rows.filter("header").groupBy(*KEYS).agg(F.min_by("cells", "row").alias("headers"))
    body = rows.filter(~F.col("header")).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rs"))
    named = lambda r: F.filter(F.transform(r["cells"], lambda c, i: F.when(c != "", F.concat(F.coalesce(F.get("headers", i), F.lit("")), F.lit(": "), c))), lambda s: s.isNotNull())
    return body.join(headers, KEYS, "left").select(*KEYS, F.slice(F.flatten(F.transform(F.slice("rs", 1, 5), named)), 1, 10).alias("cell_samples"))


def table_metadata(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Table chunks with col_headers, row_headers, units, periods and cell_samples of their tables."""
    heads = rows.filter("header").groupBy(*KEYS).agg(F.min_by("cells", "row").alias("col_headers"))
    first = F.struct("row", F.get("cells", F.lit(0)).alias("t"))
    sides = rows.filter(~F.col("header")).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["t"]).alias("row_headers"))
    out = chunks.join(heads, KEYS, "left").join(sides, KEYS, "left").join(cell_samples(rows), KEYS, "left")
    return out.withColumn("units", T.units("text")).withColumn("periods", T.periods("text"))


def pack_rows(rows: DataFrame, key: str, order: str, size: str, capacity: float) -> DataFrame:
    """Greedy packing in order: (key, group, first, last, total), a new group where the next row wouldn't fit. A row without
    a size takes no room."""
    body = rows.select(key, F.col(order).alias("_place"), F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("_size"))
    place = body.schema["_place"].dataType
    fields = [body.schema[key], StructField("group", IntegerType()), StructField("first", place), StructField("last", place), StructField("total", DoubleType())]
    return folds.fold(body, [key], ["_place"], lambda: folds.PackRows(capacity), StructType(fields))
