"""Files of any known format to chunks, and what can't be chunked to a table of errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, html_blocks, tables
from tessera.sources import readers

COLUMNS = ("doc_id", "chunk_type", "ord", "text", "headings_path", "table_id", "table_title")


def _shaped(chunks: DataFrame, kind: str | None = None) -> DataFrame:
    """The columns that all formats share; those that a format lacks are null."""
    has = set(chunks.columns)
    kinds = dict.fromkeys(COLUMNS, "string") | {"ord": "int"}
    out = [F.col(c).cast(kinds[c]).alias(c) if c in has else F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS]
    return chunks.select(*out) if kind is None else chunks.select(*out).withColumn("chunk_type", F.lit(kind))


def _tables(chunks: DataFrame) -> DataFrame:
    return _shaped(chunks.withColumns({"ord": F.col("group"), "table_title": F.col("title")}), "table")


def chunk_markdown_files(files: DataFrame) -> DataFrame:
    """Tidy text chunks of Markdown."""
    chunks = chunking.chunk_markdown(files, "content", "doc_id")
    return _shaped(chunking.tidy(chunks))


def chunk_html_files(files: DataFrame) -> DataFrame:
    """Tidy text chunks of pages, and chunks of their tables."""
    text = chunking.tidy(html_blocks.chunk_html(files, "content", "doc_id"))
    return _shaped(text).unionByName(_tables(html_blocks.html_table_chunks(files, "content", "doc_id")))


def chunk_json_files(files: DataFrame) -> DataFrame:
    """The texts of parsed documents as paragraphs, and chunks of their tables."""
    docs = readers.parsed(files)
    cells = readers.json_cells(docs)
    texts = readers.json_texts(docs).filter(T.is_meaningful("text"))
    named = cells.select("doc_id", "table_id", "label").distinct()
    return _shaped(texts, "paragraph").unionByName(_tables(tables.table_chunks(tables.cell_matrix(cells), named)))


#: What chunks the files (doc_id, content) of a format; register() adds to them.
FORMATS = {"markdown": chunk_markdown_files, "html": chunk_html_files, "json": chunk_json_files}


def register(name: str, chunker) -> None:
    FORMATS[name] = chunker


def chunk_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (doc_id, format, content) -> (chunks, errors).

    ``errors`` has (doc_id, format, error): formats without a chunker, files without content, and JSON that can't be read.
    Each format is one branch of a union, so files of all formats are read in one pass per format and never one by one.
    """
    empty = F.col("content").isNull() | (T.stripped("content") == "")
    read = F.from_json("content", readers.PARSED)
    broken = (F.col("format") == "json") & ~empty & F.coalesce(read["texts"].isNull() & read["tables"].isNull(), F.lit(True))
    unknown = F.col("format").isNull() | ~F.col("format").isin(*FORMATS)
    error = F.when(unknown, F.concat(F.lit("Unsupported format: "), F.coalesce("format", F.lit("unknown")))).when(empty, "No content").when(broken, "Not a parsed document")
    marked = files.withColumn("error", error)
    good = marked.filter("error IS NULL")
    chunks = reduce(DataFrame.unionByName, [chunker(good.filter(F.col("format") == name)) for name, chunker in FORMATS.items()])
    return chunks, marked.filter("error IS NOT NULL").select("doc_id", "format", "error")
