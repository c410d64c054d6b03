"""What a client shows of hits: inferred types, snippets, tags, streamed lines, journeys and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNIPPET = 400


def chunk_type(stated: Column, table_id: Column, label: Column, text: Column) -> Column:
    """The stated type, else table if there is a table id, else the parser's label, else table by the text's first word."""
    full = lambda c: F.nullif(c, F.lit(""))
    by_id = F.when(full(table_id).isNotNull(), F.lit("table"))
    by_text = F.when(text.startswith("Table: "), F.lit("table"))
    return F.coalesce(full(stated), by_id, full(label), by_text, F.lit(""))


def snippet(text: Column, size: int = SNIPPET) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


#: Columns shown as tags in their order: as they are, after a word, and lists after a word.
PLAIN = ("method", "chunk_type", "document", "section_title")
WORDED = (
    ("page_number", "page "), ("page", "page "), ("section_h1", "h1: "), ("section_h2", "h2: "), ("section_h3", "h3: "), ("headings_path", "path: "),
    ("table_id", "table: "), ("table_title", "title: "), ("chunk_id", "chunk "), ("chunk_size", "size "), ("overlap", "overlap "),
)
LISTED = (
    ("metric_terms", "metrics: "), ("entities", "entities: "), ("doc_refs", "refs: "), ("mentioned_dates", "dates: "), ("policy_tags", "policies: "),
    ("row_headers", "rows: "), ("col_headers", "cols: "), ("units", "units: "), ("periods", "periods: "),
)
#: Where zero is shown too.
_ALWAYS = {"chunk_id"}


def tags(hits: DataFrame) -> Column:
    """The tags of a hit: those of the columns that ``hits`` has and that aren't empty."""
    kinds = dict(hits.dtypes)

    def worded(name: str, word: str) -> Column:
        text = F.col(name).cast("string")
        shown = F.col(name).isNotNull() & (text != "")
        if kinds[name] in ("int", "bigint", "smallint", "double") and name not in _ALWAYS:
            shown = shown & (F.col(name) != 0)
        return F.when(shown, F.concat(F.lit(word), text))

    out = [worded(name, "") for name in PLAIN if name in kinds]
    out += [worded(name, word) for name, word in WORDED[:2] if name in kinds]
    if {"start_char", "end_char"} <= set(kinds):
        out.append(F.concat(F.lit("chars "), F.col("start_char").cast("string"), F.lit("-"), F.col("end_char").cast("string")))
    out += [worded(name, word) for name, word in WORDED[2:6] if name in kinds]
    lists = lambda some: [F.when(F.size(n) > 0, F.concat(F.lit(w), F.array_join(n, ", "))) for n, w in some if n in kinds]
    out += lists(LISTED[:5])
    if "is_change_note" in kinds:
        out.append(F.when(F.col("is_change_note"), F.lit("change note")))
    out += [worded(name, word) for name, word in WORDED[6:8] if name in kinds] + lists(LISTED[5:])
    out += [worded(name, word) for name, word in WORDED[8:] if name in kinds]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def stream_events(body: Column, schema: str = "type STRING, message STRING, data STRING") -> Column:
    """The JSON of the ``data:`` lines of a server-sent stream, in order; lines that aren't JSON are left out."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith("data: "))
    parsed = F.transform(lines, lambda x: F.from_json(F.substring(x, 7, 1 << 30), schema))
    return F.filter(parsed, lambda e: e.isNotNull() & e["type"].isNotNull())


def journey(message: Column) -> Column:
    """struct(method, hop_1, hop_2, final) of a journey's second line, five steps parted by arrows; null if it has fewer."""
    parts = F.split(F.get(F.split(message, "\n"), F.lit(1)), " → ")
    step = lambda k: F.btrim(F.regexp_replace(F.get(parts, F.lit(k)), r"^[^\p{L}\p{N}]+", ""))
    final = F.regexp_replace(step(4), " chunks", "")
    return F.when(F.size(parts) >= 5, F.struct(step(1).alias("method"), step(2).alias("hop_1"), step(3).alias("hop_2"), final.alias("final")))


def upsert_history(history: DataFrame, entry: DataFrame, most: int = 1000) -> DataFrame:
    """The history with the entry in front, one row per conversation id, the newest ``most`` by time."""
    rest = history.join(entry.select("conv_id"), "conv_id", "left_anti")
    return entry.unionByName(rest).orderBy(F.desc("ts"), "conv_id").limit(most)
