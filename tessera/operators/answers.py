"""Answers from hits: context, prompts, citations, trails' summaries, and the strings that explain a search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P

#: Hits that an answer's context holds, and characters of a citation's preview.
CONTEXT_HITS, PREVIEW = 10, 200


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _or(hits: DataFrame, column: str, default: Column) -> Column:
    """A column if the hits have it, else the default, also where it is null."""
    return F.coalesce(F.col(column), default) if column in hits.columns else default


def _listed(hits: DataFrame, column: str) -> Column:
    return _or(hits, column, _texts([]))


def answer_context(hits: DataFrame, limit: int = CONTEXT_HITS) -> DataFrame:
    """One row, ``context``: the first hits by ``ord``, tables under their title and page, others under their number.

    Only the first hits are collected, however many there are; without hits the context is empty.
    """
    title = F.concat(F.lit("["), _or(hits, "table_title", F.lit("Table")), F.lit(", Page "), F.coalesce(F.col("page").cast("string"), F.lit("unknown")), F.lit("]: "))
    first = hits.orderBy("ord").limit(limit)
    part = F.struct("ord", "text", F.when(F.col("chunk_type") == "table", title).alias("title"))
    numbered = F.transform(F.array_sort(F.collect_list(part)), lambda x, i: F.concat(F.coalesce(x["title"], F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("]: "))), x["text"]))
    return first.agg(F.array_join(numbered, "\n\n").alias("context"))


def citations(hits: DataFrame, order: str = "ord") -> DataFrame:
    """``hits`` with ``citation_type`` and ``citation``: preview, source, scores, and for tables a block of their own."""
    long = F.length("text") > PREVIEW
    preview = F.when(long, F.concat(F.substring("text", 1, PREVIEW), F.lit("..."))).otherwise(F.col("text"))
    source = F.struct(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")).alias("doc_id"), F.col("page").alias("page"),
        _or(hits, "headings_path", F.lit("Unknown Section")).alias("section"), F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"),
    )
    table = F.struct(
        _or(hits, "table_title", F.lit("Table")).alias("title"), _listed(hits, "col_headers").alias("col_headers"), _listed(hits, "row_headers").alias("row_headers"),
        _listed(hits, "cell_samples").alias("cell_samples"), _listed(hits, "units").alias("units"), _listed(hits, "periods").alias("periods"),
    )
    is_table = F.coalesce(F.col("chunk_type") == "table", F.lit(False))
    rerank = F.col("rerank_score") if "rerank_score" in hits.columns else F.lit(None).cast("double")
    citation = F.struct(
        preview.alias("preview"), source.alias("source"), F.coalesce(F.col("score"), F.lit(0.0)).alias("vector_score"), rerank.alias("rerank_score"),
        F.when(is_table, table).alias("table"),
    )
    return hits.withColumn("citation_type", F.when(is_table, "table").otherwise("text")).withColumn("citation", citation)


def reshaped(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits in the shape that clients take: (id, score, rerank_score, text, chunk_type, doc_id, page)."""
    rerank = F.coalesce(F.col("rerank_score"), F.col("score")) if "rerank_score" in hits.columns else F.col("score")
    return hits.orderBy("ord").limit(k).select(
        "id", "score", rerank.alias("rerank_score"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("page"),
    )


def _some(label: str, values: Column, most: int | None = None) -> Column:
    """"label: a, b" of the first values; null if there is none."""
    few = F.slice(values, 1, most) if most else values
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(few, ", ")))


def signals_summary(metrics: Column, refs: Column, dates: Column) -> Column:
    """["metric:…", "reference:…", "date:…"], two dates at most."""
    named = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(name + ":"), x))
    return F.concat(named("metric", metrics), named("reference", refs), named("date", F.slice(dates, 1, 2)))


def suggestions(metrics: Column, refs: Column, first_date: Column, last_date: Column, tables: Column) -> Column:
    """What to expand by: metrics, references, the years named, and tables if there are several."""
    a, b = F.substring(first_date, 1, 4), F.substring(last_date, 1, 4)
    years = F.when(a == b, F.concat(F.lit("Temporal focus: "), a)).otherwise(F.concat(F.lit("Temporal range: "), a, F.lit("-"), b))
    tabular = F.when(tables > 1, F.lit("Prioritize table content for numeric evidence"))
    return F.array_compact(F.array(_some("Expand search for metrics: ", metrics, 2), _some("Follow references: ", refs, 2), years, tabular))


def explain_filters(metrics: Column, names: Column) -> Column:
    """The filters that an explanation reports: three metrics and two entities at most."""
    named = lambda field, xs, n: F.transform(F.slice(xs, 1, n), lambda x: F.concat(F.lit(field + ":"), x))
    return F.concat(named("metric_terms", metrics, 3), named("entities", names, 2))


def explain_rationale(metrics: Column, names: Column) -> Column:
    said = F.concat_ws("; ", _some("Expanded using metrics: ", metrics, 3), _some("Explored entities: ", names, 2))
    return F.when(said == "", F.lit("Used general business context expansion")).otherwise(said)


def numeric_filters(metrics: Column, periods: Column) -> Column:
    """The filters that a numeric search reports."""
    by_metric = F.transform(metrics, lambda m: F.concat(F.lit("metric_terms:"), m))
    by_period = F.transform(periods, lambda p: F.concat(F.lit("mentioned_dates:*"), p, F.lit("*")))
    return F.concat(_texts(["chunk_type:table", "doc_refs:*", "metric_terms:*"]), by_metric, by_period)


def numeric_rationale(metrics: Column, refs: Column, periods: Column, units: Column) -> Column:
    said = F.concat_ws(", ", _some("temporal focus: ", periods), _some("units: ", units), _some("metrics: ", metrics), _some("table references: ", refs))
    return F.when(said == "", F.lit("General table and metric-based search")).otherwise(F.concat(F.lit("Table-focused search with "), said))


def prompt(query: Column, context: Column, method: Column, intent: Column) -> Column:
    """struct(role, prompt) for a language model, by the query's intent."""
    role = domain = None
    for name, (who, what) in P.PROMPT_ROLES.items():
        role = F.when(intent == name, who) if role is None else role.when(intent == name, who)
        domain = F.when(intent == name, what) if domain is None else domain.when(intent == name, what)
    role, domain = role.otherwise(P.PROMPT_DEFAULT[0]), domain.otherwise(P.PROMPT_DEFAULT[1])
    text = F.format_string(P.PROMPT, domain, F.replace(method, F.lit("_"), F.lit(" ")), context, query, intent)
    return F.struct(role.alias("role"), text.alias("prompt"))


def table_title(proposed: Column, number: Column) -> Column:
    """A model's title without quotes; one that is too long or says nothing gives way to a numbered one."""
    title = F.btrim(F.translate(proposed, "\"'", ""))
    words = F.size(F.filter(F.split(title, r"\s+"), lambda w: w != ""))
    named = lambda kind: F.concat(F.lit("Table "), number.cast("string"), F.lit(": " + kind))
    weak = (title == "") | F.lower(title).isin("table", "data", "unknown")
    return F.when(proposed.isNull(), named("Data Table")).when((words > 6) | (F.length(title) > 50), named("Financial Data")).when(weak, named("Business Data")).otherwise(title)


def response(hits: DataFrame, query: str, intent: str, confidence: float, generate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row: the query, its intent, the answer of the provider (the context itself without one), citations in order and
    the counts of both hops. Takes the few final hits of a search."""
    context = answer_context(hits)
    none = F.lit("No relevant information found for this query.")
    answer = generate(F.lit(query), F.col("context")) if generate else F.col("context")
    cited = citations(hits).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "citation"))), lambda x: x["citation"]).alias("citations"),
        F.count_if(F.col("hop") == 1).alias("hop_1_count"), F.count_if(F.col("hop") == 2).alias("hop_2_count"),
    )
    head = context.select(F.lit(query).alias("query"), F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), F.when(F.col("context") == "", none).otherwise(answer).alias("answer"))
    return head.join(cited, how="cross")  # one row with one row


def flow_diagram(query: str, steps: list[tuple[str, int]]) -> str:
    """The steps of a search and their hits as a Mermaid graph."""
    named = [f"s0[Query: {query[:40]}]", *(f"s{k}[{name}: {n} chunks]" for k, (name, n) in enumerate(steps, 1))]
    return "graph TD\n" + "\n".join([f"  {x}" for x in named] + [f"  s{k} --> s{k + 1}" for k in range(len(steps))])
