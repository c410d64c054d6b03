"""Metrics and reports over chunks, files, phases and query histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dollars for a thousand tokens.
TOKEN_PRICE = 0.00015


def chunk_metrics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """By type: chunks, mean characters, all words."""
    from tessera.functions.text import word_count

    return chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length(text)), 3).alias("avg_chars"), F.sum(word_count(text)).alias("n_words"))


def batch_totals(files: DataFrame) -> DataFrame:
    """Totals and rates over file metrics (ok, chunks, seconds, tokens)."""
    ok = F.count_if("ok")
    return files.agg(
        F.count(F.lit(1)).alias("files"), ok.alias("succeeded"), F.round(ok / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 3).alias("success_pct"), F.sum("chunks").alias("chunks"),
        F.sum("tokens").alias("tokens"), F.round(F.sum("chunks") / F.nullif(F.sum("seconds"), F.lit(0.0)), 3).alias("chunks_per_second"), F.round(F.sum("tokens") / 1000 * TOKEN_PRICE, 6).alias("cost"),
    )


def breakdown(chunks: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by each of two columns and in all, as grouping sets of one pass: (first, second, level, n)."""
    a, b = F.col(first), F.col(second)
    return chunks.groupingSets([[a], [b], []], a, b).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


#: Dollars for a thousand tokens of prompts and of answers, and the share of prompts.
PROMPT_PRICE, ANSWER_PRICE, PROMPT_SHARE = 0.00015, 0.0006, 0.7


def blended_cost(tokens: Column) -> Column:
    """The cost of tokens of which 70 % are prompts and 30 % answers; :func:`batch_totals` counts all as prompts."""
    return F.round(tokens / 1000 * (PROMPT_SHARE * PROMPT_PRICE + (1 - PROMPT_SHARE) * ANSWER_PRICE), 6)


def content_profile(hits: DataFrame, by: str) -> DataFrame:
    """By group: hits, distinct pages and sections, and hits of each type as a map."""
    counts = hits.groupBy(by, "chunk_type").agg(F.count(F.lit(1)).alias("k"))
    types = counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_type", "k")))).alias("chunk_types"))
    return hits.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"), F.count_distinct("section").alias("sections")).join(types, by)


def performance(history: DataFrame, by: str) -> DataFrame:
    """By group: queries, mean and greatest seconds, mean confidence, and the share answered from the cache."""
    return history.groupBy(by).agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.max("seconds").alias("max_seconds"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.avg(F.col("cached").cast("int")), 6).alias("cache_hit_rate"),
    )


def phases(steps: DataFrame, run: str) -> DataFrame:
    """Steps (run, phase, items, seconds) with items a second and the phase's share of its run, and the run's efficiency."""
    total = F.sum("seconds").over(Window.partitionBy(run))
    return steps.withColumns(
        {
            "rate": F.round(F.col("items") / F.nullif(F.col("seconds"), F.lit(0.0)), 6),
            "share_pct": F.round(F.col("seconds") / F.nullif(total, F.lit(0.0)) * 100, 3),
            "efficiency": efficiency(total),
        }
    )


def run_summary(files: DataFrame, by: str) -> DataFrame:
    """By format: files, failures, chunks and the error of the first that failed; the rows of a run's report."""
    return files.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("ok")).alias("failed"), F.sum("chunks").alias("chunks"), F.min_by("error", F.when(~F.col("ok"), F.col("file"))).alias("first_error")
    )


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The share of rows with a value, in per cent, for each column (arrays: with an element)."""
    kinds = dict(rows.dtypes)
    filled = lambda c: F.coalesce((F.size(c) > 0) if kinds[c].startswith("array") else F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.lit(False))
    means = rows.agg(*[F.round(F.avg(filled(c).cast("double")) * 100, 3).alias(c) for c in columns])
    return means.unpivot([], columns, "field", "coverage")


def recent(history: DataFrame, order: str, n: int = 1000, tie: str | None = None) -> DataFrame:
    """The last n rows of a history."""
    return history.orderBy(F.desc(order), *([F.desc(tie)] if tie else [])).limit(n)


def optimal_thresholds(history: DataFrame, least: int = 50, of_intent: int = 10, confident: int = 5) -> DataFrame:
    """By intent: the mean relevance of confident answers less a tenth, kept within .5 and .95; .8 if they are few.
    Nothing while the history or the intent's part of it is short."""
    sure = F.col("confidence") > 0.7
    enough = F.count_if(sure) >= confident
    value = F.when(enough, F.least(F.greatest(F.avg(F.when(sure, F.col("relevance"))) - 0.1, F.lit(0.5)), F.lit(0.95))).otherwise(0.8)
    total = history.agg(F.count(F.lit(1)).alias("_n"))
    by = history.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), value.alias("threshold")).filter(F.col("n") >= of_intent)
    return by.join(F.broadcast(total), F.col("_n") >= least).select("intent", "n", "threshold")


def timeline(steps: DataFrame, by: str, order: str, seconds: str) -> DataFrame:
    """Running time of the steps of each run, and each step's share in per cent."""
    w = Window.partitionBy(by)
    running = F.sum(seconds).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("cumulative", F.round(running, 6)).withColumn("share_pct", F.round(F.col(seconds) / F.nullif(F.sum(seconds).over(w), F.lit(0.0)) * 100, 3))


def efficiency(seconds: Column) -> Column:
    return F.when(seconds < 60, "high").when(seconds < 300, "medium").otherwise("low")


def missing_fields(columns: list[str]) -> Column:
    """Names of required fields that are null."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in columns]))


def term_counts(text: Column, terms: list[str]) -> Column:
    """Occurrences of each term, as a map without the absent ones."""
    low = F.lower(text)
    every = F.array(*[F.struct(F.lit(t).alias("key"), ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int").alias("value")) for t in terms])
    return F.map_from_entries(F.filter(every, lambda e: e["value"] > 0))


def report(totals: dict, rows: list[dict] | None = None) -> str:
    """A run's totals as Markdown, and under them a table of the few rows that sum it up (by format or phase)."""
    out = ["| metric | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in totals.items()]]
    if rows:
        names = list(rows[0])
        out += ["", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]]
    return "\n".join(out)
