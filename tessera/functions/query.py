"""Functions of query texts as Columns: intents, keywords, variants, content types and numeric signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions.text import bound, contains_any, word_matches


def _hits(text: Column, found: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in found])


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def intent(query: Column) -> Column:
    """struct(intent, confidence): most pattern hits, ties to the first; confidence is hits by words, one at most."""
    low = F.lower(query)
    scores = {name: _hits(low, found) for name, found in P.INTENTS.items()}
    best = F.greatest(*scores.values())
    name = F.when(best == 0, F.lit("unknown"))
    for key, score in scores.items():
        name = name.when(score == best, key)
    words = F.greatest(F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")), F.lit(1))
    return F.struct(name.alias("intent"), F.least(F.lit(1.0), best / words).alias("confidence"))


def keywords(query: Column, of: Column) -> Column:
    """Words of the query that matter for the intent ``of``, in order, repeats included."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"\b\w+\b"), 0)

    def wanted(w: Column) -> Column:
        relevant = of == "unknown"
        for name, found in P.INTENTS.items():
            relevant = relevant | ((of == name) & reduce(lambda a, b: a | b, [w.rlike(p) for p in found]))
        return w.isin(P.PRESERVERS) | (~w.isin(P.NOISE_WORDS) & (relevant | ((F.length(w) > 3) & ~w.rlike(r"^\d+$"))))

    return F.filter(words, wanted)


def _among(terms: list[str]):
    return lambda w: w.isin(terms)


def _not_among(terms: list[str]):
    return lambda w: ~w.isin(terms)


def focused(words: Column, of: Column) -> Column:
    """Keywords with those of the intent first and few others; without a list of its own, the first four."""
    out = F.when(F.lit(False), words)
    for name, (terms, others) in P.FOCUS.items():
        lead = F.filter(words, _among(terms))
        rest = F.filter(words, _not_among(terms))
        out = out.when(of == name, F.concat(lead, F.slice(rest, 1, others)))
    return out.otherwise(F.slice(words, 1, 4))


def search_variants(query: Column, of: Column, words: Column, lead: Column) -> Column:
    """The query, its keywords, and its focused keywords if they are four at most: distinct, three at most."""
    full = F.when(F.size(words) > 1, F.array_join(words, " "))
    short = F.when((of != "unknown") & F.size(lead).between(1, 4), F.array_join(lead, " "))
    return F.slice(F.array_distinct(F.array_compact(F.array(query, full, short))), 1, 3)


def optimized_query(query: Column, confidence: Column, variants: Column) -> Column:
    """The second variant if the intent is clear, else the query."""
    return F.when((confidence > 0.7) & (F.size(variants) > 1), F.get(variants, F.lit(1))).otherwise(query)


def preserve_context(of: Column, confidence: Column) -> Column:
    return (confidence < 0.5) | of.isin("process", "comparative", "temporal")


def understand(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """``queries`` with intent, confidence, keywords, variants, optimized_query and context_preserved.

    Each step is a column of its own: later ones use it many times, and expressions this deep would multiply if inlined.
    """
    q = F.col(query_col)
    out = queries.withColumn("_i", intent(q)).withColumn("intent", F.col("_i.intent")).withColumn("confidence", F.col("_i.confidence")).drop("_i")
    out = out.withColumn("keywords", keywords(q, F.col("intent"))).withColumn("_lead", focused(F.col("keywords"), F.col("intent")))
    out = out.withColumn("variants", search_variants(q, F.col("intent"), F.col("keywords"), F.col("_lead"))).drop("_lead")
    return out.withColumn("optimized_query", optimized_query(q, F.col("confidence"), F.col("variants"))).withColumn("context_preserved", preserve_context(F.col("intent"), F.col("confidence")))


def intent_filters(signals: Column) -> Column:
    """Filters of a struct of signals (temporal, financial, references): dates by part, any metric, any reference."""
    dates = F.transform(signals["temporal"], lambda v: F.concat(F.lit("mentioned_dates:*"), v, F.lit("*")))
    one = lambda values, text: F.when(F.size(values) > 0, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    return F.concat(dates, one(signals["financial"], "metric_terms:*"), one(signals["references"], "doc_refs:*"))


def financial_terms(query: Column) -> Column:
    """Abbreviations in upper case and words over three letters that aren't stop words or times: distinct, in order."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"\b\w+(?:/\w+)?\b"), 0)
    kept = F.transform(words, lambda w: F.when(w.isin(P.FINANCIAL_ABBREVIATIONS), F.upper(w)).when(
        (F.length(w) > 3) & ~w.isin(P.FINANCIAL_STOPWORDS) & ~w.isin(P.TEMPORAL_NOISE) & w.rlike(r"\p{L}"), w))
    return F.array_distinct(F.array_compact(kept))


def financial_variants(query: Column, terms: Column) -> Column:
    """The query, its terms together, and the first two alone: distinct by lower case, three at most."""
    more = F.when(F.size(terms) > 1, F.concat(F.array(F.array_join(terms, " ")), F.slice(terms, 1, 2))).otherwise(terms)
    every = F.concat(F.array(query), more)
    first = F.filter(every, lambda v, i: ~F.array_contains(F.transform(F.slice(every, 1, i), lambda x: F.lower(x)), F.lower(v)))
    return F.slice(first, 1, 3)


def best_financial_query(query: Column, variants: Column) -> Column:
    """The first variant of two words at most that isn't the query, else the query."""
    short = F.filter(F.slice(variants, 2, 2), lambda v: (F.size(F.split(v, " ")) <= 2) & (v != query))
    return F.coalesce(F.get(short, F.lit(0)), query)


def content_type(query: Column) -> Column:
    """struct(type, confidence) by keywords."""
    low, name = F.lower(query), None
    for key, words in P.CONTENT_TYPES.items():
        name = F.when(contains_any(low, words), key) if name is None else name.when(contains_any(low, words), key)
    name = name.otherwise("general")
    return F.struct(name.alias("type"), F.when(name == "general", 0.5).otherwise(0.7).alias("confidence"))


def content_expansions(query: Column, of: Column) -> Column:
    """The query, with leading keywords of the type that it lacks, then two keywords alone: four at most."""
    low, words = F.lower(query), F.split(F.lower(query), r"\s+")
    out = F.when(of == "general", F.array(query))
    for name, terms in P.QUERY_KEYWORDS.items():
        added = [F.when(~low.contains(t), F.concat_ws(" ", query, F.lit(t))) for t in terms[:3]]
        lacking = F.slice(F.filter(_array(terms), lambda t: ~F.array_contains(words, t)), 1, 2)
        alone = F.when(F.size(lacking) > 0, F.array_join(lacking, " "))
        out = out.when(of == name, F.slice(F.array_compact(F.array(query, *added, alone)), 1, 4))
    return out


def retrieval_intent(query: Column) -> Column:
    """struct(primary, confidence, strategy): the quick rules, then the fallback's keywords, all as substrings."""
    low = F.lower(query)
    count = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    case = lambda primary, confidence, strategy: F.struct(F.lit(primary).alias("primary"), F.lit(confidence).alias("confidence"), F.lit(strategy).alias("strategy"))
    out = F.when(contains_any(low, P.QUICK_EXPLAIN), case("explain", 0.8, "causal_expansion"))
    out = out.when(contains_any(low, P.QUICK_LOOKUP) & (count <= 5), case("lookup", 0.8, "semantic_expansion"))
    for primary, strategy, words in P.FALLBACK:
        out = out.when(contains_any(low, words), case(primary, 0.6, strategy))
    return out.otherwise(case("lookup", 0.6, "semantic_expansion"))


def _found(query: Column, rules: list[tuple[str, list[int]]]) -> Column:
    parts = []
    for pattern, groups in rules:
        if len(groups) < 2:
            parts.append(F.regexp_extract_all(query, F.lit(pattern), groups[0] if groups else 0))
        else:
            parts.append(F.zip_with(*[F.regexp_extract_all(query, F.lit(pattern), g) for g in groups], lambda a, b: F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(*parts))


def numeric_signals(query: Column) -> Column:
    """struct(periods, units, values, table_refs) of a query; distinct, those of the first pattern first."""
    return F.struct(
        _found(query, P.QUERY_PERIODS).alias("periods"), _found(query, P.QUERY_UNITS).alias("units"),
        _found(query, P.QUERY_VALUES).alias("values"), _found(query, P.QUERY_TABLES).alias("table_refs"),
    )


def universal_signals(text: Column, kinds: tuple[str, ...] = ("financial_terms", *P.UNIVERSAL, *P.NUMBERS)) -> Column:
    """Business signals of a text: the five most frequent financial terms (ties in the list's order), and distinct
    matches by family on lower-cased text, the pattern's group where it has one. Only the ``kinds`` are looked for."""
    return bound(F.lower(text), lambda low: F.struct(*[_signals(low, kind).alias(kind) for kind in kinds]))


def _signals(low: Column, kind: str) -> Column:
    none = F.array().cast("array<string>")
    if kind in P.UNIVERSAL:
        return F.array_sort(F.array_distinct(F.concat(*[word_matches(low, p, 1) for p in P.UNIVERSAL[kind]])))
    if kind in P.NUMBERS:
        found = F.regexp_extract_all(low, F.lit(P.NUMBERS[kind]), 0)
        return F.array_sort(F.array_distinct(F.when(~contains_any(low, P.NUMBER_SIGNS[kind]), none).otherwise(found)))
    times = lambda t: -F.floor((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t))
    some = [F.when(low.contains(t), F.struct(times(t).alias("n"), F.lit(k).alias("k"), F.lit(t).alias("t"))) for k, t in enumerate(P.FINANCIAL_TERMS)]
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*some))), 1, 5), lambda x: x["t"])


def legacy_signals(signals: Column) -> Column:
    """The four short lists that retrieval expands by: ten, ten, ten and five at most."""
    prefixed = F.concat(F.transform(signals["monetary_values"], lambda x: F.concat(F.lit("amount_"), x)), F.transform(signals["percentages"], lambda x: F.concat(F.lit("percentage_"), x)))
    return F.struct(
        F.slice(F.concat(signals["financial_terms"], signals["performance"], prefixed), 1, 10).alias("metric_terms"),
        F.slice(F.concat(signals["organizations"], signals["geographic"]), 1, 10).alias("entities"),
        F.slice(signals["time_periods"], 1, 10).alias("mentioned_dates"),
        F.slice(signals["doc_refs"], 1, 5).alias("doc_refs"),
    )


def flatten_signals(signals: Column) -> Column:
    """map of lists -> ["type:value"], by type and place."""
    return F.flatten(F.transform(F.array_sort(F.map_entries(signals)), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))


def variations(query: Column, metrics: Column, names: Column) -> Column:
    """Query variations for the second hop: templates of two metrics and two entities, then of topics; the first four."""
    templated = lambda items, templates: F.flatten(F.transform(F.slice(items, 1, 2), lambda x: F.array(*[F.replace(F.lit(t), F.lit("{}"), x) for t in templates])))
    low = F.lower(query)
    topics = [F.when(contains_any(low, words), _array(texts)).otherwise(F.array().cast("array<string>")) for words, texts in P.TOPIC_VARIATIONS]
    every = F.concat(templated(metrics, P.METRIC_TEMPLATES), templated(names, P.ENTITY_TEMPLATES), *topics)
    return F.slice(F.array_distinct(F.when(F.size(every) > 0, every).otherwise(_array(P.DEFAULT_VARIATIONS))), 1, 4)
