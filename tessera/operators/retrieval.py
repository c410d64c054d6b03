"""Retrieval over a collection: filters, exact top-k, deduplication, quotas, boosts and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessera.functions import patterns as P
from tessera.functions import vector as V
from tessera.functions.text import contains_any

#: Queries that are compared in one pass: they go to every task, so their number is bounded.
MAX_QUERIES = 10_000


def _containing(part: str) -> Callable[[Column], Column]:
    return lambda y: y.contains(part)


def compile_filters(df: DataFrame, filters: list[str]) -> Column:
    """"field:value" entries, all of which must hold. ``*`` is any value, ``*x*`` a substring; an array matches by any
    of its elements. Entries without a colon are ignored."""
    tests = []
    for field, value in (f.split(":", 1) for f in filters if ":" in f):
        listed, c = isinstance(df.schema[field].dataType, ArrayType), F.col(field)
        if value == "*":
            tests.append(F.size(c) > 0 if listed else c.isNotNull())
        elif len(value) > 2 and value[0] == value[-1] == "*":
            part = value[1:-1]
            tests.append(F.exists(c, _containing(part)) if listed else c.contains(part))
        else:
            tests.append(F.array_contains(c, value) if listed else c.cast("string") == value)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def top_k(collection: DataFrame, query: list[float], k: int, filters: list[str] = (), vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k rows nearest to one vector by cosine, ties to the smaller id; the plan keeps k rows per partition.
    Zero vectors are nobody's neighbours."""
    score = V.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    wanted = collection.filter(compile_filters(collection, list(filters))).withColumn("score", score)
    return wanted.filter("score IS NOT NULL").drop(vector).orderBy(F.desc("score"), id_col).limit(k)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; those of zero vectors are NaN."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def matrix(ids: pa.Array, vectors: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of vectors as a matrix; a vector of another size than ``dim`` is an error that names its id."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != dim).any():
        at = int(np.flatnonzero(sizes != dim)[0])
        raise ValueError(f"the vector of {ids[at].as_py()} has {sizes[at]} numbers, not {dim}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)


class Best:
    """The k best rows for each of the queries ``names`` with unit vectors ``wanted``, over all batches of a task: scores to
    twelve decimals, ties to the smaller key. ``needs`` has a column for each feature that a query asks for.

    What a query's k-th best so far excludes is dropped as soon as scores are known; a task's rows are sent on once. Pairs
    are compared in single precision, whose error is bounded; those that it can't exclude are compared in double precision.
    """

    #: Queries of one matrix, and candidates that wait before they are ranked.
    STEP, WAITING = 256, 1 << 20

    def __init__(self, names: np.ndarray, wanted: np.ndarray, k: int, needs: np.ndarray | None = None) -> None:
        self.names, self.wanted, self.k, self.needs = names, wanted, k, needs
        self.floor = np.full(len(names), -np.inf)
        self.single = wanted.astype(np.float32)
        #: Twice what products and sums of unit vectors of this size can be off by in single precision, their own rounding included.
        self.error = 2 * (wanted.shape[1] + 4) * float(np.finfo(np.float32).eps)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, rows: np.ndarray, lacks: np.ndarray | None = None, asked: np.ndarray | None = None) -> None:
        """A batch of unit ``rows``, for the queries at ``asked`` (default all); ``lacks`` tells the rows without a feature."""
        places = np.arange(len(self.names)) if asked is None else asked
        single = rows.astype(np.float32).T
        for at in range(0, len(places), self.STEP):
            some = places[at : at + self.STEP]
            scores = self.single[some] @ single
            if self.needs is not None and lacks is not None:
                scores[self.needs[some] @ lacks.T > 0] = np.nan
            floor = self.floor[some]
            if np.isneginf(floor).any() and scores.shape[1] > self.k:  # without batches before, the batch's own k-th best bounds what can count
                low = np.nan_to_num(scores, nan=-np.inf)
                floor = np.maximum(floor, np.partition(low, low.shape[1] - self.k, axis=1)[:, -self.k] - self.error)
            query, row = np.nonzero(scores >= (floor - self.error).astype(np.float32)[:, None])  # false for NaN
            for cut in range(0, len(query), self.WAITING):
                q, r = some[query[cut : cut + self.WAITING]], row[cut : cut + self.WAITING]
                exact = np.round(np.einsum("ij,ij->i", self.wanted[q], rows[r]), 12)
                ok = exact >= self.floor[q] - 2e-12
                self.new.append((q[ok], keys[r[ok]], exact[ok]))
                self.waiting += int(ok.sum())
                if self.waiting > self.WAITING:
                    self._rank()
        if np.isneginf(self.floor[places]).any():
            self._rank()

    def _rank(self) -> None:
        if not self.new:
            return
        query, key, score = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first
        ok = rank < self.k
        self.kept, self.new, self.waiting = (query[ok], key[ok], score[ok]), [], 0
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]

    def found(self, query_id: str, id_col: str) -> Iterator[pa.RecordBatch]:
        self._rank()
        query, key, score = self.kept
        for at in range(0, len(query), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(self.names[query[cut]], pa.int64()), pa.array(key[cut]), pa.array(score[cut])], [query_id, id_col, "score"])


def by_blocks(
    queries: DataFrame, query_id: str, query_vector: str, dim: int | None, block: Callable[[list[int], np.ndarray, list[list[str]]], DataFrame], k: int, id_col: str, needs: str | None = None
) -> DataFrame:
    """Ranks what ``block`` finds for the queries, MAX_QUERIES of them at a time: the k best of each, ties to the smaller id.
    ``block`` takes their ids, unit vectors, and what each needs."""
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    found = None
    for b in range(blocks):
        wants = F.coalesce(F.col(needs), F.array().cast("array<string>")) if needs else F.array().cast("array<string>")
        mine = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        some = mine.select(F.col(query_id).cast("long"), query_vector, wants.alias("_needs")).dropna().collect()  # MAX_QUERIES, about
        vectors = pa.array([r[1] for r in some], pa.list_(pa.float64()))
        wanted = unit(matrix(pa.array([r[0] for r in some], pa.int64()), vectors, dim or (len(some[0][1]) if some else 1)))
        best = block([r[0] for r in some], wanted, [r[2] for r in some])
        found = best if found is None else found.unionByName(best)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k_each(
    collection: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", id_col: str = "vec_id", query_id: str = "query_id", query_vector: str = "query_vector",
    features: Column | None = None, needs: str | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the k rows nearest to each query by cosine, ties to the smaller id; rank from 1.

    Queries go to all tasks, MAX_QUERIES at a time, as one matrix; an Arrow batch of the collection is multiplied with it,
    and a task sends on its k best of each query. Ids are longs, those of queries too; rows and queries without an id or a vector
    count for nothing; zero vectors are nobody's neighbours; a vector of another size is an error that names its id. Scores
    are compared to twelve decimals.

    Where ``needs`` names the queries' arrays of strings, a row counts for a query only if its ``features``, an array of
    strings too, hold all that the query needs.
    """
    nothing = F.array().cast("array<string>")
    traits = F.coalesce(features, nothing) if needs else nothing
    rows = collection.select(F.col(id_col).cast("long").alias(id_col), vector, traits.alias("_traits")).dropna()

    def block(ids: list[int], wanted: np.ndarray, asked: list[list[str]]) -> DataFrame:
        place = {trait: n for n, trait in enumerate(sorted({t for some in asked for t in some}))}
        need = np.zeros((len(ids), len(place)), np.float32)
        for n, some in enumerate(asked):
            need[n, [place[t] for t in some]] = 1

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(np.array(ids, np.int64), wanted, k, need if place else None)
            for batch in batches:
                mine = unit(matrix(batch.column(0), batch.column(1), wanted.shape[1]))
                if not place:
                    best.add(np.asarray(batch.column(0)), mine)
                    continue
                lacks = np.ones((len(mine), len(place)), np.float32)
                for n, some in enumerate(batch.column(2).to_pylist()):
                    lacks[n, [place[t] for t in some if t in place]] = 0
                best.add(np.asarray(batch.column(0)), mine, lacks)
            yield from best.found(query_id, id_col)

        schema = f"{query_id} long, {id_col} long, score double"
        # Each task sends k rows of each query, so for many of them there are no more tasks than cores; rows stream through.
        few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism) if len(ids) > Best.STEP else rows
        return few.mapInArrow(run, schema) if ids else rows.sparkSession.createDataFrame([], schema)

    return by_blocks(queries, query_id, query_vector, None, block, k, id_col, needs)


def dedupe_best(hits: DataFrame, id_col: str = "id") -> DataFrame:
    """Of hits with the same id the one of the highest score (ties: the first)."""
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "ord")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedupe_first(hits: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Of hits of the same key the first in order; by ("doc_id", "page") missing pages are the same page."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def content_class(text: Column, target: str) -> Column:
    """target (two keywords of the type), relevant (one), financial (two financial ones) or other."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda words: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])
    mine = hits(P.CONTENT_KEYWORDS[target])
    return F.when(mine >= 2, "target").when(mine >= 1, "relevant").when(hits(P.CONTENT_KEYWORDS["financial"]) >= 2, "financial").otherwise("other")


def rebalance(hits: DataFrame, target: str, k: int, text: str = "text") -> DataFrame:
    """At most 60 % on target and 30 % relevant, the rest from the others by score; more on target is left out."""
    if target == "financial":
        return hits.orderBy(F.desc("score"), "ord").limit(k)
    marked = hits.withColumn("content_class", content_class(F.col(text), target))
    place = F.when(F.col("content_class") == "target", 0).when(F.col("content_class") == "relevant", 1).otherwise(2)
    # A rank up to a constant: every task keeps so many of each place before anything is shuffled, and classes are told once.
    rank = F.row_number().over(Window.partitionBy("_place").orderBy(F.desc("score"), "ord"))
    best = marked.withColumn("_place", place).withColumn("_rank", rank).filter(F.col("_rank") <= k)
    quota = F.when(F.col("_place") == 0, int(k * 0.6)).when(F.col("_place") == 1, int(k * 0.3)).otherwise(k)
    return best.filter(F.col("_rank") <= quota).orderBy("_place", F.desc("score"), "ord").limit(k).drop("_place", "_rank")


def _strings(values: list[str] | Column | None) -> Column | None:
    """A list as an array column, None if there is nothing in it; columns as they are, null as empty."""
    if isinstance(values, Column):
        return F.coalesce(values, F.array().cast("array<string>"))
    return F.array(*map(F.lit, values)) if values else None


def boost_alignment(hits: DataFrame, signals: dict[str, list[str] | Column]) -> DataFrame:
    """boosted_score: the score times a factor for each period, unit, reference and table that fits the query's. The query's
    signals are lists, or array columns of the hits where each hit has a query of its own."""
    factor = F.lit(1.0)
    if (wanted := _strings(signals.get("periods"))) is not None:
        fits = lambda values, p: F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(x).contains(F.lower(p)))
        one = lambda s, p: s * F.when(fits(F.col("mentioned_dates"), p), 1.5).otherwise(1.0) * F.when(fits(F.col("periods"), p), 1.4).otherwise(1.0)
        factor = F.aggregate(wanted, factor, one)
    if (wanted := _strings(signals.get("units"))) is not None:
        factor = factor * F.when(F.arrays_overlap("units", wanted), 1.3).otherwise(1.0)
    if (wanted := _strings(signals.get("table_refs"))) is not None:
        named = F.lower(F.concat_ws(" ", "doc_refs"))
        factor = factor * F.when(F.exists(wanted, lambda r: named.contains(F.lower(r))), 1.6).otherwise(1.0)
    factor = factor * F.when(F.col("chunk_type") == "table", 1.4).otherwise(1.0)
    return hits.withColumn("boosted_score", F.col("score") * factor)


def boost_numeric(hits: DataFrame, metrics: list[str] | Column, periods: list[str] | Column) -> DataFrame:
    """final_boost_score: for tables, tables with samples, metrics in common and periods in the dates."""
    base = F.coalesce("boosted_score", "score") if "boosted_score" in hits.columns else F.col("score")
    table = F.col("chunk_type") == "table"
    out = base * F.when(table, 1.5).otherwise(1.0) * F.when(table & (F.size("cell_samples") > 0), 1.2).otherwise(1.0)
    if (wanted := _strings(metrics)) is not None:
        out = out * F.pow(F.lit(1.1), F.size(F.array_intersect("metric_terms", wanted)))
    if (wanted := _strings(periods)) is not None:
        dates = F.coalesce("mentioned_dates", F.array().cast("array<string>"))
        out = out * F.pow(F.lit(1.15), F.size(F.filter(wanted, lambda p: F.exists(dates, lambda x: F.lower(x).contains(F.lower(p))))))
    return hits.withColumn("final_boost_score", out)


def boost_explanation(hits: DataFrame, metrics: list[str] | Column, text: str = "text") -> DataFrame:
    """explanation_boost and boosted_score: change notes, causal phrases, and metrics in the text."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    boost = F.when(F.col("is_change_note"), 0.3).when(contains_any(low, P.CAUSAL), 0.2).otherwise(0.0)
    if (wanted := _strings(metrics)) is not None:
        boost = boost + F.when(F.exists(wanted, lambda m: low.contains(m)), 0.1).otherwise(0.0)
    return hits.withColumn("explanation_boost", boost).withColumn("boosted_score", F.col("score") + F.col("explanation_boost"))


def rerank(hits: DataFrame, query: str, k: int, text: str = "text", scorer: Callable[[str, Column], Column] = V.lexical_score, order: str = "ord") -> DataFrame:
    """The k hits that the scorer rates highest; a score that isn't finite is replaced by the vector's; ties keep order."""
    raw = scorer(query, F.col(text)).cast("double")
    finite = F.when(raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != float("inf")), raw).otherwise(F.col("score"))
    return hits.withColumn("rerank_score", finite).orderBy(F.desc("rerank_score"), order).limit(k)
