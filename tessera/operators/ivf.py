"""Approximate search at scale: an inverted-file index of vectors by lists, of which a search reads a few.

Lists are the cells of spherical k-means centres, fitted on a bounded sample; every row is in the list of its nearest
centre, and lists are folders of one Parquet table. A query scores all rows of the lists whose centres are nearest to it,
exactly as :func:`tessera.operators.retrieval.top_k_each` does, so nothing is approximate but which lists are read: with
all lists probed the result is the exact one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.sources.shared import forget

#: The most lists, sampled rows for each list on which centres are fitted, and rounds of fitting.
MOST_LISTS, SAMPLED, ROUNDS = 1024, 40, 8
#: The share of true neighbours that a search is to find, the sampled rows and neighbours by which the number of lists for
#: it is measured.
TARGET, ASKED, NEIGHBOURS = 0.93, 256, 10


def centres_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``lists`` unit centres (fewer, if the sample has fewer rows): k-means by cosine; a centre left empty moves to the row
    that fits its own worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        scores = sample @ centres.T
        nearest = scores.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(scores.max(axis=1), kind="stable")[: len(empty)]]
        centres = R.unit(sums)
        centres[np.isnan(centres)] = 0.0
    return centres


class IvfIndex:
    """Vectors by list under ``path``: ``rows`` holds (id, vector, list), a row per vector; ``centres`` the lists' centres, and
    how many lists a search is to read."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector: str = "embedding") -> None:
        self.spark, self.path, self.id_col, self.vector = spark, path, id_col, vector

    @classmethod
    def build(cls, collection: DataFrame, path: str, lists: int | None = None, target: float = TARGET, id_col: str = "vec_id", vector: str = "embedding") -> IvfIndex:
        """Index every row that has an id and a vector; ``lists`` is the root of their number unless it is given, 1,024 at most.

        Centres are fitted on SAMPLED rows a list, some 40,000 at most. Zero vectors go to list -1, which no search reads.
        A list that very many rows share is written by several tasks. How many lists a search reads is measured: the exact
        neighbours of some ASKED rows are found by one scan, and as many of the nearest lists are read as hold ``target`` of them.
        """
        spark = collection.sparkSession
        rows = collection.select(F.col(id_col).cast("long").alias(id_col), vector).filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
        n = rows.count()
        lists = max(1, min(MOST_LISTS, lists or math.isqrt(n)))
        share = min(1.0, SAMPLED * lists / max(n, 1))
        sample = [r[0] for r in rows.select(vector).sample(share, seed=7).collect()] or [r[0] for r in rows.select(vector).limit(1).collect()]
        known = R.unit(np.array(sample, np.float64)) if sample else np.zeros((0, 1))
        centres = centres_of(known[~np.isnan(known).any(axis=1)], lists) if len(known) else known
        kind = rows.schema[vector].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = R.unit(R.matrix(batch.column(0), batch.column(1), centres.shape[1]))
                place = (found @ centres.T).argmax(axis=1) if len(centres) else np.zeros(len(found))
                place = np.where(np.isnan(found).any(axis=1), -1, place)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], [id_col, vector, "list"])

        placed = rows.mapInArrow(run, f"{id_col} long, {vector} {kind}, list int")
        writer = placed.hint("rebalance", "list").write.mode("errorifexists")
        (writer.partitionBy("list") if n else writer).parquet(f"{path}/rows")
        index = cls(spark, path, id_col, vector)
        probes = index._measured(centres, n, target) if len(centres) else 0
        spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centres)], "list int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
        return index

    def _measured(self, centres: np.ndarray, n: int, target: float) -> int:
        """How many of the lists nearest to a row hold ``target`` of its neighbours, by a sample of rows."""
        some = self.rows().filter("list >= 0").sample(min(1.0, ASKED / max(n, 1)), seed=11).select(F.col(self.id_col).alias("query_id"), F.col(self.vector).alias("query_vector"))
        asked = {r["query_id"]: r["query_vector"] for r in some.collect()}  # ASKED, about
        if not asked:
            return 1
        fixed = self.spark.createDataFrame(list(asked.items()), "query_id long, query_vector array<double>")
        exact = R.top_k_each(self.rows(), fixed, NEIGHBOURS, self.vector, self.id_col).select("query_id", self.id_col)
        held = self.rows().select(self.id_col, "list").join(F.broadcast(exact), self.id_col).collect()  # ASKED x NEIGHBOURS, about
        order = {q: np.argsort(np.argsort(-(R.unit(np.array([v], np.float64)) @ centres.T)[0], kind="stable")) for q, v in asked.items()}
        ranks = sorted(int(order[r["query_id"]][r["list"]]) for r in held)
        return 1 + ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)] if ranks else 1

    def _centres(self) -> tuple[np.ndarray, int]:
        found = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # MOST_LISTS at most
        return np.array([r["centre"] for r in found], np.float64), found[0]["probes"] if found else 0

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """(query_id, id, score, rank) as :func:`retrieval.top_k_each`, over the ``probes`` lists nearest to each query (as
        many as :meth:`build` measured unless given). Lists that no query probes aren't read. Queries without a direction find nothing."""
        centres, measured = self._centres()
        id_col, probes = self.id_col, max(1, min(len(centres), probes or measured))

        def block(ids: list[int], wanted: np.ndarray, _: list[list[str]]) -> DataFrame:
            ok = ~np.isnan(wanted).any(axis=1)
            near = np.argsort(-(wanted[ok] @ centres.T), axis=1, kind="stable")[:, :probes]
            askers: dict[int, np.ndarray] = {int(at): np.flatnonzero(ok)[(near == at).any(axis=1)] for at in np.unique(near)}
            read = self.rows().filter(F.col("list").isin(sorted(askers))).select(self.id_col, self.vector, "list")
            names = np.array(ids, np.int64)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = R.Best(names, wanted, k)
                for batch in batches:
                    keys, place = np.asarray(batch.column(0)), np.asarray(batch.column(2))
                    vectors = R.unit(R.matrix(batch.column(0), batch.column(1), centres.shape[1]))
                    for at in np.unique(place):
                        mine = place == at
                        best.add(keys[mine], vectors[mine], asked=askers[int(at)])
                yield from best.found(query_id, id_col)

            return read.mapInArrow(run, f"{query_id} long, {id_col} long, score double")

        if not len(centres):
            return self.spark.createDataFrame([], f"{query_id} long, {self.id_col} long, score double, rank int")
        return R.by_blocks(queries, query_id, query_vector, centres.shape[1], block, k, self.id_col)

    def drop(self) -> None:
        forget(self.spark, self.path)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """(query_id, wanted, hits, recall): of each query's exact neighbours, how many were found."""
    both = exact.select(query_id, id_col).join(found.select(query_id, id_col, F.lit(1).alias("_hit")), [query_id, id_col], "left")
    out = both.groupBy(query_id).agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("hits"))
    return out.withColumn("recall", F.col("hits") / F.col("wanted"))
