"""Quality classifier (2): importance resampling between hashed n-gram models of target and raw text.

Two bag-of-n-grams models are counted: one of the target (documents labelled good), one of the raw text (all
documents). A document's log importance weight is the summed log ratio of its n-grams' probabilities. Documents are
then drawn without replacement by Gumbel top-k: noise fixed by the id is added to the weight and the k highest stay,
k being the number of documents on the good side of the cut that parts the labelled ones best. A word's letters, its
punctuation with its case, pairs of words, and a word equal to the one before are n-grams, so that decoration,
shouting and stuttering show in the models and not only odd words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ENTRY_BYTES, LONGEST, MEMO_BYTES, forget, portions, stored, text_of

#: Buckets of the hashed n-grams, the size of both models.
BUCKETS = 1 << 14
#: Added to every bucket's count, in n-grams.
SMOOTHING = 1.0
#: Labelled documents of either class that the target model and the cut are fitted on, those of the lowest hashes.
SAMPLE = 20_000
#: Weights and noise are whole millionths of a nat: sums are exact, in any order.
UNIT = 1_000_000
_CORE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_REPEAT = zlib.crc32(b"\0same as before") % BUCKETS
_EMPTY = zlib.crc32(b"\0no words") % BUCKETS


class Grams:
    """Hashes the n-grams of texts; a word that was seen lately isn't looked at again, in ``most`` bytes about."""

    def __init__(self, most: int = MEMO_BYTES) -> None:
        self.most = most
        self.memo: dict[bytes, int] = {}  # places in the arrays
        self.n = self.held = 0
        self.core = np.zeros(1024, np.uint64)
        self.mark = np.zeros(1024, np.int64)

    def _learn(self, word: bytes) -> int:
        """The place of the hash of the word's letters and the bucket of its punctuation and case."""
        at = self.n
        if at == len(self.core):
            self.core, self.mark = np.resize(self.core, 2 * at), np.resize(self.mark, 2 * at)
        core = b"".join(_CORE.findall(word))
        case = b"A" if len(core) > 1 and core.isupper() else b"a"
        self.core[at] = zlib.crc32(core.lower())
        self.mark[at] = zlib.crc32(b"\0" + _CORE.sub(b"", word) + case) % BUCKETS
        self.n += 1
        self.held += 16
        if len(word) <= LONGEST:
            self.memo[word] = at
            self.held += len(word) + ENTRY_BYTES
        return at

    def of(self, texts: list[str | None], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the texts' n-grams and the place of the text of each, from ``first``."""
        if self.held > self.most:
            self.__init__(self.most)
        words = [(t or "").encode().split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        known, flat = self.memo.get, list(chain.from_iterable(words))
        ids = np.fromiter((known(w, -1) for w in flat), np.int64, len(flat))
        for k in np.flatnonzero(ids < 0).tolist():
            found = known(flat[k], -1)
            ids[k] = self._learn(flat[k]) if found < 0 else found
        core, mark = self.core[ids], self.mark[ids]
        owner = np.repeat(np.arange(len(texts)), sizes) + first
        pair = ((core[:-1] * np.uint64(0x9E3779B97F4A7C15) + core[1:]) >> np.uint64(20)) % np.uint64(BUCKETS)
        pair = np.where(core[:-1] == core[1:], _REPEAT, pair.astype(np.int64))
        inside = owner[:-1] == owner[1:]
        none = np.flatnonzero(sizes == 0)
        return (
            np.concatenate([(core % np.uint64(BUCKETS)).astype(np.int64), mark, pair[inside], np.full(len(none), _EMPTY)]),
            np.concatenate([owner, owner, owner[:-1][inside], none + first]),
        )


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, good): at most SAMPLE ids of either class; ids that are labelled both ways are left out."""
    clean = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).alias("good")).dropna()
    once = clean.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("other")).filter("good = other").drop("other")
    pick = lambda good: once.filter(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return pick(True).union(pick(False))


def count_models(docs: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id", memo: int = MEMO_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over the target (sampled good documents) and over all documents."""
    flagged = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(sample.filter("good")), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, target, raw = Grams(memo), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.array(batch.column(0).to_pylist(), bool)
            for first, texts in portions(batch.column(1)):
                buckets, owner = grams.of(texts, first)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[good[owner]], minlength=BUCKETS)
        if raw.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(target), pa.array(raw)], ["bucket", "target", "raw"])

    sums = flagged.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    found = np.zeros((2, BUCKETS), np.int64)
    for row in sums.collect():  # a row for each bucket
        found[:, row.bucket] = row.target, row.raw
    return found[0], found[1]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Millionths of log(p target / p raw) by bucket; zero everywhere if there is no target."""
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    smooth = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)
    return np.round(np.log(smooth(target) / smooth(raw)) * UNIT).astype(np.int64)


def log_weight(ratios: np.ndarray, memo: int = MEMO_BYTES):
    """A function of a text column: its log importance weight in millionths of a nat."""

    @F.arrow_udf("long")
    def weight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams(memo)
        for texts in batches:
            out = np.zeros(len(texts), np.int64)
            for first, some in portions(texts):
                buckets, owner = grams.of(some, first)
                np.add.at(out, owner, ratios[buckets])
            yield pa.array(out)

    return weight


def gumbel(id_col: Column, seed: int = 0) -> Column:
    """Standard Gumbel noise in millionths, fixed by the id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.round(-F.log(-F.log(u)) * UNIT).cast("long")


def best_cut(good: np.ndarray, bad: np.ndarray) -> int | None:
    """The middle of the widest gap between weights at which the fewest labelled documents are on the wrong side."""
    if not len(good) or not len(bad):
        return None
    values = np.unique(np.concatenate([good, bad]))
    wrong = np.searchsorted(np.sort(good), values, "left") + len(bad) - np.searchsorted(np.sort(bad), values, "left")
    best = np.flatnonzero(wrong == wrong.min())
    gap = [values[k] - (values[k - 1] if k else values[k]) for k in best]
    k = best[int(np.argmax(gap))]
    return int(values[k] - gap[int(np.argmax(gap))] // 2)


def kth_highest(values: DataFrame, k: int) -> int | None:
    """The k-th highest of a column ``key`` of longs, exactly, by counting in ever finer bins."""
    low, high, n = values.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not k or low is None:
        return None
    if k >= n:
        return low
    while high > low:
        width = (high - low) // 4096 + 1
        bins = values.filter(F.col("key").between(low, high)).groupBy(F.floor((F.col("key") - low) / width).alias("bin")).count().collect()  # 4,096 at most
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if k <= row["count"]:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            k -= row["count"]
    return low


class Resampler:
    """Fitted models, and the key from which documents stay (None: all stay, as there is nothing to tell them by).

    ``weights`` are the stored (doc_id, weight, key) of the documents that it was fitted on, at ``path``; ``memo`` is the
    bytes of words that a worker remembers.
    """

    def __init__(self, ratios: np.ndarray, seed: int, key: int | None, weights: DataFrame | None = None, path: str | None = None, memo: int = MEMO_BYTES) -> None:
        self.ratios, self.seed, self.key, self.weights, self.path, self.memo = ratios, seed, key, weights, path, memo

    def judged(self) -> DataFrame:
        """(doc_id, weight, key, kept), a row per document of the fit."""
        return self.weights.withColumn("kept", self._kept(F.col("key")))

    def _kept(self, key: Column) -> Column:
        return F.lit(True) if self.key is None else key >= self.key

    def marked(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """``docs`` as a struct ``row``, with ``weight`` and ``noise`` (millionths) and ``kept``."""
        row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
        noise = gumbel(docs[id_col].cast("long"), self.seed).alias("noise")
        out = docs.select(row, log_weight(self.ratios, self.memo)(text_of(docs[text_col])).alias("weight"), noise)
        return out.withColumn("kept", self._kept(F.col("weight") + F.col("noise")))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", seed: int = 0, memo: int = MEMO_BYTES) -> Resampler:
    """Count the models, find the cut on labelled documents, and draw: the k highest of weight plus noise stay.

    Rows with equal keys at the k-th place all stay. Without labels of both classes everything stays. Null texts count
    as empty; ids may be null or repeated (they share their noise); an empty table gives models of no use and no rows;
    columns other than id and text aren't looked at.
    """
    spark = docs.sparkSession
    sample, labelled = stored(_labelled(labels, id_col, label_col), "labelled")
    ratios = log_ratios(*count_models(docs, sample, text_col, id_col, memo))
    everything = Resampler(ratios, seed, None, memo=memo).marked(docs, text_col, id_col)
    doc_id = F.col("row").getField(id_col).cast("long").alias("doc_id")
    weights, path = stored(everything.select(doc_id, "weight", (F.col("weight") + F.col("noise")).alias("key")), "weights")
    told = weights.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "good").agg(F.min("weight").alias("weight"))
    told = told.select("good", "weight").toPandas()  # twice SAMPLE at most
    forget(spark, labelled)
    cut = best_cut(told.weight[told.good].to_numpy(), told.weight[~told.good].to_numpy()) if len(told) else None
    if cut is None:
        return Resampler(ratios, seed, None, weights, path, memo)
    k = weights.filter(F.col("weight") >= cut).count()
    at = kth_highest(weights, k)
    return Resampler(ratios, seed, at if at is not None else (1 << 62), weights, path, memo)


def resample(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", seed: int = 0, memo: int = MEMO_BYTES) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns only; rows as in :func:`fit`."""
    fitted = fit(docs, labels, text_col, id_col, label_col, seed, memo)
    forget(docs.sparkSession, fitted.path)
    return fitted.marked(docs, text_col, id_col).filter("kept").select("row.*")
