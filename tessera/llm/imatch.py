"""Document fingerprints (12): I-Match over a band of inverse document frequencies, by randomised lexicon subsets.

The lexicon is the terms that between a thousandth and a twentieth of all documents hold, at least two. By Markov's
inequality there are at most a thousand times as many of them as a document holds different terms on average, whatever
the corpus, so the lexicon goes to all tasks. A document's distinct lexicon terms, sorted, are hashed as a whole and for
SUBSETS random subsets of the lexicon at each of LEVELS densities, each half of the one before, from the density 2^-L at
which a subset holds about one of its terms: a subset's hash stays the same as long as no term of it comes or goes, so the
share of equal hashes tells how much two documents have in common.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PORTION, portions, text_of

#: The band, as shares of all documents, and the least documents of a term.
RARE, COMMON, LEAST = 1 / 1000, 1 / 20, 2
SUBSETS, LEVELS, SEED = 16, 4, 42
#: Characters from which a term is known by its digest, and different terms that a task counts before it sends them on.
LONGEST, HELD = 64, 200_000
#: Documents to a chunk of neighbours, the most chunks, and ids sampled for each bound between chunks.
CHUNK, CHUNKS, SAMPLED = 1_000, 100_000, 8

_WORDS = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str) -> set[str]:
    """The distinct words of a text in lower case; long ones by their digest."""
    found = set(_WORDS.findall(text.lower()))
    long = [w for w in found if len(w) > LONGEST]
    for w in long:
        found.remove(w)
        found.add("#" + xxhash.xxh3_128_hexdigest(w.encode()))
    return found


def lexicon(docs: DataFrame, text_col: str = "text", rare: float = RARE, common: float = COMMON, least: int = LEAST) -> list[str]:
    """The terms, sorted, that at least ``rare`` and at most ``common`` of all rows hold, and ``least`` rows at least.

    There are at most mean number of distinct terms / ``rare``. Nulls count as rows without terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str | None] = Counter()

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.string()), pa.array(counted.values(), pa.int64())], ["term", "n"])
            counted.clear()
            return batch

        for batch in batches:
            for _, texts in portions(batch.column(0)):
                for text in texts:
                    counted.update(terms(text))
                counted[None] += len(texts)
                if len(counted) > HELD:
                    yield given()
        if counted:
            yield given()

    counts = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n_docs = F.lit(docs.count())
    band = counts.filter(F.col("term").isNotNull() & (F.col("n") >= F.greatest(F.lit(least), F.ceil(n_docs * rare))) & (F.col("n") <= F.greatest(F.lit(least), n_docs * common)))
    return sorted(r["term"] for r in band.select("term").collect())


def _digests(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each term its 64-bit hash and, for each random order of the lexicon, the sparsest density at which it is drawn."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode(), SEED) for w in words), np.uint64, len(words))
    mixed = hashes[:, None] ^ (_ODD * np.arange(1, SUBSETS + 1, dtype=np.uint64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    lowest = mixed & (~mixed + np.uint64(1))
    levels = np.where(lowest == 0, 64, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64))).astype(np.int8)
    return hashes, levels


@dataclass(frozen=True)
class Print:
    """A fingerprint: the first level, the hash of all terms, and the subsets' hashes, level by level; 0 for an empty subset."""

    first: int
    whole: int
    subsets: np.ndarray

    def __str__(self) -> str:
        return f"{self.first:02x}{self.whole:016x}" + self.subsets.astype(">u4").tobytes().hex()

    def likeness(self, other: Print) -> float:
        """Of the subsets of levels in common, from the sparser document's first on, that hold a term of either: the share
        with equal hashes. Equal fingerprints are alike by 1; without any such subset the likeness is 0."""
        if self.whole == other.whole:
            return 1.0
        start = max(self.first, other.first)
        n = min(self.first, other.first) + LEVELS - start
        if n <= 0:
            return 0.0
        a, b = self.subsets[start - self.first :][:n], other.subsets[start - other.first :][:n]
        held = (a != 0) | (b != 0)
        total = int(held.sum())
        return int((held & (a == b)).sum()) / total if total else 0.0


class Printer:
    """Fingerprints by one lexicon."""

    def __init__(self, words: list[str]) -> None:
        self.place = {w: k for k, w in enumerate(words)}
        self.hashes, self.levels = _digests(words)

    def of(self, text: str) -> Print:
        """Texts without a lexicon term are known by all their words, and those without words by themselves."""
        found = terms(text)
        at = sorted([self.place[w] for w in found if w in self.place])
        if at:
            hashes, levels = self.hashes[at], self.levels[at]
        else:
            hashes, levels = _digests(sorted(found) or [text])
        first = len(hashes).bit_length() - 1
        parts: dict[tuple[int, int], list[bytes]] = {}
        drawn, subset = np.nonzero(levels >= first)
        for k, s, top in zip(drawn.tolist(), subset.tolist(), levels[drawn, subset].tolist(), strict=True):
            raw = hashes[k].tobytes()
            for level in range(min(top - first + 1, LEVELS)):
                parts.setdefault((level, s), []).append(raw)
        subsets = np.zeros((LEVELS, SUBSETS), np.uint32)
        for (level, s), some in parts.items():
            subsets[level, s] = xxhash.xxh32_intdigest(b"".join(some), SEED) or 1
        return Print(first, xxhash.xxh64_intdigest(hashes.tobytes(), SEED), subsets)


def fingerprints(docs: DataFrame, words: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint), a row per row; by the lexicon of ``docs`` unless ``words`` are given. Null texts are empty."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col) if words is None else words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(sent.value)
        for batch in batches:
            for at, texts in portions(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([str(printer.of(t)) for t in texts])], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its last half, rounded down, replaced by the first as many characters of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def neighbours(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(chunk, tail, doc_id, tie, packed), sorted within partitions: chunks of documents of adjacent ids, whole in one
    partition; texts are packed by zstd, as they are shuffled once.

    Each chunk ends with tail rows, copies of the documents of the next chunk's first id; the last chunk's are those of the
    first. Bounds between chunks come from a sample of ids, which decides cost only. Null ids come first, texts of an id
    that repeats are ordered by ``tie``, half their XXH64.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = ids.count()
    wanted = max(1, min(CHUNKS, n // CHUNK))
    sample = sorted(r[0] for r in ids.filter("doc_id IS NOT NULL").sample(min(1.0, SAMPLED * wanted / max(n, 1)), seed=SEED).collect())  # SAMPLED x CHUNKS, about
    bounds = np.array(sorted(set(sample[:: max(1, len(sample) // wanted)][1:])), np.int64)

    def chunk_of(values: pa.Array) -> np.ndarray:
        found = np.searchsorted(bounds, values.fill_null(0).to_numpy(zero_copy_only=False), side="right") + 1
        return np.where(values.is_null().to_numpy(zero_copy_only=False), 0, found).astype(np.int32)

    @F.arrow_udf("int")
    def chunk_udf(values: pa.Array) -> pa.Array:
        return pa.array(chunk_of(values))

    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id")))
    heads = sorted((r["chunk"], r["f"]["doc_id"] if r["f"] else None) for r in ids.select("doc_id", chunk_udf("doc_id").alias("chunk")).groupBy("chunk").agg(first.alias("f")).collect())
    # A head's copies end the chunk before; the first chunk's follow the last chunk.
    ends_of = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            chunks = chunk_of(batch.column(0))
            for at, texts in portions(batch.column(1)):
                out: list[tuple] = []
                ids_ = batch.column(0).slice(at, len(texts)).to_pylist()
                for chunk, doc_id, text in zip(chunks[at : at + len(texts)].tolist(), ids_, texts, strict=True):
                    raw = text.encode()
                    row = (doc_id, xxhash.xxh64_intdigest(raw, SEED) >> 1, packer.compress(raw))
                    out.append((chunk, False, *row))
                    if doc_id in ends_of:
                        out.append((ends_of[doc_id], True, *row))
                kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk", "tail", "doc_id", "tie", "packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    dealt = rows.mapInArrow(run, "chunk int, tail boolean, doc_id long, tie long, packed binary")
    return dealt.repartition("chunk").sortWithinPartitions("chunk", "tail", F.asc_nulls_first("doc_id"), "tie")


def compared(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row.

    A row's text is compared with itself edited, that is with its last half replaced by the start of the next document's
    text, and with the next document; the last one's next is the first. Null texts are empty. Fingerprints depend on the
    text and the corpus alone, so equal texts have equal ones. A single document is its own next. Rows of the same id
    follow one another by their texts' XXH64 (seed 42, without its lowest bit).
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer, unpacker, last = Printer(sent.value), zstandard.ZstdDecompressor(), None
        for batch in batches:
            for at, packed in portions(batch.column(4), PORTION // 4):
                out = []
                tails, ids = (batch.column(k).slice(at, len(packed)).to_pylist() for k in (1, 2))
                for tail, doc_id, raw in zip(tails, ids, packed, strict=True):
                    if tail and last is None:
                        continue
                    text = unpacker.decompress(raw).decode()
                    mine = last[2] if last and last[1] == text else printer.of(text)
                    if last:
                        other = edited(last[1], text)
                        theirs = last[2] if other == last[1] else printer.of(other)
                        digest = hashlib.sha256(other.encode()).hexdigest()
                        out.append((last[0], len(last[1]), digest, str(last[2]), str(theirs), last[2].likeness(theirs), last[2].likeness(mine)))
                    last = None if tail else (doc_id, text, mine)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, text_col, id_col).mapInArrow(run, schema)
