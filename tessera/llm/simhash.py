"""SimHash near-dedup (8): pigeonhole blocks over 64-bit fingerprints, verified links, connected components.

Fingerprints that differ in at most three bits agree on three of six blocks at least, so all links meet among twenty
block choices of 32 bits or so; each choice is a join key. A key that very many different fingerprints share (a large
family of near copies) is split once more over its free blocks in the same way, after which at most some 2,000
different fingerprints can share a key: candidates grow with the rows and not with the square of a family.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, portions, spread_join, stored, text_of
from tessera.llm.components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
BLOCKS = 6
#: Fingerprints of one key from which it is split once more. It decides cost only, never a link.
SPLIT_FROM = 256


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else (b" ".join(words),)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in portions(batch.column(1)):
                found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


def _masks(free: int, blocks: int, chosen: int) -> list[int]:
    """All masks of ``chosen`` out of ``blocks`` nearly equal runs of the set bits of ``free``."""
    places = [k for k in range(BITS) if free >> k & 1]
    runs = [sum(1 << k for k in run.tolist()) for run in np.array_split(np.array(places), blocks)]
    return [sum(pick) for pick in combinations(runs, chosen)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _keyed(masks: Column) -> Column:
    """An array of (mask number, masked fingerprint) for an array of masks."""
    return F.transform(masks, lambda m, k: F.struct(k.alias("part"), F.col("fp").bitwiseAND(m).alias("sub")))


def _masks_column(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)) for m in masks])


def _pairs(rows: DataFrame, on: list[str]) -> DataFrame:
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    return rows.select(*on, F.col("fp").alias("u")).join(rows.select(*on, F.col("fp").alias("v")), on).filter(near).select("u", "v")


def links(distinct: DataFrame) -> DataFrame:
    """(fp) without repeats -> (u, v), u < v, all pairs at most three bits apart; a pair may come more than once."""
    outer = _masks((1 << BITS) - 1, BLOCKS, BLOCKS - DISTANCE)
    rows = distinct.select("fp", F.explode(_keyed(_masks_column(outer))).alias("b")).select("fp", F.col("b.part").alias("mask"), F.col("b.sub").alias("key"))
    counts, path = stored(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "blocks")
    shared = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    light = rows.join(counts.filter(F.col("n") <= SPLIT_FROM).drop("n"), ["mask", "key"])
    dense = spread_join(rows, counts.filter(F.col("n") > SPLIT_FROM), ["mask", "key"], "n", shared)
    everything = (1 << BITS) - 1
    inner = F.array(*[_masks_column(_masks(everything & ~m, 9, 6)) for m in outer])
    parts = dense.select("mask", "key", "fp", F.explode(_keyed(F.element_at(inner, F.col("mask") + 1))).alias("b"))
    dense = parts.select("mask", "key", "fp", "b.part", "b.sub")
    found, _ = stored(_pairs(light, ["mask", "key"]).union(_pairs(dense, ["mask", "key", "part", "sub"])), "pairs")
    forget(distinct.sparkSession, path)
    return found


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, root, component_id), a row per row of ``docs``.

    ``root`` names the component by one of its fingerprints, ``component_id`` by its smallest doc_id (null only if all
    its ids are null). Texts without words have fingerprint zero and link like others. Equal fingerprints are one node.
    Repeated rows come as often as they are; columns other than id and text aren't looked at. Ids are aggregated by
    fingerprint first, so what is joined and grouped by root is distinct fingerprints.
    """
    marked, _ = stored(fingerprints(docs, text_col, id_col), "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = components(links(prints.select("fp")))
    linked = nodes.withColumnRenamed("node", "fp").join(prints, "fp")
    sizes = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_fps"))
    total = nodes.count()
    named = spread_join(linked.select("fp", "n", "root"), sizes, ["root"], "_fps", total)
    alone = prints.join(nodes, F.col("fp") == F.col("node"), "left_anti").select("fp", "n", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    names, _ = stored(named.select("fp", "n", "root", "component_id").unionByName(alone), "names")
    return spread_join(marked, names, ["fp"], "n", marked.count()).select("doc_id", "fp", "root", "component_id")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component, as it is: that with the smallest id (rows without an id come last); of
    rows with the same id and fingerprint, one.

    A row is found by its id; where an id is null or its rows differ in their fingerprints, by id and fingerprint.
    """
    found = near_duplicates(docs, text_col, id_col).select("doc_id", "fp", "root")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    first, _ = stored(found.groupBy("root").agg(F.min(place).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.fp").alias("_fp")), "first")
    several = found.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("s")).filter("s OR doc_id IS NULL").select("doc_id")
    doubtful, _ = stored(several.select(F.col("doc_id").alias("_id")), "doubtful")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    named = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(docs[text_col]).alias("_text"), row)
    plain = first.join(doubtful, "_id", "left_anti").filter("_id IS NOT NULL").select("_id")
    single = named.select("_id", "_row").join(plain, "_id", "left_semi").dropDuplicates(["_id"]).select("_row.*")
    # The fingerprints of rows whose ids don't tell them apart are computed once more.
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"])
    unsure = named.join(doubtful, same(named, doubtful), "left_semi").withColumn("_fp", _fingerprint_udf()("_text")).drop("_text")
    told = unsure.join(first, same(unsure, first) & (unsure["_fp"] == first["_fp"]), "left_semi").dropDuplicates(["_id", "_fp"])
    return single.union(told.select("_row.*"))


def _fingerprint_udf():
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t) for _, some in portions(texts) for t in some]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return of
