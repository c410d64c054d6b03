"""Conversation prefix trie (11): chained SHA-256 digests of every prefix, nodes by (depth, digest), subtree sums.

A turn is known by the digest of its role and text, so texts are read once and never shuffled. A conversation's prefix of
d turns is known by the chain of its first d turn digests. What a node adds to its ancestors is summed along its smallest
member first: that conversation's prefixes are the node's ancestors, so every prefix row carries one running sum instead
of a row for each pair of node and ancestor, and rows stay as many as prefixes however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import forget, spread_join, stored, text_of

#: The root's digest, and the characters of ids that are packed into one row on the way to a node's digest of ends.
ROOT, PACKED = bytes(32), 1 << 16
_PREFIX = "conv_id long, depth long, node binary, parent binary, n_chars long, last boolean"


def marked(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, turn_digest, n_chars): the turns of each conversation in order, places from 1.

    Null turns come first; turns of equal number are ordered by their digests. Null roles and texts count as empty ones.
    Rows without a conv_id belong to no conversation and have no place here.
    """
    named, said = text_of(role), text_of(text)
    digest = F.unhex(F.sha2(F.concat(F.octet_length(named).cast("string"), F.lit(":"), named, said).cast("binary"), 256))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), digest.alias("turn_digest"), F.length(said).cast("long").alias("n_chars")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_turn"), "turn_digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "turn_digest", "n_chars")


def regrafted(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Marked turns with heads in common: the first h turns of a conversation c are those of c - c % block (fewer if it has
    fewer, none if it is absent), h = crc32(c) % heads; its own turns after its first h follow.

    Every conversation has a row of place 0 as well, so that those left without turns are still known.
    """
    base = F.pmod("conv_id", F.lit(block))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.select("conv_id").distinct()
    given = turns.filter((base == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "first")
    taken = ids.select("conv_id", (F.col("conv_id") - base).alias("first"), h.alias("h")).join(given, "first").filter("place <= h")
    start = ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("n_chars"))
    return start.unionByName(taken.select(*turns.columns)).unionByName(turns.filter(F.col("place") > h))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations that come one after the other, in order: only the last row is carried from batch to batch."""
    held: list[list] = [[] for _ in range(5)]
    conv = node = None
    depth = 0

    def given(last: list[bool], n: int) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        out = [pa.array(column[:n], kind) for column, kind in zip(held, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*out, pa.array(last[:n])], ["conv_id", "depth", "node", "parent", "n_chars", "last"])

    for batch in batches:
        for c, place, digest, n_chars in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if c != conv or conv is None:
                conv, depth, node = c, 0, ROOT
                for column, value in zip(held, (c, 0, ROOT, None, 0), strict=True):
                    column.append(value)
            if place > 0:
                parent, depth = node, depth + 1
                node = hashlib.sha256(node + digest).digest()
                for column, value in zip(held, (c, depth, node, parent, n_chars), strict=True):
                    column.append(value)
        n = len(held[0])
        if n > 1:
            yield given([d == 0 for d in held[1][1:]], n - 1)
            held = [column[n - 1 :] for column in held]
    if held[0]:
        yield given([True], 1)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn_digest, n_chars) -> (conv_id, depth, node, parent, n_chars, last), a row per prefix.

    The empty prefix is the root, depth 0, of every conversation that has a row. ``last`` tells the whole conversation.
    A conversation's rows, some fifty bytes each, are streamed through one task; none is held in memory as a whole.
    """
    rows = turns.select("conv_id", "place", "turn_digest", "n_chars")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_chain, _PREFIX)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (node, conv_id) rows as (node, first, ids): decimal ids joined by commas, some PACKED characters each."""
    node, first, ids, size = None, None, [], 0
    done: list[tuple] = []

    def given() -> pa.RecordBatch:
        nodes, firsts, texts = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts)], ["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (n != node or size > PACKED):
                done.append((node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = n, c
            ids.append(str(c))
            size += len(ids[-1])
        if done:
            yield given()
            done = []
    if ids:
        done.append((node, first, ",".join(ids)))
        yield given()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of packed rows in order; a node's text is hashed as it comes and never held."""
    node, state = None, None
    names = ["node", "ends_sha256"]
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n == node:
                state.update(b"," + ids.encode())
                continue
            if state:
                out.append((node, state.hexdigest()))
            node, state = n, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names)


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ascending, comma-joined ids of the conversations that end at a node.

    Ids are sorted by range of (node, id), so a node of very many ends is dealt to many tasks, and packed; its packed rows
    are then hashed in order by one task, as this digest can only be made from front to back.
    """
    whole = rows.filter("last").select("node", "conv_id")
    packed = whole.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_packed, "node binary, first long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, n_convs, n_chars, leaf) of prefix rows: conv_id is the smallest member, a leaf is a node
    at which all its members end."""
    found = rows.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("n_chars").alias("n_chars"), F.min("last").alias("leaf")
    )
    return found.select("node", "parent", "depth", "conv_id", "n_convs", "n_chars", "leaf")


def trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node), a row per node of
    the trie of all conversations of ``turns``, which :func:`marked` or :func:`regrafted` made; no rows make no node.

    A node is a distinct sequence of turns (role and text); members are conversations that start with it. ``saved_tokens``
    sums over the subtree what is stored once instead of once a member: (n_convs - 1) times the characters of the last
    text. Repeated turns are turns of their own. Other columns aren't looked at.
    """
    spark = turns.sparkSession
    rows, prefix_path = stored(prefixes(turns), "prefixes")
    found, node_path = stored(nodes(rows), "nodes")
    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    own = found.filter(F.col("leaf") | (saved > 0)).select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), saved.alias("saved"), F.col("leaf").cast("long").alias("leaves"))
    zero = F.lit(0).cast("long")
    path = rows.select("conv_id", "depth", "node", zero.alias("saved"), zero.alias("leaves")).unionByName(own)
    under = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upward = path.select("node", F.sum("saved").over(under).alias("saved"), F.sum("leaves").over(under).alias("leaves")).filter("node IS NOT NULL AND saved + leaves > 0")
    sums = upward.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = found.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    nobody = hashlib.sha256(b"").hexdigest()
    joined = found.join(sums, "node").join(children, "node", "left").join(ends(rows), "node", "left")
    full, full_path = stored(
        joined.select(
            "node", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256")
        ),
        "trie",
    )
    forget(spark, prefix_path)
    forget(spark, node_path)
    parents = full.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    below = spread_join(full.filter("parent IS NOT NULL"), parents, ["parent"], "_n", full.count())
    top = full.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node")
