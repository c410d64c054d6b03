"""What the operators of this subpackage share: shared storage, hashing and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and the bytes 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


#: Bytes that a memo of a Python worker holds, and the longest key that it keeps.
MEMO_BYTES, LONGEST = 48 << 20, 64
#: What an entry of a memo takes besides its key and value, about: two objects and a place in the dict.
ENTRY_BYTES = 200
#: Characters of texts that are Python objects at a time.
PORTION = 1_000_000
#: Rows of a key from which a join sends its partner to all tasks; at least so many keys can't be that frequent.
FREQUENT, FREQUENT_KEYS = 1_000, 100_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Memo(dict):
    """What was worked out before by key, in bounded bytes: it starts over when full, and long keys aren't kept."""

    def __init__(self, most: int = MEMO_BYTES) -> None:
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, key, value, size: int) -> None:
        """Remember ``value``; ``size`` is the bytes of key and value."""
        if len(key) > LONGEST:
            return
        self.held += size + ENTRY_BYTES
        if self.held > self.most:
            self.clear()
            self.held = size + ENTRY_BYTES
        self[key] = value


def portions(column: pa.Array, size: int = PORTION) -> Iterator[tuple[int, list[str]]]:
    """Runs of an Arrow column of texts of about ``size`` bytes, with the place of the first: only one is in Python at once."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(column):
        end, n = at, 0
        while end < len(column) and (n == 0 or n < size):
            n += int(lengths[end]) + 1
            end += 1
        yield at, column.slice(at, end - at).to_pylist()
        at = end


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, one is set on the driver's machine if that is the whole cluster; else it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and the shuffle files of the
    writing are deleted with its end."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def spread_join(rows: DataFrame, names: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``names``, which has each key once and in ``count`` how many rows have it.

    Keys that hold a 100,000th of all ``total`` rows or more (at least 1,000 rows) are joined by sending their names, which
    are 100,000 at most, to all tasks; so no key meets in one task. ``count`` is dropped.
    """
    least = max(FREQUENT, total // FREQUENT_KEYS)
    hot = names.filter(F.col(count) >= least).drop(count)
    cold = names.filter(F.col(count) < least).drop(count)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path that :func:`stored` made, on whatever file system it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_of(column: str | Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    written = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(written) % divisor


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``step`` to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)
