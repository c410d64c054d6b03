"""Points that are written again and again: idempotent upserts by copy-on-write of key buckets under a committed manifest.

A table is a folder with ``data``, Parquet folders that are never changed, and ``manifest``, numbered JSON files. A manifest
names the folder in which each bucket of keys lies, and the last batch of each source. An upsert rewrites the buckets that
its keys fall into beside the old ones and then commits by creating the next manifest, which only one writer can do: a
reader sees a batch whole or not at all, a batch that is played again changes nothing, and what a failed writer left is
referred to by no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.sources.shared import file_system

#: Buckets of keys, and files that a micro-batch takes.
BUCKETS, FILES = 64, 10


class Conflict(Exception):
    """Another writer has committed since this one read the manifest; play the batch again."""


class PointTable:
    """Rows by key under ``path``; ``order`` names columns by which the last of a batch's rows of one key is told."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...], order: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), list(keys), list(order), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _files(self, folder: str) -> list[str]:
        fs, p = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self) -> dict:
        """The last manifest that was written to its end."""
        for name in sorted(self._files("manifest"), reverse=True):
            raw = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).collect())
            try:
                return json.loads(raw)
            except json.JSONDecodeError:
                continue
        return {"version": 0, "buckets": self.buckets, "folders": {}, "batches": {}}

    def _commit(self, manifest: dict) -> None:
        fs, p = file_system(self.spark, f"{self.path}/manifest/{manifest['version']:012d}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as error:
            raise Conflict(f"manifest {manifest['version']} is another writer's") from error
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        """The rows of buckets: a scan for each folder that holds some of them, of their partitions alone."""
        with_bucket = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        found = None
        for folder in sorted(set(folders.values())):
            mine = [int(b) for b, f in folders.items() if f == folder]
            rows = self.spark.read.schema(with_bucket).parquet(f"{self.path}/data/{folder}").filter(F.col("_bucket").isin(mine))
            found = rows if found is None else found.unionByName(rows)
        return self.spark.createDataFrame([], with_bucket) if found is None else found

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last committed state, or of an earlier one."""
        if version is None:
            return self._rows(self._manifest()["folders"]).drop("_bucket")
        raw = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0]
        return self._rows(json.loads(raw)["folders"]).drop("_bucket")

    def upsert(self, batch: DataFrame, batch_id: int, source: str = "", before_commit: Callable[[], None] = lambda: None) -> bool:
        """Rows of ``batch`` replace those of equal keys, null keys being equal too; of a batch's rows of one key the last counts.

        False, and nothing changes, if ``source`` has committed this batch or a later one. Only buckets of the batch's keys
        are read and rewritten. ``before_commit`` is called when the data is written and the manifest isn't.
        """
        old = self._manifest()
        if batch_id <= old["batches"].get(source, -1):
            return False
        rows = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        last = Window.partitionBy(*self.keys).orderBy(*[F.desc_nulls_last(c) for c in self.order or self.keys])
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(old["buckets"])).cast("int"))
        rows = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
        touched = [str(r[0]) for r in rows.select("_bucket").distinct().collect()]  # ``buckets`` at most
        kept = self._rows({b: f for b, f in old["folders"].items() if b in set(touched)})
        new = rows.select(*[F.col(k).alias(f"_new_{k}") for k in self.keys])
        same = None
        for k in self.keys:
            one = kept[k].eqNullSafe(new[f"_new_{k}"])
            same = one if same is None else same & one
        folder = f"{batch_id:012d}-{uuid.uuid4().hex}"
        merged = kept.join(new, same, "left_anti").unionByName(rows)
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        before_commit()
        folders = old["folders"] | dict.fromkeys(touched, folder)
        self._commit({"version": old["version"] + 1, "buckets": old["buckets"], "folders": folders, "batches": old["batches"] | {source: batch_id}})
        return True

    def vacuum(self) -> list[str]:
        """Deletes folders and manifests that the last manifest doesn't need; call it when no writer or reader is at work."""
        manifest = self._manifest()
        gone = [f"data/{f}" for f in self._files("data") if f not in set(manifest["folders"].values())]
        gone += [f"manifest/{m}" for m in self._files("manifest") if m != f"{manifest['version']:012d}.json"]
        for name in gone:
            fs, p = file_system(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)
        return gone


def upsert_stream(table: PointTable, source: str, checkpoint: str, files: int = FILES) -> StreamingQuery:
    """Parquet files of points as they land, ``files`` of them to a micro-batch, upserted into ``table`` once each."""
    landing = table.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id, source)

    return landing.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
