"""Keyed state on streams: a classification cache that forgets, and adaptive thresholds over each intent's last answers.

Both run on streams and, for a check, on tables; state is Spark's own and bounded by key: one result, or the last thousand
answers. On a stream the state store must be RocksDB's (:func:`with_state_store`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Answers that are kept of each intent, and answers from which an intent has a threshold of its own.
KEPT, OF_INTENT, CONFIDENT = 1000, 10, 5


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own for stateful streams, which need the RocksDB state store; ``spark`` stays as it is."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def _ready(df: DataFrame) -> DataFrame:
    """Naming the session's streams starts the coordinator of state stores, which tables with state need as well."""
    df.sparkSession.streams.active  # noqa: B018
    return df


def quick_intent(text: str) -> str:
    """The offline classifier: the intent's leading words, else a look-up."""
    low = text.lower()
    return "explain" if any(w in low for w in ("why", "how", "cause", "reason")) else "lookup"


class Cache(StatefulProcessor):
    """One key's result, classified once and used again until nobody has asked for it for ``ttl`` seconds."""

    def __init__(self, classify: Callable[[str], str], ttl: int) -> None:
        self.classify, self.ttl = classify, ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.result = handle.getValueState("result", "intent string, used long, asked long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.result.get() if self.result.exists() else None
        intent, used, asked = known or (None, 0, 0)
        before = used
        for batch in rows:
            batch = batch.sort_values(["ts", "id"], kind="stable")
            stamps = (batch["ts"].astype("int64") // 10 ** {"s": 0, "ms": 3, "us": 6, "ns": 9}.get(getattr(batch["ts"].dtype, "unit", "ns"), 9) * 1000).tolist()
            out = []
            for id_, text, at in zip(batch["id"], batch["text"], stamps, strict=True):
                fresh = intent is None or at - used > self.ttl
                if fresh:
                    intent, asked = self.classify(text), 0
                used, asked = max(used, at), asked + 1
                out.append((id_, intent, not fresh, asked))
            yield pd.DataFrame(out, columns=["id", "intent", "cached", "asked"])
        self.result.update((intent, used, asked))
        if before:
            self.handle.deleteTimer(before + self.ttl)
        self.handle.registerTimer(used + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nobody asked in time: the key's state is dropped."""
        self.result.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached_intents(queries: DataFrame, classify: Callable[[str], str] = quick_intent, ttl: int = 3600, late: str = "1 hour") -> DataFrame:
    """(id long, ts, text) -> (id, intent, cached, asked): every query's intent, whether it was known, and how many times its
    text has been asked since it was classified.

    Texts are one key if they are equal but for case and outer blanks; null texts are empty. A key's state is dropped when
    the watermark passes its last use by ``ttl`` seconds, so state is as large as the texts of that span. On a stream,
    queries later than ``late`` are left out, and a text that is asked more than 10,000 times in one micro-batch is counted
    in the order in which Spark hands these over.
    """
    named = queries.select(F.col("id").cast("long").alias("id"), "ts", F.coalesce("text", F.lit("")).alias("text")).filter("ts IS NOT NULL")
    keyed = named.withColumn("key", F.sha2(F.lower(F.trim("text")), 256))
    if queries.isStreaming:
        keyed = keyed.withWatermark("ts", late)
    else:
        keyed = keyed.repartition("key").sortWithinPartitions("key", "ts", "id")
    return _ready(keyed).groupBy("key").transformWithStateInPandas(Cache(classify, ttl), "id long, intent string, cached boolean, asked long", "Append", "EventTime" if queries.isStreaming else "ProcessingTime")


class Recent(StatefulProcessor):
    """An intent's last answers, and the threshold that they give."""

    def __init__(self, kept: int) -> None:
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "asked array<long>, id array<long>, confidence array<double>, relevance array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        names = ["asked", "id", "confidence", "relevance"]
        kept = pd.DataFrame({n: list(v) for n, v in zip(names, held, strict=True)}) if held else None
        for batch in rows:
            both = batch[names] if kept is None else pd.concat([kept, batch[names]])
            kept = both.sort_values(["asked", "id"], kind="stable").tail(self.kept)
        self.last.update(tuple(kept[n].tolist() for n in names))
        sure = kept[kept["confidence"] > 0.7]
        value = float(np.clip(sure["relevance"].mean() - 0.1, 0.5, 0.95)) if len(sure) >= CONFIDENT else 0.8
        if len(kept) >= OF_INTENT:
            yield pd.DataFrame([(key[0], len(kept), value)], columns=["intent", "n", "threshold"])

    def close(self) -> None:
        pass


def adaptive_thresholds(history: DataFrame, kept: int = KEPT) -> DataFrame:
    """(intent, asked long, id long, confidence, relevance) -> (intent, n, threshold): as
    :func:`tessera.operators.metrics.optimal_thresholds`, over the last ``kept`` answers of each intent.

    On a stream a row comes whenever an intent's answers change. Answers are ordered by time and id; rows of an intent are
    read in batches, of which ``kept`` are held. Null intents are an intent; null scores count as not confident.
    """
    rows = history.select("intent", F.col("asked").cast("long").alias("asked"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(F.col("relevance").cast("double"), F.lit(0.0)).alias("relevance"))
    return _ready(rows).groupBy("intent").transformWithStateInPandas(Recent(kept), "intent string, n long, threshold double", "Update", "None")
