from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.sources.points import Conflict, PointTable, upsert_stream
from tessera.streaming import ingest, state

START = datetime(2024, 1, 1)


def land(spark, rows, schema, folder, name):
    """One file of rows in ``folder``; names tell the order in which they are taken."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def played(spark, frame, folder, tmp_path, mode="append"):
    """The rows of a stream after each of its ordered batches: [(batch, row)]."""
    out = []
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
    query = query.foreachBatch(lambda df, n: out.extend((n, tuple(r)) for r in df.collect())).start()
    query.awaitTermination()
    return out, query


def stream_of(session, folder, schema):
    return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


# -- upserts


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.fixture
def points(spark, tmp_path):
    return PointTable(spark, str(tmp_path / "points"), "method string, id long, n long, embedding array<float>", ("method", "id"), ("n",), buckets=8)


def batch(spark, rows):
    return spark.createDataFrame([(m, i, n, [float(n)], "extra") for m, i, n in rows], "method string, id long, n long, embedding array<float>, _bucket string").drop("_bucket")


def test_upserts_replace_by_key(spark, points):
    assert rows_of(points) == []
    assert points.upsert(batch(spark, [("a", k, 1) for k in range(50)] + [("b", 1, 1), ("a", 7, 5), (None, None, 1)]), 0)
    assert points.upsert(batch(spark, [("a", 3, 9), ("c", 1, 2), (None, None, 4)]), 1)
    want = {("a", k): 1 for k in range(50)} | {("b", 1): 1, ("a", 7): 5, ("a", 3): 9, ("c", 1): 2, (None, None): 4}
    found = points.read().collect()
    assert {(r.method, r.id): r.n for r in found} == want and len(found) == len(want)
    assert {(r.method, r.id): r.n for r in points.read(version=1).collect()}[("a", 3)] == 1


def test_replay_and_failure_before_the_commit(spark, points):
    first, second = batch(spark, [("a", k, 1) for k in range(20)]), batch(spark, [("a", k, 2) for k in range(10, 30)])
    points.upsert(first, 0)

    def fail():
        raise OSError("gone between write and commit")

    with pytest.raises(OSError):
        points.upsert(second, 1, before_commit=fail)
    assert len(rows_of(points)) == 20 and all(r[2] == 1 for r in rows_of(points))
    assert points.upsert(second, 1) and not points.upsert(second, 1) and not points.upsert(first, 0)
    after = rows_of(points)
    assert len(after) == 30 and sum(r[2] for r in after) == 10 + 2 * 20
    assert points.upsert(first, 0, source="another") and points.read().filter("n = 1").count() == 20
    assert any(g.startswith("data/") for g in points.vacuum()) and len(rows_of(points)) == 30 and points.vacuum() == []


def test_one_of_two_writers_commits(spark, points):
    points.upsert(batch(spark, [("a", 1, 1)]), 0)
    other = batch(spark, [("a", 2, 1)])
    with pytest.raises(Conflict):
        points.upsert(batch(spark, [("a", 3, 1)]), 1, before_commit=lambda: points.upsert(other, 5, source="other"))
    assert [r[1] for r in rows_of(points)] == [1, 2]
    points.upsert(batch(spark, [("a", 3, 1)]), 1)
    assert [r[1] for r in rows_of(points)] == [1, 2, 3]


def test_an_unfinished_manifest_is_passed_over(spark, points, tmp_path):
    points.upsert(batch(spark, [("a", 1, 1)]), 0)
    (tmp_path / "points/manifest/000000000002.json").write_text('{"version": 2, "buck')
    assert [r[1] for r in rows_of(points)] == [1]


def test_stream_of_points_takes_ten_files_at_a_time(spark, points, tmp_path):
    for k in range(23):
        batch(spark, [("a", j, k) for j in range(k, k + 3)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    for _ in range(2):
        query = upsert_stream(points, str(tmp_path / "landing"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    assert points.read().count() == 25 and points._manifest()["batches"] == {str(tmp_path / "landing"): 2}


# -- windows and sessions

EVENTS = "ts timestamp, event_type string, user_id long, value double"


def event(minutes, user=1, value=1.0):
    return (START + timedelta(minutes=minutes), "view", user, value)


def test_sliding_windows_drop_late_rows(spark, tmp_path):
    # When the last batch is read, what ended by minute 140 is late: all windows of 30, and the earlier one of 100.
    for n, minutes in enumerate(([0, 50, 70], [200, 20], [201], [600, 30, 100])):
        land(spark, [event(m) for m in minutes], EVENTS, tmp_path / "in", f"b{n}")
    windows = ingest.event_windows(stream_of(spark, tmp_path / "in", EVENTS), "60 minutes", slide="30 minutes")
    out, query = played(spark, windows, tmp_path / "in", tmp_path)
    assert {(r[0] - START).total_seconds() / 60: r[2] for _, r in out} == {-30: 2, 0: 3, 30: 2, 60: 1, 90: 1, 150: 2, 180: 2}
    kept = spark.createDataFrame([event(m) for m in (0, 50, 70, 200, 20, 201)], EVENTS)
    table = {tuple(r) for r in ingest.event_windows(kept, "60 minutes", slide="30 minutes").collect()}
    assert {r for _, r in out} - table == {(START + timedelta(minutes=90), "view", 1, 1.0)} and table <= {r for _, r in out}
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"]) == 3


def test_sessions_merge_across_batches(spark, tmp_path):
    for n, minutes in enumerate(([0, 20], [60, 40], [500])):  # 40 bridges what would be two sessions
        land(spark, [event(m) for m in minutes], EVENTS, tmp_path / "in", f"b{n}")
    out, _ = played(spark, ingest.sessions(stream_of(spark, tmp_path / "in", EVENTS)), tmp_path / "in", tmp_path)
    assert [(r[0], r[3]) for _, r in out] == [(1, 4)]


# -- keyed state


def test_thresholds_of_a_stream_as_of_a_table(spark, tmp_path):
    schema = "intent string, asked long, id long, confidence double, relevance double"
    rows = [(f"i{k % 3}" if k % 50 else None, k // 4, k, (k * 7 % 10) / 10, (k * 3 % 11) / 11) for k in range(400)]
    for n in range(3):
        land(spark, rows[n::3], schema, tmp_path / "in", f"b{n}")
    session = state.with_state_store(spark)
    out, _ = played(session, state.adaptive_thresholds(stream_of(session, tmp_path / "in", schema), kept=60), tmp_path / "in", tmp_path, "update")
    last = {r[0]: r[1:] for _, r in sorted(out, key=lambda x: x[0])}
    table = spark.createDataFrame(rows, schema)
    assert {r[0]: tuple(r[1:]) for r in state.adaptive_thresholds(table, kept=60).collect()} == last
    recent = [r for i in (None, "i0", "i1", "i2") for r in metrics.recent(table.filter(F.col("intent").eqNullSafe(i)), "asked", 60, "id").collect()]
    want = {r.intent: (r.n, round(r.threshold, 9)) for r in metrics.optimal_thresholds(spark.createDataFrame(recent, schema)).collect()}
    assert {k: (n, round(t, 9)) for k, (n, t) in last.items()} == want and max(r[1] for _, r in out) <= 60


def test_the_cache_forgets(spark, tmp_path):
    schema = "id long, ts timestamp, text string"
    at = lambda k, minutes, text: (k, START + timedelta(minutes=minutes), text)
    batches = [[at(1, 0, "Why?"), at(2, 5, " why? "), at(3, 6, None)], [at(4, 50, "WHY?"), at(5, 200, "what is it")], [at(6, 201, "why?"), at(7, 400, "x")], [at(8, 401, "what is it")]]
    for n, rows in enumerate(batches):
        land(spark, rows, schema, tmp_path / "in", f"b{n}")
    session = state.with_state_store(spark)
    frame = state.cached_intents(stream_of(session, tmp_path / "in", schema), ttl=3600, late="1 minute")
    out, query = played(session, frame, tmp_path / "in", tmp_path)
    want = {1: ("explain", False, 1), 2: ("explain", True, 2), 3: ("lookup", False, 1), 4: ("explain", True, 3), 5: ("lookup", False, 1), 6: ("explain", False, 1), 7: ("lookup", False, 1), 8: ("lookup", False, 1)}
    assert {r[0]: r[1:] for _, r in out} == want
    assert {r.id: tuple(r)[1:] for r in state.cached_intents(spark.createDataFrame([r for b in batches for r in b], schema), ttl=3600).collect()} == want
    assert query.lastProgress["stateOperators"][0]["customMetrics"] is not None
    assert state.cached_intents(spark.createDataFrame([], schema)).count() == 0
