import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import query as Q
from tessera.functions import vector as V
from tessera.operators import retrieval as R
from tessera.plans import many, two_hop

SMALL = "/root/testdata/sf0.001"
ASKED = ["Why did revenue drop in Q4 2024?", "revenue data of Q4-2024 in Table 3", "What is EBITDA?", "latest product release", "Show me figures of 12 million EUR in FY2022", "growth strategy and vision"]


@pytest.fixture(scope="module")
def chunks(spark):
    return queries._chunks_for_search(spark, SMALL)


def test_questions_as_one_by_one(spark, chunks):
    texts = [*ASKED, ASKED[0], None, ""]
    asked = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "query_id int, query string, ask string, rank int")
    found = many.answer_each(chunks, asked).collect()
    kinds = set()
    for k, text in enumerate(texts[:3]):
        mine = sorted((r for r in found if r.query_id == k), key=lambda r: r.trail_position)
        want = two_hop.answer(chunks, text, two_hop.Settings()).orderBy("trail_position").collect()
        assert [(r.trail_position, r.id, r.hop, r.trail_role) for r in mine] == [(r.trail_position, r.id, r.hop, r.trail_role) for r in want]
        assert np.allclose([r.rerank_score for r in mine], [r.rerank_score for r in want])
        kinds.add(spark.range(1).select(Q.retrieval_intent(F.lit(text))["primary"]).first()[0])
    assert "numeric_evidence" in kinds and len(kinds) > 1 and any(r.hop == 2 for r in found)
    blank = [r for r in found if r.query_id in (7, 8)]
    assert len({r.id for r in blank if r.query_id == 7}) == len([r for r in blank if r.query_id == 7])


def test_no_questions(spark, chunks):
    assert many.answer_each(chunks, spark.createDataFrame([], "query_id long, query string")).count() == 0
    assert many.answer_each(chunks.limit(0), spark.createDataFrame([(1, ASKED[0])], "query_id long, query string")).count() == 0


def test_needed_features(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), [f"t{j}" for j in range(6) if rng.random() < 0.5] if k % 11 else None) for k in range(300)]
    asked = [(k, rng.normal(size=8).tolist(), [f"t{j}" for j in range(7) if rng.random() < 0.3] if k % 5 else None) for k in range(40)]
    left = spark.createDataFrame(rows, "vec_id long, embedding array<float>, tags array<string>").repartition(3)
    right = spark.createDataFrame(asked, "query_id long, query_vector array<double>, wants array<string>")
    got = {}
    for r in R.top_k_each(left, right, 4, features=F.col("tags"), needs="wants").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = lambda v: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    for k, vector, wants in asked:
        fit = [(-round(float(unit(vector) @ unit(v)), 12), i) for i, v, tags in rows if set(wants or []) <= set(tags or [])]
        assert [i for _, i in sorted(got.get(k, []))] == [i for _, i in sorted(fit)[:4]]


def test_common_year_and_date_features(spark):
    dates = F.array(*map(F.lit, ["2023-01-02", "2024-05-05", "2024", "FY2023", "Q1"]))
    row = spark.range(1).select(many.common_year(dates).alias("y"), many.date_features(dates).alias("f"), many.common_year(F.array().cast("array<string>")).alias("n")).first()
    assert row.y == "2024" and "2023" in row.f and "Y202" in row.f and "Q1" not in row.f and row.n is None


def test_lexical_score_by_column(spark):
    rows = spark.createDataFrame([("a b c", "c b x"), ("a", None), ("", "a")], "q string, t string")
    one = [[spark.range(1).select(V.lexical_score(q, F.lit(t).cast("string"))).first()[0]] for q, t in (("a b c", "c b x"), ("a", None), ("", "a"))]
    assert [list(r) for r in rows.select(V.lexical_score(F.col("q"), "t")).collect()] == one


def test_a_task_sends_each_query_its_best_once():
    rng = np.random.default_rng(4)
    rows = R.unit(rng.normal(size=(40, 6))[rng.integers(0, 40, 3000)])
    rows[7] = np.nan
    asked, keys = R.unit(rng.normal(size=(30, 6))), rng.permutation(3000).astype(np.int64)
    best = R.Best(np.arange(30) * 10, asked, 9)
    best.WAITING = 100
    for at in range(0, 3000, 250):
        best.add(keys[at : at + 250], rows[at : at + 250])
    sent = [r for batch in best.found("q", "id") for r in batch.to_pylist()]
    assert len(sent) == 30 * 9
    scores = np.round(asked @ rows.T, 12)
    for n in range(30):
        want = sorted((-s, k) for s, k in zip(scores[n], keys, strict=True) if not np.isnan(s))[:9]
        assert [(-r["score"], r["id"]) for r in sent if r["q"] == n * 10] == want


def test_prose_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(queries, "DEALT", 50)
    sizes = [len(x) for x in queries.business(spark, str(tmp_path)).select("o_orderkey").rdd.glom().collect()]
    assert sum(sizes) == orders.count() and len(sizes) >= orders.count() // 50 and max(sizes) < 150


def test_columns_of_chunks_without_hits_are_not_worked_out(spark):
    chunks = spark.createDataFrame([(k, "9" if k < 3 else "x", [1.0]) for k in range(50)], "id long, text string, embedding array<double>")
    hits = spark.createDataFrame([(1, 0), (1, 2), (2, 2)], "ask long, id long")
    costly = F.col("text").cast("int").alias("n")  # an error for any chunk without hits
    got = many.Run(chunks, two_hop.Settings()).with_chunks(hits, [costly]).collect()
    assert sorted((r.ask, r.id, r.n) for r in got) == [(1, 0, 9), (1, 2, 9), (2, 2, 9)]


def test_metadata_of_chunks_are_not_worked_out_before_they_are_asked_for(spark):
    chunks = queries._chunks_for_search(spark, SMALL)
    assert {"mentioned_dates", "policy_tags", "entities", "embedding"} <= set(chunks.columns)
    (cached,) = queries._CACHED.values()
    assert set(cached.columns) == {"id", "doc_id", "page", "text", "chunk_type", "embedding"}


def test_texts_are_embedded_together_as_one_by_one():
    texts = ["Revenue fell 8%, revenue!", None, "", "ça va İstanbul", "--", "a a a b"]
    assert (V.embed_texts(texts) == np.stack([V.embed_text(t) for t in texts])).all() and V.embed_texts([]).shape == (0, V.DIM)


def test_filters_of_a_search_are_tested_on_the_nearest_chunks_first(spark, monkeypatch):
    rows = [(k, "revenue" if k % 3 else "margin of revenue", "a" if k % 4 else "b", [f"t{k % 5}"]) for k in range(60)]
    chunks = spark.createDataFrame(rows, "id long, text string, chunk_type string, tags array<string>").withColumn("embedding", V.hash_embedding("text"))
    searches = [("margin", 5, ("chunk_type:b",)), ("margin", 30, ("tags:*1*",)), ("revenue", 4, ()), ("margin", 3, ("chunk_type:none",))]
    got = {}
    for wide in (8, 1000):
        monkeypatch.setattr(two_hop, "WIDE", wide)
        got[wide] = [(r.ord, r.id) for r in two_hop._search_each(chunks, searches, two_hop.Settings()).orderBy("ord").collect()]
    best = lambda fit: [k for k in sorted(range(60), key=lambda k: (k % 3 > 0, k)) if fit(k)]
    want = [best(lambda k: k % 4 == 0)[:5], best(lambda k: k % 5 == 1)[:30], [k for k in range(60) if k % 3][:4], []]
    assert got[8] == got[1000] == [(n * 1000 + place, k) for n, some in enumerate(want) for place, k in enumerate(some)]


def test_details_are_worked_out_for_chunks_with_hits_only(spark):
    chunks = spark.createDataFrame([(k, "9" if k < 3 else "x", [1.0]) for k in range(50)], "id long, text string, embedding array<double>")
    hits = spark.createDataFrame([(1, 0), (1, 2), (2, 2)], "ask long, id long")
    run = many.Run(chunks, two_hop.Settings(), lambda df: df.withColumn("n", F.col("text").cast("int")))  # an error for any other
    assert sorted((r.ask, r.id, r.n) for r in run.with_chunks(hits, ["n"]).collect()) == [(1, 0, 9), (1, 2, 9), (2, 2, 9)]


def test_pairs_that_single_precision_takes_for_equal_are_told_apart():
    asked = R.unit(np.array([[1.0, 0.0, 0.0]]))
    rows = R.unit(np.array([[1.0, 1e-5 * (50 - k), 1e-5] for k in range(50)]))
    best = R.Best(np.array([7]), asked, 3)
    best.add(np.arange(25), rows[:25])
    best.add(np.arange(25, 50), rows[25:])
    assert [r["id"] for batch in best.found("q", "id") for r in batch.to_pylist()] == [49, 48, 47]
