"""Queries of joins, indexes and state that are built for large tables; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vocabulary
from tessera.operators import chunking, ivf, joins, retrieval
from tessera.plans import many
from tessera.queries import _detailed, _sql_clean, _texts_for_search, dealt, query, table
from tessera.sources.points import PointTable
from tessera.sources.shared import shared_path
from tessera.streaming import ingest, state

#: Neighbours, and the queries of the vector searches: every twentieth row.
K, EVERY = 10, 20


@query("substring_join", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which whole documents hold which benchmark items."""
    return joins.substring_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("ivf_every_list", f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {EVERY} = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score, list_cosine_similarity(embedding::DOUBLE[], v) AS exact FROM embeddings, q)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, vec_id) AS INT) AS "rank" FROM s QUALIFY "rank" <= {K}""")
def ivf_every_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours of every twentieth vector, read from all lists of an index."""
    vectors, asked = _asked(spark, sf_dir)
    index = ivf.IvfIndex.build(vectors, shared_path(spark, "ivf"))
    found = index.search(asked, K, probes=ivf.MOST_LISTS)
    return found.select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")


@query("ivf_recall")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the exact neighbours of every twentieth vector, how many a search of the lists that were measured to do finds."""
    vectors, asked = _asked(spark, sf_dir)
    index = ivf.IvfIndex.build(vectors, shared_path(spark, "ivf"))
    return ivf.recall(index.search(asked, K), retrieval.top_k_each(vectors, asked, K))


@query("two_hop_questions")
def two_hop_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for every turn of every user, all in one plan."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("query_id", F.concat_ws("/", "conv_id", "turn"))
    found = many.answer_each(_texts_for_search(spark, sf_dir), turns, query="text", details=_detailed)
    return found.select("query_id", "trail_position", "id", "hop", F.round("rerank_score", 6).alias("rerank_score"), "trail_role")


@query("adaptive_thresholds", """
WITH h AS (SELECT event_type AS intent, value / 100 AS confidence, (user_id % 10) / 10 AS relevance FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) DESC, event_id DESC) <= 1000)
SELECT intent, count(*) AS n, round(CASE WHEN count_if(confidence > 0.7) >= 5 THEN least(greatest(avg(CASE WHEN confidence > 0.7 THEN relevance END) - 0.1, 0.5), 0.95) ELSE 0.8 END, 6) AS threshold
FROM h GROUP BY intent HAVING count(*) >= 10""")
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholds that each kind of event's last thousand give, by keyed state."""
    e = table(spark, sf_dir, "events")
    history = e.select(F.col("event_type").alias("intent"), F.unix_micros(F.col("ts").cast("timestamp")).alias("asked"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("confidence"), (F.col("user_id") % 10 / 10).alias("relevance"))
    return state.adaptive_thresholds(history).withColumn("threshold", F.round("threshold", 6))


@query("cached_intents", """
WITH q AS (SELECT conv_id * 1000 + turn AS id, lower(trim(coalesce(text, ''))) AS t, timestamp '2024-01-01' + INTERVAL 1 SECOND * (conv_id * 1000 + turn) AS ts FROM conversations WHERE role = 'user'),
g AS (SELECT *, CASE WHEN epoch(ts - lag(ts) OVER (PARTITION BY t ORDER BY ts, id)) <= 3600 THEN 0 ELSE 1 END AS new FROM q)
SELECT id, CASE WHEN regexp_matches(t, 'why|how|cause|reason') THEN 'explain' ELSE 'lookup' END AS intent, new = 0 AS cached,
  row_number() OVER (PARTITION BY t, k ORDER BY ts, id) AS asked FROM (SELECT *, sum(new) OVER (PARTITION BY t ORDER BY ts, id) AS k FROM g)""")
def cached_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's turn by a cache that forgets after an hour, a thousand seconds to a conversation."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = turns.select("id", "text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    return state.cached_intents(asked)


@query("upserted_points", """
SELECT user_id, event_type, event_id, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, event_id DESC) = 1""")
def upserted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's last event, upserted by type after type, each played twice."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    points = PointTable(spark, shared_path(spark, "points"), e.schema, ("user_id",), ("event_id",))
    for n, kind in enumerate(sorted(r[0] for r in e.select("event_type").distinct().collect())):  # a handful of types
        for _ in range(2):
            points.upsert(e.filter(F.col("event_type") == kind), n)
    return points.read().withColumn("value", F.round("value", 4))


@query("sliding_windows", """
WITH w AS (SELECT event_type, value, unnest([0, 6, 12, 18]) AS back, ts FROM events)
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 1 HOUR * back, '%Y-%m-%d %H') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type over days that begin every six hours."""
    w = ingest.event_windows(table(spark, sf_dir, "events"), "24 hours", slide="6 hours")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


_NEIGHBOURS = """SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS ord, o_orderkey % 11 = 0 AS is_table,
  concat(o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN ' <b> home  > products >' WHEN 1 THEN '' ELSE ' was paid by the customer, who had asked for it' END, CASE WHEN o_orderkey % 6 = 0 THEN ' ...' ELSE concat(' on ', o_orderdate) END) AS text,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS h1 FROM orders"""


def _merged(a: str, b: str) -> str:
    return _sql_clean(f"{a} || chr(10) || chr(10) || {b}")


@query("merge_tiny", f"""
WITH RECURSIVE c AS ({_NEIGHBOURS}), n AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS words FROM c),
f AS (SELECT doc_id, ord, ord AS first, is_table, text, h1, words, 0 AS g FROM n WHERE ord = 1 UNION ALL
  SELECT doc_id, ord, CASE WHEN j THEN first ELSE ord END, CASE WHEN j THEN false ELSE n_table END, t, CASE WHEN j THEN h1 ELSE n_h1 END, len(regexp_extract_all(t, '[A-Za-z0-9]+')), CASE WHEN j THEN g ELSE g + 1 END FROM (
    SELECT n.doc_id, n.ord, f.first, n.is_table AS n_table, f.h1, n.h1 AS n_h1, f.g, j, CASE WHEN j THEN {_merged("f.text", "n.text")} ELSE n.text END AS t FROM (
      SELECT f.*, n.ord AS n_ord, NOT (f.words >= 10 AND n.words >= 10) AND NOT f.is_table AND NOT n.is_table AND f.words + n.words <= 40 AND f.h1 IS NOT DISTINCT FROM n.h1 AS j
      FROM f JOIN n ON n.doc_id = f.doc_id AND n.ord = f.ord + 1) f JOIN n ON n.doc_id = f.doc_id AND n.ord = f.n_ord))
SELECT doc_id, first AS ord, arg_max(md5(text), ord) AS text_md5, CAST(count(*) AS INT) AS n_merged FROM f GROUP BY doc_id, g, first""")
def merge_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts of each customer's orders, neighbours merged: which is first, and how many a merged one is of."""
    made = spark.sql(_NEIGHBOURS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    chunks = made.select("doc_id", "ord", F.when(F.col("is_table"), "table").otherwise("text").alias("chunk_type"), "text", "h1")
    merged = chunking.merge_tiny(chunks, most=40).select("doc_id", "ord", F.md5("text").alias("text_md5"))
    ends = Window.partitionBy("doc_id").orderBy("ord")
    last = chunks.groupBy("doc_id").agg(F.max("ord").alias("_last"))
    return merged.join(last, "doc_id").withColumn("n_merged", F.lead("ord").over(ends)).select("doc_id", "ord", "text_md5", (F.coalesce("n_merged", F.col("_last") + 1) - F.col("ord")).alias("n_merged"))


@query("vocabulary_terms", """
WITH v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]{4,}'))) AS term FROM benchmark), d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, count(term) AS n_terms, md5(coalesce(string_agg(term, ' ' ORDER BY encode(term)), '')) AS terms_md5 FROM d LEFT JOIN v ON contains(t, term) GROUP BY doc_id""")
def vocabulary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of the benchmark every whole document holds, by one automaton."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]{4,}"), 0)).alias("term")
    terms = sorted(r[0] for r in table(spark, sf_dir, "benchmark").select(words).distinct().collect())  # a benchmark's words
    found = vocabulary.with_terms(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), terms)
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort("terms"), " ")).alias("terms_md5"))
