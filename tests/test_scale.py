import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries_scale
from tessera.functions import text as T
from tessera.operators import chunking, html_blocks, ivf, joins, retrieval, tables

SMALL = "/root/testdata/sf0.001"


# -- substring join


@pytest.mark.parametrize("sent", [joins.SENT, 0])
@pytest.mark.parametrize("frequent", [joins.FREQUENT, 3])
def test_substring_join_as_all_pairs(spark, monkeypatch, sent, frequent):
    monkeypatch.setattr(joins, "FREQUENT", frequent)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "été", "日本", "😀", "a", "b", "common phrase of many texts"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(120)]
    texts += [(200, None), (201, ""), (202, "common phrase of many texts" * 50), (3, "an id that comes again: gamma gamma"), (None, "alpha")]
    needles = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for k in range(60)]
    needles += [(100, None), (101, ""), (102, "é"), (103, "a"), (104, "not in any text at all"), (105, "alpha beta gamma " * 3), (None, "alpha"), (1, "gamma gamma"), needles[0]]
    left = spark.createDataFrame([(*r, "x") for r in texts], "id long, text string, gram string").repartition(4)
    right = spark.createDataFrame([(*r, "y") for r in needles], "item long, text string, needle string").repartition(3)
    found = joins.substring_join(left, right, "id", "text", "item", "text", size=6, sent=sent).collect()
    want = {(i, j) for i, t in texts for j, n in needles if t and n and i is not None and j is not None and n in t}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_substring_join_of_nothing(spark):
    some = spark.createDataFrame([(1, "abc")], "id long, text string")
    for a, b in ((some.limit(0), some), (some, some.limit(0))):
        assert joins.substring_join(a, b.withColumnRenamed("id", "item"), "id", "text", "item", "text").count() == 0


def test_grams_are_of_code_points():
    assert len(joins.grams("é😀日", 2)) == 2 and len(joins.grams("ab", 3)) == 0
    assert joins.grams("xabcx", 3)[1] == joins.grams("abc", 3)[0] != joins.grams("acb", 3)[0]


# -- inverted-file index


def vectors_of(spark, n, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(k, (centres[k % 12] + 0.6 * rng.normal(size=dim)).astype(np.float32).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def test_index_holds_every_row_and_finds_most_neighbours(spark, tmp_path):
    rows = vectors_of(spark, 1500).union(spark.createDataFrame([(5000, [0.0] * 24)], "vec_id long, embedding array<float>"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = ivf.IvfIndex.build(rows, str(tmp_path / "index"))
    assert index.rows().count() == 1501 and index.rows().filter("list = -1").count() == 1
    exact = [tuple(r) for r in retrieval.top_k_each(rows, asked, 10).collect()]
    assert sorted(tuple(r) for r in index.search(asked, 10, probes=1000).collect()) == sorted(exact)
    shares = [r.recall for r in ivf.recall(index.search(asked, 10), retrieval.top_k_each(rows, asked, 10)).collect()]
    assert len(shares) == 75 and sum(shares) / 75 >= 0.9
    plan = index.search(asked.limit(1), 3, probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:80]
    index.drop()
    assert not (tmp_path / "index").exists()


def test_index_of_few_and_of_copies(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, query_vector array<float>")
    empty = ivf.IvfIndex.build(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert empty.search(asked, 3).count() == 0
    copies = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(50)] + [(None, [1.0, 1.0]), (60, None)], schema)
    found = ivf.IvfIndex.build(copies, str(tmp_path / "copies"), lists=4).search(asked, 3).collect()
    assert [(r.query_id, r.vec_id, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_a_vector_of_another_size_is_named(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (77, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<float>")
    with pytest.raises(Exception, match="vector of 77 has 3 numbers, not 2"):
        retrieval.top_k_each(rows, asked, 1).collect()


def test_recall_on_the_tables(spark):
    found = queries_scale.ivf_recall(spark, SMALL).collect()
    assert len(found) == math.ceil(500 / 20) and sum(r.recall for r in found) / len(found) >= 0.9


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clean_texts_are_left_alone_as_cleaning_would_leave_them(spark):
    odd = ["", " ", "a", "a b", " a", "a ", "a  b", "a\nb", "a　b", "a\x1cb", "​x", "<<b>b>x", "a < b", "&lt;x&gt; y", "/x GLYPHy/", "HOME > Products > x", "a skip to MAIN content b", "toggle navigation", "search search", "Copyright © 2024", "home alone", None]
    rows = spark.createDataFrame([(x,) for x in odd], "t string").select("t", T.cleaned_again("t").alias("a"), T.clean_content("t").alias("b"), T.is_meaningful("t", 1).alias("m")).collect()
    assert len(rows) == len(odd) and all(r.a == r.b for r in rows)
    assert {r.t for r in rows if r.m} == {"a", "a b", " a", "a ", "a  b", "a\nb", "a　b", "a\x1cb", "​x", "<<b>b>x", "a < b", "&lt;x&gt; y", "HOME > Products > x", "a skip to MAIN content b", "home alone"}


def test_tidying_cleans_a_text_once(spark):
    """One place where a chunk's text is made, two where it is looked at, as conditions on what is made already."""
    docs = spark.createDataFrame([(1, "# A\n\nSome <b>words</b> of a text &lt;x&gt; here\n\na: b\n\n* one\n* two")], "doc_id long, text string")
    tidy = chunking.tidy(chunking.chunk_markdown(docs))
    assert plan_of(tidy).count("Toggle navigation") <= 3
    assert [r.text for r in tidy.collect()] == [r.text for r in tidy.filter(T.is_meaningful("text")).collect()]


def test_pages_of_tables_are_parsed_once(spark):
    page = "<h2>Orders</h2><table><tr><th>A</th><th>B</th></tr><tr></tr><tr><td>one 1</td><td></td></tr></table><table><caption>Cap</caption><tr><th>only</th></tr></table><table><tr><td>7</td><td>8</td><td>9</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    chunks = html_blocks.html_table_chunks(pages)
    assert plan_of(chunks).count("MapInArrow") == 2  # the page's rows, and the groups of rows
    cells = html_blocks.html_tables(pages).select("doc_id", F.concat(F.lit("html_table_"), F.col("table_no").cast("string")).alias("table_id"), "row", "col", "text", "column_header", "row_header", F.lit(False).alias("row_section"))
    titles = html_blocks.html_table_titles(pages).select("doc_id", F.concat(F.lit("html_table_"), F.col("table_no").cast("string")).alias("table_id"), "label")
    want = sorted(map(tuple, tables.table_chunks(cells, titles).collect()))
    assert sorted(map(tuple, chunks.collect())) == want and len(want) == 2
