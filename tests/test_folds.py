import random
import time

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, folds, html_blocks, tables

PIECES = ["a b c", "one two three four five six seven eight nine ten", "<b>", "x > y", "Home > Products > ", "Search Search", "", "  ", "!!!", "GLYPH<1>z</GLYPH>", "Skip to", "main content", "é ü", "copyright ©", "2024 now", "&lt;q", "&gt; r"]


def merged_by_hand(chunks, min_words, most):
    out = []
    for chunk in chunks:
        a, b = out[-1] if out else None, chunk
        words = lambda c: folds.word_count(c["text"])
        joins = a and not (words(a) >= min_words and words(b) >= min_words) and "table" not in (a["chunk_type"], b["chunk_type"]) and words(a) + words(b) <= most and a["h1"] == b["h1"]
        if joins:
            out[-1] = a | {"text": folds.clean_content(a["text"] + "\n\n" + b["text"]), "chunk_type": "paragraph"}
        else:
            out.append(dict(chunk))
    return out


def test_merging_as_by_hand(spark):
    rng = random.Random(9)
    rows = [
        {"doc_id": d, "ord": k, "chunk_type": rng.choice(["paragraph"] * 6 + ["table", "list"]), "text": rng.choice(["", " "]).join(rng.choices(PIECES, k=rng.randint(1, 3))),
         "h1": rng.choice([None, "H"]) if d % 2 else None, "tags": [str(k)], "meta": (k, "m")}
        for d in range(40) for k in range(rng.randint(1, 30))
    ]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    chunks = spark.createDataFrame(shuffled, "doc_id long, ord int, chunk_type string, text string, h1 string, tags array<string>, meta struct<a: int, b: string>")
    found = chunking.merge_tiny(chunks.repartition(5), most=25)
    assert found.columns == chunks.columns
    want = {(r["doc_id"], r["ord"], r["chunk_type"], r["text"], r["h1"], r["tags"][0], r["meta"][0]) for d in range(40) for r in merged_by_hand([x for x in rows if x["doc_id"] == d], 10, 25)}
    assert {(r.doc_id, r.ord, r.chunk_type, r.text, r.h1, r.tags[0], r.meta.a) for r in found.collect()} == want


def test_cleaning_is_the_columns(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices([*PIECES, "\x1c", " ", "\t", "HOME >products>", "toggle NAVIGATION", "ſearch search"], k=rng.randint(0, 8))) for _ in range(400)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_content("t").alias("c"), T.word_count("t").alias("n")).collect()
    assert all(folds.clean_content(r.t) == r.c and folds.word_count(r.t) == r.n for r in found)


def test_null_texts_and_keys(spark):
    chunks = spark.createDataFrame([(1, 0, "paragraph", "a", None), (1, 1, "paragraph", None, None), (1, 2, "paragraph", "b", None), (None, 0, "paragraph", "c", None), (None, 1, "paragraph", "d", None)], "doc_id long, ord int, chunk_type string, text string, h1 string")
    assert sorted((r.doc_id or 0, r.ord, r.text or "") for r in chunking.merge_tiny(chunks).collect()) == [(0, 0, "c d"), (1, 0, "a"), (1, 1, ""), (1, 2, "b")]
    assert chunking.merge_tiny(chunks.limit(0)).count() == 0


def test_folds_of_a_long_document_are_linear(spark):
    long = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), F.lit("paragraph").alias("chunk_type"), F.when(F.col("id") % 3 == 0, "two words").otherwise("...").alias("text"), F.lit(None).cast("string").alias("h1"))
    rows = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("table_id"), F.col("id").cast("int").alias("row"), F.array(F.lit("a b"), F.lit("c")).alias("cells"), F.lit(False).alias("section"), F.lit(False).alias("header"))
    spark.range(10).count()
    began = time.time()
    assert chunking.merge_tiny(long).count() == -(-66_667 * 2 // 300)
    assert tables.group_rows(rows).count() == 2000
    packed = tables.pack_rows(rows.withColumn("size", F.lit(1.0)), "doc_id", "row", "size", 7.0)
    assert packed.agg(F.count(F.lit(1)), F.sum("total")).first() == (28572, 200_000.0)
    assert time.time() - began < 30


def test_element_walk_is_linear():
    for html, n in (("<div>" * 100_000 + "a b" + "</div>" * 100_000, 100_000), ("<ul><li>" * 20_000 + "x" + "</li></ul>" * 20_000, 20_000), ("<p>" + "<div>" * 50_000 + "</p></span>" * 50_000 + "y", None)):
        began = time.time()
        found = html_blocks.elements(html)
        assert time.time() - began < 10 and (n is None or len(found) == n)
    nested = html_blocks.elements("".join(f"<div>w{k} " for k in range(1500)))
    assert len(nested) == 1500 and nested[0][2].startswith("w0w1") and nested[-1][2] == "w1499"


def test_elements_by_hand():
    page = "<h2>A &amp; B</h2><div class='x metric'>n</div><ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><dl><dt>k</dt><dd>v</dd></dl><section><dl><dt>k</dt></dl>z</section><p>a: b<p>c: d: e<script>s()</script><div><span class=label>L</span><span class=value>V</span></div>"
    assert html_blocks.elements(page) == [
        ("heading", 2, "A & B"), ("kv", None, "n"), ("list", None, "• onein\n• two"), ("list", None, "• in"), ("kv", None, "kz"), ("kv", None, "a: b"), ("text", None, "c: d: e"), ("kv", None, "LV")
    ]
