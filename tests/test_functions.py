import random
import re
import time

from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.operators import signals as S
from tessera.functions import query as Q
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import chunking, html_blocks, tables
from tessera.plans.config import Config


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_metadata(spark):
    text = F.lit("Introducing SecuritySuite on 2024-01-02, FY2023 and Q42024; refer to Table 3. It was changed.")
    dates, refs, names, changed = one(spark, T.dates(text), T.doc_refs(text), T.entities(text), T.is_change_note(text))
    assert dates == ["2024-01-02", "FY2023", "Q42024"] and refs == ["Table 3", "refer to Table 3"] and names[0] == "SecuritySuite" and changed


def test_policy_tags(spark):
    for text, want in (("board decided to invest", ["decision"]), ("updated privacy policy", ["update"]), ("customer feedback influenced", ["customer_insight"]), ("risk factors affecting revenue", ["factor", "risk_factor"])):
        assert one(spark, T.policy_tags(F.lit(text)))[0] == want


def test_toc_lines(spark):
    for line, want in (("Item 1. Business | 5", ("Item 1.", "Business", 5, 2)), ("Item 1A. Risk Factors | 15", ("Item 1A.", "Risk Factors", 15, 2)), ("Revenue 2024", ("", "Revenue", 2024, 1)), ("# x 5", None)):
        found = one(spark, T.toc_line(F.lit(line)))[0]
        assert (tuple(found) if found else None) == want


def test_folders(spark):
    for path, want in (("input/doc.html", []), ("input/reports/doc.html", ["reports"]), ("input/a/b/c/d/doc.html", ["a", "b", "c", "d"]), ("x/y/doc.md", ["x", "y"])):
        assert one(spark, T.folders(F.lit(path)))[0] == want


def test_intents(spark):
    asked = {"Why did revenue drop in Q4 2024?": "explain", "What was the profit margin for FY2024?": "numeric_evidence", "Compare sales between Q3 and Q4": "relationship", "What is EBITDA?": "lookup", "Show me Table 5 data": "explain"}
    for text, want in asked.items():
        assert one(spark, Q.retrieval_intent(F.lit(text)))[0]["primary"] == want
    row = Q.understand(spark.createDataFrame([("What is EBITDA?",)], "query string")).first()
    assert row.intent == "financial" and row.variants == ["What is EBITDA?", "what ebitda", "ebitda what"]


def test_embeddings(spark):
    a, b, z = V.embed_text("the quick fox"), V.embed_text("THE quick fox!"), V.embed_text(None)
    assert (a == b).all() and not z.any() and abs((a * a).sum() - 1) < 1e-6


def chunks_by_hand(text):
    """The rules line by line."""
    import re

    words = lambda t: len(re.findall("[A-Za-z0-9]+", t))
    h, out, held = [None] * 3, [], []

    def flush():
        if held:
            t = " ".join(held)
            t = f"{h[2]}: {t}" if h[2] else t
            held.clear()
            if out and out[-1][0] == "paragraph" and words(t) < 15:
                out[-1][1] += " " + t
            else:
                out.append(["paragraph", t])

    for line in text.split("\n"):
        s = line.strip()
        if m := re.match(r"^(#{1,3})\s+(.+)", line):
            flush()
            n = len(m[1])
            h[n - 1 :] = [m[2].strip()] + [None] * (3 - n)
        elif "|" in s and s != "|" and not s.startswith("#"):
            continue
        elif any(re.match(p, s) for p in (r"^[^:]+:\s*[^:]+$", r"^[^-]+-\s*[^-]+$", r"^[^=]+=\s*[^=]+$")):
            flush()
            out.append(["kv", f"{h[2]}: {s}" if h[2] else s])
        elif not s:
            flush()
        elif words(s) and len(s) > 1:
            held.append(s)
    flush()
    return [tuple(x) for x in out]


def test_chunks_by_hand(spark):
    import random

    rng = random.Random(1)
    line = lambda: rng.choice(["# One", "## Two", "### Three", "", "k: v", "a | b", "x - y", "--", "word " * rng.randint(1, 20), "some text here"])
    texts = ["\n".join(line() for _ in range(rng.randint(1, 25))) + "\nend" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {}
    for r in chunking.chunk_markdown(docs).orderBy("doc_id", "chunk_id").collect():
        found.setdefault(r.doc_id, []).append((r.chunk_type, r.text))
    for k, text in enumerate(texts):
        assert found.get(k, []) == chunks_by_hand(text)


def test_tidy_merges_and_keeps_tables(spark):
    rows = [(1, 0, "kv", "alpha beta gamma", None), (1, 1, "paragraph", "delta epsilon zeta", None), (1, 2, "table", "one two three four", None), (1, 3, "paragraph", "•", None)]
    out = chunking.tidy(spark.createDataFrame(rows, "doc_id int, ord int, chunk_type string, text string, h1 string")).orderBy("ord").collect()
    assert [(r.chunk_type, r.text) for r in out] == [("paragraph", "alpha beta gamma delta epsilon zeta"), ("table", "one two three four")]


def test_html():
    page = "<nav class='toc'><ul><li><a href='#a'>A</a></li></ul></nav><h1>T</h1><div><p>x y<p>k: v</div><table><tr><th>N</th></tr><tr><td>5</td></tr></table>"
    assert html_blocks.elements(page) == [("list", None, "• A"), ("heading", 1, "T"), ("kv", None, "x yk: v"), ("text", None, "x y"), ("kv", None, "k: v")]
    assert html_blocks.tables(page) == [(0, 0, 0, "N", True, False), (0, 1, 0, "5", False, False)]
    assert html_blocks.nav_links(page) == [(0, "A", "#a", 1)]


def test_table_groups_start_at_sections(spark):
    rows = [(1, "t", 0, ["a", "b"], False, True), (1, "t", 1, ["x y"], False, False), (1, "t", 2, ["S"], True, False), (1, "t", 3, ["z"], False, False)]
    out = tables.group_rows(spark.createDataFrame(rows, "doc_id int, table_id string, row int, cells array<string>, section boolean, header boolean")).orderBy("group").collect()
    assert [[x.row for x in r.rows] for r in out] == [[1], [2, 3]]


def test_config():
    c = Config.load("not json")
    c.update("search.hop_1_k", 7)
    assert c.get("search.hop_1_k") == 7 and c.get("search.none", 3) == 3 and Config().get("search.hop_1_k") == 50


def test_stream_of_documents(spark, tmp_path):
    from tessera.streaming import ingest

    docs = spark.createDataFrame([(1, "some words in a first paragraph")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    ingest.chunk_stream(spark, str(tmp_path / "in"), "doc_id int, text string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    import shutil

    shutil.rmtree(tmp_path / "cp")  # the same batch is played again
    ingest.chunk_stream(spark, str(tmp_path / "in"), "doc_id int, text string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stripped_takes_all_white_space(spark):
    kinds = one(spark, *[T.line_kind(F.lit(x)) for x in ("\t", "\u00a0", " \x1c ", "\u3000x y z\t", "\tk: v ")])
    assert list(kinds) == ["blank", "blank", "blank", "text", "kv"]


def test_short_texts(spark):
    noise, word, kv, long = one(spark, T.is_ui_noise(F.lit("Read more")), T.is_ui_noise(F.lit("singleword")), T.is_short_key_value(F.lit("a: b")), T.is_short_key_value(F.lit("a: " + "b " * 12)))
    assert noise and word and kv and not long
    cut, whole, bare = one(spark, T.for_embedding(F.lit("One two. Three four five."), 12), T.for_embedding(F.lit("short")), T.for_embedding(F.lit("no sentence here"), 5))
    assert (cut, whole, bare) == ("One two.", "short", "no se")
    assert one(spark, T.clean_artefacts(F.lit("a&nbsp;GLYPHxy b  Privacy Policy ")))[0] == "a b"


def test_financial_variants(spark):
    for text, terms, variants, best in (
        ("What is the EPS growth?", ["EPS", "growth"], ["What is the EPS growth?", "EPS growth", "EPS"], "EPS growth"),
        ("tell me about", [], ["tell me about"], "tell me about"),
        ("p/e", ["P/E"], ["p/e"], "p/e"),
    ):
        row = spark.range(1).select(Q.financial_terms(F.lit(text)).alias("t")).select("t", Q.financial_variants(F.lit(text), F.col("t")).alias("v"))
        got = row.select("t", "v", Q.best_financial_query(F.lit(text), F.col("v")).alias("b")).first()
        assert (got.t, got.v, got.b) == (terms, variants, best)


def test_contents_places_in_order():
    page = "<div class='contents'><a href='#z'>Z</a></div><nav><ul><li><a href='#b'>B</a><ul><li><a href='#c'>C</a></ul></ul></nav><nav class='table-of-contents'><li>only items</li></nav>"
    assert html_blocks.nav_links(page) == [(0, "only items", "", 1)]
    assert html_blocks.nav_links(page.replace("table-of-contents", "other")) == [(0, "B", "#b", 1), (1, "C", "#c", 2)]
    assert html_blocks.nav_links("<nav><a href=x>y</a></nav>") == []


def test_trimming_is_linear_and_takes_all_white_space(spark):
    long = "\t\u00a0" * 250_000 + "#" + " " * 500_000 + "x" + "\u3000" * 500_000
    rows = spark.createDataFrame([(long,), ("\u00a0a \x1c\x1f b\u2003\t",), ("#\u00a0Head\u00a0",), (None,)], "t string")
    rows.select(T.stripped("t")).collect()
    began = time.time()
    found = rows.select(T.stripped("t").alias("s"), T.clean_content("t").alias("c"), T.line_kind("t").alias("k"), T.heading_text("t").alias("h")).collect()
    assert time.time() - began < 10
    assert len(found[0].s) == 500_002 and found[0].c == "# x" and [r.c for r in found[1:]] == ["a b", "# Head", ""]
    assert (found[2].k, found[2].h, found[1].s) == ("heading", "Head", "a \x1c\x1f b")


def test_names_as_by_the_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["Data", "a", "é", "1", "_", " ", " ", "v2.1", "system", "the", "new", "Launching", "offers", "X9", "ſ", "-", "version 3"]
    rows = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(12)),) for _ in range(400)], "t string")
    pairs = [(F.regexp_extract_all("t", F.lit(a), 1), F.regexp_extract_all("t", F.lit(b), 1)) for a, b in zip(P.ENTITIES, P.FAST_ENTITIES, strict=True)]
    for row in rows.select(*[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs]).collect():
        assert all(x.a == x.b for x in row)


def test_matches_hold_what_their_patterns_need(spark):
    found = [p for family in (*P.UNIVERSAL.values(), *P.POLICY_TAGS.values()) for p in family if P.needed(p)]
    words = sorted({w for p in found for w in re.findall(r"[a-z&]+", p)} | {"was", "in 2024", "table 3"})
    rng = random.Random(6)
    rows = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(14)),) for _ in range(600)] + [("",), (None,)], "t string")
    plain = F.array(*[F.regexp_extract_all("t", F.lit(p), 0) for p in found])
    asked = F.array(*[T.word_matches(F.col("t"), p, 0) for p in found])
    got = rows.select(plain.alias("a"), asked.alias("b")).collect()
    assert len(found) > 35 and all(r.a == r.b for r in got) and sum(any(r.a and r.a[k] for r in got) for k in range(len(found))) > 25


def test_signals_and_tags_lower_a_text_once(spark):
    for c in (Q.universal_signals(F.col("t")), T.policy_tags("t"), S.signal_array(F.col("t"), F.lit("x"))):
        plan = spark.createDataFrame([("a",)], "t string").select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(t") == 1
