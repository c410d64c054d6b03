"""Queries of answers, clients, governance, reports and dispatch, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.functions import text as T
from tessera.operators import answers, chunking, client, governance, html_blocks, metrics, retrieval
from tessera.plans import two_hop
from tessera.queries import ASKED, BUSINESS, _chunks_for_search, business, query, table
from tessera.sources import dispatch, readers


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with short lists of what they name: none, one or three metrics, references, periods and units."""
    some = lambda n, *xs: F.slice(F.array(*map(F.lit, xs)), 1, F.col("o_orderkey").cast("int") % n)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", some(4, "revenue", "margin", "cash").alias("metrics"), some(3, "Table 3", "Section 4.2").alias("refs"),
        some(5, "2024", "Q4", "FY2023", "2021").alias("dates"), some(2, "USD").alias("units"), some(7, "Acme", "Europe", "Retail").alias("names"),
    )


_LISTS = """WITH l AS (SELECT o_orderkey, o_orderdate, (['revenue', 'margin', 'cash'])[1:o_orderkey % 4] AS metrics, (['Table 3', 'Section 4.2'])[1:o_orderkey % 3] AS refs,
  (['2024', 'Q4', 'FY2023', '2021'])[1:o_orderkey % 5] AS dates, (['USD'])[1:o_orderkey % 2] AS units, (['Acme', 'Europe', 'Retail'])[1:o_orderkey % 7] AS names FROM orders) """


@query("signals_summary", _LISTS + """SELECT o_orderkey, array_to_string(list_transform(metrics, lambda x: 'metric:' || x) || list_transform(refs, lambda x: 'reference:' || x)
  || list_transform(dates[1:2], lambda x: 'date:' || x), ';') AS summary FROM l""")
def signals_summary(spark, sf_dir):
    """What a search was expanded by, in short."""
    return _lists(spark, sf_dir).select("o_orderkey", F.array_join(answers.signals_summary(F.col("metrics"), F.col("refs"), F.col("dates")), ";").alias("summary"))


@query("expansion_suggestions", _LISTS + """SELECT o_orderkey, concat_ws(';', CASE WHEN len(metrics) > 0 THEN 'Expand search for metrics: ' || array_to_string(metrics[1:2], ', ') END,
  CASE WHEN len(refs) > 0 THEN 'Follow references: ' || array_to_string(refs[1:2], ', ') END,
  CASE WHEN year(o_orderdate) = 1995 THEN 'Temporal focus: 1995' ELSE 'Temporal range: 1995-' || year(o_orderdate) END,
  CASE WHEN o_orderkey % 3 > 1 THEN 'Prioritize table content for numeric evidence' END) AS suggestions FROM l""")
def expansion_suggestions(spark, sf_dir):
    """Texts that say what to expand by."""
    last = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = answers.suggestions(F.col("metrics"), F.col("refs"), F.lit("1995-01-01"), last, F.col("o_orderkey") % 3)
    return _lists(spark, sf_dir).select("o_orderkey", F.array_join(said, ";").alias("suggestions"))


@query("explain_report", _LISTS + """SELECT o_orderkey, array_to_string(list_transform(metrics[1:3], lambda x: 'metric_terms:' || x) || list_transform(names[1:2], lambda x: 'entities:' || x), ';') AS filters,
  coalesce(nullif(concat_ws('; ', CASE WHEN len(metrics) > 0 THEN 'Expanded using metrics: ' || array_to_string(metrics[1:3], ', ') END,
  CASE WHEN len(names) > 0 THEN 'Explored entities: ' || array_to_string(names[1:2], ', ') END), ''), 'Used general business context expansion') AS rationale FROM l""")
def explain_report(spark, sf_dir):
    """Filters and rationale that an explanation reports."""
    m, n = F.col("metrics"), F.col("names")
    return _lists(spark, sf_dir).select("o_orderkey", F.array_join(answers.explain_filters(m, n), ";").alias("filters"), answers.explain_rationale(m, n).alias("rationale"))


@query("numeric_report", _LISTS + """SELECT o_orderkey, array_to_string(['chunk_type:table', 'doc_refs:*', 'metric_terms:*'] || list_transform(metrics, lambda x: 'metric_terms:' || x)
  || list_transform(dates, lambda x: 'mentioned_dates:*' || x || '*'), ';') AS filters,
  coalesce('Table-focused search with ' || nullif(concat_ws(', ', CASE WHEN len(dates) > 0 THEN 'temporal focus: ' || array_to_string(dates, ', ') END, CASE WHEN len(units) > 0 THEN 'units: USD' END,
  CASE WHEN len(metrics) > 0 THEN 'metrics: ' || array_to_string(metrics, ', ') END, CASE WHEN len(refs) > 0 THEN 'table references: ' || array_to_string(refs, ', ') END), ''),
  'General table and metric-based search') AS rationale FROM l""")
def numeric_report(spark, sf_dir):
    """Filters and rationale that a numeric search reports."""
    m, d = F.col("metrics"), F.col("dates")
    why = answers.numeric_rationale(m, F.col("refs"), d, F.col("units"))
    return _lists(spark, sf_dir).select("o_orderkey", F.array_join(answers.numeric_filters(m, d), ";").alias("filters"), why.alias("rationale"))


@query("intent_filters", _LISTS + """SELECT o_orderkey, array_to_string(list_transform(dates, lambda x: 'mentioned_dates:*' || x || '*') || CASE WHEN len(metrics) > 0 THEN ['metric_terms:*'] ELSE [] END
  || CASE WHEN len(refs) > 0 THEN ['doc_refs:*'] ELSE [] END, ';') AS filters FROM l""")
def intent_filters(spark, sf_dir):
    """Filters made of a query's signals."""
    signals = F.struct(F.col("dates").alias("temporal"), F.col("metrics").alias("financial"), F.col("refs").alias("references"))
    return _lists(spark, sf_dir).select("o_orderkey", F.array_join(Q.intent_filters(signals), ";").alias("filters"))


@query("answer_prompt", f"""WITH q AS (SELECT o_orderkey, {ASKED} AS q, CASE o_orderkey % 4 WHEN 0 THEN 'financial' WHEN 1 THEN 'technical' WHEN 2 THEN 'process' ELSE 'temporal' END AS i FROM orders)
SELECT o_orderkey, CASE i WHEN 'financial' THEN 'financial analyst' WHEN 'technical' THEN 'technical analyst' ELSE 'business analyst' END AS role,
  'Analyse ' || CASE i WHEN 'financial' THEN 'financial documents and reports' WHEN 'technical' THEN 'product documentation and technical updates' WHEN 'process' THEN 'strategic documents and process information'
  ELSE 'business documents' END || ' with the context given, found by graph rag.' || chr(10) || chr(10) || 'ctx' || chr(10) || chr(10) || 'Question: ' || q || chr(10) || chr(10)
  || 'Answer this ' || i || ' query from the context alone, and say what it lacks.' AS prompt FROM q""")
def answer_prompt(spark, sf_dir):
    """Role and prompt by the query's intent."""
    intent = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'financial' WHEN 1 THEN 'technical' WHEN 2 THEN 'process' ELSE 'temporal' END")
    p = answers.prompt(F.expr(ASKED), F.lit("ctx"), F.lit("graph_rag"), intent)
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.role", "p.prompt")


_PROPOSED = """CASE o_orderkey % 6 WHEN 0 THEN '"Revenue by Quarter"' WHEN 1 THEN 'Data' WHEN 2 THEN 'one two three four five six seven' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'Income and very long words in a title of over fifty letters' END"""


@query("table_titles", f"""WITH t AS (SELECT o_orderkey, {_PROPOSED} AS p FROM orders), u AS (SELECT o_orderkey, p, replace(replace(p, '"', ''), chr(39), '') AS t FROM t)
SELECT o_orderkey, CASE WHEN p IS NULL THEN 'Table ' || o_orderkey || ': Data Table' WHEN len(string_split(t, ' ')) > 6 OR length(t) > 50 THEN 'Table ' || o_orderkey || ': Financial Data'
  WHEN t = '' OR lower(t) IN ('table', 'data', 'unknown') THEN 'Table ' || o_orderkey || ': Business Data' ELSE t END AS title FROM u""")
def table_titles(spark, sf_dir):
    """A model's table titles, checked."""
    return table(spark, sf_dir, "orders").select("o_orderkey", answers.table_title(F.expr(_PROPOSED), F.col("o_orderkey")).alias("title"))


def _order_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits, every fifth a table, some without page or rerank score."""
    o = business(spark, sf_dir)
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("doc_id"), "text", F.when(F.col("o_orderkey") % 5 == 0, "table").otherwise("paragraph").alias("chunk_type"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 40).alias("page"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 2 == 0, 0.5).alias("rerank_score"),
        F.when(F.col("o_orderkey") % 10 == 0, "Orders").alias("table_title"),
    )


_HITS = f"""WITH h AS (SELECT o_orderkey AS id, {BUSINESS} AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'table' ELSE 'paragraph' END AS chunk_type, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 40 END AS page,
  o_totalprice AS score, CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE END AS rerank_score, CASE WHEN o_orderkey % 10 = 0 THEN 'Orders' END AS table_title FROM orders) """


@query("citations", _HITS + """SELECT id, CASE WHEN chunk_type = 'table' THEN 'table' ELSE 'text' END AS citation_type, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview,
  page, rerank_score, CASE WHEN chunk_type = 'table' THEN coalesce(table_title, 'Table') END AS title FROM h""")
def citations(spark, sf_dir):
    """Citations of hits: previews, sources, scores and tables' blocks."""
    c = answers.citations(_order_hits(spark, sf_dir))
    return c.select("id", "citation_type", F.col("citation.preview").alias("preview"), F.col("citation.source.page").alias("page"), F.col("citation.rerank_score").alias("rerank_score"), F.col("citation.table.title").alias("title"))


@query("answer_context", _HITS + """, f AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM h QUALIFY n <= 10)
SELECT string_agg(CASE WHEN chunk_type = 'table' THEN '[' || coalesce(table_title, 'Table') || ', Page ' || coalesce(CAST(page AS STRING), 'unknown') || ']: ' ELSE '[Chunk ' || n || ']: ' END || text, chr(10) || chr(10) ORDER BY n) AS context FROM f""")
def answer_context(spark, sf_dir):
    """The context of an answer, from the first ten hits."""
    return answers.answer_context(_order_hits(spark, sf_dir))


@query("hit_shape", _HITS + "SELECT id, score, coalesce(rerank_score, score) AS rerank_score, text, chunk_type, CAST(id AS STRING) AS doc_id, page FROM h ORDER BY id LIMIT 25")
def hit_shape(spark, sf_dir):
    """Hits as clients take them."""
    return answers.reshaped(_order_hits(spark, sf_dir), 25)


@query("two_hop_response")
def two_hop_response(spark, sf_dir):
    """The whole response to a question: answer, citations and counts of both hops."""
    hits = two_hop.answer(_chunks_for_search(spark, sf_dir), "Why did revenue drop in Q4 2024?").withColumn("ord", F.col("trail_position"))
    found = answers.response(hits, "Why did revenue drop in Q4 2024?", "explain", 0.8)
    return found.select("query", "intent", F.md5("answer").alias("answer_md5"), F.size("citations").alias("n_citations"), "hop_1_count", "hop_2_count")


# -- clients


@query("client_view", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'list' WHEN doc_id % 4 = 1 THEN 'table' WHEN doc_id % 4 = 2 AND source <> '' THEN source WHEN text LIKE 'Table: %' THEN 'table' ELSE '' END AS chunk_type,
  md5(CASE WHEN length(text) > 400 THEN left(text, 400) || '...' ELSE text END) AS snippet_md5 FROM documents""")
def client_view(spark, sf_dir):
    """Inferred types and snippets of all documents."""
    when = lambda k, v: F.when(F.col("doc_id") % 4 == k, v)
    kind = client.chunk_type(when(0, F.lit("list")), when(1, F.lit("#/tables/1")), when(2, F.col("source")), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("chunk_type"), F.md5(client.snippet(F.col("text"))).alias("snippet_md5"))


@query("client_tags", _LISTS + """SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 40 <> 0 THEN 'page ' || o_orderkey % 40 END, CASE WHEN len(metrics) > 0 THEN 'metrics: ' || array_to_string(metrics, ', ') END,
  CASE WHEN len(refs) > 0 THEN 'refs: ' || array_to_string(refs, ', ') END, CASE WHEN o_orderkey % 2 = 0 THEN 'change note' END, CASE WHEN len(units) > 0 THEN 'units: USD' END, 'chunk ' || o_orderkey) AS tags FROM l""")
def client_tags(spark, sf_dir):
    """All tags of hits."""
    hits = _lists(spark, sf_dir).select(
        "o_orderkey", (F.col("o_orderkey") % 40).alias("page"), F.col("metrics").alias("metric_terms"), F.col("refs").alias("doc_refs"), "units", (F.col("o_orderkey") % 2 == 0).alias("is_change_note"), F.col("o_orderkey").alias("chunk_id")
    )
    return hits.select("o_orderkey", F.array_join(client.tags(hits), "|").alias("tags"))


@query("client_journey", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'method ' || o_orderpriority END AS method, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS STRING) END AS hop_1,
  CASE WHEN o_orderkey % 3 > 0 THEN '10' END AS final FROM orders""")
def client_journey(spark, sf_dir):
    """Steps and counts of journeys, null where a message has fewer steps."""
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit("2-HOP JOURNEY:\n* Query → # method "), "o_orderpriority", F.lit(" → + "), F.col("o_custkey").cast("string"), F.lit(" → ~ 5"), F.when(F.col("o_orderkey") % 3 > 0, " → = 10 chunks").otherwise(""))
    return o.select("o_orderkey", client.journey(line).alias("j")).select("o_orderkey", "j.method", "j.hop_1", "j.final")


@query("client_stream", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS events, CASE WHEN o_orderkey % 2 = 0 THEN 'log' ELSE 'result' END AS first_type, CAST(o_custkey AS STRING) AS last_message FROM orders""")
def client_stream(spark, sf_dir):
    """Events of server-sent streams; lines that aren't JSON are left out."""
    o = table(spark, sf_dir, "orders")
    log = F.when(F.col("o_orderkey") % 2 == 0, 'data: {"type": "log", "message": "x"}\n').otherwise(": ping\ndata: broken {\n")
    body = F.concat(log, F.lit('\ndata: {"type": "result", "message": "'), F.col("o_custkey").cast("string"), F.lit('"}\n\n'))
    e = o.select("o_orderkey", client.stream_events(body).alias("e"))
    return e.select("o_orderkey", F.size("e").alias("events"), F.get("e", F.lit(0))["type"].alias("first_type"), F.element_at("e", -1)["message"].alias("last_message"))


@query("history_upsert", """SELECT conv_id, ts FROM (SELECT conv_id, CASE WHEN conv_id = 3 THEN 1000000 ELSE max(turn) * 1000 + conv_id END AS ts FROM conversations GROUP BY conv_id) ORDER BY ts DESC, conv_id LIMIT 20""")
def history_upsert(spark, sf_dir):
    """The newest conversations after one came in again."""
    h = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") * 1000 + F.col("conv_id")).cast("long").alias("ts"))
    entry = h.filter("conv_id = 3").withColumn("ts", F.lit(1_000_000).cast("long"))
    return client.upsert_history(h, entry, 20)


# -- governance


@query("access", "SELECT o_orderkey FROM orders WHERE CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' ELSE 'public' END IN ('public', 'internal')")
def access(spark, sf_dir):
    """What an internal role may read."""
    level = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' END")
    return table(spark, sf_dir, "orders").filter(governance.may_read(level, "internal")).select("o_orderkey")


@query("completeness", "SELECT doc_id, round(((lang IS NOT NULL AND lang <> '')::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) / 3, 6) AS share FROM documents LEFT JOIN labels USING (doc_id)")
def completeness(spark, sf_dir):
    """The share of a document's fields that have values."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.round(governance.completeness(["lang", "quality", "toxic"], dict(d.dtypes)), 6).alias("share"))


@query("cross_references", f"""WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS chunk_id, lower(unnest(list_distinct(regexp_extract_all({BUSINESS}, '\\b(?:Table|Figure|Chart|Exhibit)\\s+\\d+(?:\\.\\d+)?\\b', 0, 'i')))) AS ref FROM orders),
t AS (SELECT o_custkey AS doc_id, o_orderkey AS target_id, 'figure ' || o_orderkey % 9 AS ref FROM orders)
SELECT DISTINCT c.doc_id, chunk_id, c.ref, target_id FROM c JOIN t ON c.doc_id = t.doc_id AND c.ref = t.ref""")
def cross_references(spark, sf_dir):
    """References of chunks to the figures of their document."""
    o = table(spark, sf_dir, "orders")
    chunks = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_id"), T.doc_refs(F.expr(BUSINESS)).alias("doc_refs"))
    label = F.concat(F.lit("Figure "), (F.col("o_orderkey") % 9).cast("string")).alias("label")
    return governance.cross_references(chunks, o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("target_id"), label))


@query("temporal_neighbours", "SELECT event_id, lag(event_id) OVER w AS earlier, lead(event_id) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def temporal_neighbours(spark, sf_dir):
    """Events before and after each event of a user."""
    return governance.temporal_neighbours(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "earlier", "later")


@query("temporal_relevance", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 / (1 + abs(year(o_orderdate) - 1996)) END, 9) AS relevance FROM orders")
def temporal_relevance(spark, sf_dir):
    """Hits by the distance of the nearest year that they name."""
    o = table(spark, sf_dir, "orders")
    dates = F.when(F.col("o_orderkey") % 4 > 0, F.array(F.lit("FY"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    hits = o.select("o_orderkey", F.col("o_orderkey").alias("ord"), dates.alias("mentioned_dates"))
    return governance.by_temporal_relevance(hits, 1996).select("o_orderkey", F.round("temporal_relevance", 9).alias("relevance"))


@query("diversified", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS turn FROM documents QUALIFY turn <= 2")
def diversified(spark, sf_dir):
    """Two hits of a source at most, the first of all sources first."""
    hits = table(spark, sf_dir, "documents").withColumns({"score": F.col("n_chars").cast("double"), "ord": F.col("doc_id")})
    return governance.diversified(hits, "source", 2).select("doc_id", "turn")


# -- texts


@query("ui_noise", """SELECT conv_id, turn, length(text) < 10 OR lower(trim(text)) IN ('home', 'menu', 'search', 'login', 'logout', 'sign in', 'sign up', 'click here', 'read more', 'show more', 'expand', 'collapse',
  'loading', 'error', 'success', 'warning', 'info') OR (NOT contains(text, ' ') AND length(text) < 20) AS noise,
  len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 10 AND (regexp_matches(trim(text), '^[^:]+:\\s*.+$') OR regexp_matches(trim(text), '^[^=]+=.+$')
  OR regexp_matches(trim(text), '^[^-]+\\s*-\\s*.+$')) AS key_value FROM conversations""")
def ui_noise(spark, sf_dir):
    """Interface noise and short key-values among all turns of conversations."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_ui_noise("text").alias("noise"), T.is_short_key_value("text").alias("key_value"))


@query("clean_artefacts", """WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '&[a-zA-Z0-9#]+;', ' ', 'g'), 'GLYPH[^G]*GLYPH', '', 'g'), 'GLYPH\\S*', '', 'g'), '\\s+', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'Skip to (?:main )?content', '', 'gi'), 'Toggle navigation', '', 'gi'), 'Search\\s*Search', '', 'gi'), 'Home\\s*>\\s*[^>]*>\\s*', '', 'gi') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'Copyright\\s*©\\s*\\d{4}', '', 'gi'), 'All rights reserved', '', 'gi'), 'Privacy Policy', '', 'gi'), 'Terms of Service', '', 'gi') AS t FROM b)
SELECT doc_id, md5(trim(t)) AS cleaned FROM c""")
def clean_artefacts(spark, sf_dir):
    """Texts without artefacts of HTML."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_artefacts("text")).alias("cleaned"))


@query("financial_terms", f"""WITH q AS (SELECT o_orderkey, regexp_extract_all(lower({ASKED}), '\\b\\w+(?:/\\w+)?\\b') AS w FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(w, lambda x: x IN ('eps', 'roi', 'ebitda', 'capex', 'opex', 'ebit') OR (length(x) > 3 AND regexp_matches(x, '[a-z]')
  AND x NOT IN ('tell', 'show', 'what', 'much', 'give', 'provide', 'find', 'about', 'from', 'with', 'this', 'that', 'these', 'those', 'please', 'would', 'could', 'should')
  AND x NOT IN ('year', 'quarter', 'month', 'period', 'time', 'current', 'latest', 'recent', 'last', 'next', 'today'))),
  lambda x: CASE WHEN x IN ('eps', 'roi', 'ebitda', 'capex', 'opex', 'ebit') THEN upper(x) ELSE x END))), ';') AS terms FROM q""")
def financial_terms(spark, sf_dir):
    """Financial words of questions."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(Q.financial_terms(F.expr(ASKED))), ";").alias("terms"))


@query("document_metadata", """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\bFY\\d{2,4}\\b') || regexp_extract_all(text, '\\bQ[1-4]-?\\d{4}\\b') || regexp_extract_all(text, '\\b\\d{4}\\b'))), ';') AS periods,
  regexp_matches(text, '\\b(?:deprecated|migrated|renamed|changed|updated|modified|replaced|removed)\\b', 'i') AS is_change_note, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS INT) AS word_count FROM documents""")
def document_metadata(spark, sf_dir):
    """Metadata of all documents as they are."""
    d = chunking.with_metadata(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_join(F.array_sort(T.periods("text")), ";").alias("periods"), "is_change_note", "word_count")


# -- pages, files and reports


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as pages with a heading and a table, some with a caption."""
    o = table(spark, sf_dir, "orders")
    row = F.struct("o_orderkey", F.format_string("<tr><td>%d</td><td>%s</td></tr>", "o_orderkey", "o_orderstatus").alias("h"))
    body = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["h"]), "").alias("rows"))
    caption = F.when(F.col("o_custkey") % 2 == 0, "<caption>Orders made</caption>").otherwise("")
    html = F.concat(F.lit("<h1>Customer</h1><div><h2>Orders</h2><table>"), caption, F.lit("<tr><th>Order</th><th>Status</th></tr>"), "rows", F.lit("</table></div>"))
    return body.select(F.col("o_custkey").alias("page_id"), html.alias("html"))


@query("html_table_chunks", """WITH o AS (SELECT o_custkey AS doc_id, string_agg(o_orderkey || ' | ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS t, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Orders made' ELSE 'Table: Orders' END AS title, 'Table: ' || CASE WHEN doc_id % 2 = 0 THEN 'Orders made' ELSE 'Table: Orders' END || chr(10) || 'Order | Status' || chr(10) || '---' || chr(10) || t AS text FROM o""")
def html_table_chunks(spark, sf_dir):
    """Tables of pages as titled chunks."""
    return html_blocks.html_table_chunks(_order_pages(spark, sf_dir)).select("doc_id", "title", "text")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as files, with some of unknown formats and without content."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("doc_id"), F.lit("html").alias("format"), F.col("html").alias("content"))
    kind = F.when(F.col("doc_id") % 50 == 0, "pdf").otherwise("markdown")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"), kind.alias("format"), F.when(F.col("doc_id") % 50 != 7, F.col("text")).alias("content"))
    return pages.unionByName(docs)


@query("file_errors", """SELECT 'doc_' || doc_id AS doc_id, CASE WHEN doc_id % 50 = 0 THEN 'Unsupported format: pdf' ELSE 'No content' END AS error FROM documents WHERE doc_id % 50 IN (0, 7) OR trim(coalesce(text, '')) = ''""")
def file_errors(spark, sf_dir):
    """Files that no chunker takes."""
    return dispatch.chunk_files(_files(spark, sf_dir))[1].select("doc_id", "error")


@query("file_chunks")
def file_chunks(spark, sf_dir):
    """Chunks of files of all formats."""
    return dispatch.chunk_files(_files(spark, sf_dir))[0].select("doc_id", "ord", "chunk_type", F.md5("text").alias("text_md5"))


@query("content_profile", """SELECT lang AS grp, count(*) AS n, count(DISTINCT doc_id % 9) AS pages, count(DISTINCT source) AS sections, CAST(count_if(n_chars > 2000) AS BIGINT) AS long_ones FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def content_profile(spark, sf_dir):
    """Hits, pages, sections and types by language."""
    kind = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    d = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("grp"), (F.col("doc_id") % 9).alias("page"), F.col("source").alias("section"), kind.alias("chunk_type"))
    return metrics.content_profile(d, "grp").select("grp", "n", "pages", "sections", F.coalesce(F.element_at("chunk_types", "long"), F.lit(0)).alias("long_ones"))


@query("performance_stats", """SELECT event_type AS grp, count(*) AS queries, round(avg(value), 6) AS avg_seconds, max(value) AS max_seconds, round(avg(user_id % 10 / 10), 6) AS avg_confidence, round(avg((event_id % 3 = 0)::INT), 6) AS cache_hit_rate FROM events GROUP BY event_type""")
def performance_stats(spark, sf_dir):
    """Queries, times, confidence and cache hits by kind."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), F.col("value").alias("seconds"), (F.col("user_id") % 10 / 10).alias("confidence"), (F.col("event_id") % 3 == 0).alias("cached"))
    return metrics.performance(e, "grp")


@query("phase_metrics", """SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_tax * 1000, 0), 6) AS rate, round(l_tax * 1000 / nullif(sum(l_tax * 1000) OVER w, 0) * 100, 3) AS share_pct,
  CASE WHEN sum(l_tax * 1000) OVER w < 60 THEN 'high' WHEN sum(l_tax * 1000) OVER w < 300 THEN 'medium' ELSE 'low' END AS efficiency FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def phase_metrics(spark, sf_dir):
    """Rates, shares and efficiency of the phases of runs."""
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("items"), (F.col("l_tax") * 1000).alias("seconds"))
    return metrics.phases(steps, "l_orderkey").select("l_orderkey", "l_linenumber", "rate", "share_pct", "efficiency")


@query("run_summary", """SELECT o_orderpriority AS format, count(*) AS files, CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS failed, CAST(sum(o_custkey) AS BIGINT) AS chunks,
  min_by('status ' || o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'F') AS first_error FROM orders GROUP BY o_orderpriority""")
def run_summary(spark, sf_dir):
    """The rows of a run's report, by format."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("format"), F.col("o_orderkey").alias("file"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_custkey").alias("chunks"), F.concat(F.lit("status "), "o_orderstatus").alias("error"))
    return metrics.run_summary(o, "format")


@query("blended_cost", "SELECT o_orderkey, round(o_custkey / 1000 * (0.7 * 0.00015 + 0.3 * 0.0006), 6) AS cost FROM orders")
def blended_cost(spark, sf_dir):
    """The cost of tokens by both prices."""
    return table(spark, sf_dir, "orders").select("o_orderkey", metrics.blended_cost(F.col("o_custkey")).alias("cost"))


@query("export_detailed", "SELECT lang AS method, doc_id AS chunk_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS INT) AS words FROM documents")
def export_detailed(spark, sf_dir):
    """The detailed export of all points."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("method"), F.col("doc_id").alias("chunk_id"), "text")
    return readers.export_detailed(d).select("method", "chunk_id", "words")


@query("numeric_priority", """SELECT o_orderkey, round(1.0::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 1.5 ELSE 1.0 END * CASE WHEN o_orderkey % 4 = 1 THEN 1.1 WHEN o_orderkey % 4 = 2 THEN 1.1 * 1.1 WHEN o_orderkey % 4 = 3 THEN 1.1 * 1.1 ELSE 1.0 END, 6) AS boosted FROM orders""")
def numeric_priority(spark, sf_dir):
    """Boosts of tables and of metrics in common with the question."""
    none = F.array().cast("array<string>")
    hits = _lists(spark, sf_dir).select("o_orderkey", F.lit(1.0).alias("score"), F.when(F.col("o_orderkey") % 2 == 0, "table").otherwise("paragraph").alias("chunk_type"), F.col("metrics").alias("metric_terms"), none.alias("cell_samples"), none.alias("mentioned_dates"))
    return retrieval.boost_numeric(hits, ["revenue", "margin"], []).select("o_orderkey", F.round("final_boost_score", 6).alias("boosted"))


