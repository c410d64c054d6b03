"""Queries of the retrieval engine by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import query as Q
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import chunking, html_blocks, metrics, retrieval, signals, tables, toc
from tessera.plans import two_hop
from tessera.streaming import ingest

FLAGSHIP = "chunk_text"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The tables hold no business prose, headings or tables: these make some of the orders, in both dialects. Three lists by
# coprime numbers make 9 x 5 x 7 different texts.
BUSINESS = """concat(CASE o_orderkey % 9
 WHEN 0 THEN 'Revenue declined 8% in Q4-2024 due to lower sales in Europe. Operating margin decreased to 25.2%.'
 WHEN 1 THEN 'The board decided to invest in DataAnalytics solution v2.1, see Table 3 and Section 4.2.'
 WHEN 2 THEN 'User growth increased because the updated privacy policy was released on 2024-03-01; customer feedback improved.'
 WHEN 3 THEN 'Product launch of the new software platform in FY2023 as a result of our strategy.'
 WHEN 4 THEN 'Risk factors affecting revenue and cost: market expansion, quarterly report, Figure 7.'
 WHEN 5 THEN 'Production efficiency increased by 12% in our facility. Cost reduction initiatives saved $5.80 million annually.'
 WHEN 6 THEN 'Campaign conversion rates improved from 2.1% to 3.8%. ROI on marketing spend increased 45% year over year.'
 WHEN 7 THEN 'Introducing the new CloudSuite version 3 on March 5, 2023, which enables software features for the engineering team.'
 ELSE 'Home > Products > <b>Skip to main content</b> Search Search January 5, 2024' END,
 CASE o_custkey % 5 WHEN 0 THEN ' Management concluded that net income rose to EUR 12 billion in Q1-2023.' WHEN 1 THEN ' The legacy API was deprecated and replaced, as shown in Figure 2.'
 WHEN 2 THEN ' Our vision and roadmap focus on Asia Pacific; refer to Section 7.' WHEN 3 THEN ' Demand was stable, and USD 3 million of debt was renamed.' ELSE '' END,
 CASE o_orderkey % 7 WHEN 0 THEN ' Exhibit 9.1 lists FY2022 and Q2-2022.' WHEN 1 THEN ' Customer satisfaction is a concern in the United States.' WHEN 2 THEN ' See Chapter 11.' WHEN 3 THEN ' EBITDA and cash flow fell.'
 WHEN 4 THEN ' The PaymentsHub platform supports monthly review results.' WHEN 5 THEN ' December 31, 2021 was the end of the fiscal year.' ELSE '' END,
 ' Order ', CAST(o_orderkey AS STRING), ' was changed for customer ', CAST(o_custkey AS STRING))"""
ASKED = """CASE o_orderkey % 6 WHEN 0 THEN 'Why did revenue drop in Q4 2024?' WHEN 1 THEN 'Show me Table 5 data on quarterly expenses'
 WHEN 2 THEN 'What is EBITDA?' WHEN 3 THEN 'latest product release' WHEN 4 THEN 'Compare sales between Q3 and Q4' ELSE 'strategy roadmap and vision' END"""
TITLES = """CASE o_orderkey % 6 WHEN 0 THEN 'Item 1. Business | 5' WHEN 1 THEN 'Item 1A. Risk Factors | 15' WHEN 2 THEN 'Revenue 2024'
 WHEN 3 THEN '1.1 Overview 10' WHEN 4 THEN 'Introduction ........ 5' ELSE '# heading' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table that comes in fewer pieces than there are cores is dealt out to all of them; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Orders whose texts are one task's work.
DEALT = 100_000


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with prose; they are dealt out first, as their texts are many times their size: by key and in parts of about
    DEALT, so that tasks don't grow with the table, whatever its files and row groups are."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    parts = max(spark.sparkContext.defaultParallelism, -(-orders.count() // DEALT))
    return orders.repartition(parts, "o_orderkey").select("o_orderkey", "o_totalprice", F.expr(BUSINESS).alias("text"))


def _sql_all(column: str, found: list[str], group: int = 0) -> str:
    """Distinct matches of all patterns, sorted, as one string."""
    flags = lambda p: ("'i'" if p.startswith("(?i)") else "''", p.removeprefix("(?i)"))
    parts = [f"regexp_extract_all({column}, '{p}', {group}, {f})" for f, p in map(flags, found)]
    joined = parts[0]
    for part in parts[1:]:
        joined = f"list_concat({joined}, {part})"
    return f"array_to_string(list_sort(list_distinct({joined})), ';')"


#: White space that is trimmed and collapsed, for SQL: all of Unicode's and the separators 28 to 31.
_SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIMMED_SQL = f"regexp_replace(regexp_replace(%s, '^{_SPACE_SQL}+', ''), '{_SPACE_SQL}+$', '')"


def _sql_clean(column: str) -> str:
    """Cleaning of chunks, written out for SQL: artefacts, tags, white space, navigation."""
    out = f"coalesce({column}, '')"
    for pattern in ("GLYPH<[^>]*>[^<]*</GLYPH>", "GLYPH&lt;[^&]*&gt;[^&]*", "/[^/]*GLYPH[^/]*/", "&lt;[^&]*&gt;", "<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = f"regexp_replace({out}, '{_SPACE_SQL}+', ' ', 'g')"
    for pattern in (r"Home\s*>\s*Products\s*>\s*", "Skip to main content", "Toggle navigation", r"Search\s*Search\s*", r"Copyright\s*©\s*\d{4}"):
        out = f"regexp_replace({out}, '{pattern}', '', 'gi')"
    return _TRIMMED_SQL % out


_SORTED = lambda c: F.array_join(F.array_sort(c), ";")


# -- scalar functions over whole tables


@query("text_word_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS n_words FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").cast("long").alias("n_words"))


@query("clean_content", f"SELECT doc_id, md5({_sql_clean('text')}) AS cleaned FROM documents")
def _(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", F.md5(T.clean_content("text")).alias("cleaned"))


#: Every document between a no-break space and an em space, with a separator and a tab in its words.
WIDE = "concat(chr(160), replace(replace(text, 'e ', concat('e', chr(28), chr(160))), '. ', concat('.', chr(9), chr(8195))), chr(8195), chr(31))"
_WIDE_SPARK = "concat('\u00a0', replace(replace(text, 'e ', 'e\u001c\u00a0'), '. ', '.\t\u2003'), '\u2003', '\u001f')"


@query("clean_wide_space", f"SELECT doc_id, md5({_sql_clean(WIDE)}) AS cleaned, length({_TRIMMED_SQL % WIDE})::INT AS n_trimmed FROM documents")
def clean_wide_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning and trimming of every document with white space of many kinds in it."""
    wide = dealt(table(spark, sf_dir, "documents")).select("doc_id", F.expr(_WIDE_SPARK).alias("text"))
    return wide.select("doc_id", F.md5(T.clean_content("text")).alias("cleaned"), F.length(T.stripped("text")).alias("n_trimmed"))


@query("clean_business", f"SELECT o_orderkey, {_sql_clean(BUSINESS)} AS cleaned FROM orders")
def _(spark, sf_dir):
    return business(spark, sf_dir).select("o_orderkey", T.clean_content("text").alias("cleaned"))


@query("meaningful", f"""
WITH c AS (SELECT doc_id, {_sql_clean('text')} AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9]+')) >= 3 AND NOT regexp_matches(t, '^[•\\-\\*\\s]+$') AND NOT regexp_matches(t, '^\\d+\\.$')
  AND NOT regexp_matches(t, '^[:\\s]*$') AND NOT regexp_matches(t, '^(Home|Menu|Search|Login|Logout)$', 'i') AS meaningful FROM c""")
def _(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", T.is_meaningful("text").alias("meaningful"))


@query("metadata", f"""
SELECT o_orderkey, {_sql_all(BUSINESS, P.DATES)} AS dates, {_sql_all(BUSINESS, P.DOC_REFS)} AS doc_refs, {_sql_all(BUSINESS, P.PERIODS)} AS periods,
  regexp_matches({BUSINESS}, '{P.CHANGE_NOTE.removeprefix('(?i)')}', 'i') AS is_change_note FROM orders""")
def _(spark, sf_dir):
    return business(spark, sf_dir).select("o_orderkey", _SORTED(T.dates("text")).alias("dates"), _SORTED(T.doc_refs("text")).alias("doc_refs"), _SORTED(T.periods("text")).alias("periods"), T.is_change_note("text").alias("is_change_note"))


@query("policy_tags", "SELECT o_orderkey, concat_ws(';', " + ", ".join(
    f"CASE WHEN {' OR '.join(f'''regexp_matches(lower({BUSINESS}), '{p}')''' for p in found)} THEN '{tag}' END" for tag, found in P.POLICY_TAGS.items()) + ") AS tags FROM orders")
def _(spark, sf_dir):
    return business(spark, sf_dir).select("o_orderkey", F.array_join(T.policy_tags("text"), ";").alias("tags"))


@query("entities", f"""
WITH e AS (SELECT o_orderkey, list_distinct({' || '.join(f"regexp_extract_all({BUSINESS}, '{p.removeprefix('(?i)')}', 1, 'i')" for p in P.ENTITIES)}) AS x FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_filter(x, lambda w: length(w) > 3 AND regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN ({', '.join(f"'{w}'" for w in P.NOT_ENTITIES)})
  AND NOT lower(w) LIKE '%ing' AND NOT lower(w) LIKE '%ed')), ';') AS entities FROM e""")
def _(spark, sf_dir):
    return business(spark, sf_dir).select("o_orderkey", _SORTED(T.entities("text")).alias("entities"))


@query("toc_lines", f"""
WITH l AS (SELECT o_orderkey, {TITLES} AS t FROM orders), m AS (
SELECT o_orderkey, t, CASE WHEN t LIKE '#%' THEN 0 WHEN regexp_matches(t, '{P.TOC_LINES[0][0].removeprefix('(?i)')}', 'i') THEN 1
  WHEN regexp_matches(t, '{P.TOC_LINES[1][0]}') THEN 2 WHEN regexp_matches(t, '{P.TOC_LINES[2][0]}') THEN 3 WHEN regexp_matches(t, '{P.TOC_LINES[3][0]}') THEN 4 ELSE 0 END AS k FROM l)
SELECT o_orderkey, CASE k WHEN 1 THEN trim(regexp_extract(t, '{P.TOC_LINES[0][0].removeprefix('(?i)')}', 1, 'i')) WHEN 3 THEN trim(regexp_extract(t, '{P.TOC_LINES[2][0]}', 1)) ELSE '' END AS section,
  CASE k WHEN 1 THEN trim(regexp_extract(t, '{P.TOC_LINES[0][0].removeprefix('(?i)')}', 2, 'i')) WHEN 2 THEN trim(regexp_extract(t, '{P.TOC_LINES[1][0]}', 1))
    WHEN 3 THEN trim(regexp_extract(t, '{P.TOC_LINES[2][0]}', 2)) ELSE trim(regexp_extract(t, '{P.TOC_LINES[3][0]}', 1)) END AS title,
  CAST(CASE k WHEN 1 THEN regexp_extract(t, '{P.TOC_LINES[0][0].removeprefix('(?i)')}', 3, 'i') WHEN 2 THEN regexp_extract(t, '{P.TOC_LINES[1][0]}', 2)
    WHEN 3 THEN regexp_extract(t, '{P.TOC_LINES[2][0]}', 3) ELSE regexp_extract(t, '{P.TOC_LINES[3][0]}', 2) END AS INT) AS page,
  CAST(CASE k WHEN 1 THEN CASE WHEN t LIKE '%.%' THEN 2 ELSE 1 END WHEN 3 THEN 2 ELSE 1 END AS INT) AS level FROM m WHERE k > 0""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", T.toc_line(F.expr(TITLES)).alias("t"))
    return o.filter("t IS NOT NULL").select("o_orderkey", "t.section", "t.title", "t.page", "t.level")


@query("folders_and_ids", """
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://', 'input/'), '/'), lambda x: x <> '') AS x, url FROM pages)
SELECT page_id, array_to_string(x[2:len(x) - 1], '/') AS folder_hierarchy, CAST(greatest(len(x) - 2, 0) AS INT) AS folder_depth,
  regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '\\.md|\\.json', '', 'g'), '[^a-zA-Z0-9_-]', '_', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g') AS stable_id FROM p""")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", T.folders(F.regexp_replace("url", "^https?://", "input/")).alias("f"))
    return p.select("page_id", F.array_join("f", "/").alias("folder_hierarchy"), F.size("f").alias("folder_depth"), T.stable_doc_id("url").alias("stable_id"))


@query("term_counts", f"SELECT o_orderkey, CAST((length(lower({BUSINESS})) - length(replace(lower({BUSINESS}), 'revenue', ''))) / 7 AS INT) AS revenue FROM orders")
def _(spark, sf_dir):
    return business(spark, sf_dir).select("o_orderkey", F.coalesce(F.element_at(metrics.term_counts(F.col("text"), ["revenue"]), "revenue"), F.lit(0)).alias("revenue"))


# -- query understanding


@query("query_intent", "WITH q AS (SELECT o_orderkey, lower(" + ASKED + ") AS q FROM orders), s AS (SELECT o_orderkey, q, " + ", ".join(
    f"{' + '.join(f'''len(regexp_extract_all(q, '{p}'))''' for p in found)} AS {name}" for name, found in P.INTENTS.items()) + " FROM q) SELECT o_orderkey, CASE WHEN greatest("
    + ", ".join(P.INTENTS) + ") = 0 THEN 'unknown' " + " ".join(f"WHEN {n} = greatest({', '.join(P.INTENTS)}) THEN '{n}'" for n in P.INTENTS)
    + f" END AS intent, round(least(1.0, greatest({', '.join(P.INTENTS)}) / len(string_split_regex(q, '\\s+'))), 6) AS confidence FROM s")
def _(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select("o_orderkey", Q.intent(F.expr(ASKED)).alias("i"))
    return q.select("o_orderkey", "i.intent", F.round("i.confidence", 6).alias("confidence"))


@query("query_types", f"""WITH q AS (SELECT o_orderkey, lower({ASKED}) AS q FROM orders)
SELECT o_orderkey, CASE {' '.join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in P.CONTENT_TYPES.items())} ELSE 'general' END AS content_type,
  CASE WHEN {' OR '.join(f"contains(q, '{w}')" for w in P.QUICK_EXPLAIN)} THEN 'explain'
    WHEN ({' OR '.join(f"contains(q, '{w}')" for w in P.QUICK_LOOKUP)}) AND len(string_split_regex(q, '\\s+')) <= 5 THEN 'lookup'
    {' '.join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, _, words in P.FALLBACK)} ELSE 'lookup' END AS retrieval_intent FROM q""")
def _(spark, sf_dir):
    q = F.expr(ASKED)
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.content_type(q)["type"].alias("content_type"), Q.retrieval_intent(q)["primary"].alias("retrieval_intent"))


@query("query_understanding")
def _(spark, sf_dir):
    q = Q.understand(table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")))
    return q.select("conv_id", "turn", "intent", "confidence", F.size("keywords").alias("n_keywords"), F.size("variants").alias("n_variants"), "optimized_query", "context_preserved")


@query("numeric_signals", f"""WITH q AS (SELECT o_orderkey, {ASKED} AS q FROM orders)
SELECT o_orderkey, {_sql_all('q', [p for p, g in P.QUERY_UNITS], 1)} AS units, {_sql_all('q', [p for p, _ in P.QUERY_VALUES])} AS values_found FROM q""")
def _(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select("o_orderkey", Q.numeric_signals(F.expr(ASKED)).alias("s"))
    return q.select("o_orderkey", _SORTED(F.col("s.units")).alias("units"), _SORTED(F.col("s.values")).alias("values_found"))


@query("universal_signals", f"""SELECT o_orderkey, {_sql_all(f'lower({BUSINESS})', P.UNIVERSAL['performance'], 1)} AS performance, {_sql_all(f'lower({BUSINESS})', P.UNIVERSAL['organizations'], 1)} AS organizations,
  {_sql_all(f'lower({BUSINESS})', P.UNIVERSAL['geographic'], 1)} AS geographic, {_sql_all(f'lower({BUSINESS})', [P.NUMBERS['percentages']])} AS percentages FROM orders""")
def _(spark, sf_dir):
    kinds = ("performance", "organizations", "geographic", "percentages")
    u = business(spark, sf_dir).withColumn("u", Q.universal_signals(F.col("text"), kinds))
    return u.select("o_orderkey", *[_SORTED(F.col(f"u.{k}")).alias(k) for k in kinds])


# -- chunking


@query("line_kinds", """
WITH l AS (SELECT doc_id, unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS line FROM documents WHERE text IS NOT NULL), k AS (
SELECT doc_id, CASE WHEN regexp_matches(line, '^#{1,3}\\s+') THEN 'heading' WHEN contains(trim(line), '|') AND trim(line) <> '|' AND NOT trim(line) LIKE '#%' THEN 'skip'
  WHEN regexp_matches(trim(line), '^[^:]+:\\s*[^:]+$') OR regexp_matches(trim(line), '^[^-]+-\\s*[^-]+$') OR regexp_matches(trim(line), '^[^=]+=\\s*[^=]+$') THEN 'kv'
  WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '[A-Za-z0-9]') AND length(trim(line)) > 1 THEN 'text' ELSE 'skip' END AS kind FROM l)
SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL""")
def _(spark, sf_dir):
    lines = chunking.lines_of(dealt(table(spark, sf_dir, "documents").filter("text IS NOT NULL")))
    return lines.groupBy("doc_id", T.line_kind("line").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("chunk_text", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE text IS NOT NULL), k AS (
SELECT doc_id, ord, trim(line) AS t, CASE WHEN contains(trim(line), '|') AND trim(line) <> '|' AND NOT trim(line) LIKE '#%' THEN 'skip'
  WHEN regexp_matches(trim(line), '^[^:]+:\\s*[^:]+$') OR regexp_matches(trim(line), '^[^-]+-\\s*[^-]+$') OR regexp_matches(trim(line), '^[^=]+=\\s*[^=]+$') THEN 'kv'
  WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '[A-Za-z0-9]') AND length(trim(line)) > 1 THEN 'text' ELSE 'skip' END AS kind FROM l), u AS (
SELECT *, sum(CASE WHEN kind = 'text' AND p = 'text' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM (
  SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM k WHERE kind <> 'skip')), c AS (
SELECT doc_id, min(ord) AS ord, CASE WHEN min(kind) = 'text' THEN 'paragraph' ELSE min(kind) END AS chunk_type, string_agg(t, ' ' ORDER BY ord) AS text FROM u WHERE kind IN ('text', 'kv') GROUP BY doc_id, island), m AS (
SELECT *, sum(CASE WHEN chunk_type = 'paragraph' AND p = 'paragraph' AND len(regexp_extract_all(text, '[A-Za-z0-9]+')) < 15 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM (
  SELECT *, lag(chunk_type) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM c)), r AS (
SELECT doc_id, min(ord) AS ord, min_by(chunk_type, ord) AS chunk_type, string_agg(text, ' ' ORDER BY ord) AS text FROM m GROUP BY doc_id, g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INT) AS chunk_id, chunk_type, md5(text) AS text_md5, 'Document' AS headings_path FROM r""")
def _(spark, sf_dir):
    chunks = chunking.chunk_markdown(table(spark, sf_dir, "documents").filter("text IS NOT NULL"))
    return chunks.select("doc_id", "chunk_id", "chunk_type", F.md5("text").alias("text_md5"), "headings_path")


@query("chunk_tidy")
def _(spark, sf_dir):
    chunks = chunking.tidy(chunking.chunk_markdown(table(spark, sf_dir, "documents")))
    return chunking.with_metadata(chunks).select("doc_id", "ord", "chunk_type", "word_count", chunking.chunk_uuid().alias("uuid"), F.size("entities").alias("n_entities"))


@query("section_index")
def _(spark, sf_dir):
    return chunking.section_index(chunking.chunk_markdown(table(spark, sf_dir, "documents")))


@query("html_elements")
def _(spark, sf_dir):
    return html_blocks.element_stream(dealt(table(spark, sf_dir, "pages")))


@query("html_clean_blocks")
def _(spark, sf_dir):
    return html_blocks.element_stream(dealt(table(spark, sf_dir, "pages")), clean=True)


@query("html_chunks")
def _(spark, sf_dir):
    return html_blocks.chunk_html(dealt(table(spark, sf_dir, "pages")))


@query("html_toc", """
WITH n AS (SELECT page_id AS doc_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)">[^<]*</a>', 1) AS t, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS x FROM pages)
SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS ord, unnest(x) AS title, unnest(t) AS target, CAST(1 AS INT) AS level FROM n""")
def _(spark, sf_dir):
    return html_blocks.html_toc(dealt(table(spark, sf_dir, "pages")))


@query("html_tables", """
SELECT o_orderkey AS doc_id, CAST(0 AS INT) AS table_no, CAST(r AS INT) AS "row", CAST(c AS INT) AS col,
  CASE WHEN r = 0 AND c = 0 THEN 'Order' WHEN r = 0 THEN 'Price' WHEN c = 0 THEN CAST(o_orderkey AS STRING) ELSE printf('%.2f', o_totalprice) END AS text,
  r = 0 AS column_header, false AS row_header FROM orders, range(2) a(r), range(2) b(c)""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    html = F.format_string("<table><tr><th>Order</th><th>Price</th></tr><tr><td>%d</td><td>%.2f</td></tr></table>", "o_orderkey", "o_totalprice")
    return html_blocks.html_tables(o.select(F.col("o_orderkey").alias("page_id"), html.alias("html")))


# -- tables and contents


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a table of two columns under a header."""
    o = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    cell = lambda row, col, text, head: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), text.cast("string").alias("text"), F.lit(head).alias("column_header"))
    body = o.select("o_custkey", F.explode(F.array(cell(F.col("r"), 0, F.col("o_orderkey"), False), cell(F.col("r"), 1, F.col("o_orderpriority"), False))).alias("c"))
    heads = o.select("o_custkey").distinct().select("o_custkey", F.explode(F.array(cell(F.lit(0), 0, F.lit("order"), True), cell(F.lit(0), 1, F.lit("priority"), True))).alias("c"))
    # Every customer is a document, and all their tables have the same id.
    return body.union(heads).select(F.col("o_custkey").alias("doc_id"), F.lit("#/tables/0").alias("table_id"), F.lit(0).alias("ord"), F.col("c.row").alias("start_row"), (F.col("c.row") + 1).alias("end_row"), F.col("c.col").alias("start_col"), (F.col("c.col") + 1).alias("end_col"), "c.text", "c.column_header", F.lit(False).alias("row_header"), F.lit(False).alias("row_section"))


@query("table_rows", """
WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS "row", o_orderkey, o_orderpriority FROM orders)
SELECT doc_id, CAST("row" AS INT) AS "row", o_orderkey || ';' || o_orderpriority AS cells, false AS header FROM o
UNION ALL SELECT DISTINCT doc_id, CAST(0 AS INT), 'order;priority', true FROM o""")
def _(spark, sf_dir):
    return tables.rows_of(tables.cell_matrix(_order_cells(spark, sf_dir))).select("doc_id", "row", F.array_join("cells", ";").alias("cells"), "header")


@query("table_groups", """
WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, len(regexp_extract_all(o_orderkey || ' ' || o_orderpriority, '[A-Za-z0-9]+')) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT doc_id, r, s AS total, 0 AS g FROM o WHERE r = 1 UNION ALL
  SELECT o.doc_id, o.r, CASE WHEN f.total + 6 + o.s <= 40 THEN f.total + o.s ELSE o.s END, CASE WHEN f.total + 6 + o.s <= 40 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
SELECT doc_id, CAST(g AS INT) AS "group", CAST(count(*) AS INT) AS n_rows FROM f GROUP BY doc_id, g""")
def _(spark, sf_dir):
    rows = tables.rows_of(tables.cell_matrix(_order_cells(spark, sf_dir)))
    return tables.group_rows(rows, max_words=40).select("doc_id", "group", F.size("rows").alias("n_rows"))


@query("table_samples", """
WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderkey, o_orderpriority FROM orders)
SELECT doc_id, string_agg('order: ' || o_orderkey || ';priority: ' || o_orderpriority, ';' ORDER BY r) AS samples FROM o WHERE r <= 5 GROUP BY doc_id""")
def _(spark, sf_dir):
    found = tables.cell_samples(tables.rows_of(tables.cell_matrix(_order_cells(spark, sf_dir))))
    return found.select("doc_id", F.array_join("cell_samples", ";").alias("samples"))


@query("table_chunks", """
WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, o_orderkey || ' | ' || o_orderpriority AS t, len(regexp_extract_all(o_orderkey || ' ' || o_orderpriority, '[A-Za-z0-9]+')) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT doc_id, r, t, s AS total, 0 AS g FROM o WHERE r = 1 UNION ALL
  SELECT o.doc_id, o.r, o.t, CASE WHEN f.total + 6 + o.s <= 300 THEN f.total + o.s ELSE o.s END, CASE WHEN f.total + 6 + o.s <= 300 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
SELECT doc_id, CAST(1 AS INT) AS table_no, CAST(g AS INT) AS "group", 'Table: Table 1' || chr(10) || 'order | priority' || chr(10) || '---' || chr(10) || string_agg(t, chr(10) ORDER BY r) AS text FROM f GROUP BY doc_id, g""")
def _(spark, sf_dir):
    matrix = tables.cell_matrix(_order_cells(spark, sf_dir))
    untitled = matrix.select("doc_id", "table_id", F.lit("").alias("label")).distinct()
    return tables.table_chunks(matrix, untitled).select("doc_id", "table_no", "group", "text")


@query("pack_rows", """
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT o_custkey, r, o_orderkey, s AS total, 0 AS g FROM o WHERE r = 1 UNION ALL
  SELECT o.o_custkey, o.r, o.o_orderkey, CASE WHEN f.total + o.s <= 300000 THEN f.total + o.s ELSE o.s END, CASE WHEN f.total + o.s <= 300000 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.r = f.r + 1)
SELECT o_custkey, CAST(g AS INT) AS "group", min(o_orderkey) AS "first", max(o_orderkey) AS "last", round(max_by(total, r), 2) AS total FROM f GROUP BY o_custkey, g""")
def _(spark, sf_dir):
    packed = tables.pack_rows(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 300_000)
    return packed.withColumn("total", F.round("total", 2))


@query("as_of_join", """
SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.filter("event_type <> 'error'").select("user_id", "ts", F.col("value").alias("last_value"))
    return toc.as_of(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "ts", "last_value").select("event_id", "last_value")


@query("toc_section_as_of", """
WITH t AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderpriority || ' ' || o_orderkey AS title, o_orderkey % 50 AS page FROM orders),
n AS (SELECT *, lag(title) OVER w AS p, lead(title) OVER w AS x FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
c AS (SELECT o_custkey AS doc_id, o_orderkey AS chunk_id, o_orderkey % 37 AS page FROM orders)
SELECT c.doc_id, c.chunk_id, max_by(n.title, n.ord) AS toc_title, arg_max_null(n.p, n.ord) AS toc_prev, arg_max_null(n.x, n.ord) AS toc_next
FROM c LEFT JOIN n ON n.doc_id = c.doc_id AND n.page <= c.page GROUP BY c.doc_id, c.chunk_id""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    t = o.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).alias("ord"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), (F.col("o_orderkey") % 50).alias("page"))
    v = Window.partitionBy("doc_id").orderBy("ord")
    t = t.withColumn("prev_title", F.lag("title").over(v)).withColumn("next_title", F.lead("title").over(v))
    c = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 37).alias("page"), F.lit("").alias("headings_path"))
    return toc.section_as_of(c, t)


# -- vectors and retrieval

_COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


@query("vector_top_k_each", f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (
SELECT query_id, vec_id, round({_COSINE.format(a='embedding', b='qv')}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COSINE.format(a='embedding', b='qv')} DESC, vec_id) AS "rank" FROM embeddings, q)
SELECT query_id, vec_id, score, CAST("rank" AS INT) AS "rank" FROM s WHERE "rank" <= 5""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.top_k_each(e.select("vec_id", "embedding"), queries, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("vector_filtered_top_k", f"""
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round({_COSINE.format(a='embedding', b='qv')}, 6) AS score FROM embeddings, q WHERE label = 1 ORDER BY {_COSINE.format(a='embedding', b='qv')} DESC, vec_id LIMIT 20""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    probe = e.filter("vec_id = 0").first()["embedding"]
    return retrieval.top_k(e, probe, 20, ["label:1"]).withColumn("score", F.round("score", 6))


@query("embedding_validation", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.valid_embedding("embedding", 64).alias("valid"))


@query("label_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-CAST(label AS DOUBLE))), 6) AS probability FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.sigmoid(F.col("label").cast("double")), 6).alias("probability"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits: the user is the id, the value the score, in event order."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("doc_id"), (F.col("user_id") % 7).alias("page"), F.col("value").alias("score"), F.col("event_id").alias("ord"))


@query("dedupe_best", "SELECT user_id AS id, event_id AS ord, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def _(spark, sf_dir):
    return retrieval.dedupe_best(_hits(spark, sf_dir)).select("id", "ord", "score")


@query("dedupe_first", "SELECT event_type AS doc_id, user_id % 7 AS page, min(event_id) AS ord FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return retrieval.dedupe_first(_hits(spark, sf_dir), ("doc_id", "page")).select("doc_id", "page", "ord")


@query("dedupe_first_by_id", "SELECT user_id AS id, min(event_id) AS ord FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return retrieval.dedupe_first(_hits(spark, sf_dir)).select("id", "ord")


@query("rebalance", f"""
WITH h AS (SELECT o_orderkey, o_totalprice AS score, lower({BUSINESS}) AS t FROM orders), k AS (SELECT *, {' + '.join(f"contains(t, '{w}')::INT" for w in P.CONTENT_KEYWORDS['product'])} AS m FROM h),
c AS (SELECT *, CASE WHEN m >= 2 THEN 0 WHEN m >= 1 THEN 1 ELSE 2 END AS g FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, o_orderkey) AS n FROM c)
SELECT o_orderkey, score FROM r WHERE n <= CASE g WHEN 0 THEN 60 WHEN 1 THEN 30 ELSE 100 END ORDER BY g, n LIMIT 100""")
def _(spark, sf_dir):
    hits = business(spark, sf_dir).select("o_orderkey", "text", F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("ord"))
    return retrieval.rebalance(hits, "product", 100).select("o_orderkey", "score")


@query("boost_explanation", f"""
SELECT o_orderkey, round(CASE WHEN regexp_matches({BUSINESS}, '{P.CHANGE_NOTE.removeprefix('(?i)')}', 'i') THEN 0.3 ELSE 0.0 END + CASE WHEN contains(lower({BUSINESS}), 'revenue') THEN 0.1 ELSE 0.0 END + 0.5::DOUBLE, 6) AS boosted_score FROM orders""")
def _(spark, sf_dir):
    hits = business(spark, sf_dir).withColumn("is_change_note", T.is_change_note("text")).withColumn("score", F.lit(0.5))
    return retrieval.boost_explanation(hits, ["revenue"]).select("o_orderkey", F.round("boosted_score", 6).alias("boosted_score"))


@query("boost_numeric", f"""
WITH h AS (SELECT o_orderkey, {BUSINESS} AS t, o_orderkey % 2 = 0 AS is_table FROM orders), p AS (SELECT *, regexp_matches(t, '\\bQ[1-4]-?\\d{{4}}\\b') AND contains(t, 'Q4-2024') AS q FROM h)
SELECT o_orderkey, round(1.0::DOUBLE * CASE WHEN q THEN 1.5 * 1.4 ELSE 1.0 END * CASE WHEN is_table THEN 1.4 * 1.5 ELSE 1.0 END * CASE WHEN q THEN 1.15 ELSE 1.0 END, 6) AS final_boost_score FROM p""")
def _(spark, sf_dir):
    empty = F.array().cast("array<string>")
    hits = business(spark, sf_dir).select("o_orderkey", F.lit(1.0).alias("score"), T.dates("text").alias("mentioned_dates"), T.periods("text").alias("periods"), T.units("text").alias("units"), T.doc_refs("text").alias("doc_refs"), F.when(F.col("o_orderkey") % 2 == 0, "table").otherwise("paragraph").alias("chunk_type"), empty.alias("cell_samples"), empty.alias("metric_terms"))
    boosted = retrieval.boost_alignment(hits, {"periods": ["Q4-2024"]})
    return retrieval.boost_numeric(boosted, [], ["Q4-2024"]).select("o_orderkey", F.round("final_boost_score", 6).alias("final_boost_score"))


@query("rerank", """
WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(left(text, 1200)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM documents)
SELECT doc_id, len(list_intersect(w, ['the', 'and', 'of', 'was', 'that'])) / 5 AS rerank_score FROM d ORDER BY rerank_score DESC, doc_id LIMIT 50""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0.0).alias("score"), F.col("doc_id").alias("ord"))
    return retrieval.rerank(d, "the and of was that", 50).select("doc_id", "rerank_score")


@query("content_retrieval")
def _(spark, sf_dir):
    return two_hop.retrieve(_chunks_for_search(spark, sf_dir), "latest product release", 10).select("id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


_CACHED: dict[str, DataFrame] = {}


def _texts_for_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business prose as chunks, tables among them: texts and vectors, cached while the queries of one folder use them, as a
    two-hop search reads the collection several times."""
    key = f"{spark.sparkContext.applicationId} {sf_dir}"
    if key not in _CACHED:
        while _CACHED:
            _CACHED.popitem()[1].unpersist()
        kind = F.when(F.col("o_orderkey") % 5 == 0, "table").otherwise("paragraph").alias("chunk_type")
        b = business(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), "text", kind)
        _CACHED[key] = b.withColumn("embedding", V.hash_embedding("text")).persist()
    return _CACHED[key]


def _detailed(texts: DataFrame) -> DataFrame:
    """Chunks with metadata, which cost many times what a vector does: they are worked out where a search asks for them, and
    for its hits."""
    meta = chunking.with_metadata(texts, {"metrics": ["revenue", "margin"]})
    lists = {"units": T.units("text"), "periods": T.periods("text"), "cell_samples": F.array().cast("array<string>")}
    return meta.withColumns(lists | {"headings_path": F.lit(None).cast("string")})


def _chunks_for_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detailed(_texts_for_search(spark, sf_dir))


@query("two_hop_explain")
def _(spark, sf_dir):
    return two_hop.answer(_chunks_for_search(spark, sf_dir), "Why did revenue drop in Q4 2024?").select("trail_position", "id", "hop", "trail_role")


@query("two_hop_numeric")
def _(spark, sf_dir):
    return two_hop.answer(_chunks_for_search(spark, sf_dir), "revenue data of Q4-2024 in Table 3").select("trail_position", "id", "hop", "trail_role")


# -- signals


@query("top_signals", """
WITH s AS (SELECT user_id AS ord, event_type AS signal_type, CAST(json_extract(props, '$.k') AS STRING) AS term FROM events),
c AS (SELECT signal_type, term, count(*) AS n, min(ord) AS first_seen FROM s WHERE term IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
SELECT signal_type, term, n, CAST(row_number() OVER (PARTITION BY signal_type ORDER BY n DESC, first_seen, term) AS INT) AS "rank" FROM c QUALIFY "rank" <= 3""")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("ord"), F.col("event_type").alias("signal_type"), F.get_json_object("props", "$.k").alias("term")).filter("term IS NOT NULL")
    return signals.top_signals(s).select("signal_type", "term", "n", "rank")


@query("signal_strength", """SELECT event_type AS signal_type, count(*) AS total, count(DISTINCT user_id) AS distinct_terms, least(count(*) / count(DISTINCT user_id) / 5, 1.0) AS confidence,
  count(*) * count(DISTINCT user_id) / 10 AS strength FROM events GROUP BY event_type""")
def _(spark, sf_dir):
    return signals.strength(table(spark, sf_dir, "events").select(F.col("event_type").alias("signal_type"), F.col("user_id").alias("term")))


@query("date_range", "SELECT min(year(o_orderdate)) || '-01-01' AS first_date, max(year(o_orderdate)) || '-12-31' AS last_date FROM orders")
def _(spark, sf_dir):
    return signals.date_range(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("mentioned_date")))


@query("common_year", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS count FROM orders GROUP BY ALL ORDER BY count DESC, year DESC LIMIT 1")
def _(spark, sf_dir):
    return signals.common_year(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("mentioned_date")))


@query("result_diversity", "SELECT round((count(DISTINCT doc_id) / count(*) + count(DISTINCT lang) / count(*) + count(DISTINCT source) / count(*)) / 3, 9) AS diversity FROM documents")
def _(spark, sf_dir):
    return signals.diversity(table(spark, sf_dir, "documents"), ("doc_id", "lang", "source")).select(F.round("diversity", 9).alias("diversity"))


# -- joins, set operations, windows


@query("unlabelled_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("companion_labels", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT user_id FROM events UNION SELECT o_custkey FROM orders) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT user_id FROM events INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders)""")
def _(spark, sf_dir):
    a, b = table(spark, sf_dir, "events").select("user_id"), table(spark, sf_dir, "orders").select("o_custkey")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("except", a.subtract(b)))


@query("quota_by_language", "SELECT lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 3")
def _(spark, sf_dir):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("lang", "doc_id", "n_chars")


# -- metrics


@query("chunk_metrics", "SELECT lang AS chunk_type, count(*) AS n_chunks, round(avg(length(text)), 3) AS avg_chars, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS BIGINT) AS n_words FROM documents GROUP BY lang")
def _(spark, sf_dir):
    return metrics.chunk_metrics(table(spark, sf_dir, "documents").withColumnRenamed("lang", "chunk_type"))


@query("batch_totals", """SELECT count(*) AS files, count_if(o_orderstatus = 'F') AS succeeded, round(count_if(o_orderstatus = 'F') / count(*) * 100, 3) AS success_pct, CAST(sum(o_custkey) AS BIGINT) AS chunks,
  CAST(sum(o_orderkey) AS BIGINT) AS tokens, round(sum(o_custkey) / count(*), 3) AS chunks_per_second, round(sum(o_orderkey) / 1000 * 0.00015, 6) AS cost FROM orders""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("ok"), F.col("o_custkey").alias("chunks"), F.col("o_orderkey").alias("tokens"), F.lit(1.0).alias("seconds"))
    return metrics.batch_totals(o)


@query("breakdown", "SELECT lang, source, CAST(grouping_id(lang, source) AS INT) AS level, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def _(spark, sf_dir):
    return metrics.breakdown(table(spark, sf_dir, "documents"), "lang", "source")


@query("coverage", """SELECT 'quality' AS field, round(avg((quality IS NOT NULL)::INT) * 100, 3) AS coverage FROM documents LEFT JOIN labels USING (doc_id) UNION ALL
SELECT 'lang', round(avg((lang IS NOT NULL AND lang <> '')::INT) * 100, 3) FROM documents""")
def _(spark, sf_dir):
    return metrics.coverage(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "lang"])


@query("recent_history", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(spark, sf_dir):
    return metrics.recent(table(spark, sf_dir, "events"), "ts", 1000, "event_id").select("event_id", "user_id", "value")


@query("optimal_thresholds", """SELECT event_type AS intent, count(*) AS n, CASE WHEN count_if(value / 100 > 0.7) >= 5 THEN least(greatest(round(avg(CASE WHEN value / 100 > 0.7 THEN (user_id % 10) / 10 END), 6) - 0.1, 0.5), 0.95) ELSE 0.8 END AS threshold
FROM events GROUP BY event_type HAVING count(*) >= 10""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("intent"), (F.col("value") / 100).alias("confidence"), (F.col("user_id") % 10 / 10).alias("relevance"))
    return metrics.optimal_thresholds(e).withColumn("threshold", F.round("threshold", 6))


@query("timeline", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) AS cumulative FROM events")
def _(spark, sf_dir):
    return metrics.timeline(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", F.round("cumulative", 3).alias("cumulative"))


@query("conversation_summary", "SELECT conv_id, count(*) AS turns, max_by(role, turn) AS last_role, min_by(left(text, 60), turn) AS title FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role"), F.min_by(F.substring("text", 1, 60), "turn").alias("title"))


@query("event_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf_dir):
    w = ingest.event_windows(table(spark, sf_dir, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events")).select("user_id", "n")


from tessera import queries_answers, queries_scale  # noqa: E402, F401  (they register their queries)
