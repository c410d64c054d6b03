"""The queries of this subpackage: one ``opN_<name>`` for each operator, the pipeline, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: (page_id, url, text, n_chars)."""
    from tessera.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log importance weight of every document, its Gumbel key, and whether it is drawn."""
    from tessera.llm import importance

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = importance.fit(docs, table(spark, sf_dir, "labels")).judged()
    return judged.select("doc_id", (F.col("weight") / importance.UNIT).alias("log_weight"), (F.col("key") / importance.UNIT).alias("gumbel_key"), "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    from tessera.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled ones that aren't held out."""
    from tessera.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    from tessera.llm import bpe

    coded = bpe.code(table(spark, sf_dir, "documents"))
    n = F.expr("CAST(octet_length(ids) div 4 AS BIGINT)").alias("n_tokens")
    return coded.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's media column and of the features read back from its tensors."""
    from tessera.llm import media

    return media.digests(media.media_columns(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, judged by the production policy."""
    from tessera.llm import rules

    entries = rules.judge(rules.ledger(table(spark, sf_dir, "documents")))
    base = entries.failures.bitwiseAND(rules.mask_of("v1")) != 0
    return entries.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "n_lines", "n_exclaims", "n_upper"
    )


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy would reject without each of its rules, over the ledger of all documents."""
    from tessera.llm import rules

    return rules.ablation(rules.ledger(table(spark, sf_dir, "documents")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id of its component."""
    from tessera.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base and the suffix tree's log probability of every document."""
    from tessera.llm import pst

    return pst.score(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture, as read back from the archives."""
    from tessera.llm import warc

    found = warc.archive(table(spark, sf_dir, "pages"))
    number = lambda name: F.expr(f"try_cast(metadata[0].fields['{name}'] AS BIGINT)").alias
    return found.select(
        number("page-id")("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers-to-page")("refers_to")
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt to share heads by hundreds."""
    from tessera.llm import tries

    return tries.trie(tries.regrafted(tries.marked(table(spark, sf_dir, "conversations")))).drop("node")


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness."""
    from tessera.llm import imatch

    return imatch.compared(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error, and its label's."""
    from tessera.llm import codes

    return codes.compressed(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
         max(page_id) OVER (PARTITION BY body) AS latest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN latest IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest IS DISTINCT FROM page_id THEN latest END AS refers_to FROM d
"""

_LEDGER_SQL = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), b AS (
  SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g FROM a
), u AS (
  SELECT doc_id, t, unnest(g) AS win, unnest(range(0, len(g))) AS place FROM b
), twice AS (
  SELECT doc_id, t, place FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, t, win) > 1
), covered AS (
  SELECT doc_id, t, count(DISTINCT pos) AS n FROM (SELECT doc_id, t, unnest([place, place + 1, place + 2]) AS pos FROM twice) GROUP BY ALL
), m AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(b.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(b.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(b.t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
         CAST(length(regexp_replace(b.t, '\P{Lu}', '', 'g')) AS BIGINT) AS n_upper
  FROM b LEFT JOIN covered c ON b.doc_id = c.doc_id AND b.t = c.t
), f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 5 * word_chars)::INT
         + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
         + 32 * (100 * n_exclaims > 30 * n_words)::INT + 64 * (100 * n_upper > 60 * word_chars)::INT AS BIGINT) AS failures FROM m
)
"""
OP7_SQL = _LEDGER_SQL + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept,
       failures, n_lines, n_exclaims, n_upper FROM f
"""
ABLATION_SQL = _LEDGER_SQL + """, c AS (
  SELECT * FROM (VALUES ('v1', 3, 'few_words', 1), ('v1', 3, 'repeated_windows', 2),
    ('v2', 15, 'few_words', 1), ('v2', 15, 'repeated_windows', 2), ('v2', 15, 'symbols', 4), ('v2', 15, 'duplicate_lines', 8),
    ('v3', 127, 'few_words', 1), ('v3', 127, 'repeated_windows', 2), ('v3', 127, 'symbols', 4), ('v3', 127, 'duplicate_lines', 8),
    ('v3', 127, 'word_length', 16), ('v3', 127, 'exclamations', 32), ('v3', 127, 'capitals', 64)) t(policy, mask, rule, bit)
)
SELECT policy, rule, count(*) AS documents, CAST(count_if((failures & mask) <> 0) AS BIGINT) AS rejected, CAST(count_if((failures & bit) <> 0) AS BIGINT) AS failing,
       CAST(count_if((failures & mask) = bit) AS BIGINT) AS only_by_this FROM f, c GROUP BY policy, rule
"""

OP11_SQL = """
WITH RECURSIVE crc(byte, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), crcs AS (
  SELECT list(c ORDER BY byte) AS t FROM crc WHERE k = 8
), marked AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
         struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - ((conv_id % 100) + 100) % 100 AS first,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM marked), crcs
), turns AS (
  SELECT i.conv_id, m.place, m.said FROM ids i JOIN marked m ON m.conv_id = i.first AND m.place <= i.h UNION ALL
  SELECT i.conv_id, m.place, m.said FROM ids i JOIN marked m ON m.conv_id = i.conv_id AND m.place > i.h
), convs AS (
  SELECT i.conv_id, coalesce(list(said ORDER BY place) FILTER (place IS NOT NULL), []) AS turns FROM ids i LEFT JOIN turns t ON t.conv_id = i.conv_id GROUP BY i.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS node, turns[1:d - 1] AS parent, len(turns) = d AS last, CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS n_chars
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM convs)
), nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars, bool_and(last) AS leaf,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), children AS (
  SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), sums AS (
  SELECT p.node, p.depth, sum((n.n_convs - 1) * n.n_chars) AS saved_tokens, count_if(n.leaf) AS n_leaves
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node, p.depth
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth LEFT JOIN children c ON c.parent = n.node
  LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.parent
"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """SQL of the vector codes: a round is a nearest entry for each part, and a mean for each entry that is used."""
    near = """n{k} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM (
    SELECT p.rid, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN b{k} b ON b.part = p.part) GROUP BY rid, part
)"""
    move = """b{next} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY place) AS x FROM (
      SELECT n.part, n.entry, place, sum(p.x[place])::BIGINT AS s, count(*) AS c FROM n{k} n JOIN parts p ON p.rid = n.rid AND p.part = n.part, range(1, (SELECT len(any_value(x)) + 1 FROM parts)) r(place)
      GROUP BY n.part, n.entry, place) GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry
)"""
    steps = [near.format(k=0)]
    for k in range(rounds):
        steps += [move.format(k=k, next=k + 1), near.format(k=k + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(part)
), seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {entries})
), b0 AS MATERIALIZED (
  SELECT part, entry, min(x) AS x FROM parts JOIN seeds ON seeds.vec_id = parts.vec_id GROUP BY part, entry
), {", ".join(steps)}, books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
), coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n{rounds} GROUP BY rid
)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256 FROM kept k JOIN coded c ON c.rid = k.rid, books
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_media_columns": op6_media_columns,
    "op7_quality_rules": op7_quality_rules,
    "rules_ablation": rules_ablation,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_warc": op10_warc,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op7_quality_rules": OP7_SQL,
    "rules_ablation": ABLATION_SQL,
    "op10_warc": OP10_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op13_vector_codes": _codes_sql(),
}
