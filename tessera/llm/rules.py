"""Quality rules (7): a ledger of rule failures as bits, and versioned policies over it.

Every rule is evaluated once per document. Its failure is one bit of ``failures`` and what it measured stays beside
it, so that a policy is a mask over bits: applying another version, or asking what a policy would lose without one of
its rules, never reads a text again. Everything here is DataFrame functions: texts stay in the JVM, nothing is
shuffled but counts by ledger value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, text_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` is the rule's place in the ledger for all time."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic only, so that any engine gets the same bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 5 * word_chars"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(5, "exclamations", "100 * n_exclaims > 30 * n_words"),
    Rule(6, "capitals", "100 * n_upper > 60 * word_chars"),
)
#: A version names the rules that reject. Versions are never changed, only added.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v3": tuple(rule.name for rule in RULES),
}
PRODUCTION = "v3"


def mask_of(policy: str) -> int:
    """The bits of a policy's rules."""
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _without(text: Column, characters: str, instead: str = "") -> Column:
    """``text`` with each of the characters replaced; one-character replace() is several times faster than translate()."""
    for x in characters:
        text = F.replace(text, F.lit(x), F.lit(instead))
    return text


def _count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(_without(text, characters))).cast("long")


def _repeat_words() -> Column:
    """Words inside three-word windows that occur at least twice, over the columns _words and _windows.

    Distinct windows (nearly every text) end it at once. Else windows are sorted with their places, those equal to a
    neighbour are kept, and the words that they cover are counted by the distances of their sorted places.
    """
    placed = "sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i)))"
    twice = f"transform(array({placed}), p -> sort_array(transform(filter(p, (x, j) -> (j > 0 AND p[greatest(j - 1, 0)].h = x.h) OR (j < size(p) - 1 AND p[least(j + 1, size(p) - 1)].h = x.h)), x -> x.i)))[0]"
    covered = f"aggregate({twice}, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + CAST(least(3, i - a.last) AS BIGINT), 'last', i), a -> a.n)"
    return F.expr(f"CASE WHEN size(array_distinct(_windows)) = size(_windows) THEN 0L ELSE {covered} END")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements of its texts, whole; a null text has no words.

    Windows are compared by their 64-bit hash within a text.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return (
        docs.withColumn("_text", text_of(text_col))
        .withColumn("_spaced", _without(F.col("_text"), BLANKS[1:], " "))
        .withColumn("_words", F.array_remove(F.split("_spaced", " "), ""))
        .withColumn("_lines", lines)
        .withColumn("_windows", F.expr("CASE WHEN size(_words) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"))
        .withColumns(
            {
                # Not deterministic for Catalyst: a filter on what follows isn't pushed below, where it would repeat all this.
                "_row": F.monotonically_increasing_id(),
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.char_length(_without(F.col("_spaced"), " ")).cast("long"),
                "n_symbols": _count_of(F.col("_text"), SYMBOLS),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": _repeat_words(),
                "n_exclaims": _count_of(F.col("_text"), "!"),
                "n_upper": (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"\p{Lu}", ""))).cast("long"),
            }
        )
        .drop("_text", "_spaced", "_words", "_lines", "_windows")
    )


def _with_failures(measured: DataFrame) -> DataFrame:
    """``measured`` with ``failures``, the bits of the rules that fail."""
    bits = None
    for rule in RULES:
        bit = F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(0)
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.withColumn("failures", F.when(F.col("_row") >= 0, bits.cast("long"))).drop("_row")


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, the measurements and ``failures``, the bits of the rules that it fails.

    Null and empty texts have no words and fail ``few_words``; an id may be null or repeated; other columns of ``docs``
    are not looked at, whatever their names. An empty table gives an empty ledger.
    """
    measured = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    return _with_failures(measured)


def judge(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """``entries`` of a ledger with ``kept``: whether none of the policy's rules fails."""
    return entries.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(entries: DataFrame) -> DataFrame:
    """For every policy and rule: documents in all, rejected, failing the rule, and rejected by this rule alone.

    Entries are first counted by ledger value, of which there are at most 2 to the number of rules.
    """
    spark = entries.sparkSession
    counts = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    cases = spark.createDataFrame([(p, r.name, mask_of(p), 1 << r.bit) for p in POLICIES for r in RULES if r.name in POLICIES[p]], "policy string, rule string, mask long, bit long")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    tally = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    return (
        cases.join(F.broadcast(counts), F.lit(True), "left")
        .groupBy("policy", "rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
            tally(hit != 0)("rejected"),
            tally(hit.bitwiseAND(F.col("bit")) != 0)("failing"),
            tally(hit == F.col("bit"))("only_by_this"),
        )
    )


def keep(docs: DataFrame, text_col: str = "text", policy: str = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` that the policy accepts by their ledger, with their own columns only; rows as in :func:`ledger`."""
    boxed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    entries = _with_failures(measure(boxed.withColumn("text", F.col("row").getField(text_col)), "text"))
    return judge(entries, policy).filter("kept").select("row.*")
