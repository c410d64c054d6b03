"""Text functions as Columns: cleaning, counting, classification of lines, and metadata found by patterns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import patterns as P


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once for all its uses: lists are sorted and filtered by expressions that are
    evaluated as they stand, where a value in many places would be worked out in each of them."""
    return F.get(F.transform(F.array(value), lambda x: of(x)), F.lit(0))


def any_match(text: Column | str, found: list[str]) -> Column:
    """Whether any of the patterns occurs, tried in one go."""
    return _col(text).rlike("|".join(f"(?:{p})" for p in found))


def contains_any(text: Column | str, words: list[str]) -> Column:
    """Whether any of the words occurs, as a substring."""
    return reduce(lambda a, b: a | b, [_col(text).contains(w) for w in words])


def any_word_match(low: Column, found: list[str]) -> Column:
    """Whether any of the patterns occurs in lower-cased text; those are tried only where a word that they need is there,
    as looking for words is many times faster than matching."""
    words = [P.needed(p) for p in found]
    tried = any_match(low, found)
    return contains_any(low, sorted({w for some in words for w in some})) & tried if all(words) else tried


def word_matches(low: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern in lower-cased text, tried only where a word that it needs is there."""
    words, tried = P.needed(pattern), F.regexp_extract_all(low, F.lit(pattern), group)
    return F.when(~contains_any(low, words), F.array().cast("array<string>")).otherwise(tried) if words else tried


def all_matches(text: Column | str, found: list[str], group: int = 0) -> Column:
    """Distinct matches of the patterns, those of the first pattern first."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(_col(text), F.lit(p), group) for p in found]))


def word_count(text: Column | str) -> Column:
    """Runs of ASCII letters and digits."""
    return F.regexp_count(_col(text), F.lit("[A-Za-z0-9]+"))


#: White space as the reference's language knows it, wider than Java's: Unicode's and four separators.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _wide(pattern: str) -> str:
    """A pattern whose white space is all of SPACES; in Java a class may stand within a class."""
    return pattern.replace(r"\s", _SPACE)


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at both ends, in one pass from each end."""
    return F.btrim(_col(text), F.lit(SPACES))


def clean_content(text: Column | str) -> Column:
    """Without extraction artefacts, tags and navigation, white space collapsed, trimmed; null becomes empty."""
    out = F.coalesce(_col(text), F.lit(""))
    for pattern, instead in P.CLEANING:
        out = F.regexp_replace(out, _wide(pattern) if pattern == r"\s+" else pattern, instead)
    return stripped(out)


#: White space that cleaning would change: any but single spaces between other characters.
_LOOSE = _SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f") + r"|^\x20|\x20\x20|\x20\z"


def cleaned_again(text: Column | str) -> Column:
    """:func:`clean_content` of a column that is mostly clean: its patterns are only tried on texts that one of them might change."""
    t = _col(text)
    return F.when(t.isNull() | t.rlike(f"{P.RISKY}|{_LOOSE}"), clean_content(t)).otherwise(t)


def is_meaningful(text: Column | str, min_words: int = 3) -> Column:
    """Enough words once cleaned, and not only noise."""
    return bound(cleaned_again(text), lambda cleaned: (word_count(cleaned) >= min_words) & ~any_match(cleaned, P.NOISE))


def is_ui_noise(text: Column | str) -> Column:
    """Under ten characters, a word of an interface, or one short word."""
    t = _col(text)
    return (F.length(t) < 10) | F.lower(stripped(t)).isin(P.UI_WORDS) | (~t.contains(" ") & (F.length(t) < 20))


def is_short_key_value(text: Column | str) -> Column:
    """A looser key-value test, of ten words at most."""
    t = stripped(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (words > 0) & (words <= 10) & any_match(t, P.SHORT_KEY_VALUE)


def clean_artefacts(text: Column | str) -> Column:
    """Text of HTML without entities, extraction artefacts and navigation; null becomes empty."""
    out = F.coalesce(_col(text), F.lit(""))
    for pattern, instead in P.HTML_ARTEFACTS:
        out = F.regexp_replace(out, _wide(pattern), instead)
    return stripped(out)


def for_embedding(text: Column | str, most: int = 2000) -> Column:
    """Text cut to ``most`` characters after its last whole sentence there; without one, just cut."""
    t = clean_content(text)
    head = F.substring(t, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(t) <= most, t).when(whole != "", whole).otherwise(head)


def lines(text: Column | str) -> Column:
    """Lines as an array; a last empty line doesn't count."""
    t = F.regexp_replace(_col(text), "\x1c|\x1d|\x1e", "\n")
    return F.split(F.regexp_replace(t, r"\R\z", ""), r"\R")


def is_heading(line: Column | str, max_level: int = 3) -> Column:
    return _col(line).rlike(_wide(rf"^#{{1,{max_level}}}\s+"))


def heading_level(line: Column | str, max_level: int = 3) -> Column:
    return F.length(F.regexp_extract(_col(line), _wide(rf"^(#{{1,{max_level}}})\s+"), 1))


def heading_text(line: Column | str, max_level: int = 3) -> Column:
    return stripped(F.regexp_extract(_col(line), _wide(rf"^#{{1,{max_level}}}\s+(.+)"), 1))


def is_key_value(line: Column | str) -> Column:
    return any_match(stripped(line), P.KEY_VALUE)


def is_table_line(line: Column | str) -> Column:
    t = stripped(line)
    return t.contains("|") & (t != "|") & ~t.startswith("#")


def line_kind(line: Column | str, max_level: int = 3) -> Column:
    """heading, skip (table lines, lines without words), kv, blank or text, by the first that fits."""
    t = stripped(line)
    return (
        F.when(is_heading(line, max_level), "heading").when(is_table_line(line), "skip").when(is_key_value(line), "kv").when(t == "", "blank")
        .when((word_count(line) >= 1) & (F.length(t) > 1), "text").otherwise("skip")
    )


def is_numeric(text: Column | str) -> Column:
    """Whether a number is left once money, per cent and grouping signs are gone."""
    t = F.btrim(F.translate(_col(text), "$,%()", ""))
    return t.rlike(r"(?i)^[+-]?(nan|inf(inity)?|(\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?)$")


def dates(text: Column | str) -> Column:
    return F.array_sort(all_matches(text, P.DATES))


def doc_refs(text: Column | str) -> Column:
    return all_matches(text, P.DOC_REFS)


def entities(text: Column | str, vocabulary: list[str] | None = None) -> Column:
    """Capitalised words that a pattern names and no stop word or participle, then vocabulary terms that occur."""
    found = all_matches(text, P.FAST_ENTITIES, 1)
    kept = F.filter(found, lambda x: (F.length(x) > 3) & x.rlike("^[A-Z]") & ~F.lower(x).isin(P.NOT_ENTITIES) & ~F.lower(x).endswith("ing") & ~F.lower(x).endswith("ed"))
    return F.array_union(kept, terms_in(text, vocabulary)) if vocabulary else kept


def terms_in(text: Column | str, terms: list[str]) -> Column:
    """Those of the terms that occur, case ignored, word bounds or not."""
    low = F.lower(_col(text))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lower(F.lit(t))), F.lit(t)) for t in terms]))


def policy_tags(text: Column | str) -> Column:
    tags = lambda low: F.array_compact(F.array(*[F.when(any_word_match(low, found), tag) for tag, found in P.POLICY_TAGS.items()]))
    return bound(F.lower(_col(text)), tags)


def is_change_note(text: Column | str) -> Column:
    return _col(text).rlike(P.CHANGE_NOTE)


def units(text: Column | str) -> Column:
    return all_matches(text, P.UNITS)


def periods(text: Column | str) -> Column:
    return all_matches(text, P.PERIODS)


def tickets_and_versions(text: Column | str) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(_col(text), F.lit(P.TICKET), 1), all_matches(text, P.VERSIONS, 1)))


def stable_doc_id(name: Column | str) -> Column:
    """Lower case, extensions of text formats dropped, anything but letters, digits, _ and - as one _."""
    t = F.regexp_replace(_col(name), r"\.md|\.json", "")
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(t, r"[^a-zA-Z0-9_-]", "_")), "_+", "_"), "^_|_$", "")


def folders(path: Column | str) -> Column:
    """The directories of a path after the first named input; all of them if there is none."""
    parts = F.filter(F.split(_col(path), "/"), lambda x: x != "")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_position(dirs, "input").cast("int")
    return F.when(at > 0, F.slice(dirs, at + 1, F.size(dirs))).otherwise(dirs)


def headings_path(*levels: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" > ", *[F.nullif(x, F.lit("")) for x in levels]), F.lit("")), F.lit("Document"))


def toc_label(label: Column | str) -> Column:
    return contains_any(F.lower(_col(label)), P.TOC_LABELS)


def toc_content(text: Column | str, headers: Column | None = None) -> Column:
    low = F.lower(_col(text))
    hits = reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in P.TOC_CONTENT])
    by_header = contains_any(F.lower(F.concat_ws(" ", headers)), P.TOC_HEADERS) if headers is not None else F.lit(False)
    return (hits >= 2) | by_header


def section_level(section: Column | str) -> Column:
    s = _col(section)
    dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    return F.when(dots > 0, dots + 1).when(s.rlike(r"(?i)^(Item|Section|Chapter|Part)\s+\d+[A-Z]$"), 2).otherwise(1)


def toc_line(line: Column | str) -> Column:
    """struct(section, title, page, level) of a line of a table of contents; null if it is none."""
    t = F.btrim(_col(line))
    out = F.when((t == "") | t.startswith("#"), F.lit(None))
    for pattern, numbered in P.TOC_LINES:
        groups = [F.btrim(F.regexp_extract(t, pattern, k)) for k in (1, 2, 3 if numbered else 2)]
        section, title, page = (groups[0], groups[1], groups[2]) if numbered else (F.lit(""), groups[0], groups[1])
        level = section_level(section) if numbered else F.lit(1)
        out = out.when(t.rlike(pattern), F.struct(section.alias("section"), title.alias("title"), page.try_cast("int").alias("page"), level.cast("int").alias("level")))
    return out
