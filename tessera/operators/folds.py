"""Folds over the rows of a key in order: what a row does depends on all before it, so neither windows nor joins say it.

Rows are dealt by key, sorted, and streamed in Arrow batches through a Python object for each key that holds what the
fold needs of the past; a key of any number of rows takes time in proportion to them and the memory of one step.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions import patterns as P

#: Rows of results that are held before they are sent on.
HELD = 4096


class Step(Protocol):
    """A fold of one key."""

    def row(self, row: tuple) -> Iterator[tuple]:
        """What the next row lets be known."""

    def end(self) -> Iterator[tuple]:
        """What is left when the key has no more rows."""


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[], Step], schema: StructType) -> DataFrame:
    """What ``step`` makes of the rows of each key (the first columns of ``rows``), in order; its tuples are those of ``schema``,
    keys included. Null keys are a key."""
    width, names, types = len(keys), schema.names, to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out = None, None, []

        def given() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = row[:width]
                if now is None or mine != key:
                    if now:
                        out.extend(now.end())
                    key, now = mine, step()
                out.extend(now.row(row))
                if len(out) >= HELD:
                    yield given()
        if now:
            out.extend(now.end())
        if out:
            yield given()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


_WORDS = re.compile(r"[A-Za-z0-9]+")
_CLEANING = [(re.compile(p, re.ASCII if p.startswith("(?i)") else 0), instead) for p, instead in P.CLEANING]
_RISKY = re.compile(r"[<&]|GLYPH|home|skip|toggle|search|copyright", re.IGNORECASE)


def word_count(text: str) -> int:
    """Runs of ASCII letters and digits."""
    return len(_WORDS.findall(text))


def clean_content(text: str) -> str:
    """:func:`tessera.functions.text.clean_content` of one text."""
    for pattern, instead in _CLEANING:
        text = pattern.sub(instead, text)
    return text.strip()


class MergeTiny:
    """Chunks of a document, (doc_id, ord, chunk_type, text, h1, …): see :func:`tessera.operators.chunking.merge_tiny`.

    Texts that no cleaning pattern can touch are put together when they are done; others are cleaned at every merge.
    """

    def __init__(self, min_words: int, most: int, columns: list[str]) -> None:
        self.min_words, self.most = min_words, most
        self.kind, self.text, self.h1 = (columns.index(c) for c in ("chunk_type", "text", "h1"))
        self.last: list | None = None

    def row(self, row: tuple) -> Iterator[tuple]:
        text = row[self.text]
        words = word_count(text or "")
        if self.last is not None:
            small = not (self.words >= self.min_words and words >= self.min_words)
            plain = self.last[self.kind] != "table" and row[self.kind] != "table"
            if small and plain and self.words + words <= self.most and self.last[self.h1] == row[self.h1] and text is not None and self.parts is not None:
                self.last[self.kind] = "paragraph"
                if self.plain and self._is_plain(text):
                    self.parts.append(text)
                    self.words += words
                else:
                    whole = clean_content(" ".join(self.parts) + "\n\n" + text)
                    self.parts, self.words, self.plain = [whole], word_count(whole), self._is_plain(whole)
                return
            yield from self.end()
        self.last, self.words = list(row), words
        self.parts = None if text is None else [text]
        self.plain = text is not None and self._is_plain(text)

    @staticmethod
    def _is_plain(text: str) -> bool:
        return bool(text) and not _RISKY.search(text) and " ".join(text.split()) == text

    def end(self) -> Iterator[tuple]:
        if self.last is not None:
            self.last[self.text] = None if self.parts is None else " ".join(self.parts)
            yield tuple(self.last)
            self.last = None


class GroupRows:
    """Rows of a table, (doc_id, table_id, row, cells, section, words, base, …): see :func:`tessera.operators.tables.group_rows`;
    what else the table has is that of its last row."""

    def __init__(self, max_words: int) -> None:
        self.max_words, self.group, self.now, self.words = max_words, 0, [], 0

    def row(self, row: tuple) -> Iterator[tuple]:
        doc_id, table_id, number, cells, section, words, base, *self.others = row
        self.key = (doc_id, table_id)
        if self.now and (section or self.words + base + words > self.max_words):
            yield from self.end()
        self.now.append({"row": number, "cells": cells, "section": section, "words": words})
        self.words += words

    def end(self) -> Iterator[tuple]:
        if self.now:
            yield (*self.key, self.group, self.now, *self.others)
            self.group, self.now, self.words = self.group + 1, [], 0


class PackRows:
    """Rows of a key, (key, order, size): see :func:`tessera.operators.tables.pack_rows`."""

    def __init__(self, capacity: float) -> None:
        self.capacity, self.group, self.now = capacity, 0, None

    def row(self, row: tuple) -> Iterator[tuple]:
        key, place, size = row
        if self.now and self.now[3] + size <= self.capacity:
            self.now[2], self.now[3] = place, self.now[3] + size
            return
        yield from self.end()
        self.now = [key, place, place, size]

    def end(self) -> Iterator[tuple]:
        if self.now:
            key, first, last, total = self.now
            yield (key, self.group, first, last, total)
            self.group, self.now = self.group + 1, None
