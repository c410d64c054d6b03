"""Vocabularies of thousands of terms: one automaton for all of them, built once in each task and run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Characters of all terms up to which a vocabulary is sent to the tasks.
MOST = 64_000_000


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds all of the terms, by their places in the list, wherever they begin and end; of terms that are equal but for case,
    each place."""
    out = ahocorasick.Automaton()
    places: dict[str, list[int]] = {}
    for place, term in enumerate(terms):
        if term:
            places.setdefault(term.lower(), []).append(place)
    for term, found in places.items():
        out.add_word(term, (len(term), found))
    out.make_automaton()
    return out


def with_terms(df: DataFrame, terms: list[str], text: str = "text", name: str = "terms") -> DataFrame:
    """``df`` with those of the terms that its text holds, as :func:`tessera.functions.text.terms_in` finds them: case ignored,
    word bounds or not, in the vocabulary's order. Empty terms are nowhere; null texts hold none.

    The time for a text doesn't depend on the number of terms. Vocabularies of more than MOST characters are an error:
    :func:`tessera.operators.joins.substring_join` joins those.
    """
    if sum(map(len, terms)) > MOST:
        raise ValueError(f"a vocabulary may have {MOST} characters; join larger ones")
    sent = df.sparkSession.sparkContext.broadcast(list(terms))
    others = [f for f in df.schema.fields if f.name != name]
    at = [f.name for f in others].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        found = automaton(words) if any(words) else None
        for batch in batches:
            out = []
            for value in batch.column(at):
                low = (value.as_py() or "").lower()
                hits = sorted({p for _, (_, places) in found.iter(low) for p in places}) if found and low else []
                out.append([words[p] for p in hits])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*(f.name for f in others), name])

    schema = StructType([*others, StructField(name, ArrayType(StringType()))])
    return df.select(*[F.col(f.name) for f in others]).mapInArrow(run, schema)
