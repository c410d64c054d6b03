"""Models as providers of Arrow batches: set up once in a worker, fed in batches of a size that the model likes.

A provider is an object that is sent to the workers and whose ``load`` gives the function to call there: texts to vectors,
or (query, text) pairs to scores. What it loads is kept for the life of the worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from tessera.functions import vector as V

#: Texts and pairs that a model is given at once, and tokens of a text that it reads.
EMBEDDED, SCORED, TOKENS = 4, 32, 512
_LOADED: dict[str, Any] = {}


class Provider(Protocol):
    """``key`` tells what is loaded; ``load`` makes the function that is fed with batches."""

    key: str

    def load(self) -> Callable[[list], Any]: ...


def loaded(provider: Provider) -> Callable[[list], Any]:
    """The provider's function, loaded once for each worker."""
    if provider.key not in _LOADED:
        _LOADED[provider.key] = provider.load()
    return _LOADED[provider.key]


@dataclass(frozen=True)
class Truncation:
    """Cuts texts after so many tokens of a public tokenizer, of which two are the model's own marks at both ends."""

    path: str
    tokens: int = TOKENS
    marks: int = 2

    @property
    def key(self) -> str:
        return f"truncation {self.path} {self.tokens} {self.marks}"

    def load(self) -> Callable[[list[str]], list[str]]:
        from tokenizers import Tokenizer

        tokenizer, most = Tokenizer.from_file(self.path), self.tokens - self.marks

        def cut(texts: list[str]) -> list[str]:
            out = []
            for text in texts:
                offsets = tokenizer.encode(text, add_special_tokens=False).offsets if text else []
                out.append(text if len(offsets) <= most else text[: offsets[most - 1][1]])
            return out

        return cut


@dataclass(frozen=True)
class HashEmbedder:
    """The offline embedder as a provider: a row of signed counts of hashed words for each text."""

    dim: int = V.DIM

    @property
    def key(self) -> str:
        return f"hash {self.dim}"

    def load(self) -> Callable[[list[str]], np.ndarray]:
        return lambda texts: np.stack([V.embed_text(t, self.dim) for t in texts])


@dataclass(frozen=True)
class OverlapScorer:
    """The offline reranker as a provider: the share of a query's distinct words that a text has."""

    key: str = "overlap"

    def load(self) -> Callable[[list[tuple[str, str]]], list[float]]:
        words = lambda text: set(V._WORDS.findall(text.lower()))

        def score(pairs: list[tuple[str, str]]) -> list[float]:
            return [len(words(q) & words(t)) / max(len(words(q)), 1) for q, t in pairs]

        return score


def _fed(df: DataFrame, columns: list[str], provider: Provider, size: int, truncation: Truncation | None, field: StructField, kind: pa.DataType) -> DataFrame:
    others = [f for f in df.schema.fields if f.name != field.name]
    names = [f.name for f in others]
    at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(provider)
        cut = loaded(truncation) if truncation else list
        for batch in batches:
            texts = [[t or "" for t in batch.column(k).to_pylist()] for k in at]
            texts[-1] = cut(texts[-1])
            items = texts[0] if len(at) == 1 else list(zip(*texts, strict=True))
            found = [row for k in range(0, len(items), size) for row in model(items[k : k + size])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tolist() if isinstance(r, np.ndarray) else r for r in found], kind)], [*names, field.name])

    return df.select(*[F.col(n) for n in names]).mapInArrow(run, StructType([*others, field]))


def embedded(df: DataFrame, provider: Provider, text: str = "text", name: str = "embedding", size: int = EMBEDDED, truncation: Truncation | None = None) -> DataFrame:
    """``df`` with the vectors of its texts, which the provider is given ``size`` at a time; null texts are empty."""
    return _fed(df, [text], provider, size, truncation, StructField(name, ArrayType(FloatType())), pa.list_(pa.float32()))


def scored(df: DataFrame, provider: Provider, query: str = "query", text: str = "text", name: str = "rerank_raw", size: int = SCORED, truncation: Truncation | None = None) -> DataFrame:
    """``df`` with a score for each (query, text), ``size`` pairs at a time; scores that aren't finite become null."""
    out = _fed(df, [query, text], provider, size, truncation, StructField(name, DoubleType()), pa.float64())
    good = F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))
    return out.withColumn(name, F.when(good, F.col(name)))
