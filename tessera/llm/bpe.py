"""BPE encoding and decoding (5): a segment tree over the ranks of adjacent pairs.

The leaf of a symbol holds the rank of its pair with the next symbol, and its place; the root is the least of all, so
it names the leftmost pair of lowest rank. A merge changes three leaves, each in logarithmic time, until no leaf holds a
rank. A word of n symbols takes O(n log n), however long it is. Chunks between white space are encoded once and then
looked up, and so are the words in them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, portions, text_of
from tessera.llm.wordcodec import Words, byte_letters, chunks, tokenizer_path

_NONE = 1 << 62
#: Bytes of each of a worker's two memos: what a task of 16 MB meets, so that its words are merged once.
CODER_BYTES = 80 << 20


class SegmentTree:
    """The least of ``leaves``, with point updates."""

    def __init__(self, leaves: list[int]) -> None:
        size = 1
        while size < len(leaves):
            size *= 2
        self.size = size
        tree = self.tree = [_NONE] * size + leaves + [_NONE] * (size - len(leaves))
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

    def least(self) -> int:
        return self.tree[1] if self.size > 1 else self.tree[-1]

    def put(self, at: int, value: int) -> None:
        tree = self.tree
        k = at + self.size
        tree[k] = value
        while k > 1:
            a, b = tree[k], tree[k ^ 1]
            k >>= 1
            value = a if a < b else b
            if tree[k] == value:
                return
            tree[k] = value


class Codec:
    """A BPE vocabulary with word ends, from a tokenizers file."""

    def __init__(self, path: str) -> None:
        self.words = Words(path)
        self.cut = self.words.cut
        model = self.words.spec.pop("model")
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = self.words.special
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.memo = Memo(CODER_BYTES)

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word."""
        data = word.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n = len(ids)
        rank = self.merges.get
        if n == 2:
            at = rank((ids[0], ids[1]))
            return tuple(ids) if at is None else (self.made[at],)
        if n > 1:
            leaves = [_NONE if (r := rank(pair)) is None else r * n + k for k, pair in enumerate(zip(ids, ids[1:], strict=False))]
            tree, after, before = SegmentTree(leaves), list(range(1, n + 1)), list(range(-1, n - 1))
            while (least := tree.least()) != _NONE:
                r, at = divmod(least, n)
                gone = after[at]
                ids[at], ids[gone] = self.made[r], -1
                end = after[at] = after[gone]
                if gone < n - 1:
                    tree.put(gone, _NONE)
                if end < n:
                    before[end] = at
                    r = rank((ids[at], ids[end]))
                    tree.put(at, _NONE if r is None else r * n + at)
                else:
                    tree.put(at, _NONE)
                if (left := before[at]) >= 0:
                    r = rank((ids[left], ids[at]))
                    tree.put(left, _NONE if r is None else r * n + left)
        return tuple(i for i in ids if i >= 0)

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a text without white space and special tokens."""
        out: list[int] = []
        for word in self.words.of(chunk):
            ids = self.memo.get(word)
            if ids is None:
                ids = self.word(word)
                self.memo.keep(word, ids, len(word) + 8 * len(ids))
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        parts = self.cut.split(text) if self.cut else [text]
        return [i for part in parts for i in ([self.special[part]] if part in self.special else chain.from_iterable(map(self.chunk, chunks(part))))]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings joined by spaces, as for a tokenizer file without a decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


class Batches:
    """Encodes many texts; a chunk's packed ids are remembered."""

    def __init__(self, path: str) -> None:
        self.codec = Codec(path)
        self.memo = Memo(CODER_BYTES)

    def ids(self, text: str) -> bytes:
        if self.codec.cut and self.codec.cut.search(text):
            return np.array(self.codec.encode(text), "<u4").tobytes()
        memo, out = self.memo, []
        for c in chunks(text):
            data = memo.get(c)
            if data is None:
                data = np.array(self.codec.chunk(c), "<u4").tobytes()
                memo.keep(c, data, len(c) + len(data))
            out.append(data)
        return b"".join(out)


def code(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers in binary, and what they decode to.

    Null texts count as empty; an empty text has no ids and decodes to the empty text. Ids may be null; a repeated row
    is coded as often as it comes; an empty table gives no rows; columns other than id and text aren't looked at.
    """
    path = path or tokenizer_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Batches(path)
        for batch in batches:
            for first, texts in portions(batch.column(1)):
                ids = [coder.ids(t) for t in texts]
                decoded = [coder.codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
