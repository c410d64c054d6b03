"""LM scoring (9): a probabilistic suffix tree over words.

A context of one to ``depth`` words is a state of the tree if it occurs ``least`` times in training, whatever the
corpus, and its next-word distribution diverges from its parent's (Kullback-Leibler, over a threshold). Distributions
are smoothed towards the parent's; the root is the base distribution over all words. Every word is told apart after every
such context, however rare both are together. A text is scored in the longest suffix state at every word.

Texts are read once, into chunks of some million tokens: arrays of places in the chunk's own vocabulary. All that
crosses the corpus afterwards is counts by hash: order by order, a chunk asks for each of its different contexts with a
word once, in blocks of hashes in order; a block of all chunks' hashes is summed in a task, and the sums go back by chunk
in the order in which they were asked for, so that the chunk can place them without hashes. What no other chunk has,
or training hasn't, isn't asked for: with such a word or such a sequence in it, a longer one is the chunk's own too. One
chunk of those that have the same in training is told to own it: what it adds to the divergence of its context is summed
by context in whole billionths, so that the sum is the same in any order. So nothing that grows with the corpus is held by
the driver or sent to all, and a frequent word is one number per chunk. There are more blocks for more chunks, so none
grows with the corpus. A chunk is walked in slices and its questions are found in parts. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, stored, text_of

#: Tokens of a chunk, about (a longer text is a chunk of its own), and those that are looked at in one go.
CHUNK_TOKENS, SLICE = 1_600_000, 250_000
#: Words of the longest contexts.
DEPTH = 2
#: Training occurrences from which contexts are told apart.
LEAST = 30
#: Occurrences from which a word after a context is counted there; words under it are left to the shorter context. 1: all are.
SEEN = 1
#: Parts, by hash of the context's last word, in which a chunk finds the words after its contexts.
PARTS = 4
#: Blocks of hashes of a part, for every so many chunks.
BLOCKS, BLOCK_CHUNKS = 32, 128
#: Shares of the chunks that meet their answers one after the other, so that only one share is in a shuffle at once.
SHARES = 2
#: Nats by which a state's distribution must diverge from its parent's.
DIVERGENCE = 0.02
#: Occurrences that the parent's distribution counts for in a state's.
SMOOTHING = 20.0
#: The base distribution's pseudo-count.
PSEUDO = 0.1
#: Parts of a nat in which divergences are summed.
UNITS = 1e9
END = 0x5EED_0F_7E87_E4D0

_CODEC = pa.Codec("zstd", compression_level=3)
_CHUNK = "chunk long, n_train long, doc_ids array<long>, lengths array<int>, train array<boolean>, tokens binary, vocab binary"
_COUNTED = _CHUNK + ", counts binary, n_new long, grams array<binary>"
_GRAMS = pa.list_(pa.binary())
_ASKED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("sums", _GRAMS)])
_ASKED_COLUMNS, _ANSWERED = "part int, block int, chunk long, keys binary, sums array<binary>", "chunk long, part int, block int, found binary, flags binary"
#: Names of words are hashes from this on; under it they are numbers that a chunk gives to rare words that no other chunk has.
OWN_NAMES = np.uint64(1 << 32)
#: Flags of an answer: no longer sequence with it is asked for, the chunk owns it.
ALONE, OWNS = 1, 2
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _packed(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, its size before them; the numbers' first bytes come first, then their second ones."""
    data = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(_CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _mix(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """A 64-bit hash of an ordered pair."""
    x = (a ^ np.uint64(kind)) * _M1 + b
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def _chunks(docs: DataFrame, text_col: str, id_col: str, divisor: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths, train = [], []
        parts: list[np.ndarray] = []
        vocab: dict[bytes, int] = {b" ": 0}  # no word is a blank: the end
        size = 0

        def out() -> pa.RecordBatch:
            hashes = np.array([END if w == b" " else xxhash.xxh64_intdigest(w) for w in vocab], np.uint64) | OWN_NAMES
            tokens = np.concatenate(parts)
            n = int(np.array(lengths)[np.array(train, bool)].sum())
            columns = [[part << 32 | made], [n], [ids], [lengths], [train], [_packed(tokens)], [_packed(hashes)]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "n_train", "doc_ids", "lengths", "train", "tokens", "vocab"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().encode().lower().split()
                words.append(b" ")
                place = vocab.setdefault
                parts.append(np.array([place(w, len(vocab)) for w in words], np.int32))
                ids.append(doc_id)
                lengths.append(len(words))
                train.append(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor != 0)
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield out()
                    made += 1
                    ids, lengths, train, parts, vocab, size = [], [], [], [], {b" ": 0}, 0
        if ids:
            yield out()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return picked.mapInArrow(run, _CHUNK)


class Chunk:
    """A chunk's arrays, from a row of the chunk table as Arrow; ``counts`` are the training occurrences of its words, and
    ``grams[k]`` those of the k + 2 words that end at each place, zero where they aren't told apart; ``alone[k]`` says which
    of those have no longer sequences to ask for, and ``owned[k]`` is one place of each that the chunk owns."""

    def __init__(self, row: dict, least: int) -> None:
        self.chunk, self.doc_ids, self.least = row["chunk"], row["doc_ids"], least
        self.lengths = np.array(row["lengths"], np.int64)
        self.train = np.array(row["train"], bool)
        self.tokens, self.vocab = _unpacked(row["tokens"], np.int32), _unpacked(row["vocab"], np.uint64)
        self.counts = _unpacked(row["counts"], np.int64) if row.get("counts") is not None else None
        packed = [_unpacked(x, np.int64) for x in row.get("grams") or ()]
        self.grams, self.alone = [x >> 2 for x in packed], [(x & ALONE).astype(bool) for x in packed]
        self.owned = [np.flatnonzero(x & OWNS) for x in packed]
        self.owner = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def count(self, order: int, at: np.ndarray) -> np.ndarray:
        """The training occurrences of the ``order`` words that end at these places."""
        return self.counts[self.tokens[at]] if order == 1 else self.grams[order - 2][at]

    def closed(self, order: int, at: np.ndarray) -> np.ndarray:
        """Whether the ``order`` words that end at these places are in no other chunk, or not in training."""
        if order > 1:
            return self.alone[order - 2][at]
        words = self.tokens[at]
        return (self.vocab[words] < OWN_NAMES) | (self.counts[words] == 0)

    def hashes(self, order: int, at: np.ndarray) -> np.ndarray:
        """A hash of the ``order`` words that end at these places."""
        out = self.vocab[self.tokens[at - order + 1]]
        for k in range(1, order):
            out = _mix(out, self.vocab[self.tokens[at - order + 1 + k]], k)
        return out

    def contexts(self, order: int, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slice by slice, the places that have a candidate context of this order, its hash and training occurrences;
        ``only``: those that follow one of these words."""
        told = self.counts >= self.least
        if only is not None:
            told &= only
        for low in range(order, len(self.tokens), SLICE):
            at = np.arange(low, min(low + SLICE, len(self.tokens)))
            before = self.tokens[low - 1 : at[-1]]
            ok = self.owner[at] == self.owner[low - 1 : at[-1]]
            ok &= told[before]
            at = at[ok]
            total = self.count(order, at - 1)
            if order > 1:
                ok = total >= self.least
                at, total = at[ok], total[ok]
            yield at, self.hashes(order, at - 1), total

    def named(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The different candidate contexts of this order by hash, in order, and their training occurrences."""
        some = [np.unique(context, return_index=True) + (total,) for _, context, total in self.contexts(order)]
        contexts, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, _, _ in some)]), return_index=True)
        return contexts, np.concatenate([np.zeros(0, np.int64), *(total[k] for _, k, total in some)])[first]

    def questions(self, order: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places whose context is in this part; of their different contexts with a word: the hashes in order, the first
        place of each, which each place has, the chunk's own training occurrences, and which are asked for."""
        places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, context, _ in self.contexts(order, self.vocab % np.uint64(PARTS) == part):
            places.append(at)
            keys.append(_mix(context, self.vocab[self.tokens[at]], order))
        at = np.concatenate(places)
        keys, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=self.train[self.owner[at]], minlength=len(keys)).astype(np.int64)
        return at, keys, first, which, n, ~self.closed(order, at[first])


def _rows(batch: pa.RecordBatch | pa.Table, least: int = LEAST) -> Iterator[Chunk]:
    for k in range(batch.num_rows):
        yield Chunk(batch.slice(k, 1).to_pylist()[0], least)


def _blocks(part: int, chunk: int, keys: np.ndarray, sums: list[np.ndarray], blocks: int) -> pa.RecordBatch:
    """Hashes in order with what the chunk has of each, a row for each block of them."""
    edges = np.arange(1, blocks, dtype=np.uint64) * np.uint64((1 << 64) // blocks)
    cuts = pairwise([0, *np.searchsorted(keys, edges).tolist(), len(keys)])
    rows = [(part, b, chunk, _packed(np.diff(keys[i:j], prepend=np.uint64(0))), [_packed(x[i:j]) for x in sums]) for b, (i, j) in enumerate(cuts) if i < j]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_ASKED.types)], schema=_ASKED)


def _answered(step: Callable[[int, np.ndarray, list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[pa.Table], pa.Table]:
    """A function of all chunks' rows of a block: a row of answers for each. ``step`` gets the part, which of the different
    hashes each row has (in order, chunks of a hash in order too), the sums and whether a hash's first row is there, all in
    that order, and gives found and flags in it."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = [np.cumsum(_unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        ends = np.cumsum([0, *map(len, keys)])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.concatenate([[True], keys[1:] != keys[:-1]])
        sums = [np.concatenate([_unpacked(r["sums"][k], np.int64) for r in rows])[order] for k in range(len(rows[0]["sums"]))]
        out = []
        for x in step(rows[0]["part"], np.cumsum(starts) - 1, sums, starts):
            back = np.empty_like(x)
            back[order] = x
            out.append(pa.array([_packed(back[i:j]) for i, j in pairwise(ends.tolist())], pa.binary()))
        names = ("chunk", "part", "block")
        kinds = (pa.int64(), pa.int32(), pa.int32())
        return pa.Table.from_arrays([*(pa.array([r[x] for r in rows], t) for x, t in zip(names, kinds, strict=True)), *out], [*names, "found", "flags"])

    return run


def _answer(answers: list[dict], part: int, column: str, kind) -> np.ndarray:
    """The answers to what a chunk asked in a part, in its order."""
    mine = sorted((r for r in answers if r["part"] == part), key=lambda r: r["block"])
    return np.concatenate([np.zeros(0, kind), *(_unpacked(r[column], kind) for r in mine)])


def _counted(_: int, group: np.ndarray, sums: list[np.ndarray], __: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training occurrences over all chunks; the first chunk that has any owns it."""
    (n,) = sums
    total = np.bincount(group, weights=n).astype(np.int64)
    some = np.flatnonzero(n)
    flags = np.zeros(len(group), np.uint8)
    flags[some[np.unique(group[some], return_index=True)[1]]] = OWNS
    flags[(np.bincount(group) == 1)[group]] |= ALONE
    return total[group], flags


def _word_requests(blocks: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in _rows(batch):
            order = np.argsort(c.vocab)
            yield _blocks(0, c.chunk, c.vocab[order], [np.bincount(c.tokens[c.train[c.owner]], minlength=len(c.vocab))[order].astype(np.int64)], blocks)


def _with_counts(least: int):
    """A function of a chunk and the counts of its words: the chunk with them. Rare words that no other chunk has need a name
    in their chunk only."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        (c,) = _rows(chunk, least)
        order, rows = np.argsort(c.vocab), answers.to_pylist()
        counts, flags = np.empty(len(order), np.int64), np.empty(len(order), np.uint8)
        counts[order], flags[order] = _answer(rows, 0, "found", np.int64), _answer(rows, 0, "flags", np.uint8)
        own = (flags & ALONE > 0) & (counts < least)
        vocab = np.where(own, np.arange(len(order), dtype=np.uint64), c.vocab)
        out = chunk.set_column(chunk.schema.get_field_index("vocab"), "vocab", pa.array([_packed(vocab)], pa.binary()))
        out = out.append_column("counts", pa.array([_packed(counts)], pa.binary())).append_column("n_new", pa.array([int(np.count_nonzero(flags & OWNS))]))
        return out.append_column("grams", pa.array([[]], _GRAMS))

    return run


def _questions(order: int, least: int, blocks: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the different contexts and words of a chunk that it asks for: the training count there."""
    for batch in batches:
        for c in _rows(batch, least):
            for part in range(PARTS):
                _, keys, _, _, n, asked = c.questions(order, part)
                yield _blocks(part, c.chunk, keys[asked], [n[asked]], blocks)


def _adding(order: int, least: int, seen: int):
    """A function of a chunk and the answers to it: the chunk with the counts of order + 1 words."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        (c,) = _rows(chunk, least)
        rows = answers.to_pylist()
        grams = np.zeros(len(c.tokens), np.int64)
        for part in range(PARTS):
            at, keys, first, which, found, asked = c.questions(order, part)
            flags = np.where(found > 0, OWNS | ALONE, ALONE).astype(np.uint8)
            found[asked], flags[asked] = _answer(rows, part, "found", np.int64), _answer(rows, part, "flags", np.uint8)
            found[found < seen] = 0
            flags[found == 0] = ALONE
            grams[at] = (found << 2 | (flags & ALONE))[which]
            grams[at[first]] |= flags & OWNS
        place = chunk.schema.get_field_index("grams")
        return chunk.set_column(place, "grams", pa.array([[*chunk["grams"][0].as_py(), _packed(grams)]], _GRAMS))

    return run


def _tests(order: int, least: int, blocks: int, n: int, v: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' contexts of this order: what the words that a chunk owns add to the test of each (mass, kl, back), and the
    context's occurrences."""
    for batch in batches:
        for c in _rows(batch, least):
            contexts, totals = c.named(order)
            mass, kl, back = (np.zeros(len(contexts)) for _ in range(3))
            owned = c.owned[order - 1]
            for low in range(0, len(owned), SLICE):
                where = owned[low : low + SLICE]
                count = c.count(order + 1, where)
                parent, share = c.count(order, where) / PSEUDO, count / c.count(order, where - 1)
                # The parent's weight of the word, in pseudo-counts; above the root it is relative to the words of the context.
                weight = parent + 1 if order == 1 else np.maximum(parent, 1)
                against = share * (n / PSEUDO + v + 1) if order == 1 else count / PSEUDO
                inside = np.searchsorted(contexts, c.hashes(order, where - 1))
                mass += np.bincount(inside, weights=count, minlength=len(contexts))
                kl += np.bincount(inside, weights=np.rint(UNITS * share * np.log(against / weight)), minlength=len(contexts))
                back += np.bincount(inside, weights=np.rint(weight), minlength=len(contexts))
            yield _blocks(order, c.chunk, contexts, [*(x.astype(np.int64) for x in (mass, kl, back)), totals], blocks)


def _tested(n: int, v: int, order: int, group: np.ndarray, sums: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences of the words told apart in a context, over all chunks, if it passes the divergence test; else zero."""
    mass, kl, back = (np.bincount(group, weights=x) for x in sums[:3])
    total, some = sums[3][starts], mass > 0
    share = mass / total
    rest, left = np.maximum(1 - share, 0), np.maximum(1 - back / (n / PSEUDO + v + 1), 1e-12)
    others = np.zeros(len(mass))
    # At the root the other words are one more event; above it the parent's shares are relative to the words told apart.
    if order > 1:
        others[some] = share[some] * np.log(back[some] * PSEUDO / mass[some])
    else:
        more = some & (rest > 0)
        others[more] = rest[more] * np.log(rest[more] / left[more])
    passed = some & (kl / UNITS + others >= DIVERGENCE)
    return np.where(passed, mass, 0).astype(np.int64)[group], passed[group].astype(np.uint8)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_chunk(depth: int, least: int, n: int, v: int, chunk: pa.Table, known: pa.Table) -> pa.Table:
    (c,) = _rows(chunk, least)
    rows = known.to_pylist()
    base = (c.counts + PSEUDO) / (n + PSEUDO * (v + 1))
    docs, p = len(c.lengths), base[c.tokens]
    held_by = np.bincount(c.owner, weights=c.counts[c.tokens] > 0, minlength=docs).astype(np.int64)
    root = np.bincount(c.owner, weights=np.log10(base)[c.tokens], minlength=docs)
    for order in range(1, depth + 1):
        names, mass = c.named(order)[0], _answer(rows, order, "found", np.int64)
        names, mass = names[mass > 0], mass[mass > 0]
        for at, context, total in c.contexts(order):
            found, held = _lookup(names, mass, context)
            at, total, held = at[found], total[found], held[found]
            p[at] = (c.count(order + 1, at) + (SMOOTHING + total - held) * p[at]) / (total + SMOOTHING)
    scores = np.bincount(c.owner, weights=np.log10(p), minlength=docs)
    columns = [pa.array(c.doc_ids, pa.int64()), pa.array(~c.train), pa.array(c.lengths), pa.array(held_by), pa.array(np.full(docs, n)), pa.array(root), pa.array(scores)]
    return pa.Table.from_arrays(columns, [f.split()[0] for f in _SCORES.split(", ")])


def _lookup(names: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the ordered ``names``, and their values, zero for those that aren't."""
    if not len(names):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), values.dtype)
    place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    hit = names[place] == wanted
    return hit, np.where(hit, values[place], 0)


def _asked(chunks: DataFrame, ask, step) -> tuple[DataFrame, str]:
    """The answers to what ``ask`` makes of the chunks, and their path."""
    rows = chunks.mapInArrow(ask, _ASKED_COLUMNS)
    return stored(rows.groupBy("part", "block").applyInArrow(_answered(step), _ANSWERED), "answers")


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", divisor: int = 10, depth: int = DEPTH, least: int = LEAST, seen: int = SEEN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``.

    Documents whose crc32 of the id as text is divisible by ``divisor`` are held out of training. A null id counts as
    the empty text there; a null text is empty and has the end as its only token. Repeated rows count and come as often
    as they are; an empty table gives no rows; columns other than id and text aren't looked at. Without any training
    tokens the base probability of every token is one.

    ``least`` says what a state is and ``seen`` from how many occurrences a word counts after a context (1: every one does);
    what isn't counted has the probability of the shorter context.
    """
    spark = docs.sparkSession
    plain, first = stored(_chunks(docs, text_col, id_col, divisor), "chunks")
    blocks = BLOCKS * max(1, -(-plain.count() // BLOCK_CHUNKS))

    def merged(chunks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)

    def added(chunks: DataFrame, answers: DataFrame, run, name: str) -> tuple[DataFrame, list[str]]:
        mine = [F.pmod(F.xxhash64("chunk"), F.lit(SHARES)) == k for k in range(SHARES)]
        done = [stored(merged(chunks.filter(share), answers.filter(share), run, _COUNTED), name) for share in mine]
        return reduce(DataFrame.unionAll, (rows for rows, _ in done)), [path for _, path in done]

    answers, gone = _asked(plain, partial(_word_requests, blocks), _counted)
    chunks, paths = added(plain, answers, _with_counts(least), "counted")
    n, v = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_new"), F.lit(0))).first()
    for x in (first, gone):
        forget(spark, x)
    known = []
    for order in range(1, depth + 1):
        answers, gone = _asked(chunks, partial(_questions, order, least, blocks), _counted)
        chunks, after = added(chunks, answers, _adding(order, least, seen), "grams")
        for x in (*paths, gone):
            forget(spark, x)
        paths = after
        known.append(_asked(chunks, partial(_tests, order, least, blocks, n, v), partial(_tested, n, v))[0])
    return merged(chunks, reduce(DataFrame.unionAll, known), lambda c, r: _score_chunk(depth, least, n, v, c, r), _SCORES)
