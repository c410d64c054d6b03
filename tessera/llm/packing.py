"""Best-fit packing (3): a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens. A configuration is a multiset of lengths that fits a sequence;
the program asks for the fewest configurations that cover the histogram, and its dual for a price of each length such
that no configuration costs over one. It is solved by multiplicative weights: a length's weight falls by a constant
factor to the power of its coverage, a knapsack dynamic program over the prices finds the configurations worth most, and
each step uses a little of them. The average of the steps is a fractional solution, the prices of any step bound the
optimum from below, and the steps end when the two are close. Rounded down, it leaves a remainder that goes best-fit
decreasing, again on the histogram. Only where best fit alone makes fewer sequences is its plan taken, so a plan never has
more sequences than best fit's.

Only the histogram (``capacity`` numbers) reaches the driver, and only the plan, whose size doesn't depend on the rows,
goes back: a piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Memo, portions, stored, text_of
from tessera.llm.wordcodec import Words, byte_letters, chunks, tokenizer_path

CAPACITY, END = 2048, 0
#: The gap to the bound at which the program stops; the rates of its steps; how close to the best configuration others are
#: used, as a part of the rate; lengths that are priced in all steps together, the least steps of a rate, and the steps
#: after which a solution is looked at.
GAP, RATES, CLOSE, WORK, MIN_STEPS, CHECKED = 0.002, (0.3, 0.1, 0.03, 0.01), 0.1, 60_000, 20, 10
#: The share of the volume that rounding leaves to best fit.
TAIL = 0.08
#: Half the bytes of a worker's memo: it holds what a task of 16 MB meets, so that its words are encoded once.
ENCODER_BYTES = 80 << 20
#: Pieces of one length that are ranked in one task.
RANKED = 200_000


class Encoder:
    """Ids of the tokenizers library, as little-endian unsigned 32-bit integers in bytes.

    Its model encodes a word once; chunks and words that were seen lately are looked up in one memo.
    """

    def __init__(self, path: str, memo: int = ENCODER_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.words = Words(path)
        del self.words.spec
        self.letters = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.known = Memo(2 * memo)  # of words and chunks: a word is a chunk too, with the same ids

    def _word(self, word: str) -> bytes:
        data = self.known.get(word)
        if data is None:
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            data = b"".join([t.id.to_bytes(4, "little") for t in tokens])
            self.known.keep(word, data, len(word) + len(data))
        return data

    def _chunk(self, chunk: str) -> bytes:
        words = self.words.of(chunk)
        if words == [chunk]:
            return self._word(chunk)
        data = b"".join(map(self._word, words))
        self.known.keep(chunk, data, len(chunk) + len(data))
        return data

    def ids(self, text: str) -> bytes:
        if self.words.cut and self.words.cut.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, parts = self.known, chunks(text)
        out = list(map(known.get, parts))
        if None in out:
            for k, data in enumerate(out):
                if data is None:
                    data = known.get(parts[k])
                    out[k] = self._chunk(parts[k]) if data is None else data
        return b"".join(out)


_KEPT: dict[tuple[str, int], Encoder] = {}


def kept_encoder(path: str, memo: int) -> Encoder:
    """A worker's encoder: the tasks that it runs one after the other go on with what it has met."""
    if (path, memo) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, memo] = Encoder(path, memo)
    return _KEPT[path, memo]


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, memo: int = ENCODER_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and one END, cut at ``capacity``; null texts are empty."""
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    path = path or tokenizer_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(path, memo)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in portions(batch.column(1)):
                rows = []
                for k, data in enumerate(map(encoder.ids, texts), first):
                    data += end
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[at : at + 4 * capacity]
                        rows.append((ids[k], p, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every room up to ``capacity``: the most that lengths which fit it are worth, the length to take first (zero: none)
    and how many times. ``prices`` is indexed by length; those that aren't positive aren't for sale."""
    value = np.zeros(capacity + 1)
    took, times = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for x in np.flatnonzero(prices[: capacity + 1] > 0)[::-1].tolist():
        k = 1
        while k * x <= capacity:  # one, two, four, …: together any number of times
            now = value[: capacity + 1 - k * x] + k * prices[x]
            better = now > value[k * x :]
            np.copyto(value[k * x :], now, where=better)
            np.copyto(took[k * x :], x, where=better)
            np.copyto(times[k * x :], k, where=better)
            k *= 2
    return value, took, times


def columns(lengths: np.ndarray, took: np.ndarray, times: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """For each length the configuration worth most among those that hold it: ((length, times), ...), longest first."""
    room = capacity - lengths
    found: list[dict[int, int]] = [{int(x): 1} for x in lengths]
    while (took[room] > 0).any():
        for k in np.flatnonzero(took[room] > 0).tolist():
            x = int(took[room[k]])
            found[k][x] = found[k].get(x, 0) + int(times[room[k]])
        room = room - took[room] * times[room]
    return [tuple(sorted(c.items(), reverse=True)) for c in found]


def program(need: np.ndarray, capacity: int, gap: float = GAP, work: int = WORK) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """For ``need`` by length: a fractional solution, the times that each configuration is used, and a lower bound on the
    sequences of any packing: the best that the prices of any step gave, the volume's included.

    Multiplicative weights: a step prices each length by its weight, the knapsack finds the best configurations, those
    close to the best are used until some length is covered by the step's rate more, and weights fall by a constant factor
    to the power of what was covered. The average of the steps of a rate is a solution; rates fall, as a smaller one comes
    closer, and the weights go on from rate to rate. It ends within ``gap`` of the bound, or after ``work`` priced lengths.
    """
    lengths = np.flatnonzero(need)
    wanted = need[lengths].astype(np.float64)
    if not len(lengths):
        return {}, 0.0
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    bound = float((lengths * wanted).sum()) / capacity
    level = np.log(lengths / capacity)  # prices begin in proportion to length
    prices, found, least = np.zeros(capacity + 1), {}, np.inf
    each = max(MIN_STEPS, work // (len(lengths) * len(RATES)))
    for rate in RATES:
        used: dict[tuple[tuple[int, int], ...], float] = {}
        covered, total = np.zeros(len(lengths)), 0.0
        for step in range(each):
            prices[lengths] = np.exp(level - level.max())
            value, took, times = knapsack(prices, capacity)
            best = value[capacity]
            bound = max(bound, float((prices[lengths] * wanted).sum()) / best)
            near = np.flatnonzero(prices[lengths] + value[capacity - lengths] >= (1 - CLOSE * rate) * best)
            gain, share = np.zeros(len(lengths)), {}
            for k, column in zip(near.tolist(), columns(lengths[near], took, times, capacity), strict=True):
                amount = wanted[k] / dict(column)[int(lengths[k])]
                share[column] = share.get(column, 0.0) + amount
                for x, n in column:
                    gain[place[x]] += n * amount / wanted[place[x]]
            size = rate / gain.max()
            for column, amount in share.items():
                used[column] = used.get(column, 0.0) + amount * size
                total += amount * size
            covered += gain * size
            level = level - gain * size
            if covered.min() > 0 and total / covered.min() < least and step % CHECKED == 0 or step == each - 1:
                scale = covered.min() if covered.min() > 0 else float((lengths * wanted * covered).sum() / (lengths * wanted).sum())
                if not found or total / scale < least:
                    least, found = total / scale, {column: amount / scale for column, amount in used.items()}
            if least <= (1 + gap) * bound:
                return found, bound
    return found, bound


def rounded(used: dict[tuple[tuple[int, int], ...], float], need: np.ndarray, tail: float = TAIL) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The fractional solution with whole times, never over what is needed; ``need`` loses what they hold.

    Times are rounded down; then configurations are used once more, the fullest first and of these the ones that lost most,
    until only ``tail`` of the volume is left.
    """
    lengths = np.arange(len(need))
    least = tail * float((lengths * need).sum())
    times = dict.fromkeys(used, 0)

    def use(column: tuple[tuple[int, int], ...], most: int) -> None:
        n = min(most, min(int(need[x]) // k for x, k in column))
        if n > 0:
            times[column] += n
            for x, k in column:
                need[x] -= n * k

    for column, amount in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        use(column, int(amount + 1e-9))
    volume = float((lengths * need).sum())
    for column in sorted(used, key=lambda c: (-sum(x * k for x, k in c), int(used[c]) - used[c], c)):
        if volume <= least:
            break
        before = times[column]
        use(column, 1)
        volume -= (times[column] - before) * sum(x * k for x, k in column)
    return [(column, n) for column, n in times.items() if n]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, work: int = WORK) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(configuration as ((length, times), ...), number of sequences)] that hold exactly the histogram's pieces: the program's,
    rounded, and best-fit decreasing for what is left; best-fit decreasing for all only where that makes fewer sequences."""
    need = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        need[x] = n
    full = [(((capacity, 1),), int(need[capacity]))] if need[capacity] else []
    need[capacity] = 0
    lengths, left = np.flatnonzero(need), need.copy()
    plain = _best_fit(lengths, need[lengths], capacity)
    out = rounded(program(need, capacity, gap, work)[0], left)
    lengths = np.flatnonzero(left)
    out += _best_fit(lengths, left[lengths], capacity)
    return full + min(out, plain, key=lambda groups: sum(n for _, n in groups))


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: equal bins are one group, split as they get different contents."""
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(content: tuple[tuple[int, int], ...], count: int) -> None:
        if count:
            room.setdefault(capacity - sum(x * k for x, k in content), []).append((content, count))

    for x, n in zip(lengths[::-1].tolist(), left[::-1].tolist(), strict=True):
        for space in sorted(s for s in room if s >= x):
            while n and room.get(space):
                content, count = room[space].pop()
                fit = space // x
                used = min(count, n // fit)
                put(content + ((x, fit),), used)
                n -= used * fit
                count -= used
                if count and 0 < n < fit:
                    put(content + ((x, n),), 1)
                    n, count = 0, count - 1
                put(content, count)
            if not n:
                break
        fit = capacity // x
        put(((x, fit),), n // fit)
        if n % fit:
            put(((x, n % fit),), 1)
    return [group for groups in room.values() for group in groups]


def places(groups: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that go to one group, sorted by (length, first rank)."""
    rows, ranks, base = [], {}, 0
    for content, count in groups:
        offset = 0
        for x, k in content:
            first = ranks.get(x, 0)
            rows.append((x, first, base, k, offset))
            ranks[x] = first + k * count
            offset += x * k
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "times", "offset"), table.T, strict=True))


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, memo: int = ENCODER_BYTES) -> DataFrame:
    """Pieces of ``docs`` with ``sequence_id`` and ``offset``; every sequence is filled from 0 without gaps.

    Repeated rows are packed as often as they come; ids may be null; an empty table gives no pieces; columns other than
    id and text aren't looked at. Twice ``memo`` bytes bound what a worker's memo holds, and nothing else.
    """
    cut, _ = stored(pieces(docs, text_col, id_col, capacity, path, memo), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # a row for each length
    at = places(plan(histogram, capacity))
    salts = -(-max([*histogram.values(), 1]) // RANKED)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"]).select(*names, (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = at["length"] << 40 | at["first"]
        for batch in batches:
            x, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            k = np.searchsorted(keys, x << 40 | rank, "right") - 1
            inside, times = rank - at["first"][k], at["times"][k]
            place = [pa.array(at["base"][k] + inside // times), pa.array(at["offset"][k] + inside % times * x)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), *place], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
