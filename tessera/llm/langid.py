"""Language identification (4): cross-parsing entropy by suffix automata.

For each language a suffix automaton of labelled text recognises all its substrings. A text is parsed into the fewest
pieces that each occur in the labelled text, always taking the longest match; the language that needs the fewest
phrases, normalised by the length of its labelled text, wins. Whole texts are parsed, as lanes of LANE letters side by
side: each lane is first parsed from the root, and then again from the state in which the lane before it ended, until
the two parses meet, which they soon do; so the phrases are those of one parse from the first letter to the last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc_remainder, portions, text_of

#: Bounds of the training sample of a language: letters, and documents that they come from, whole up to that.
TRAIN_CHARS, TRAIN_DOCS = 40_000, 400
#: Leading bits of a hash that name its range.
RANGE_BITS = 20
#: Languages whose automata a worker holds at once; more are taken in turn.
LANGUAGES = 8
#: Letters of a lane, and lanes that are parsed side by side.
LANE, BESIDE = 1024, 2048
#: Letters of an automaton, the most frequent ones, whose moves are a dense table; moves by others are looked up by hash.
DENSE = 48
#: Bytes of texts that are parsed at a time.
PARSED = 2_000_000
UNDETERMINED = "und"


class _Normal(dict):
    """A translate table, filled as characters come up."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        value = self[code] = code if c.isalpha() else 32
        return value


_TABLE = _Normal()


def letters(text: str) -> str:
    """Lower case; whatever isn't a letter parts words, as one space."""
    return " ".join(text.lower().translate(_TABLE).split())


class Automaton:
    """The suffix automaton of a text; class 0 is every letter that it lacks.

    A move is the next state times two, plus one if the match couldn't go on and a new phrase began. The root is where
    a text begins and where an unknown letter leads: there every letter begins a phrase.
    """

    def __init__(self, text: str) -> None:
        self.alphabet = {x: k for k, (x, _) in enumerate(sorted(Counter(text).items(), key=lambda e: (-e[1], e[0])), 1)}
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in (self.alphabet[x] for x in text):
            now = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = now
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    clone = len(moves)
                    moves.append(dict(moves[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q] = link[now] = clone
            last = now
        self.classes = len(self.alphabet) + 1
        self.width = min(self.classes, DENSE + 1)
        self.fresh = np.ones(self.classes, np.int32)  # moves from the root
        for c, q in moves[0].items():
            self.fresh[c] = 2 * q + 1
        table, rare = np.tile(self.fresh[: self.width], (len(moves), 1)), []
        for state, row in enumerate(moves[1:], 1):
            for c, q in row.items():
                if c < self.width:
                    table[state, c] = 2 * q
                else:
                    rare.append((state * self.classes + c, 2 * q))
        self.table = table.ravel()
        found = np.array(sorted(rare), np.int64).reshape(-1, 2)
        self.keys, self.targets = found[:, 0], found[:, 1].astype(np.int32)

    def move(self, state: np.ndarray, letter: np.ndarray, any_rare: bool) -> np.ndarray:
        if not any_rare:
            return self.table[state * self.width + letter]
        out = self.table[state * self.width + np.where(letter < self.width, letter, 0)]
        at = np.flatnonzero(letter >= self.width)
        if len(at):
            out[at] = self.fresh[letter[at]]
            if len(self.keys):
                wanted = state[at].astype(np.int64) * self.classes + letter[at]
                place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[place] == wanted
                out[at[hit]] = self.targets[place[hit]]
        return out


class Parser:
    """Automata of some languages over one alphabet."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        alphabet = {c: k for k, c in enumerate(sorted(set("".join(samples.values()))), 1)}
        self.letters = np.zeros(0x110000, np.int32 if len(alphabet) > 32_000 else np.int16)
        for c, k in alphabet.items():
            self.letters[ord(c)] = k
        self.automata = [Automaton(samples[n]) for n in self.names]
        self.own = [np.zeros(len(alphabet) + 1, np.int32) for _ in self.names]  # each automaton's class of each letter
        for own, automaton in zip(self.own, self.automata, strict=True):
            for c, k in automaton.alphabet.items():
                own[alphabet[c]] = k

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each normalised text for each language."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        lanes = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t), LANE)]
        carried = np.zeros(len(self.names), np.int64)  # where the last lane of the lanes before ended
        for at in range(0, len(lanes), BESIDE):
            some = lanes[at : at + BESIDE]
            owner, begin = np.array(some, np.int64).T
            sizes = np.array([min(LANE, len(texts[k]) - b) for k, b in some])
            order = np.argsort(-sizes, kind="stable")  # lanes longer than a place come first there
            place = np.argsort(order)
            codes = np.zeros((int(sizes.max()), len(some)), self.letters.dtype)
            for column, lane in enumerate(order.tolist()):
                k, b = some[lane]
                codes[: sizes[lane], column] = self.letters[np.frombuffer(texts[k][b : b + LANE].encode("utf-32-le", "surrogatepass"), np.uint32)]
            before = np.where(begin[order] > 0, np.where(order > 0, place[np.maximum(order, 1) - 1], -2), -1)
            for j in range(len(self.names)):
                count, ends = self._parse(j, codes, sizes[order], before, int(carried[j]))
                np.add.at(out[:, j], owner[order], count)
                carried[j] = ends[place[len(some) - 1]]
        return out

    def _parse(self, j: int, codes: np.ndarray, sizes: np.ndarray, before: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and last states of lanes, longest first, a column each. ``before`` is the column of the lane that one
        goes on from, -1 for the first of a text, -2 for one that goes on from ``carried``."""
        automaton, letter = self.automata[j], self.own[j][codes]
        rare = (letter >= automaton.width).any(axis=1).tolist()
        path = np.zeros(codes.shape, np.int32)
        start = np.where(before == -2, carried, 0)
        state = start.astype(np.int32)
        for t, n in enumerate(np.searchsorted(-sizes, -np.arange(len(codes)), "left").tolist()):
            found = path[t, :n] = automaton.move(state[:n], letter[t, :n], rare[t])
            state = found >> 1
        last, columns = sizes - 1, np.arange(len(sizes))
        while True:
            ends = path[last, columns] >> 1
            true = np.where(before >= 0, ends[np.maximum(before, 0)], start)
            lanes = np.flatnonzero(true != start)
            if not len(lanes):
                return (path & 1).sum(axis=0), ends
            start = true
            state, t = true[lanes], 0
            while len(lanes):
                found = automaton.move(state, letter[t, lanes], rare[t])
                apart = (found >> 1) != (path[t, lanes] >> 1)
                path[t, lanes] = found
                t += 1
                apart &= sizes[lanes] > t
                lanes, state = lanes[apart], (found >> 1)[apart]


def parsers(samples: dict[str, str]) -> Iterator[Parser]:
    """All languages by name, in groups that are held at once."""
    names = sorted(samples)
    for at in range(0, len(names), LANGUAGES):
        yield Parser({name: samples[name] for name in names[at : at + LANGUAGES]})


def best(phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language with the fewest normalised phrases (ties: the first by name) and 1 - best / runner-up."""
    cost = phrases * np.log2(np.maximum(sizes, 2))[None, :]
    first = cost.argmin(axis=1)
    low = cost[np.arange(len(cost)), first]
    if cost.shape[1] > 1:
        second = np.partition(cost, 1, axis=1)[:, 1]
        score = np.clip(1 - low / np.maximum(second, 1e-12), 0.0, 1.0)
    else:
        score = np.ones(len(cost))
    return first, score


def held_out(doc_id: str = "doc_id"):
    return crc_remainder(doc_id, 3) == 1


def samples(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, str]:
    """Labelled text of every language, from documents that aren't held out: those of the lowest hashes, whole, until
    they have TRAIN_CHARS characters or are TRAIN_DOCS. Hashes are counted by range first, so that only the ranges that
    hold the lowest TRAIN_DOCS of a language are ordered; sent to all tasks is one range per language."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    cut = known.select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, 4 * TRAIN_CHARS).alias("text"))
    by_range = cut.groupBy("lang", F.shiftright("h", 64 - RANGE_BITS).alias("range")).count()
    reached = F.sum("count").over(Window.partitionBy("lang").orderBy("range")) - F.col("count")
    last = by_range.withColumn("reached", reached).filter(F.col("reached") < TRAIN_DOCS).groupBy("lang").agg(F.max("range").alias("last"))
    cut = cut.join(F.broadcast(last), "lang").filter(F.shiftright("h", 64 - RANGE_BITS) <= F.col("last"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    few = cut.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= TRAIN_DOCS)
    size = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")
    out: dict[str, list[str]] = {}
    for row in few.withColumn("before", size).filter(F.col("before") < TRAIN_CHARS).orderBy("lang", "n").collect():
        out.setdefault(row["lang"], []).append(letters(row["text"]))
    return {lang: " ".join(parts)[:TRAIN_CHARS] for lang, parts in out.items()}


def predict(docs: DataFrame, learned: dict[str, str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score). A text that is null or has no letter is ``und`` with score 0, and so is any text if
    no language was learned. Ids may be null; repeated rows come as often as they are; an empty table gives no rows;
    columns other than id and text aren't looked at."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of = [*sorted(learned), UNDETERMINED]
        sizes = np.array([len(learned[name]) for name in sorted(learned)])
        # One group stays for all batches; of more, each is built anew for a batch and then dropped.
        few = list(parsers(learned)) if len(learned) <= LANGUAGES else None
        for batch in batches:
            found, full, column = np.zeros((batch.num_rows, len(learned)), np.int64), np.zeros(batch.num_rows, bool), 0
            for parser in few or parsers(learned):
                for first, raw in portions(batch.column(1), PARSED):
                    texts = [letters(t) for t in raw]
                    found[first : first + len(texts), column : column + len(parser.names)] = parser.phrases(texts)
                    full[first : first + len(texts)] = [bool(t) for t in texts]
                column += len(parser.names)
            name, scores = np.full(batch.num_rows, len(learned)), np.zeros(batch.num_rows)
            if full.any():
                name[full], scores[full] = best(found[full], sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names_of[k] for k in name.tolist()], pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Learn on the labelled documents that aren't held out and predict all: (doc_id, held_out, lang_pred, score); rows
    as in :func:`predict`."""
    found = predict(docs, samples(docs, text_col, lang_col, id_col), text_col, id_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
