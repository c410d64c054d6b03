"""Vector code compression (13): product codes over integer parts, nearest entries found under segment-mean lower bounds.

Two vectors cut into blocks are at least as far apart as their block means and their residual norms say:
|x - y|^2 >= sum over blocks of width * (mean difference)^2 + (|x's residual| - |y's residual|)^2. The bound by one block
filters the entries for each part, finer blocks filter what is left, and survivors get exact integer distances. Bounds
carry a slack for rounding, so the nearest entry, the first of equals, always survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import spread_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are held within these bounds (65,536 before scaling), so that squared distances and their order fit
#: in 64 bits while entries times a part's width is 8,192 at most.
MOST = 1 << 24
#: Rows of a batch that are compared with a codebook at once.
ROWS = 4096


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, place]``, integers; ``dim`` is the size of the vectors that they fit."""

    entries: np.ndarray
    dim: int

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Bounds:
    """What the lower bounds need of a set of points: block sums and residual norms at each coarseness, coarse first."""

    def __init__(self, points: np.ndarray) -> None:
        width = points.shape[1]
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        blocks = 1
        while blocks < width:
            if width % blocks == 0:
                parts = points.reshape(len(points), blocks, -1).astype(np.float64)
                means = parts.mean(axis=2)
                residual = np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=(1, 2)))
                self.levels.append((width // blocks, means, residual))
            blocks *= 2


def nearest(points: np.ndarray, entries: np.ndarray, bounds: Bounds | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each point, the lower index of equals; all are integers."""
    n, m = len(points), len(entries)
    mine, theirs = Bounds(points).levels, (bounds or Bounds(entries)).levels
    if mine:
        width, means, residual = mine[0]
        low = width * (means - theirs[0][1][:, 0]) ** 2 + (residual[:, None] - theirs[0][2]) ** 2
        guess = entries[low.argmin(axis=1)]
        most = ((points - guess) ** 2).sum(axis=1)
        most = most + 1e-5 * (1.0 + most)
        rows, cols = np.nonzero(low <= most[:, None])
        for (width, means, residual), (_, their_means, their_residual) in zip(mine[1:], theirs[1:], strict=True):
            low = width * ((means[rows] - their_means[cols]) ** 2).sum(axis=1) + (residual[rows] - their_residual[cols]) ** 2
            left = low <= most[rows]
            rows, cols = rows[left], cols[left]
    else:
        rows, cols = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    order = ((points[rows] - entries[cols]) ** 2).sum(axis=1) * m + cols
    best = np.minimum.reduceat(order, np.searchsorted(rows, np.arange(n)))
    return best % m, best // m


def finite(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow column hold ``dim`` numbers, and floor(scale * x) of those rows within +-MOST."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dim)
    good = np.isfinite(values).all(axis=1)
    whole = np.clip(np.floor(values[good] * scale), -MOST, MOST).astype(np.int64)
    return fits[good], whole


def _assigned(whole: np.ndarray, books: Codebooks, bounds: list[Bounds]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column per part."""
    codes = np.zeros((len(whole), len(books.entries)), np.int64)
    errors = np.zeros_like(codes)
    cut = whole.reshape(len(whole), len(books.entries), books.entries.shape[2])
    for at in range(0, len(whole), ROWS):
        for part, entries in enumerate(books.entries):
            some = slice(at, at + ROWS)
            codes[some, part], errors[some, part] = nearest(cut[some, part], entries, bounds[part])
    return codes, errors


def _sums(vectors: DataFrame, books: Codebooks, scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By (part, entry): how many parts are nearest to it, and their componentwise sums; every task sends on one set of sums."""
    parts, m, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(e) for e in books.entries]
        total, count = np.zeros((parts * m, width), np.int64), np.zeros(parts * m, np.int64)
        for batch in batches:
            _, whole = _integers(batch.column(0), books.dim, scale)
            if len(whole):
                codes, _ = _assigned(whole, books, bounds)
                slot = (codes + np.arange(parts) * m).ravel()
                np.add.at(total, slot, whole.reshape(-1, width))
                count += np.bincount(slot, minlength=parts * m)
        used = np.flatnonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], ["slot", "n", "sums"])

    found = vectors.mapInArrow(run, "slot long, n long, sums array<long>")
    places = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    rows = found.groupBy("slot").agg(F.sum("n").alias("n"), *places).collect()  # parts x entries at most
    return {(r["slot"] // m, r["slot"] % m): (r["n"], list(r[2:])) for r in rows}


def fit(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``entries`` for each of ``parts`` equal parts: the vectors of the smallest ids (of an id that repeats, the
    smallest vector), then ``rounds`` of assigning all vectors and moving every used entry to the floor of its mean.

    Vectors that are null or hold anything but finite numbers are left out, as are sizes other than that of the smallest
    id's vector whose size is a multiple of ``parts``. None if there are no vectors; null ids are no seeds.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    seeds = rows.filter(F.col("id").isNotNull() & finite("v") & (F.size("v") > 0) & (F.size("v") % parts == 0))
    first = seeds.orderBy("id", "v").select(F.size("v").alias("dim")).first()
    if first is None:
        return None
    dim = first["dim"]
    fitting = seeds.filter(F.size("v") == dim)
    ids = [r["id"] for r in fitting.select("id").distinct().orderBy("id").limit(entries).collect()]
    start = fitting.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()  # ``entries`` rows
    whole = np.clip(np.floor(np.array([r["v"] for r in start], np.float64) * scale), -MOST, MOST).astype(np.int64)
    books = Codebooks(whole.reshape(len(whole), parts, -1).swapaxes(0, 1).copy(), dim)
    for _ in range(rounds):
        moved = books.entries.copy()
        for (part, entry), (n, sums) in _sums(rows.select("v"), books, scale).items():
            moved[part, entry] = np.array(sums) // n
        books = Codebooks(moved, dim)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, *keep): the entries' numbers in two hex digits for each part, and the sum of squared distances.

    Rows whose vector is null or not of finite numbers are dropped; vectors of another size have a null code and error.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("_v"), *[F.col(c).alias(f"_k{n}") for n, c in enumerate(keep)])
    digits = np.array([f"{k:02x}" for k in range(books.entries.shape[1])])
    kept = [f"_k{n}" for n in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(e) for e in books.entries]
        for batch in batches:
            at, whole = _integers(batch.column(1), books.dim, scale)
            codes, errors = _assigned(whole, books, bounds)
            code = np.full(batch.num_rows, None, object)
            code[at] = ["".join(row) for row in digits[codes]]
            error = np.zeros(batch.num_rows, np.int64)
            error[at] = errors.sum(axis=1)
            unfit = np.ones(batch.num_rows, bool)
            unfit[at] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array(error, mask=unfit), *batch.columns[2:]], ["vec_id", "code", "error", *kept])

    kinds = "".join(f", {name} {rows.schema[name].dataType.simpleString()}" for name in kept)
    coded = rows.filter(finite("_v")).mapInArrow(run, f"vec_id long, code string, error long{kinds}")
    return coded.select("vec_id", "code", "error", *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)])


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes by codebooks fitted on all vectors, a row per row kept.

    Null vectors and those with a null or non-finite component are dropped; larger components than MOST count as MOST.

    ``label_error`` is the error summed over equal labels, null labels together. Without any vector there are no rows. Ids
    that repeat are coded each for itself. Labels that very many rows share are sent to the rows and not met in one task.
    """
    books = fit(vectors, id_col, vector)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded, _ = stored(encode(vectors, books, id_col, vector, (label,)), "codes")
    told = coded.select("vec_id", "code", "error", F.col(label).isNull().alias("_none"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label"))
    sums = told.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return spread_join(told, sums, ["_none", "_label"], "_n", coded.count()).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
