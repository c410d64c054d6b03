"""Media columns (6): audio stored as 8-bit PCM, its log-mel features as fixed-shape tensors with time spans.

A payload is written losslessly as an unsigned 8-bit mono WAVE file and read back from the stored bytes; everything else
is computed from what was read. Features: polyphase resampling to a third of the rate, overlapped Hann-windowed frames,
log-mel filterbank energies, and speech-like segments found by two energy thresholds with hysteresis. Mel frames are
stored in blocks of a fixed shape (frames x bands), each with the time span it covers: a column of Arrow streams, whose
records are a span and a fixed-shape tensor. What is said of features is read from that column.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

RATE, DOWN, TAPS = 24_000, 3, 8
FRAME, HOP, BANDS = 256, 128, 32
#: Frames of a stored tensor, and the seconds between frames.
BLOCK_FRAMES, STEP = 16, HOP * DOWN / RATE
#: A segment begins at the upper threshold and lasts while the energy is over the lower one (log units over the mean).
UPPER, LOWER = 0.25, 0.0
MULTIPLE, FILL = 192, 32
#: Frames whose spectra are computed at a time.
CHUNK = 2048
#: Bytes of columns that a task sends on at a time.
BATCH_BYTES = 4 << 20


def padded(text: str | None) -> bytes:
    """UTF-8 and then bytes 32 up to a positive multiple of 192."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // MULTIPLE)) * MULTIPLE, bytes([FILL]))


def store(payload: bytes) -> bytes:
    """A WAVE file: unsigned 8-bit PCM, one channel."""
    pad = b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + pad


def load(media: bytes) -> bytes:
    """The samples of a WAVE file as :func:`store` writes it; chunks are walked, unknown ones skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono PCM")
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.cache
def _filter() -> np.ndarray:
    """A windowed-sinc low-pass at the new half rate, TAPS taps for each of the DOWN phases."""
    n = np.arange(DOWN * TAPS) - (DOWN * TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(DOWN * TAPS)
    return (h / h.sum()).astype(np.float32)


def resampled(samples: np.ndarray) -> np.ndarray:
    """Every DOWN-th output of the low-pass: sums over phases, each a short filter on every DOWN-th sample."""
    h, n = _filter(), -(-len(samples) // DOWN)
    x = np.zeros((n + TAPS) * DOWN, np.float32)
    x[: len(samples)] = samples
    phases, out = x.reshape(-1, DOWN), np.zeros(n, np.float32)
    for k in range(TAPS):
        out += phases[k : k + n] @ h[k * DOWN : (k + 1) * DOWN]
    return out


@functools.cache
def _mel() -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale, over the power spectrum's bins."""
    rate = RATE / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    weights = np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)))
    return (weights + 1e-9).T.astype(np.float32)


def log_mel(signal: np.ndarray) -> np.ndarray:
    """Log energies (frames x BANDS) of overlapped Hann-windowed frames; a short signal has one, filled with silence."""
    frames = 1 + max(0, -(-(len(signal) - FRAME) // HOP))
    x = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    x[: len(signal)] = signal
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, out = np.hanning(FRAME).astype(np.float32), np.empty((frames, BANDS), np.float32)
    for at in range(0, frames, CHUNK):
        spectrum = np.fft.rfft(view[at : at + CHUNK] * window, axis=1)
        out[at : at + CHUNK] = np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _mel() + 1e-6)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) frames: from where the energy reaches the upper threshold until it falls below the lower one."""
    over = energy - energy.mean()
    event = np.where(over >= UPPER, 1, np.where(over < LOWER, -1, 0))
    told = np.flatnonzero(event)
    if not len(told):
        return []
    last = np.zeros(len(event), np.int64)
    last[told] = told
    on = event[np.maximum.accumulate(last)] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float32(), (BLOCK_FRAMES, BANDS))
SPANNED = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", TENSOR)])


def tensors(mel: np.ndarray) -> pa.RecordBatch:
    """Frames as blocks of BLOCK_FRAMES, the last filled with the log of silence, and the seconds that each covers."""
    n = -(-len(mel) // BLOCK_FRAMES)
    blocks = np.full((n * BLOCK_FRAMES, BANDS), -6.0, np.float32)
    blocks[: len(mel)] = mel
    first = np.arange(n) * BLOCK_FRAMES
    flat = pa.FixedSizeListArray.from_arrays(pa.array(blocks.ravel()), BLOCK_FRAMES * BANDS)
    spans = pa.array(first * STEP), pa.array(np.minimum(first + BLOCK_FRAMES, len(mel)) * STEP)
    return pa.RecordBatch.from_arrays([*spans, pa.ExtensionArray.from_storage(TENSOR, flat)], schema=SPANNED)


def packed(batch: pa.RecordBatch) -> bytes:
    """The batch as an Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> np.ndarray:
    """The frames of a stream of spanned tensors: as many as the spans cover."""
    table = pa.ipc.open_stream(data).read_all()
    if table.schema.field("mel").type != TENSOR:
        raise ValueError(f"not tensors of {BLOCK_FRAMES} x {BANDS}")
    frames = round(table["end_s"][-1].as_py() / STEP)
    return table["mel"].combine_chunks().to_numpy_ndarray().reshape(-1, BANDS)[:frames]


def features(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The log-mel frames of a WAVE file and its segments, [begin, end) in frames."""
    mel = log_mel(resampled((np.frombuffer(load(media), np.uint8).astype(np.float32) - 128) / 128))
    return mel, segments(mel.mean(axis=1))


COLUMNS = "doc_id long, n_bytes long, media binary, tensors binary, segments array<struct<start_s:double,end_s:double>>"
_SEGMENTS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def media_columns(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media, tensors, segments), a row per row of ``docs``: the stored form of every text, its
    features as an Arrow stream of spanned tensors, and the seconds of its segments.

    Null texts are empty, and an empty text has one frame; ids may be null; a repeated row comes as often as it does in
    ``docs``; an empty table gives no rows; columns other than id and text aren't looked at.
    """
    names, kinds = [f.split()[0] for f in COLUMNS.split(", ")], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), _SEGMENTS]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py()
                media = store(padded(data))
                mel, found = features(media)
                stream = packed(tensors(mel))
                spans = [{"start_s": a * STEP, "end_s": b * STEP} for a, b in found]
                rows.append((doc_id, len(data.encode()), media, stream, spans))
                held += len(media) + len(stream) + 64 * len(spans)
                if held > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, COLUMNS)


def said(mel: np.ndarray, spans: list[dict]) -> str:
    """Frames, segments, speech frames, mean energy, and the four strongest bands."""
    bands = mel.mean(axis=0, dtype=np.float64)
    top = np.argsort(-np.round(bands, 3), kind="stable")[:4]
    speech = sum(round((x["end_s"] - x["start_s"]) / STEP) for x in spans)
    return f"frames={len(mel)};segments={len(spans)};speech={speech};mean={bands.mean():.2f};bands={','.join(map(str, top.tolist()))}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(columns: DataFrame) -> DataFrame:
    """A row per row of :func:`media_columns`: sizes and digests of the payload as read back from the media column and of
    that column, and a description of the features as read back from the tensors and segments."""
    names, kinds = [f.split()[0] for f in DIGEST.split(", ")], [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media, stream, spans in zip(*(batch.column(k) for k in range(5)), strict=True):
                media = media.as_py()
                payload = load(media)
                sums = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()
                rows.append((doc_id.as_py(), n.as_py(), len(payload), *sums, said(unpacked(stream.as_py()), spans.as_py())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return columns.mapInArrow(run, DIGEST)
