"""Media columns: byte payloads stored as 8-bit PCM audio, read back, with log-mel features as fixed-shape tensors.

A payload is the text's UTF-8 with bytes 255 appended up to a positive multiple of 576, so that it is a whole number of
resampling periods and feature hops. It is stored as an unsigned 8-bit mono WAV file (12 kHz) in a binary column, which
holds every byte as it is, and read back from the stored bytes by walking their chunks. Features are made from the samples
read: polyphase resampling by 2/3 to 8 kHz (a windowed-sinc filter in two phases), frames of 256 samples every 128 under a
Hann window, 24 log-mel bands, and segments by hysteresis on frame energy (a segment opens at the document's mean plus
half a deviation and closes below the mean). ``media_table`` stores the log-mel frames of a document as an Arrow stream whose
column ``values`` has the type fixed_shape_tensor(float32, (32, 24)), with the time span of each tensor beside it; as a binary column it
keeps that type through Parquet, which Spark's own arrays would lose. ``read_tensors`` gives the Arrow table back.

The documents of a slice are one signal with gaps, so a short text costs no call of its own; a row's values do not depend on
its neighbours. Edge cases: null text is empty, and an empty payload is one block of 255; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import read_table

BLOCK, PAD = 576, 255
RATE, UP, DOWN, TAPS = 12_000, 2, 3, 16
FRAME, HOP, BANDS, TENSOR_FRAMES = 256, 128, 24, 32
#: Samples that are turned into features at a time; a longer document makes a batch of its own.
CHUNK = 1 << 20
#: Bytes of text whose stored files, features and tensors a task holds at a time.
SLICE = 4 << 20
#: Rows of each matrix product: always the same shape, so that a frame's sums do not depend on how many there are.
_ROWS = 1024
OUT_RATE = RATE * UP // DOWN


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload, and its bytes before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def encode_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono PCM; the payload has an even number of bytes."""
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def decode_wav(stored: bytes) -> bytes:
    """The samples of a stored file, chunk by chunk."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif name == b"data":
            if form is None or form[0] != 1 or form[1] != 1 or form[5] != 8:
                raise ValueError("not 8-bit mono PCM")
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=1)
def _phases() -> np.ndarray:
    """(UP, TAPS): a Hann-windowed sinc at the lower of the two Nyquist rates, split in its phases; each sums to 1."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * (0.5 + 0.5 * np.cos(2 * np.pi * t / n))
    phases = h.reshape(TAPS, UP).T
    return phases / phases.sum(axis=1, keepdims=True)


def resample(x: np.ndarray) -> np.ndarray:
    """x at 2/3 of its rate; len(x) is a multiple of 3, silence surrounds it."""
    half = TAPS // 2
    padded = np.concatenate([np.zeros(TAPS), x, np.zeros(TAPS)])
    q = len(x) // DOWN
    out = np.zeros((q, UP))
    for p, h in enumerate(_phases()):
        first = TAPS + p + half  # output 2q + p lies at input 3q + 1.5p
        for j in range(TAPS):
            out[:, p] += h[j] * padded[first - j : first - j + DOWN * q : DOWN][:q]
    return out.reshape(-1)


@lru_cache(maxsize=1)
def mel_bank() -> np.ndarray:
    """(FRAME // 2 + 1, BANDS): triangles evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(OUT_RATE / 2), BANDS + 2) / 2595) - 1)
    f = np.linspace(0, OUT_RATE / 2, FRAME // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log-mel and (frames,) log energy of frames that start every HOP; len(y) is a multiple of HOP."""
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([y, np.zeros(FRAME)]), FRAME)[: len(y) : HOP]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    mels, energy, bank = np.empty((len(frames), BANDS)), np.empty(len(frames)), mel_bank()
    for a in range(0, len(frames), _ROWS):
        part = frames[a : a + _ROWS] * window
        spectrum = np.fft.rfft(part, axis=1)
        power = np.zeros((_ROWS, FRAME // 2 + 1))
        power[: len(part)] = spectrum.real**2 + spectrum.imag**2
        mels[a : a + _ROWS] = np.log((power @ bank)[: len(part)] + 1e-6)
        energy[a : a + _ROWS] = np.log((part * part).sum(axis=1) + 1e-6)
    return mels, energy


def hysteresis(energy: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each frame is in a segment; doc: the number of each frame's document, 0 and up in order."""
    n = np.bincount(doc)
    mean = np.bincount(doc, energy) / n
    dev = np.sqrt(np.maximum(np.bincount(doc, energy**2) / n - mean**2, 0))
    # an even signal stays below the opening threshold
    high, low = energy >= (mean + 0.5 * dev + 1e-6)[doc], energy < mean[doc]
    first = np.r_[0, np.cumsum(n)[:-1]]
    decided = high | low
    decided[first] = True
    last = np.maximum.accumulate(np.where(decided, np.arange(len(energy)), 0))
    return high[last]


def analyse(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per payload: log-mel frames, and segments as (first frame, end frame) rows."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(payloads):
        size, b = 0, at
        while b < len(payloads) and (b == at or size + len(payloads[b]) <= CHUNK):
            size, b = size + len(payloads[b]) + BLOCK, b + 1
        gap = np.full(BLOCK, 128, np.uint8)
        parts = [x for p in payloads[at:b] for x in (np.frombuffer(p, np.uint8), gap)]
        mels, energy = log_mel(resample((np.concatenate(parts).astype(np.float64) - 128) / 128))
        frames = np.array([len(p) * UP // DOWN // HOP for p in payloads[at:b]])
        gap_frames = BLOCK * UP // DOWN // HOP
        first = np.r_[0, np.cumsum(frames + gap_frames)[:-1]]
        keep = np.repeat(first - np.r_[0, np.cumsum(frames)[:-1]], frames) + np.arange(frames.sum())
        doc = np.repeat(np.arange(len(frames)), frames)
        on = hysteresis(energy[keep], doc)
        ends = np.cumsum(frames)
        for n, e in zip(frames, ends, strict=True):
            edge = np.diff(np.r_[False, on[e - n : e], False].astype(np.int8))
            out.append((mels[keep[e - n : e]], np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)))
        at = b
    return out


def summary(mels: np.ndarray, segments: np.ndarray) -> str:
    """Frames, segments, seconds in segments, and the mean of each band."""
    seconds = (segments[:, 1] - segments[:, 0]).sum() * HOP / OUT_RATE
    return f"{len(mels)}|{len(segments)}|{seconds:.3f}|" + ",".join(f"{m + 0.0:.2f}" for m in mels.mean(axis=0))


MEDIA_SCHEMA = "doc_id long, n_bytes long, stored binary, segments array<struct<start:double,end:double>>, tensors binary"
_SPAN = pa.struct([("start", pa.float64()), ("end", pa.float64())])
TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, BANDS), dim_names=("frame", "band"))


def tensor_bytes(mels: np.ndarray) -> bytes:
    """An Arrow stream of one batch (start, end, values): values is a fixed-shape tensor column, start and end are its spans in seconds.

    The last tensor is filled up with the log of silence; its span ends with its frames.
    """
    n = -(-len(mels) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, BANDS), np.log(1e-6), np.float32)
    full[: len(mels)] = mels
    first = np.arange(n) * TENSOR_FRAMES
    last = np.minimum(first + TENSOR_FRAMES, len(mels))
    values = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR_FRAMES * BANDS))
    batch = pa.RecordBatch.from_arrays([pa.array(first * HOP / OUT_RATE), pa.array(last * HOP / OUT_RATE), values], ["start", "end", "values"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """(start, end, values) as ``tensor_bytes`` stored them, values of the type TENSOR."""
    with pa.ipc.open_stream(stored) as source:
        return source.read_all()


def read_frames(stored: bytes, segments: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Frames and segments of stored tensors and spans; what fills the last tensor up is left out."""
    table, frames = read_tensors(stored), lambda seconds: np.round(np.asarray(seconds, float) * OUT_RATE / HOP).astype(np.int64)
    total = int(frames(table["end"].to_numpy()).max(initial=0))
    mels = np.concatenate([c.to_numpy_ndarray().reshape(-1, BANDS) for c in table["values"].chunks])
    spans = np.array([[s["start"], s["end"]] for s in segments], float).reshape(-1, 2)
    return mels[:total].astype(np.float64), frames(spans)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together, or of one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, stored, segments, tensors): unpadded bytes, the WAV file, time spans of segments in seconds, and the log-mel
    tensors with their time spans as an Arrow stream. A task holds the features of SLICE bytes of text, or of one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), SLICE):
                part = batch.slice(a, b - a)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                stored = [encode_wav(p) for p, _ in made]
                found = analyse([decode_wav(s) for s in stored])
                spans = [[{"start": x * HOP / OUT_RATE, "end": y * HOP / OUT_RATE} for x, y in segs.tolist()] for _, segs in found]
                cols = [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(stored, pa.binary()), pa.array(spans, pa.list_(_SPAN)), pa.array([tensor_bytes(m) for m, _ in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "stored", "segments", "tensors"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, MEDIA_SCHEMA)


def digests(media: DataFrame) -> DataFrame:
    """media with the digests of its payload and of the stored file, both of the bytes read back, and the feature summary of its tensors."""
    names = [f.split()[0] for f in _DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), SLICE):
                part, rows = batch.slice(a, b - a), []
                for s, spans, tensors in zip(*[part.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                    p = decode_wav(s)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(s), hashlib.sha256(s).hexdigest(), summary(*read_frames(tensors, spans))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made, part.column(3), part.column(4)], ["doc_id", "n_bytes", *names, "segments", "tensors"])

    return media.mapInArrow(run, f"doc_id long, n_bytes long, {_DIGESTS}, segments array<struct<start:double,end:double>>, tensors binary")


_DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media_table(read_table(spark, sf_dir, "documents")))
