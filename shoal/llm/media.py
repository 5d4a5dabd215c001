"""Audio features of byte payloads kept as 8-bit WAV.

``store`` writes each text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as the
samples of a mono 8-bit WAV file in a binary column. ``features`` reads those bytes back:
polyphase resampling by a windowed sinc, overlapped Hann frames, log-mel filterbank energies
averaged into a tensor of fixed shape (16 time bins by 32 bands, half precision), and segments by an
energy gate with hysteresis, with their time spans. ``keep`` writes tensors and spans as Arrow record
batches, with Arrow's fixed-shape tensor type, one batch of rows in each row of a table; ``kept`` reads
them back. Spans are in seconds of the stored sound. Every row is computed by itself and in blocks of frames, so
equal bytes give equal values and a long row needs no more memory than a block beyond its own bytes.

null and empty texts: one block of padding. Repeated rows: each is kept. Other columns aren't read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import flat, remove, scratch, slices

UNIT, PAD = 576, 255
RATE, TARGET = 16_000, 10_000  # 5 to 8: five phases of the filter
FRAME, HOP, FFT, BANDS, BINS = 250, 100, 256, 32, 16
BLOCK = 2048  # frames
ZEROS = 8  # of the sinc on either side
#: The gate opens above ON and closes below OFF standard deviations from the mean log energy; quiet frames are always below the mean, so it closes.
ON, OFF = 0.5, 0.0


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file."""
    pad = len(samples) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def samples_of(raw: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a mono 8-bit PCM file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data" and rate:
            return raw[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(8)
def kernel(up: int, down: int, zeros: int = ZEROS) -> np.ndarray:
    """Phases of a Hann-windowed sinc low-pass: row p is applied to outputs whose position has phase p."""
    wide = max(up, down)
    n = np.arange(-zeros * wide, zeros * wide + 1)
    h = np.sinc(n / wide) * (0.5 + 0.5 * np.cos(np.pi * n / (zeros * wide + 1))) / wide * up
    h = np.r_[h, np.zeros(-len(h) % up)]
    return np.ascontiguousarray(h.reshape(-1, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int = TARGET) -> np.ndarray:
    """x at ``rate`` as float32 at ``target``: each output needs one phase of the filter alone."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x.astype(np.float32)
    phases = kernel(up, down)
    taps = phases.shape[1]
    centre = ZEROS * max(up, down)  # the filter's middle, in steps of 1 / up
    n = -(-len(x) * up // down)
    padded = np.r_[np.zeros(taps - 1, np.float32), x, np.zeros(centre // up + taps, np.float32)]
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for k in range(min(up, n)):  # outputs k, k + up, ... share a phase
        first, phase = divmod(k * down + centre, up)
        rows = view[first :: down][: len(range(k, n, up))]
        for lo in range(0, len(rows), 1 << 16):
            out[k + lo * up : k + (lo + (1 << 16)) * up : up] = rows[lo : lo + (1 << 16)] @ phases[phase]
    return out


@lru_cache(4)
def mel(rate: int) -> np.ndarray:
    """Triangular bands, equally spaced on the mel scale, by FFT bin."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    up = (f - edge[:-2]) / np.maximum(edge[1:-1] - edge[:-2], 1e-9)
    fall = (edge[2:] - f) / np.maximum(edge[2:] - edge[1:-1], 1e-9)
    return np.maximum(0, np.minimum(up, fall)).astype(np.float32)


WINDOW = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def logmel(y: np.ndarray, rate: int = TARGET) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies by frame, log energy by frame); the last frame is filled with zeros."""
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.r_[y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)]
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    bank, out, energy = mel(rate), np.empty((n, BANDS), np.float32), np.empty(n, np.float32)
    for lo in range(0, n, BLOCK):
        part = frames[lo : lo + BLOCK]
        power = np.abs(np.fft.rfft(part * WINDOW, FFT)) ** 2
        out[lo : lo + BLOCK] = np.log(power.astype(np.float32) @ bank + 1e-6)
        energy[lo : lo + BLOCK] = np.log(np.einsum("ij,ij->i", part, part) + 1e-6)
    return out, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [a, b) during which the gate is open; it keeps its state between the two thresholds."""
    mean, std = float(energy.mean()), float(energy.std())
    event = np.where(energy > mean + ON * std, 1, np.where(energy < mean + OFF * std, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    state = np.r_[False, (last >= 0) & (event[np.maximum(last, 0)] == 1), False]
    edge = np.flatnonzero(state[1:] != state[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def analyse(raw: bytes) -> dict:
    """All features of one stored file."""
    payload, rate = samples_of(raw)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    bands, energy = logmel(resample(x, rate))
    n = len(bands)
    lo = np.arange(BINS) * n // BINS
    hi = np.maximum(lo + 1, (np.arange(BINS) + 1) * n // BINS)
    total = np.r_[np.zeros((1, BANDS)), np.cumsum(bands, 0, dtype=np.float64)]
    tensor = ((total[hi] - total[lo]) / (hi - lo)[:, None]).astype(np.float16)
    spans = [(a * HOP / TARGET, min(b * HOP + FRAME - HOP, n * HOP + FRAME) / TARGET) for a, b in segments(energy)]
    return {"payload": payload, "tensor": tensor, "spans": spans, "frames": n}


def digest(frames: int, tensor: np.ndarray, spans: list[dict]) -> str:
    """A short text of the features: frames, segments, open seconds, and a hash of the tensor in tenths."""
    cells = np.round(tensor.astype(np.float32) * 10).astype("<i2").tobytes()
    return f"{frames}f {len(spans)}s {sum(x['end'] - x['begin'] for x in spans):.2f}t {hashlib.sha256(cells).hexdigest()[:16]}"


STORED = "doc_id {}, n_bytes long, media binary"


def store(docs: DataFrame, path: str) -> None:
    """Write (doc_id, n_bytes, media) of every text to ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offs = flat(b.column(1))
            raw, at = data.tobytes(), offs.tolist()
            media = [wav(p + bytes([PAD]) * (UNIT - len(p) if not p else -len(p) % UNIT)) for p in (raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True))]
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array(np.diff(offs)), "media": pa.array(media, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs.select("doc_id", "text").mapInArrow(run, STORED.format(kind)).write.option("compression", "zstd").parquet(path)


TENSOR = pa.fixed_shape_tensor(pa.float16(), (BINS, BANDS))
SPANS = pa.list_(pa.struct([("begin", pa.float64()), ("end", pa.float64())]))
#: Of one stored file, besides its doc_id and n_bytes.
FACTS = pa.schema({"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "frames": pa.int64(), "tensor": TENSOR, "spans": SPANS})
COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(ids: pa.RecordBatch, media: pa.Array) -> pa.RecordBatch:
    """The facts, tensors and time spans of stored files, from their bytes alone, beside the columns of ``ids``."""
    out: dict[str, list] = {n: [] for n in FACTS.names}
    for raw in media:
        raw = raw.as_py()
        found = analyse(raw)
        p = found["payload"]
        spans = [{"begin": s, "end": e} for s, e in found["spans"]]
        row = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), found["frames"], found["tensor"].ravel(), spans)
        for column, x in zip(out.values(), row, strict=True):
            column.append(x)
    cells = pa.array(np.concatenate(out.pop("tensor")))
    tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(cells, BINS * BANDS))
    made = {n: tensor if n == "tensor" else pa.array(out[n], FACTS.field(n).type) for n in FACTS.names}
    return pa.record_batch({n: ids.column(n) for n in ids.schema.names} | made)


def keep(media: DataFrame, path: str) -> None:
    """Write the features of a table of ``store`` to ``path`` as Arrow record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            rows = features(b.select(["doc_id", "n_bytes"]), b.column("media"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_batch(rows)
            yield pa.record_batch({"arrow": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    media.select("doc_id", "n_bytes", "media").mapInArrow(run, "arrow binary").write.option("compression", "zstd").parquet(path)


def batches_of(column: pa.Array) -> Iterator[pa.RecordBatch]:
    """The record batches, with tensors and spans, in the rows of a table of ``keep``."""
    for raw in column:
        with pa.ipc.open_stream(raw.as_buffer()) as reader:
            yield from reader


def kept(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(doc_id, n_bytes, facts, feature) of a table of ``keep``; the feature comes from the tensor and spans read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in batches_of(b.column(0)):
                tensor = rows.column("tensor").to_numpy_ndarray()
                told = zip(rows.column("frames").to_pylist(), tensor, rows.column("spans").to_pylist(), strict=True)
                made = {n: rows.column(n) for n in ["doc_id", "n_bytes", *FACTS.names[:5]]}
                yield pa.record_batch(made | {"feature": pa.array([digest(*t) for t in told], pa.string())})

    return spark.read.schema("arrow binary").parquet(path).mapInArrow(run, f"doc_id {kind}, n_bytes long, {COLUMNS}")


def stored(docs: DataFrame) -> DataFrame:
    """Store every text, read the files back, keep their features, and read these back."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    path, facts = scratch(spark), scratch(spark)
    store(docs, path)
    keep(spark.read.schema(STORED.format(kind)).parquet(path), facts)
    remove(spark, path)
    return kept(spark, facts, kind)
