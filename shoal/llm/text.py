"""Helpers shared by the text operators: Arrow batches as flat numpy arrays, word hashes, tables in the shared folder.

Every kernel here works on one Arrow batch at a time, cut into slices of a bounded number of
bytes, so that the memory of a Python worker doesn't depend on the size of the table.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20
U = np.uint64


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; a local one only where that is unset and Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + os.path.join(tempfile.gettempdir(), "shoal-checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offs, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about ``most`` bytes of ``name``, or one row."""
    for batch in batches:
        n, lo = batch.num_rows, 0
        if not n:
            continue
        _, offs = flat(batch.column(batch.schema.get_field_index(name)))
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def ascii_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: ASCII white space: blank, tab to carriage return.
BLANK = ascii_table(bytes([32, *range(9, 14)]))
#: What separates words once case and punctuation are ignored: all of ASCII but letters and digits.
NOT_WORD = ascii_table(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_C1, _C2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(32))
    h = h * _C2
    h ^= h >> U(29)
    h *= _C1
    h ^= h >> U(32)
    return h


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes at a step."""
    lens = ends - starts
    h = lens.astype(U) * _C1
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at, k = slice(None), 0
    while True:
        s, left = starts[at] + 8 * k, lens[at] - 8 * k
        h[at] = mix(h[at] ^ (view[s] & _MASK[np.minimum(left, 8)]))
        k += 1
        at = np.flatnonzero(lens > 8) if k == 1 else at[left > 8]  # one long word costs no look at all the others
        if not len(at):
            return h


def spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): maximal runs of bytes that ``sep`` doesn't mark, never across rows; runs by row."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = np.frombuffer(data.tobytes().translate(np.logical_not(sep).tobytes()), bool)  # faster than an index of bytes
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    both = inside[1:-1][edge] & inside[1:-1][edge - 1]
    first[edge[both]] = True
    last[edge[both] - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def words(column: pa.Array, sep: np.ndarray = BLANK, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all rows in order, number of words by row)."""
    data, offs = flat(column)
    if lower:
        data = LOWER[data]
    starts, ends, counts = spans(data, offs, sep)
    return span_hash(data, starts, ends), counts


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of all start + 0 .. len - 1, one run after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return out


class Memo:
    """Integer lists by 64-bit key, held flat; emptied when it has ``most`` entries, so its memory is bounded."""

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.flat, self.offs, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def rows(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, flat) for each of the distinct ``keys``; ``make(indices)`` gives (flat ids, lengths) of those not held."""
        if len(self.at) > self.most:
            self.clear()
        ks = keys.tolist()
        get = self.at.get
        found = np.fromiter((get(k, -1) for k in ks), np.int64, len(ks))
        new = np.flatnonzero(found < 0)
        if len(new):
            ids, lens = make(new)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            n = len(self.at)
            while n + len(new) + 1 > len(self.offs):
                self.offs = np.concatenate([self.offs, np.zeros(len(self.offs), np.int64)])
            self.offs[n + 1 : n + 1 + len(new)] = self.used + np.cumsum(lens)
            self.used += len(ids)
            found[new] = np.arange(n, n + len(new))
            self.at.update(zip(keys[new].tolist(), range(n, n + len(new)), strict=True))
        return self.offs[found], self.offs[found + 1] - self.offs[found], self.flat


def encode_parts(tok, parts: list[str], group: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, lengths) of texts by a tokenizer of the tokenizers library, many at a call.

    The texts are joined by a special token, which the library cuts out before all else, so
    each is encoded as if it stood alone; texts that hold special tokens do stand alone.
    """
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)}
    if not special or len(parts) < 2:
        got = [e.ids for e in tok.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got))
    sep, mark = next(iter(special.items()))
    odd = [i for i, p in enumerate(parts) if "<" in p and any(t in p.lower() for t in special)]
    texts = list(parts)
    for i in odd:
        texts[i] = ""
    ids = np.concatenate([np.array(e.ids + [mark], np.int32) for e in tok.encode_batch_fast([sep.join(texts[i : i + group]) for i in range(0, len(texts), group)], add_special_tokens=False)])
    ends = np.flatnonzero(ids == mark)
    lens = np.diff(np.r_[-1, ends]) - 1
    ids = ids[ids != mark]
    if odd:
        own = [tok.encode(parts[i], add_special_tokens=False).ids for i in odd]
        pieces = np.split(ids, np.cumsum(lens)[:-1])
        for i, x in zip(odd, own, strict=True):
            pieces[i], lens[i] = np.array(x, np.int32), len(x)
        ids = np.concatenate(pieces).astype(np.int32)
    return ids, lens
