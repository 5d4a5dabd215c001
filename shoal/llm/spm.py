"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

``encode``/``decode`` give the ids and texts of the sentencepiece library for a BPE model with
identity normalisation, a dummy prefix and byte fallback. A text is cut where no piece can
reach across: before a run of blanks, and around ASCII characters that no piece holds. Each
distinct segment of a slice is encoded once: its characters are symbols in one flat numpy
array; a round finds each segment's best pair (least rank, leftmost), merges all these at
once and compacts the array, until no pair is left. Segments of more than ``LONG`` characters
go through a heap instead, as rounds would take a time that grows with the square.

null and empty texts: no ids, decoded text empty. Repeated rows: each gives its own row. Only
doc_id and text are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import Memo, flat, ragged, slices, span_hash

LONG = 200
SPACE = "▁"


class Model:
    """The tables of a model file: piece ids, pair ranks, the ids of each character's bytes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, spec = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or spec.model_type != spec.BPE or not spec.byte_fallback:
            raise ValueError("a BPE model with identity normalisation, dummy prefix and byte fallback is needed")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with a blank after other characters aren't supported")
        self.text = [p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type != p.NORMAL:
                self.text[i] = b""
        # Symbols: a piece's id, or for characters that are no piece: len(pieces) + code point.
        self.size = len(proto.pieces)
        chars = {c: normal.get(c, self.size + ord(c)) for p in normal for c in p}
        symbol = lambda s: chars.get(s) if len(s) == 1 else normal.get(s)
        order = sorted(normal, key=lambda p: (-proto.pieces[normal[p]].score, normal[p]))
        rank = {p: r for r, p in enumerate(order)}
        # pieces of equal score are of equal rank, so that the leftmost wins
        last, same = None, 0
        for p in order:
            s = proto.pieces[normal[p]].score
            if s != last:
                last, same = s, rank[p]
            rank[p] = same
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 24) | b] = (rank[p], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.into = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.char = {ord(c): i for c, i in chars.items()}
        self.low = np.full(0x110000, -1, np.int32)
        self.low[list(self.char)] = list(self.char.values())
        # ASCII characters that no piece holds: a segment each
        self.alone = np.array([c < 128 and c != 32 and c not in self.char for c in range(256)])
        self.memo = Memo()
        self.decimal = np.array([f"{i}," for i in range(self.size)], "S6")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or a large number, merged id) of each pair of symbols."""
        key = (a.astype(np.int64) << 24) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], np.int32(2**30)), self.into[at]

    def rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair is left. sym: flat symbols; seg: the segment of each, ascending."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(2**30) << 32
        rank = np.full(len(sym), 2**30, np.int32)
        into = np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[:-1][seg[1:] != seg[:-1]] = 2**30
        while len(sym):
            begin = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            size = np.diff(np.r_[begin, len(sym)])
            best = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(sym)), begin)
            live = best < none
            if not live.all():  # segments without a pair are finished
                out = np.repeat(~live, size)
                done.append((sym[out], seg[out]))
                shift = np.cumsum(out)
                best = best[live]
                best = (best >> 32 << 32) | ((p := best & 0xFFFFFFFF) - shift[p])
                keep = ~out
                sym, seg, rank, into = sym[keep], seg[keep], rank[keep], into[keep]
                if not len(sym):
                    break
            at = best & 0xFFFFFFFF
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol fewer in each segment before
            sym, seg, rank, into = sym[keep], seg[keep], rank[keep], into[keep]
            for i in (at, at - 1):
                i = i[i >= 0]
                j = np.minimum(i + 1, len(sym) - 1)
                r, t = self.ranks(sym[i], sym[j])
                r[(seg[i] != seg[j]) | (i == j)] = 2**30
                rank[i], into[i] = r, t
        if not done:
            return sym, seg
        sym, seg = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def heap(self, sym: list[int]) -> list[int]:
        """The same merges for one long segment, in n log n."""
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and (hit := self.pairs.get((sym[i] << 24) | sym[j])):
                heapq.heappush(queue, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(n - 1):
            push(i)
        gone = [False] * n
        while queue:
            _, i, a, b, c = heapq.heappop(queue)
            j = right[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j] = c, True
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def segments(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths) of segments whose blanks are written as such."""
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).replace(" ", SPACE).encode("utf-32-le"), np.int32)
        sym = self.low[codes]
        sym = np.where(sym < 0, codes + self.size, sym).astype(np.int32)
        seg = np.repeat(np.arange(len(parts)), lens)
        long = np.flatnonzero(lens > LONG)
        if len(long):
            offs = np.r_[0, np.cumsum(lens)]
            extra = [(i, self.heap(sym[offs[i] : offs[i + 1]].tolist())) for i in long.tolist()]
            keep = np.repeat(lens <= LONG, lens)
            sym, seg = self.rounds(sym[keep], seg[keep])
            seg = np.concatenate([seg, *(np.full(len(s), i) for i, s in extra)])
            sym = np.concatenate([sym, *(np.array(s, np.int32) for _, s in extra)])
            order = np.argsort(seg, kind="stable")
            sym, seg = sym[order], seg[order]
        else:
            sym, seg = self.rounds(sym, seg)
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):  # byte fallback
            raw = [chr(c).encode() for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            fill = np.repeat(sym >= self.size, times)
            sym, seg = np.repeat(sym, times), np.repeat(seg, times)
            sym[fill] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(seg, minlength=len(parts))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids by row) of a string array."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.replace_substring(column.fill_null(""), SPACE, " ")
        filled = pc.binary_length(column).to_numpy(zero_copy_only=False) > 0
        column = pc.if_else(pa.array(filled), pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)), column)
        data, offs = flat(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        blank, alone = data == 32, self.alone[data]
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first |= alone
        first[1:] |= alone[:-1] & ~alone[1:]
        first[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], len(data)]
        counts = np.diff(np.searchsorted(starts, offs))
        code, keys = pd.factorize(span_hash(data, starts, ends))
        seen = np.zeros(len(keys), np.int64)
        seen[code[::-1]] = np.arange(len(code))[::-1]
        raw = data.tobytes()
        make = lambda new: self.segments([raw[a:b].decode() for a, b in zip(starts[seen[new]].tolist(), ends[seen[new]].tolist(), strict=True)])
        at, size, ids = self.memo.rows(keys, make)
        each = size[code]
        total = np.r_[0, np.cumsum(each)]
        rows = np.r_[0, np.cumsum(counts)]
        return ids[ragged(at[code], each)], np.diff(total[rows])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one row's ids, without the blank that encoding puts before it."""
        text = self.text
        out = b"".join([text[i] for i in ids.tolist()])
        return out[1:] if out[:1] == b" " else out


@lru_cache(1)
def model(path: str) -> Model:
    return Model(path)


def encode_rows(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches, text_col):
            ids, n = m.encode(b.column(1))
            offs = np.r_[0, np.cumsum(n)].astype(np.int32)
            yield pa.record_batch({id_col: b.column(0), "ids": pa.ListArray.from_arrays(pa.array(offs), pa.array(ids))})

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode_rows(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row of ids; null ids: empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            out = [m.decode(np.asarray(x.as_py() or [], np.int32)).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.record_batch({id_col: b.column(0), "text": pa.array(out, pa.string())})

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids as encoded, and the text decoded from those ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches):
            ids, n = m.encode(b.column(1))
            offs = np.r_[0, np.cumsum(n)].tolist()
            first, second = [], []
            for lo, hi in zip(offs[:-1], offs[1:], strict=True):
                own = ids[lo:hi]
                first.append(hashlib.sha256(m.decimal[own].tobytes().translate(None, b"\0")[:-1]).hexdigest())
                second.append(hashlib.sha256(m.decode(own)).hexdigest())
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
