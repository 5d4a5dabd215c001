"""Token ids as directly addressable codes: any token is read without decoding a block.

``encode_block`` cuts each id into chunks of eight bits, least first. Level k holds chunk k of
those ids that have so many; its bitmap says which go on in level k + 1, and its rank directory
(the number of set bits before every 512th) gives the place there. A block is one file's bytes:
header, document ids and starts, levels. ``write_blocks`` makes blocks of whole documents in
ascending doc_id order (null first; ties by text hash) as rows of an uncompressed Parquet table
in a folder that every executor reads; ``read_blocks`` and ``Block`` read them back. Documents are dealt by
ranges of (doc_id, text hash), so a doc_id that many rows have, or null, is split too.

null and empty texts: the end id alone. Repeated rows: each is stored. doc_id is an integer, or null. Other columns aren't read, and an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import BLANK, LOWER, Memo, encode_parts, flat, ragged, scratch, slices, span_hash, spans

MAGIC, STEP, END = b"SDAC0001", 512, 2
#: What a byte of a plain word is: 1 a letter, 2 a digit, 3 another sign, 0 not plain.
KIND = np.array([1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 if 33 <= c < 127 and chr(c) not in "'<" else 0 for c in range(128)] + [0] * 128, np.uint8)
#: Bits set in a byte.
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def encode_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: ``ids`` of all documents in order, ``counts`` ids to each."""
    starts = np.r_[0, np.cumsum(counts)].astype("<u8")
    null = np.array([d is None for d in doc_ids], bool)
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest >> np.uint32(8)
        go = more > 0
        bits = np.packbits(go, bitorder="little")
        bits = np.r_[bits, np.zeros(-len(bits) % (STEP // 8), np.uint8)]
        rank = np.r_[0, np.cumsum(ONES[bits].reshape(-1, STEP // 8).sum(1, dtype=np.uint32))].astype("<u4")
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()))
        rest = more[go]
        if not len(rest):
            break
    out = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)), null.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), starts.tobytes()]
    for n, low, bits, rank in levels:
        out += [struct.pack("<QQQ", n, len(bits), len(rank) // 4), low, bits, rank]
    return b"".join(out)


class Block:
    """Random access into a block's bytes."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        docs, self.n, levels = struct.unpack_from("<QQQ", raw, 8)
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        null = take("?", docs)
        self.doc_ids = [None if z else d for d, z in zip(take("<i8", docs).tolist(), null.tolist(), strict=True)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n, m, k = struct.unpack_from("<QQQ", raw, at)
            at += 24
            self.levels.append((take("u1", n), take("u1", m), take("<u4", k)))

    @staticmethod
    def rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        b, byte = i // STEP, i // 8
        out = int(directory[b]) + int(ONES[bits[b * (STEP // 8) : byte]].sum())
        return out + (bin(int(bits[byte]) & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        """Token i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (low, bits, directory) in enumerate(self.levels):
            out |= int(low[i]) << (8 * k)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self.rank(bits, directory, i)
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b - 1; touches only their own chunks."""
        out = np.zeros(b - a, np.uint32)
        where = None
        for k, (low, bits, directory) in enumerate(self.levels):
            if b <= a:
                break
            part = low[a:b].astype(np.uint32) << np.uint32(8 * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            go = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = np.flatnonzero(go) if where is None else where[go]
            n = len(where)
            if not n:
                break
            a = self.rank(bits, directory, a)
            b = a + n
        return out


#: The pattern that the vocabulary's file splits lower-cased words by (fixed value); what lies between matches goes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a printable byte as itself, and the others as 256, 257 and so on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + k for k, b in enumerate(others) if b != 32}  # no piece has blanks


class Encoder:
    """The library's ids of whole texts; each distinct piece of a word is encoded once.

    The tokenizer drops white space and works on each run between it alone, so this gives
    the ids of the whole text; ``Encoder`` refuses tokenizers of another kind. Plain words (ASCII but for ``'`` and
    ``<``, and the letters of Latin-1) are cut into the pieces of ``PIECES`` here, and pieces go to the same
    merges without the normalizer; other words go to the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        probe = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        if any(probe(f"{w}{s}{w}") != probe(w) * 2 for w in ("it's", "x1", "<|a", "é") for s in " \t\n\v\f\r"):
            raise ValueError("a tokenizer that drops white space is needed")
        self.memo = Memo()
        spec = json.loads(self.tok.to_str())
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        plain = parts[0].get("pattern", {}).get("Regex") == PIECES and parts[0].get("invert") and [x["type"] for x in parts] == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>"
        plain = plain and [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and all(chr(self.letters.get(b, b)) + "</w>" in spec["model"]["vocab"] for b in range(256) if b != 32)
        self.merges = None
        if plain:
            self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}))
            self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True

    letters = byte_letters()

    def cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(data in lower case, starts, ends, plain) of the pieces of words; a word that isn't plain is one piece, as it is."""
        if self.merges is None or not len(starts):
            return data, starts, ends, np.zeros(len(starts), bool)
        kind = KIND[data]
        before = np.r_[np.uint8(0), data[:-1]]
        after = np.r_[data[1:], np.uint8(0)]
        tail = (before == 0xC3) & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
        kind[tail] = 1
        kind[(data == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)] = 1
        odd = np.r_[0, np.cumsum(kind == 0)]
        plain = odd[ends] == odd[starts]
        low = LOWER[data]
        low[tail & (data <= 0x9E)] += 0x20
        first = np.zeros(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        word = np.zeros(len(data) + 1, np.int8)
        word[starts[plain]] += 1
        word[ends[plain]] -= 1  # adjacent words of two rows: the next one's start adds up with it
        first &= np.cumsum(word[:-1]) > 0
        first[starts] = True
        at = np.flatnonzero(first)
        own = np.searchsorted(starts, at, "right") - 1
        close = np.minimum(np.r_[at[1:], len(data)], ends[own])
        return np.where(np.cumsum(word[:-1]) > 0, low, data), at, close, plain[own]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = flat(column)
        starts, ends, _ = spans(data, offs, BLANK)
        data, starts, ends, plain = self.cut(data, starts, ends)
        counts = np.diff(np.searchsorted(starts, offs))
        code, keys = pd.factorize(span_hash(data, starts, ends) ^ np.where(plain, 0, 0x5A5A5A5A5A5A5A5A).astype(np.uint64))
        seen = np.zeros(len(keys), np.int64)
        seen[code[::-1]] = np.arange(len(code))[::-1]
        raw = data.tobytes()

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = seen[new]
            easy, sizes, out = plain[at], np.zeros(len(at), np.int64), []
            bounds = lambda k: zip(starts[k].tolist(), ends[k].tolist(), strict=True)
            if easy.any():
                parts = [raw[a:b] for a, b in bounds(at[easy])]
                lines = [b" ".join(parts[k : k + 2000]).decode("latin-1").translate(self.letters) for k in range(0, len(parts), 2000)]
                ids = np.concatenate([np.array(e.ids, np.int32) for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)])
                sizes[easy] = np.diff(np.r_[-1, np.flatnonzero(self.last[ids])])
                out.append(ids)
            if not easy.all():
                ids, sizes[~easy] = encode_parts(self.tok, [raw[a:b].decode() for a, b in bounds(at[~easy])])
                out.append(ids)
            # the plain ones come first in ids: put them in the order of new
            order = np.r_[np.flatnonzero(easy), np.flatnonzero(~easy)]
            begin = np.empty(len(at), np.int64)
            begin[order] = np.cumsum(sizes[order]) - sizes[order]
            return np.concatenate(out)[ragged(begin, sizes)], sizes

        at, size, ids = self.memo.rows(keys, make)
        each = size[code]
        total = np.r_[0, np.cumsum(each)]
        return ids[ragged(at[code], each)], np.diff(total[np.r_[0, np.cumsum(counts)]])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


BLOCKS = "bucket int, seq int, n_docs long, n_tokens long, payload binary"


def write_blocks(docs: DataFrame, path: str, out: str, *, end: int = END, part_bytes: int = 16 << 20, block_bytes: int = 2 << 20) -> None:
    """Encode, and write blocks of about ``block_bytes`` of text to ``out``; ascending doc_id is ascending (bucket, seq, place)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for seq, b in enumerate(slices(batches, "text", block_bytes)):
            ids, n = e.encode(b.column(2))
            full = np.full(len(ids) + len(n), end, np.int32)
            full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            raw = encode_block(b.column(1).to_pylist(), n + 1, full)
            yield pa.record_batch({"bucket": b.column(0).slice(0, 1), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(n)]), "n_tokens": pa.array([len(full)]), "payload": pa.array([raw], pa.binary())})

    key = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), key).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    blocks = dealt.select(F.spark_partition_id().alias("bucket"), "doc_id", "text").mapInArrow(run, BLOCKS)
    # row groups of a few blocks, so that a task holds no more at once
    blocks.write.option("compression", "uncompressed").option("parquet.block.row.count.limit", 4).parquet(out)


def read_blocks(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the blocks at ``path``."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    total = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("all"))
    first = total.select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("before"))
    within = blocks.select("bucket", "seq", "n_tokens").withColumn("ahead", F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("seq")) - F.col("n_tokens"))
    begin = within.join(first, "bucket").select("bucket", "seq", (F.col("before") + F.col("ahead")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "payload", 1):  # a block at a time
            for lane, seq, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                block = Block(raw)
                s = block.starts
                crc = [zlib.crc32(block.slice(int(s[k]), int(s[k + 1])).astype("<u4").tobytes()) for k in range(len(s) - 1)]
                n = len(crc)
                yield pa.record_batch({"bucket": pa.array([lane] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc_id": pa.array(block.doc_ids, pa.int64()), "own": pa.array(s[:-1]), "n_tokens": pa.array(np.diff(s)), "ids_crc32": pa.array(crc, pa.int64())})

    rows = blocks.select("bucket", "seq", "payload").mapInArrow(run, "bucket int, seq int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return rows.join(begin, ["bucket", "seq"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, path: str) -> DataFrame:
    """Write every document's ids to a new folder, then read them back."""
    out = scratch(docs.sparkSession)
    write_blocks(docs, path, out)
    return read_blocks(docs.sparkSession, out)
