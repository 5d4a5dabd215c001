"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become words (lower case, ASCII punctuation parts them). Windows of
``SEED`` words that a text shares with an item are joined as seeds (an item of fewer words is one
seed). For each such pair the longest match that is free on both sides is marked, again and again, by
Karp-Rabin hashes of windows of that length, until none of ``SEED`` words is left. The share
of the item's words that tiles cover is its coverage; a text with an item of ``COVERAGE`` or more
is contaminated, in whatever order the passages stand.

The benchmark's seeds are broadcast if there are at most ``BROADCAST_SEEDS`` (their number is
counted first); beyond that they are joined by a shuffle. null and empty texts and items match
nothing. Repeated rows and items: each gives its own result. An item that covers several tied
ways takes the leftmost. Only doc_id and text, item_id and text are read. An
empty table of documents or of items gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NOT_WORD, free, mix, slices, words

SEED, COVERAGE, BROADCAST_SEEDS = 5, 0.5, 2_000_000
_B = np.uint64(0x100000001B3)
_B_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Most (text, item) candidates by seed that are held at once, unless a single text has more.
CANDIDATES = 1 << 21


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words by row), ignoring case and ASCII punctuation."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return words(pc.utf8_lower(column.fill_null("")), NOT_WORD)


def windows(w: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of the k words from each position on; the last k - 1 positions have none."""
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        h = h * _B + w[j : j + len(h)]
    return mix(h ^ np.uint64(k))


class Runs:
    """Karp-Rabin hashes of a text's windows of any length, from one pass of prefix sums."""

    def __init__(self, w: np.ndarray) -> None:
        self.w = w
        up, down = np.full(len(w) + 1, _B), np.full(len(w) + 1, _B_INVERSE)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.r_[np.zeros(1, np.uint64), np.add.accumulate(w * np.multiply.accumulate(up)[:-1])]
        self.taken = np.zeros(len(w), bool)

    def free(self, k: int) -> np.ndarray:
        """Where a window of k words begins that no tile has touched."""
        used = np.r_[0, np.cumsum(self.taken)]
        return np.flatnonzero(used[k:] == used[: len(used) - k])

    def at(self, begin: np.ndarray, k: int) -> np.ndarray:
        return (self.sums[begin + k] - self.sums[begin]) * self.down[begin]


def _shared(doc: Runs, item: Runs, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Free windows of k words of the item and of the doc that have a common hash, with these hashes."""
    i, j = doc.free(k), item.free(k)
    hi, hj = doc.at(i, k), item.at(j, k)
    both = np.intersect1d(hi, hj)
    own_i, own_j = np.isin(hi, both), np.isin(hj, both)
    return i[own_i], hi[own_i], j[own_j], hj[own_j]


def tile(doc: np.ndarray, item: np.ndarray, k: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), longest first; ties go to the leftmost in the item, then in the doc.

    The longest length that free windows of both share is found by doubling and halving (a shared window holds a shorter
    one), and all tiles of that length are marked in one sweep over the item. Memory grows with the sum of both lengths.
    """
    k = min(k, len(item))
    if not k or len(doc) < k:
        return []
    a, b, out, most = Runs(doc), Runs(item), [], min(len(doc), len(item))
    while most >= k:
        low, found, high = k - 1, None, most + 1
        step = k
        while low + 1 < high:
            got = _shared(a, b, step)
            if len(got[0]):
                low, found = step, got
            else:
                high = step
            step = (low + high) // 2 if high <= most else min(2 * low, most)
        if found is None:
            break
        out += _sweep(a, b, low, *found)
        most = low - 1
    return out


def _sweep(a: Runs, b: Runs, n: int, i: np.ndarray, hi: np.ndarray, j: np.ndarray, hj: np.ndarray) -> list[tuple[int, int, int]]:
    """Mark every tile of ``n`` words; no longer one is left. A tile can touch no other but at one of its ends."""
    order = np.argsort(hi, kind="stable")
    i, hi = i[order], hi[order]
    begin, end = np.searchsorted(hi, hj, "left"), np.searchsorted(hi, hj, "right")
    first: dict[int, int] = {}  # by hash: places in the doc before this one are taken
    out = []
    for q, lo, top in zip(j.tolist(), begin.tolist(), end.tolist(), strict=True):
        if b.taken[q] or b.taken[q + n - 1]:
            continue
        x = first.get(lo, lo)
        while x < top and (a.taken[i[x]] or a.taken[i[x] + n - 1]):
            x += 1
        first[lo] = x
        while x < top:
            p = int(i[x])
            if not (a.taken[p] or a.taken[p + n - 1]) and np.array_equal(a.w[p : p + n], b.w[q : q + n]):
                a.taken[p : p + n] = b.taken[q : q + n] = True
                out.append((p, q, n))
                break
            x += 1
    return out


class Bench:
    """Benchmark items with their seeds, sorted by hash."""

    def __init__(self, ids: list, texts: pa.Array, k: int = SEED) -> None:
        self.ids, self.k = ids, k
        w, n = tokens(texts)
        offs = np.r_[0, np.cumsum(n)]
        self.items = [w[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
        seeds = [(windows(x, min(k, len(x))), min(k, len(x))) if len(x) else (np.zeros(0, np.uint64), k) for x in self.items]
        self.sizes = sorted({m for s, m in seeds if len(s)})
        self.hash = np.concatenate([s for s, _ in seeds]) if seeds else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(seeds)), [len(s) for s, _ in seeds])
        order = np.lexsort((self.item, self.hash))
        self.hash, self.item = self.hash[order], self.item[order]
        new = np.r_[np.ones(min(1, len(order)), bool), (np.diff(self.hash) != 0) | (np.diff(self.item) != 0)]
        first = np.flatnonzero(new)
        self.hash, self.item, self.times = self.hash[first], self.item[first], np.diff(np.r_[first, len(order)])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hash >> np.uint64(44)] = True

    def find(self, column: pa.Array, least: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, coverage, tiles, words covered) of every pair at or over ``least``."""
        w, n = tokens(column)
        offs = np.r_[0, np.cumsum(n)]
        rows, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k in self.sizes:
            h = windows(w, k)
            at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            row = np.searchsorted(offs, at, "right") - 1
            keep = at + k <= offs[row + 1]
            rows.append(row[keep])
            seeds.append(h[at[keep]])
        row, seed = np.concatenate(rows), np.concatenate(seeds)
        order = np.lexsort((seed, row))
        row, seed = row[order], seed[order]
        once = np.r_[np.ones(min(1, len(row)), bool), (np.diff(row) != 0) | (np.diff(seed) != 0)]
        row, seed = row[once], seed[once]
        lo = np.searchsorted(self.hash, seed, "left")
        size = np.searchsorted(self.hash, seed, "right") - lo
        out = []
        for x, y in _blocks(row, size, CANDIDATES):
            out += self._pairs(w, offs, row[x:y], lo[x:y], size[x:y], least)
        return out

    def _pairs(self, w: np.ndarray, offs: np.ndarray, row: np.ndarray, lo: np.ndarray, size: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pair, back = np.unique(np.repeat(row, size) * max(1, len(self.ids)) + self.item[at], return_inverse=True)
        places = np.bincount(back, weights=self.times[at], minlength=len(pair))  # places in the item whose seed the text has
        out = []
        for p, s in zip(pair.tolist(), places.tolist(), strict=True):
            row, item = divmod(p, len(self.ids))
            x = self.items[item]
            if s * self.k < least * len(x):  # so few seeds can't cover enough
                continue
            tiles = tile(w[offs[row] : offs[row + 1]], x, self.k)
            own = sum(t[2] for t in tiles)
            if own >= least * len(x):
                out.append((row, item, own / len(x), len(tiles), own))
        return out


def _blocks(row: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows whose sizes add up to ``most`` at the utmost, or of one row."""
    begin = np.flatnonzero(np.r_[np.ones(min(1, len(row)), bool), np.diff(row) != 0])
    total = np.r_[0, np.cumsum(size)][np.r_[begin, len(row)]]
    ends = np.r_[begin, len(row)]
    x = 0
    while x < len(begin):
        y = max(x + 1, int(np.searchsorted(total, total[x] + most, "right")) - 1)
        yield int(ends[x]), int(ends[y])
        x = y


FOUND = "coverage double, n_tiles int, n_words int"


def _count_seeds(items: DataFrame, k: int) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch({"n": pa.array(np.maximum(tokens(b.column(0))[1] - k + 1, 1))})

    return items.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def contaminated(docs: DataFrame, items: DataFrame, *, k: int = SEED, least: float = COVERAGE, most: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_words) of every contaminated pair."""
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, {FOUND}"
    if _count_seeds(items, k) > most:
        return _by_shuffle(docs, items, k, least, kinds)
    bench = docs.sparkSession.sparkContext.broadcast(_collect(items, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bench.value
        for b in slices(batches):
            found = own.find(b.column(1), least)
            yield _found(b.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([own.ids[f[1]] for f in found]), found)

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def _collect(items: DataFrame, k: int) -> Bench:
    """Only after the seeds have been counted."""
    rows = items.select("item_id", "text").toArrow()
    return Bench(rows.column("item_id").to_pylist(), rows.column("text"), k)


def _found(doc_ids: pa.Array, item_ids: pa.Array, found: list) -> pa.RecordBatch:
    item_ids = item_ids.cast(pa.int64()) if pa.types.is_null(item_ids.type) else item_ids
    return pa.record_batch({"doc_id": doc_ids, "item_id": item_ids, "coverage": pa.array([f[2] for f in found], pa.float64()), "n_tiles": pa.array([f[3] for f in found], pa.int32()), "n_words": pa.array([f[4] for f in found], pa.int32())})


def _by_shuffle(docs: DataFrame, items: DataFrame, k: int, least: float, kinds: str) -> DataFrame:
    """The same for a benchmark of any size: seeds of both sides meet by a join on their hash."""
    sizes = sorted(r[0] for r in items.select("text").mapInArrow(lambda bs: (pa.record_batch({"n": pa.array(np.unique(np.clip(tokens(b.column(0))[1], 1, k)))}) for b in slices(bs)), "n long").distinct().collect())

    def seeds(table: DataFrame, own: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                w, n = tokens(b.column(1))
                offs = np.r_[0, np.cumsum(n)]
                found = []
                for r in range(len(n)):
                    x = w[offs[r] : offs[r + 1]]
                    ks = ([min(k, len(x))] if len(x) else []) if own else [s for s in sizes if s <= len(x)]
                    found.append(np.unique(np.concatenate([windows(x, s) for s in ks])) if ks else np.zeros(0, np.uint64))
                keys = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(h) for h in found])
                yield pa.record_batch({"key": pa.array(keys, pa.int64()), "seed": pa.array(np.concatenate(found).view(np.int64))})

        return table.select("key", "text").mapInArrow(run, "key long, seed long")

    left = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    right = items.select("item_id", F.col("text").alias("item_text")).withColumn("item_key", F.xxhash64("item_id", "item_text"))
    meet = seeds(left, False).join(seeds(right.select(F.col("item_key").alias("key"), F.col("item_text").alias("text")), True).withColumnRenamed("key", "item_key"), "seed").select("key", "item_key").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            (w, n), (v, m) = tokens(b.column(1)), tokens(b.column(3))
            at, to, found = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(m)], []
            for r in range(len(n)):
                x = v[to[r] : to[r + 1]]
                tiles = tile(w[at[r] : at[r + 1]], x, k)
                own = sum(t[2] for t in tiles)
                if len(x) and own >= least * len(x):
                    found.append((r, r, own / len(x), len(tiles), own))
            take = pa.array([f[0] for f in found], pa.int64())
            yield _found(b.column(0).take(take), b.column(2).take(take), found)

    return meet.join(left, "key").join(right, "item_key").select("doc_id", "text", "item_id", "item_text").mapInArrow(run, kinds)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, k: int = SEED, least: float = COVERAGE, most: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows of ``docs``, all columns, without contaminated ones; in one pass where the benchmark is small."""
    if _count_seeds(items, k) > most:
        key = F.xxhash64("doc_id", "text")  # rows go by their texts, whatever others have their doc_id or none
        bad = contaminated(docs.select(key.alias("doc_id"), "text"), items, k=k, least=least, most=most).select(F.col("doc_id").alias("__bad")).distinct()
        own = free(docs, "__own")
        out = docs.withColumn(own, key)
        return out.join(bad, out[own] == bad["__bad"], "left_anti").drop(own)
    bench = docs.sparkSession.sparkContext.broadcast(_collect(items, k))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = np.ones(b.num_rows, bool)
            keep[[f[0] for f in bench.value.find(b.column(at), least)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
