"""Near duplicates by order MinHash, verified by banded alignment.

Exact copies meet first, by a 128-bit hash of the text; only one text of each goes on. A text's
k-mers are its windows of ``K`` words (lower case, ASCII punctuation parts words), each labelled with its
occurrence number. For each of ``SKETCHES`` seeds the ``MINIMA`` least hashes are taken and hashed
in text order, so texts that agree in a sketch share these k-mers in the same order. A pair is a link if the edit
similarity of its words, 1 - distance / words of the longer, is ``SIMILAR`` or more; the distance is
found by alignment in a band no wider than that allows.

Texts that share a sketch are compared with the leader of their bucket (the least id), so a group of copies
costs one comparison per member. Where a bucket then still has rows of several components, they meet the leaders of
``DEEP_SKETCHES`` sketches of ``DEEP_MINIMA`` k-mers, and what is still apart meets in cells (``met``): a bucket is
a cell, but one of more than ``HOT`` rows has a cell for each rare word instead. Bounds that leave out
no similar pair come before alignments. A cell gives out only links that connect components, fewer than its rows.
So every link between texts that share a sketch is found or joins texts of one class already. Only texts that agree in
their rarest words too and yet aren't similar meet in numbers that grow with the square of their group.
Classes are the connected components of links and copies, found by label propagation over written tables.

Texts of fewer than ``K`` words, null and empty texts have only exact copies (null and empty count as
equal). Repeated rows: each gives its own row of the same class. Only doc_id and text are
read. Class ids are the least doc_id of the class. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import NOT_WORD, discard, flat, free, materialize, mix, ragged, slices, span_hash, spans

K, SKETCHES, MINIMA, SIMILAR = 5, 48, 3, 0.8
#: Deeper sketches beside the others, for texts in groups of several components.
DEEP_SKETCHES, DEEP_MINIMA = 64, 10
#: Keys that the rows of one leader are dealt over.
PARTS = 64
#: Rows and words of a cell that meet at once, and hashes of words by which their distance is bounded.
BLOCK, BLOCK_WORDS, BINS = 256, 1 << 20, 1024
#: Buckets of more rows meet by their rarest words instead.
HOT = 4096
#: Words compared at a step of an alignment, and places on diagonals that are held at once.
STRIDE, CELLS = 8, 1 << 20
_B = np.uint64(0x100000001B3)


def kmers(w: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled k-mer hashes in text order, k-mers by row)."""
    own = np.maximum(counts - k + 1, 0)
    offs = np.r_[0, np.cumsum(counts)]
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        h = h * _B + w[j : j + len(h)]
    row = np.repeat(np.arange(len(counts)), own)
    h = h[np.arange(len(row)) + np.repeat(offs[:-1] - (np.cumsum(own) - own), own)] if len(row) else h[:0]
    # the occurrence number: the place among equal hashes of the same row
    key = mix(h ^ mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    nth = np.empty(len(s), np.uint64)
    nth[order] = np.arange(len(s)) - np.repeat(begin, np.diff(np.r_[begin, len(s)]))
    return mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), own


def sketches(h: np.ndarray, own: np.ndarray, n: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """An (rows with k-mers) x n table of order sketches."""
    size = own[own > 0]
    out = np.zeros((len(size), n), np.uint64)
    if not len(size):
        return out
    begin = np.cumsum(size) - size
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 32) - 1)
    for s in range(n):
        seed = np.uint64((2 * s + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))
        # 32 bits of hash above the place: the least of these are the minima, with where they stand
        x = h * seed
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x = (x & ~low) | place
        at = np.empty((len(size), minima), np.int64)
        for m in range(minima):
            least = np.minimum.reduceat(x, begin)
            p = (least & low).astype(np.int64)
            gone = least == top
            p[gone] = -1
            at[:, m] = p
            x[p[~gone]] = top
        at.sort(axis=1)
        v = np.zeros(len(size), np.uint64)
        for m in range(minima):
            v = mix(v * _B ^ np.where(at[:, m] >= 0, h[at[:, m]], np.uint64(m + 1)))
        out[:, s] = mix(v ^ np.uint64(s))
    return out


def distances(w: np.ndarray, sa: np.ndarray, la: np.ndarray, sb: np.ndarray, lb: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The edit distances of pairs of word sequences w[start : start + length], or most + 1 where it is more.

    All pairs take their steps together: furthest-reaching places on a band of diagonals no wider than ``most``.
    """
    swap = la > lb
    sa, sb, la, lb = np.where(swap, sb, sa), np.where(swap, sa, sb), np.minimum(la, lb), np.maximum(la, lb)
    d, out = lb - la, most + 1
    padded = np.concatenate([w, np.zeros(STRIDE, w.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, STRIDE)

    def slide(p: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Each place in the first sequence moved on along its diagonal while words agree."""
        i, j = i.copy(), i + k
        # most places don't move: the first words settle that
        at = np.flatnonzero((i < la[p]) & (j < lb[p]) & (padded[sa[p] + i] == padded[sb[p] + j]))
        while len(at):
            q, x = p[at], i[at]
            y = x + k[at]
            same = view[sa[q] + x] == view[sb[q] + y]
            run = np.where(same.all(1), STRIDE, same.argmin(1))
            run = np.minimum(run, np.minimum(la[q] - x, lb[q] - y))
            i[at] += run
            at = at[run == STRIDE]
        return i

    live, e = np.flatnonzero(d <= most), 0
    mid = int(most.max(initial=0)) + 2
    far = np.full((len(d), 2 * mid + 1), -(1 << 40), np.int64)
    far[live, mid] = slide(live, np.zeros(len(live), np.int64), np.zeros(len(live), np.int64))
    while len(live):
        there = far[live, mid + d[live]] >= la[live]
        out[live[there]] = e
        e += 1
        live = live[~there & (most[live] >= e)]
        # beyond these diagonals what is left to the end takes more than is left of most
        lo, hi = np.maximum(-e, d[live] - (most[live] - e)), np.minimum(e, d[live] + most[live] - e)
        p, k = np.repeat(live, hi - lo + 1), ragged(lo, hi - lo + 1)
        i = np.maximum(far[p, mid + k - 1], np.maximum(far[p, mid + k], far[p, mid + k + 1]) + 1)
        i = np.minimum(i, np.minimum(la[p], lb[p] - k))
        ok = (i >= 0) & (i + k >= 0)
        p, k = p[ok], k[ok]
        far[p, mid + k] = slide(p, i[ok], k)
    return out


def bags(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many words of each row have each of ``BINS`` hashes, a byte each, 255 at most."""
    place = np.repeat(np.arange(len(n)) * BINS, n) + (w % np.uint32(BINS)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=len(n) * BINS), 255).astype(np.uint8).reshape(-1, BINS)


def bound(bag: np.ndarray, total: np.ndarray, p: np.ndarray | int, q: np.ndarray) -> np.ndarray:
    """No more than the distance of rows p and q: the words not in common once they are hashed into bins."""
    return np.maximum(total[q], total[p]) - np.minimum(bag[q], bag[p]).sum(1, dtype=np.int64)


def allowed(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """The largest distance of similar texts of x and y words."""
    return (np.maximum(x, y) * (1 - least) + 1e-9).astype(np.int64)


def similar(w: np.ndarray, begin: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """Whether 1 - distance / longer length of rows p and q is ``least`` or more, by alignment; many at a time, of like length."""
    out, most = np.zeros(len(p), bool), allowed(n[p], n[q], least)
    order = np.argsort(most, kind="stable")
    cells = np.cumsum(2 * most[order] + 5)
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(cells, (cells[lo - 1] if lo else 0) + CELLS, "right")))
        at = order[lo:hi]
        out[at] = distances(w, begin[p[at]], n[p[at]], begin[q[at]], n[q[at]], most[at]) <= most[at]
        lo = hi
    return out


TEXT = "t1 long, t2 long"


def text_keys() -> tuple[Column, Column]:
    """The 128-bit hash of a text, null as empty."""
    x = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(x), F.xxhash64(F.lit(1), x)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n, sketch) of every row: the text's hash, its words, and its sketches packed as bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            column = b.column(1).fill_null("")
            data, offs = flat(pc.utf8_lower(column))
            starts, ends, counts = spans(data, offs, NOT_WORD)
            h, own = kmers(span_hash(data, starts, ends), counts)
            s = sketches(h, own)
            packed, at = [b""] * len(counts), np.flatnonzero(own > 0)
            for r, row in zip(at.tolist(), s, strict=True):
                packed[r] = row.tobytes()
            yield pa.record_batch({"doc_id": b.column(0), "t1": b.column(2), "t2": b.column(3), "n": pa.array(counts, pa.int32()), "sketch": pa.array(packed, pa.binary())})

    x, y = text_keys()
    return docs.select("doc_id", "text", x.alias("t1"), y.alias("t2")).mapInArrow(run, f"doc_id {kind}, {TEXT}, n int, sketch binary")


def shared(rows: DataFrame) -> DataFrame:
    """(bucket, s, id, n) with the bucket's leader and its length, for buckets of more than one."""
    many = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("first")).filter("size > 1").select("bucket", F.col("first.id").alias("leader"), F.col("first.n").alias("leader_n"))
    return rows.join(many, "bucket")


def buckets(texts: DataFrame) -> DataFrame:
    """A row for each sketch (the ``s``-th) of each text, where others share it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            s = np.frombuffer(b"".join(raw), np.int64)
            times = np.array([len(r) // 8 for r in raw], np.int64)
            yield pa.record_batch({"bucket": pa.array(s), "s": pa.array(ragged(np.zeros_like(times), times).astype(np.int16)), "id": pa.array(np.repeat(b.column(0).to_numpy(), times)), "n": pa.array(np.repeat(b.column(1).to_numpy(), times))})

    return shared(texts.select("id", "n", "sketch").filter("n >= " + str(K)).mapInArrow(run, "bucket long, s short, id long, n int"))


def deep_buckets(words: DataFrame) -> DataFrame:
    """The same by sketches of ``DEEP_MINIMA`` k-mers, from the words themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words"):
            w, counts = packed(b.column(1))
            s = sketches(*kmers(w.astype(np.uint64), counts), DEEP_SKETCHES, DEEP_MINIMA)
            yield pa.record_batch({"bucket": pa.array(s.ravel().view(np.int64)), "id": pa.array(np.repeat(b.column(0).to_numpy(), DEEP_SKETCHES)), "n": pa.array(np.repeat(counts, DEEP_SKETCHES), pa.int32())})

    return shared(words.select("id", "words").mapInArrow(run, "bucket long, id long, n int"))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the word hashes of all rows in order, words by row) of a column of packed words."""
    data, offs = flat(column)
    return np.frombuffer(data.tobytes(), np.uint32), np.diff(offs) // 4


def fitting(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): each row's leader and the row, if their lengths allow a link."""
    return rows.filter("id <> leader").filter(F.least("n", "leader_n") >= F.greatest("n", "leader_n") * least - 1e-9).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()


def verify(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The similar ones of (a, b). What meets one ``a`` is dealt over ``PARTS`` keys, and the words of ``a`` go once to each."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    heads = pairs.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("id")).distinct()
    # merged at every size, for words don't fit a broadcast at scale
    all_words = heads.unionByName(pairs.select("a", "part", "b", F.col("b").alias("id"))).hint("merge").join(words, "id")
    dealt = all_words.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint32)  # the words that the rows of this slice meet before its first head
        for b in slices(batches, "words"):
            w, n = packed(b.column(3))
            w, n = np.r_[head, w], np.r_[len(head), n]
            begin = np.cumsum(n) - n
            q = 1 + np.flatnonzero(b.column(2).is_valid())
            heads = np.r_[0, 1 + np.flatnonzero(b.column(2).is_null())]
            p = heads[np.searchsorted(heads, q) - 1]
            head = w[begin[heads[-1]] : begin[heads[-1]] + n[heads[-1]]].copy()
            bag = bags(w, n)
            fit = bound(bag, bag.sum(1, dtype=np.int64), p, q) <= allowed(n[p], n[q], least)
            q = q[fit][similar(w, begin, n, p[fit], q[fit], least)] - 1
            yield pa.record_batch([b.column(0).take(pa.array(q)), b.column(2).take(pa.array(q))], names=["a", "b"])

    return dealt.select("a", "part", "b", "words").mapInArrow(run, "a long, b long")


def word_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, words) of the wanted (t1, t2, id): 32-bit word hashes packed as bytes."""
    x, y = text_keys()
    rows = docs.select("doc_id", "text", x.alias("t1"), y.alias("t2")).join(wanted.hint("merge"), (F.col("doc_id").eqNullSafe(F.col("copy_of"))) & (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2"))).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offs = flat(pc.utf8_lower(b.column(1).fill_null("")))
            starts, ends, counts = spans(data, offs, NOT_WORD)
            raw = (span_hash(data, starts, ends) >> np.uint64(32)).astype(np.uint32).tobytes()
            at = np.r_[0, np.cumsum(counts)] * 4
            yield pa.record_batch({"id": b.column(0), "words": pa.array([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})

    return rows.mapInArrow(run, "id long, words binary")


def apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, s, id, n, root, size, total) of buckets whose rows are of several components; of buckets with the same rows, that of least ``s``."""
    rows = rows.select("bucket", "s", "id", "n").join(groups, "id", "left").select("bucket", "s", "id", "n", F.coalesce("root", "id").alias("root"))
    many = rows.groupBy("bucket", "s").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).filter("lo <> hi")
    one = many.groupBy("size", "total", "x", "y").agg(F.min(F.struct("s", "bucket")).alias("k"))
    return rows.join(one.select(F.col("k.bucket").alias("bucket"), "size", "total"), "bucket")


def by_rare_words(rows: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Rows of hot buckets again, once for each of their rarest words, as cells of their own.

    Similar texts have all but ``1 - least`` of their words in common, so they share one of as many and one more of
    each one's rarest words (by how many rows of the bucket have them, occurrences counted apart); no link is lost.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", 1 << 20):
            w, n = packed(b.column(5))
            nth, _ = kmers(w.astype(np.uint64), n, 1)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.record_batch([*(b.column(k).take(row) for k in range(5)), pa.array(nth.view(np.int64))], names=["bucket", "s", "id", "n", "root", "w"])

    each = materialize(rows.join(words, "id").select("bucket", "s", "id", "n", "root", "words").mapInArrow(run, "bucket long, s short, id long, n int, root long, w long"))
    often = materialize(each.groupBy("bucket", "w").agg(F.count("*").alias("c")).filter("c > 1"))
    place = F.row_number().over(Window.partitionBy("bucket", "id").orderBy(F.coalesce("c", F.lit(1)), "w"))
    first = each.join(often, ["bucket", "w"], "left").withColumn("place", place).filter((F.col("place") <= F.floor(F.col("n") * (1 - least) + 1e-9) + 1) & F.col("c").isNotNull())
    cells = materialize(first.select(F.col("bucket").alias("of"), "s", "id", "n", "root", F.xxhash64("bucket", "w").alias("bucket")))
    discard(each, often)
    return apart(cells, cells.select("id", "root").distinct()).join(cells.select("bucket", "of").distinct(), "bucket")


def met(rows: DataFrame, texts: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(a, b) of links that connect all similar rows of a cell; rows of one component aren't compared again.

    Large cells are dealt into blocks of bounded rows and words that meet two by two. Pairs within the bound are aligned, the likeliest
    first, and those that have become connected are left out; a pair that shares several buckets is looked at in the first.
    """
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_WORDS)).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    # a block meets itself once, so rows of one block and another have keys of their own
    key = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    own = own.select(key.alias("key"), side.alias("side"), "of", "s", "id", "root")
    data = texts.select("id", "sketch").join(words, "id")
    dealt = own.join(data, "id").repartition("key").sortWithinPartitions("key", "id").select("key", "side", "of", "s", "id", "root", "sketch", "words")

    def cell(t: pa.Table) -> list[tuple[int, int]]:
        side, of, s, ids, root = (t.column(k).to_numpy() for k in range(1, 6))
        sketch = np.frombuffer(flat(t.column(6))[0].tobytes(), np.int64).reshape(len(ids), -1)
        w, n = packed(t.column(7))
        begin, bag = np.cumsum(n) - n, bags(w, n)
        total = bag.sum(1, dtype=np.int64)
        few = np.minimum(bag.reshape(len(ids), 8, -1).sum(1), 255).astype(np.uint8)  # eight bins in one: looser, and quicker
        few_total = few.sum(1, dtype=np.int64)
        _, name = np.unique(root, return_inverse=True)
        later, pairs = np.arange(len(ids)) if side[0] == 2 else np.flatnonzero(side == 1), []
        for p in range(len(ids)) if side[0] == 2 else np.flatnonzero(side == 0).tolist():
            q = later[p + 1 :] if side[0] == 2 else later
            q = q[name[q] != name[p]]
            q = q[np.abs(n[q] - n[p]) <= allowed(n[q], n[p], least)]
            q = q[bound(few, few_total, p, q) <= allowed(n[q], n[p], least)]
            gap = bound(bag, total, p, q)
            fit = gap <= allowed(n[q], n[p], least)
            q, gap = q[fit], gap[fit]
            if len(q):
                same = sketch[q] == sketch[p]
                fit = (same.argmax(1) == s[0]) & same.any(1)
                pairs.append((np.full(int(fit.sum()), p), q[fit], gap[fit]))
        if not pairs:
            return []
        p, q, gap = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order, found = np.argsort(gap, kind="stable"), []
        p, q = p[order], q[order]
        at, step = 0, 64
        while at < len(p):
            a, b = p[at : at + step], q[at : at + step]
            new = name[a] != name[b]
            a, b = a[new], b[new]
            ok = similar(w, begin, n, a, b, least)
            for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                if name[i] != name[j]:
                    name[name == name[i]] = name[j]
                    found.append((int(ids[i]), int(ids[j])))
            at, step = at + step, min(4 * step, 4096)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in itertools.chain(slices(batches, "words"), [None]):
            held += [] if b is None else [b]
            if not held or b is not None and held[0].column(0)[0] == b.column(0)[b.num_rows - 1]:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            edge = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, *([len(key)] if b is None else [])].tolist()
            found = [x for lo, hi in itertools.pairwise(edge) if hi > lo + 1 for x in cell(t.slice(lo, hi - lo))]
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
            held = t.slice(edge[-1]).to_batches()

    return dealt.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, texts: DataFrame, least: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """(a, b) of edges between different texts that connect all that share a sketch and are similar."""
    rows = materialize(buckets(texts))
    wanted = materialize(rows.select("id").distinct().join(texts.select("id", "copy_of", F.col("t1").alias("w1"), F.col("t2").alias("w2")), "id"))
    words = materialize(word_table(docs, wanted).dropDuplicates(["id"]))
    found = materialize(verify(fitting(rows, least), words, least))
    groups = materialize(components(found))
    # what leaders don't decide: rows of a bucket in different components, linked with the leader or not
    left = materialize(apart(rows, groups))
    some = materialize(words.join(left.select("id").distinct(), "id", "left_semi"))
    discard(rows, wanted, words)
    # leaders of deeper sketches first connect what is most alike
    root = groups.select(F.col("id").alias("b"), "root")
    deep = fitting(deep_buckets(some), least).join(root, "b", "left").withColumnRenamed("root", "rb")
    deep = deep.join(root.withColumnRenamed("b", "a"), "a", "left").filter(~F.coalesce("root", "a").eqNullSafe(F.coalesce("rb", "b")))
    found = found.unionByName(materialize(verify(deep.select("a", "b"), some, least)))
    groups = materialize(components(found))
    left = materialize(apart(left, groups).withColumn("of", F.col("bucket")))
    if (many := left.filter(F.col("size") > hot).select("bucket", "s", "id", "n", "root")).isEmpty():
        return found.unionByName(materialize(met(left, texts, some, least)))
    cells = materialize(left.filter(F.col("size") <= hot).unionByName(by_rare_words(many, some, least)))
    return found.unionByName(materialize(met(cells, texts, some, least)))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges: the least id that it is connected with, by large-star and small-star steps."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below has no other task in its stage and Spark may split a hub's edges
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("x"), "m").distinct()
        # each node with its smaller neighbours: all of them, and the node, point to the least
        least = large.groupBy("x").agg(F.min("m").alias("r"))
        small = large.join(least, "x").select(F.explode(F.array("x", "m")).alias("b"), F.col("r").alias("a")).filter("a <> b").distinct()
        old, edges = edges, materialize(small.select("a", "b"))
        discard(old, low)
        now = mark(edges)
        if now == was:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        was = now


def grouped(docs: DataFrame, least: float, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2) of every row, written, and (t1, t2, copy_of, root) of every text."""
    rows = materialize(copies(docs))
    keyed = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("copy_of"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    # texts have ids of their own: doc_ids may be null, or the same for several texts
    texts = materialize(keyed.withColumn("id", F.monotonically_increasing_id()))
    group = components(links(docs, texts, least, hot))
    return rows, texts.select("t1", "t2", "copy_of", "id").join(group, "id", "left").select("t1", "t2", "copy_of", F.coalesce("root", "id").alias("root"))


def classes(docs: DataFrame, least: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, copy_of) of every row: its class, and the least doc_id with exactly its text; null where all are null."""
    rows, texts = grouped(docs, least, hot)
    texts = materialize(texts)
    # written, so that Spark may split the texts of a large class in the join
    named = texts.join(materialize(texts.groupBy("root").agg(F.min("copy_of").alias("class_id"))), "root")
    return rows.select("doc_id", "t1", "t2").join(named, ["t1", "t2"]).select("doc_id", "class_id", "copy_of")


def one_of_each(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row of each class of ``docs``, all columns: of the least doc_id, null only where all are null."""
    rows, texts = grouped(docs, least)
    own = rows.select("doc_id", "t1", "t2").join(texts.select("t1", "t2", "root"), ["t1", "t2"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("k")
    keep = materialize(own.groupBy("root").agg(first).select(F.col("k.doc_id").alias("__id"), F.col("k.t1").alias("__t1"), F.col("k.t2").alias("__t2")))
    x, y = text_keys()
    p, q = free(docs, "__x"), free(docs, "__y")
    out = docs.withColumns({p: x, q: y})
    out = out.join(keep, out["doc_id"].eqNullSafe(keep["__id"]) & (out[p] == keep["__t1"]) & (out[q] == keep["__t2"]), "left_semi")
    twice = own.join(keep, own["doc_id"].eqNullSafe(keep["__id"]) & (own["t1"] == keep["__t1"]) & (own["t2"] == keep["__t2"]), "left_semi").count() > keep.count()
    return (out.dropDuplicates(["doc_id", p, q]) if twice else out).drop(p, q)
