"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) P(cell | class, context) P(word | cell). Each of the ``TOP`` most frequent training
words is a class of its own; the other words fall into ``FORMS`` classes by the hash of their ending, so
unknown words have a class too, and the words of a class fall into ``CELLS`` cells by their hash. Both the class and the cell
have a softmax over rows of weights that hashed features choose, trained by gradients. The class's features are the
previous word, the word before it (a skip), the classes of both, and the classes of the two words before those;
the cell's are the previous word and the skipped one, each with the class. Within a cell, known words have their discounted
share of training tokens, and the discount goes to unknown words. All probabilities sum to 1 over known
words and, by cell, unknown ones. A softmax over all words of a class would cost as many steps a token as the class has words,
and words by the hundred thousand occur once, so a word's share of its cell has no features.

Word counts are one Spark aggregation. Training takes every training text once, in ``ROUNDS``: each task
updates the weights by minibatch gradients on its texts, and the changed rows are averaged
over tasks, weighted by how often a row was used. Scoring deals rows evenly into lanes, a partition each; a lane's distinct
words are joined with the counts, and both meet in a cogroup, so no table of words goes to one place.

null and empty texts hold the end token alone. Repeated rows: each counts and gives its own row.
Without training texts every word is unknown. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANK, LOWER, flat, materialize, slices, span_hash, spans

TOP, FORMS, CELL_BITS, ROUNDS = 16, 48, 5, 2
CELLS = 1 << CELL_BITS
CLASSES = TOP + FORMS
WORD_ROWS, CELL_ROWS = 1 << 14, 1 << 15
PAIR_ROWS = CLASSES * CLASSES
#: Rows and width of the two tables of weights: of classes, and of cells.
SHAPES = ((2 * WORD_ROWS + 2 * PAIR_ROWS, CLASSES), (2 * CELL_ROWS, CELLS))
TABLE = 1 << 20  # numbers of blocks of rows that one table may have
BATCH, RATE = 8192, 0.5
PART, FEW = 1024, 16  # tokens at a time within a batch, rows of weights that are summed one by one
LANE_BYTES, TASK_BYTES = 24 << 20, 16 << 20
MERGE = 256  # rows of weights that are averaged together
#: The end of a text as a word.
END = np.uint64(0x5EED0FE2D0000001)
Weights = tuple[np.ndarray, np.ndarray]
_EDGE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = LOWER.tobytes()
#: The class of an ending, by its last byte and the one before it (0 where the word has one byte).
_FORM = (((np.arange(256, dtype=np.uint64)[:, None] * np.uint64(257) + np.arange(256, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FORMS)).astype(np.int16)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with an end after each text, ending classes, tokens by row)."""
    data, offs = flat(column)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    starts, ends, counts = spans(data, offs, BLANK)
    h = span_hash(data, starts, ends)
    last = ends.copy()
    at = np.flatnonzero(_EDGE[data[last - 1]])
    for _ in range(3):  # signs after a word don't belong to its ending
        at = at[last[at] - 1 > starts[at]]
        last[at] -= 1
        at = at[_EDGE[data[last[at] - 1]]]
    form = _FORM[data[last - 1], np.where(last - 2 >= starts, data[np.maximum(last - 2, 0)], 0)] if len(last) else np.zeros(0, np.int16)
    total = counts + 1
    at = np.cumsum(total) - 1
    out, kind = np.empty(len(h) + len(counts), np.uint64), np.zeros(len(h) + len(counts), np.int16)
    own = np.ones(len(out), bool)
    own[at] = False
    out[own], kind[own], out[at] = h, form, END
    return out, kind, total


def classes(h: np.ndarray, form: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The class of each word. top: (hash, class) of the frequent ones, sorted by hash."""
    out = form.astype(np.int32) + TOP
    if len(top):
        keys = top["h"]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        out[hit] = top["k"][at[hit]]
    return out


class Places:
    """Where words stand among sorted distinct ones: the first bits of a hash say where to begin, and few stand before it there."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.shift = keys, np.uint64(64 - max(1, len(keys).bit_length()))
        self.begin = np.searchsorted(keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """As searchsorted gives it for words that are there; for others a place whose word is another, if there is one."""
        if not len(self.keys):
            return np.zeros(len(h), np.int32)
        at = np.minimum(self.begin[(h >> self.shift).astype(np.int64)], len(self.keys) - 1)
        rest = np.flatnonzero(self.keys[at] < h)
        for _ in range(8):
            at[rest] += 1
            rest = rest[at[rest] < len(self.keys)]
            rest = rest[self.keys[at[rest]] < h[rest]]
        at[rest] = np.searchsorted(self.keys, h[rest])
        return np.minimum(at, len(self.keys) - 1)


def rows_of(h: np.ndarray, k: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of weights that each token's context chooses: four for its class, and two for its cell."""
    n = len(h)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)

    def back(x: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[j:] = x[:-j] if j else x
        out[place < j] = 0
        return out

    spread = np.uint64(0x9E3779B97F4A7C15)
    one, two = back(h, 1) * spread, back(h, 2) * spread
    out, cell = np.empty((n, 4), np.int32), np.empty((n, 2), np.int32)
    out[:, 0] = one >> np.uint64(64 - 14)
    out[:, 1] = (two >> np.uint64(64 - 14)).astype(np.int32) + WORD_ROWS
    out[:, 2] = back(k, 1) * CLASSES + back(k, 2) + 2 * WORD_ROWS
    out[:, 3] = back(k, 3) * CLASSES + back(k, 4) + 2 * WORD_ROWS + PAIR_ROWS
    own = (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for j, x in enumerate((one, two)):
        cell[:, j] = ((x ^ own) * spread >> np.uint64(64 - 15)).astype(np.int32) + j * CELL_ROWS
    return out, cell


def cells(h: np.ndarray) -> np.ndarray:
    """The cell of each word: the first bits of its hash."""
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int32)


def cell_of(h: Column) -> Column:
    """``cells`` of a column."""
    return F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int")


def zeros() -> Weights:
    return tuple(np.zeros(s, np.float32) for s in SHAPES)


class Logits:
    """The sums of the weights that tokens choose, in arrays that are used again: new ones of this size would be mapped and cleared by the system each time."""

    def __init__(self) -> None:
        self.held, self.part = np.empty(BATCH * max(CLASSES, CELLS), np.float32), np.empty(PART * max(CLASSES, CELLS), np.float32)

    def of(self, w: np.ndarray, bias: np.ndarray, rows: np.ndarray, kind: np.ndarray | None) -> Iterator[tuple[slice, np.ndarray]]:
        """(tokens, their logits) in parts that the processor's cache holds, which together are ``all_of``. ``bias``: a row, or with ``kind`` one for each kind of token."""
        for lo in range(0, len(rows), PART):
            at = slice(lo, min(lo + PART, len(rows)))
            z, x = (y[: (at.stop - lo) * w.shape[1]].reshape(-1, w.shape[1]) for y in (self.held[lo * w.shape[1] :], self.part))
            w.take(rows[at, 0], axis=0, out=z, mode="clip")  # other modes copy once more
            for j in range(1, rows.shape[1]):
                z += w.take(rows[at, j], axis=0, out=x, mode="clip")
            z += bias if kind is None else bias.take(kind[at], axis=0, out=x, mode="clip")
            yield at, z

    def all_of(self, n: int, width: int) -> np.ndarray:
        return self.held[: n * width].reshape(n, width)


def exponents(z: np.ndarray) -> np.ndarray:
    """exp(z) in place; gives the sums by row. ``shifted`` comes first."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def shifted(z: np.ndarray) -> np.ndarray:
    """z less each row's greatest, in place, where any exponential could overflow or vanish; else z as it is, which has the same softmax."""
    if not (z.max() < 60 and z.min() > -60):
        z -= z.max(1, keepdims=True)
    return z


def own_of(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of each row's k-th in z's values one after the other."""
    return np.arange(0, z.size, z.shape[1]) + k


def log_share(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each row's k-th; z is overwritten."""
    own = shifted(z).ravel()[own_of(z, k)].astype(float)
    return own - np.log(exponents(z), dtype=float)


def whole_rows(x: np.ndarray) -> np.ndarray:
    """x with each row as one value, which numpy puts in place faster than a row of numbers."""
    return x.view(f"V{x.itemsize * x.shape[1]}").ravel()


def sums_by_row(z: np.ndarray, rows: np.ndarray, held: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, how often each is chosen, sums of z over the tokens that chose it) in parts, each row once; the sums lie in ``held`` and go with the next part. ``part``: another such array."""
    chosen = rows.ravel().astype(np.uint16)  # a table has 2^16 rows at most, and numpy sorts short integers by their digits
    order = np.argsort(chosen, kind="stable")
    s = chosen[order]
    token = order // rows.shape[1]
    begin = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s))
    size = np.diff(begin)
    by = np.argsort((len(s) - size).astype(np.uint16), kind="stable")
    begin, size, width = begin[by], size[by], z.shape[1]
    for lo in range(0, len(by), PART):
        first, left = begin[lo : lo + PART], size[lo : lo + PART]
        g, x = (y[: len(first) * width].reshape(-1, width) for y in (held, part))
        z.take(token[first], axis=0, out=g, mode="clip")
        # the second token of each row that has one, then the third, and so on, as long as many rows have one: few calls
        done, n = 1, int(np.searchsorted(-left, -1))
        while n > FEW:
            g[:n] += z.take(token[first[:n] + done], axis=0, out=x[:n], mode="clip")
            done += 1
            n = int(np.searchsorted(-left[:n], -done))
        for r in range(n):
            g[r] += z.take(token[first[r] + done : first[r] + left[r]], axis=0).sum(0)
        yield s[first], left, g


class Trainer:
    """Minibatch gradient steps with a rate that falls for each row as its gradients add up."""

    def __init__(self, w: Weights) -> None:
        self.w, self.first = tuple(x.copy() for x in w), w
        self.sum = tuple(np.full(len(x), 1e-3, np.float32) for x in w)
        self.used = tuple(np.zeros(len(x), np.float32) for x in w)
        self.logits, self.sums = Logits(), np.empty(PART * max(CLASSES, CELLS), np.float32)

    def step(self, t: int, rows: np.ndarray, k: np.ndarray, bias: np.ndarray, kind: np.ndarray | None = None) -> None:
        """In the table of classes (0) or of cells (1), for ``BATCH`` tokens at most. ``bias``, ``kind``: as in ``Logits.of``."""
        for at, z in self.logits.of(self.w[t], bias, rows, kind):
            total = exponents(shifted(z))
            z *= (1 / total)[:, None]
            z.ravel()[own_of(z, k[at])] -= 1
        w, part = whole_rows(self.w[t]), self.logits.part
        for own, size, g in sums_by_row(self.logits.all_of(len(k), SHAPES[t][1]), rows, self.sums, part):
            self.used[t][own] += size
            total = self.sum[t][own] + np.einsum("ij,ij->i", g, g)
            self.sum[t][own] = total
            g *= (RATE / np.sqrt(total))[:, None]
            new = self.w[t].take(own, axis=0, out=part[: g.size].reshape(g.shape), mode="clip")
            new -= g
            w.put(own, whole_rows(new))

    def learn(self, h: np.ndarray, k: np.ndarray, counts: np.ndarray, bias: np.ndarray, cell_bias: np.ndarray) -> None:
        """Steps over the tokens of some texts: all of them for the class, those of classes of many words for the cell."""
        rows, cell_rows = rows_of(h, k, counts)
        for lo in range(0, len(k), BATCH):
            self.step(0, rows[lo : lo + BATCH], k[lo : lo + BATCH], bias)
        rest = np.flatnonzero(k >= TOP)
        cell = cells(h)
        for lo in range(0, len(rest), BATCH):
            at = rest[lo : lo + BATCH]
            self.step(1, cell_rows[at], cell[at], cell_bias, k[at])

    def changed(self) -> Iterator[pa.RecordBatch]:
        """(block, used, delta): the change of each block of rows, as half floats, with how often they were used."""
        for t, block in ((t, b) for t, (rows, _) in enumerate(SHAPES) for b in range(-(-rows // MERGE))):
            at = slice(block * MERGE, (block + 1) * MERGE)
            used = self.used[t][at]
            own = np.flatnonzero(used)
            if len(own):
                delta = (self.w[t][at] - self.first[t][at])[own].astype(np.float16)
                block += t * TABLE
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "part": pa.array([0], pa.int32()), "own": pa.array([own.astype(np.uint8).tobytes()], pa.binary()), "used": pa.array([used[own].tobytes()], pa.binary()), "delta": pa.array([delta.tobytes()], pa.binary())})


CHANGE = "block int, part int, own binary, used binary, delta binary"


def merged(key: tuple, table: pa.Table) -> pa.Table:
    """The used-weighted mean of a block's changes; one row again."""
    width = SHAPES[key[0].as_py() // TABLE][1]
    total, used = np.zeros((MERGE, width), np.float32), np.zeros(MERGE, np.float32)
    for own, n, delta in zip(*(table.column(c).to_pylist() for c in ("own", "used", "delta")), strict=True):
        at, n = np.frombuffer(own, np.uint8), np.frombuffer(n, np.float32)
        total[at] += np.frombuffer(delta, np.float16).reshape(-1, width).astype(np.float32) * n[:, None]
        used[at] += n
    at = np.flatnonzero(used)
    mean = (total[at] / used[at][:, None]).astype(np.float16)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "own": pa.array([at.astype(np.uint8).tobytes()], pa.binary()), "used": pa.array([used[at].tobytes()], pa.binary()), "delta": pa.array([mean.tobytes()], pa.binary())})


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, form, c) of every word of the texts, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def folded() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, f, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)  # equal words have equal endings, so any order of them does
            h = h[order]
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return h[begin], f[order][begin], np.add.reduceat(c[order], begin)

        for b in slices(batches, "text"):
            h, form, _ = tokens(b.column(0))
            held.append((h, form, np.ones(len(h), np.int64)))
            held[-1:] = [folded()] if len(held) == 1 else held[-1:]
            if sum(len(x[0]) for x in held) > 1_500_000:
                held[:] = [folded()]
                if len(held[0][0]) > 1_000_000:
                    yield pa.record_batch({"h": pa.array(held[0][0].view(np.int64)), "form": pa.array(held[0][1], pa.int16()), "c": pa.array(held[0][2])})
                    held.clear()
        if held:
            h, f, c = folded()
            yield pa.record_batch({"h": pa.array(h.view(np.int64)), "form": pa.array(f, pa.int16()), "c": pa.array(c)})

    rows = docs.select("text").mapInArrow(run, "h long, form short, c long")
    return materialize(rows.groupBy("h").agg(F.min("form").alias("form"), F.sum("c").alias("c")))


def fit(docs: DataFrame, top: np.ndarray, bias: np.ndarray, cell_bias: np.ndarray, size: int) -> Weights:
    """The weights after every text has been taken once. ``size``: bytes of text, some; a task takes ``TASK_BYTES`` of them or more, as each gives out its changes."""
    spark = docs.sparkSession
    w = zeros()
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((w, bias, cell_bias, top))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, bias, cell_bias, top = shared.value
            own = Trainer(first)
            for b in slices(batches, "text"):
                h, form, n = tokens(b.column(0))
                own.learn(h, classes(h, form, top), n, bias, cell_bias)
            yield from own.changed()

        part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(ROUNDS)) == turn).select("text")
        few = max(spark.sparkContext.defaultParallelism, size // ROUNDS // TASK_BYTES)
        part = part.coalesce(few) if part.rdd.getNumPartitions() > few else part
        tasks = max(1, part.rdd.getNumPartitions())
        salts = int(np.ceil(np.sqrt(tasks)))
        change = part.mapInArrow(run, CHANGE).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(salts)))
        half = change.groupBy("block", "part").applyInArrow(merged, CHANGE)
        done = half.groupBy("block").applyInArrow(lambda key, t: merged(key, t), CHANGE).select("block", "own", "delta").toArrow()
        w = tuple(x.copy() for x in w)
        for block, own, delta in zip(*(done.column(c).to_pylist() for c in ("block", "own", "delta")), strict=True):
            t, k = divmod(block, TABLE)
            w[t][k * MERGE + np.frombuffer(own, np.uint8).astype(np.int64)] += np.frombuffer(delta, np.float16).reshape(-1, SHAPES[t][1])
        shared.unpersist()
    return w


def log_word(w: Weights, bias: np.ndarray, cell_bias: np.ndarray, h: np.ndarray, k: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The natural logarithm of P(class | context) P(cell | class, context) of each token; a frequent word's class has no cells."""
    rows, cell_rows = rows_of(h, k, counts)
    out, sums = np.empty(len(h)), Logits()
    for lo in range(0, len(k), BATCH):
        own = slice(lo, lo + BATCH)
        for at, z in sums.of(w[0], bias, rows[own], None):
            out[own][at] = log_share(z, k[own][at])
    rest, cell = np.flatnonzero(k >= TOP), cells(h)
    for lo in range(0, len(rest), BATCH):
        own = rest[lo : lo + BATCH]
        for at, z in sums.of(w[1], cell_bias, cell_rows[own], k[own]):
            out[own[at]] += log_share(z, cell[own[at]])
    return out


def word_share(c: np.ndarray, k: np.ndarray, cell: np.ndarray, size: np.ndarray, types: np.ndarray, discount: float) -> np.ndarray:
    """P(word | class, cell) of words that occur c times in training texts; of unknown ones together where c is 0."""
    in_cell = size[k, cell]
    d = np.where(k < TOP, 0.0, discount)
    known = c - d
    unknown = np.where(in_cell > 0, discount * types[k, cell], 1)
    return np.where(c > 0, known, unknown) / np.maximum(in_cell, 1)


SCORED = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    train = training(docs)
    counts = word_counts(train)
    sums = counts.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    total, distinct, once, twice = (int(x or 0) for x in sums)
    best = counts.orderBy(F.desc("c"), "h").limit(TOP).select("h").collect()
    top = np.array([(np.uint64(r.h & (2**64 - 1)), k) for k, r in enumerate(best)], [("h", np.uint64), ("k", np.int32)])
    top.sort(order="h")
    kind = F.col("form").cast("int") + TOP
    if best:
        kind = F.coalesce(F.expr(f"try_element_at(map({', '.join(f'{r.h}L, {k}' for k, r in enumerate(best))}), h)"), F.col("form").cast("int") + TOP)
    size, types = np.zeros((CLASSES, CELLS)), np.zeros((CLASSES, CELLS))
    for r in counts.groupBy(kind.alias("k"), cell_of(F.col("h")).alias("cell")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        size[r.k, r.cell], types[r.k, r.cell] = r.c, r.v
    discount = once / (once + 2 * twice) if once else 0.5
    bias = np.log((size.sum(1) + 0.5) / (total + 0.5 * CLASSES)).astype(np.float32)
    cell_bias = np.log((size + 0.5) / (size.sum(1, keepdims=True) + 0.5 * CELLS)).astype(np.float32)
    w = fit(train, top, bias, cell_bias, total * 6)
    model = spark.sparkContext.broadcast((w, bias, cell_bias, top, size, types, discount, total, distinct))

    # as many lanes as Spark would make partitions, at least, so that the cogroup keeps them as they are
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 6 // LANE_BYTES))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    names = spark.range(int(lanes * (np.log(lanes) + 8))).select(F.col("id").cast("int").alias("lane")).groupBy(F.pmod(F.hash("lane"), F.lit(lanes)).alias("turn")).agg(F.min("lane").alias("lane"))
    # rows take turns, whatever their ids and texts; each lane's name is hashed to a partition of its own
    dealt = docs.select(F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int").alias("turn"), "doc_id", held.alias("held_out"), "text")
    laned = dealt.join(F.broadcast(names), "turn").select("lane", "doc_id", "held_out", "text").repartition(lanes, "lane")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lane, parts in seen.items():
                u = np.unique(np.concatenate(parts))
                yield pa.record_batch({"lane": pa.array(np.full(len(u), lane, np.int32)), "h": pa.array(u.view(np.int64))})
            seen.clear()

        for b in slices(batches, "text"):
            lane = b.column(0).to_numpy()
            h, _, n = tokens(b.column(3))
            each = np.repeat(lane, n)
            for x in np.unique(lane).tolist():
                seen.setdefault(x, []).append(np.unique(h[each == x]))
            if sum(len(p) for parts in seen.values() for p in parts) > 2_000_000:
                yield from out()
        yield from out()

    pairs = laned.mapInArrow(distinct_words, "lane int, h long")  # all columns, so that Spark deals the texts once
    known = pairs.join(counts.select("h", "c"), "h").select("lane", "h", "c")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        w, bias, cell_bias, top, size, types, discount, total, distinct = model.value
        keys = right.column("h").to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, held = keys[order], right.column("c").to_numpy()[order]
        places = Places(keys)
        outs = [[], [], [], []]
        for b in slices(left.to_batches(), "text"):
            h, form, n = tokens(b.column(b.schema.get_field_index("text")))
            at = places.of(h)
            c = np.where(keys[at] == h, held[at], 0) if len(keys) else np.zeros(len(h), np.int64)
            k = classes(h, form, top)
            own = log_word(w, bias, cell_bias, h, k, n) / np.log(10) + np.log10(word_share(c, k, cells(h), size, types, discount))
            begin = np.cumsum(n) - n
            outs[0].append(n)
            outs[1].append(np.add.reduceat((c > 0).astype(np.int64), begin))
            outs[2].append(np.add.reduceat(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))), begin))
            outs[3].append(np.add.reduceat(own, begin))
        n, hit, base, own = (np.concatenate(x) if x else np.zeros(0) for x in outs)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(hit.astype(np.int64)), "train_tokens": pa.array(np.full(len(n), total, np.int64)), "base_score": pa.array(base.astype(float)), "score": pa.array(own.astype(float))})

    kind_id = docs.schema["doc_id"].dataType.simpleString()
    return laned.groupBy("lane").cogroup(known.groupBy("lane")).applyInArrow(score, f"doc_id {kind_id}, held_out boolean, {SCORED}")
