"""Ranked lexical search over a clustered index, exact.

**Order.** Documents are reordered by recursive graph bisection: a set of documents is halved, and documents change sides
in pairs as long as that brings the bits which the terms' gaps cost down, then each half is halved again. The
topmost ``LEVELS`` halvings are fitted to a bounded sample (``SAMPLE`` documents, terms hashed to ``FEATURES``); every document then
goes down that tree to a leaf, by which terms' log shares of the two sides it holds. Documents are dealt by leaf in even
ranges, so that a leaf which holds most of the corpus spans many tasks, and blocks of ``BLOCK_BYTES`` of text are
bisected in full, over all their terms, down to clusters of ``CLUSTER`` documents. The order serves speed alone: results
are exact whatever the sample was.

**Index.** A row a cluster: its doc_ids and lengths, its terms with postings, and for each term its greatest frequency and the least
length of a document that holds it. A document's impact rises with the frequency and falls with
the length, so the sum of impacts of these over a query's terms bounds the score of every document of the cluster.

**Search.** Queries are taken in blocks of ``QUERY_BYTES`` of text and meet all clusters. One pass counts the query terms' documents. One
pass finds clusters of the highest bounds for each query, and these are scored: the tenth best score is a floor for
the query. The last pass goes, in each task and for each query, down the clusters by their bounds and stops at the first bound
under the floor, which rises with the scores found; equal bounds are still visited, as a smaller doc_id wins a tie. Tasks give
out ten documents a query at most, and ranks are by score, then doc_id.

Terms are compared by 64-bit hashes of the whole term. null and empty texts have no terms: such documents never match and don't count, such
items have no rows. A null doc_id comes last among equal scores. Repeated rows: each is a document, or an item, of its
own. Other columns don't matter. Without documents or items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import NOT_WORD, discard, flat, materialize, mix, ragged, slices, words

SAMPLE, FEATURES, LEVELS = 2048, 1 << 15, 5
BLOCK_BYTES, CLUSTER, STEPS = 8 << 20, 96, 6
PARTITION_BYTES = 16 << 20
QUERY_BYTES, BEST, TRIES = 4 << 20, 10, 8
NULL = np.iinfo(np.int64).max
INDEX = "cluster long, docs array<long>, terms binary, ends binary, at binary, tf binary, n binary, most binary, least binary, held long, words long"


# --- order ------------------------------------------------------------------------------------


def bisect(owner: np.ndarray, term: np.ndarray, docs: int, levels: int, steps: int = STEPS) -> np.ndarray:
    """The leaf, 0 to 2^levels - 1, of each of ``docs`` documents from distinct (owner, term) postings, owners ascending.

    All nodes of a level are halved at once. A document's gain is what the cost of its terms falls by if it changes
    sides: a term in d of a side's n documents costs d log2(n / (d + 1)). In each node, the documents of either side are sorted
    by gain and change places in pairs while both gains sum to more than zero.
    """
    node = np.zeros(docs, np.int64)
    _, term = np.unique(term, return_inverse=True)
    terms = int(term.max()) + 1 if len(term) else 1
    first = np.searchsorted(owner, np.arange(docs))
    some = np.flatnonzero(np.bincount(owner, minlength=docs))
    for level in range(levels):
        nodes = 1 << level
        order = np.argsort(node, kind="stable")
        size = np.bincount(node, minlength=nodes)
        place = np.empty(docs, np.int64)
        place[order] = np.arange(docs) - np.repeat(np.cumsum(size) - size, size)
        side = (place >= (size[node] + 1) // 2).astype(np.int64)
        held, key = compact(node[owner] * terms + term, nodes * terms)
        home = held // terms
        for _ in range(steps):
            n = np.bincount(node * 2 + side, minlength=2 * nodes).reshape(nodes, 2)
            two = np.bincount(key, side[owner], len(held)).astype(np.float32)
            deg = np.bincount(key, minlength=len(held)).astype(np.float32) - two, two
            log_n = np.log2(np.maximum(n, 1)).astype(np.float32)[home]
            cost = lambda d, s: d * (log_n[:, s] - np.log2(d + 1))  # noqa: B023, E731
            now = cost(deg[0], 0) + cost(deg[1], 1)
            table = np.stack([now - cost(np.maximum(deg[s] - 1, 0), s) - cost(deg[1 - s] + 1, 1 - s) for s in (0, 1)])
            gain = np.zeros(docs, np.float32)
            if len(some):
                gain[some] = np.add.reduceat(table[side[owner], key], first[some])
            order = np.lexsort((-gain, side, node))
            group = node[order] * 2 + side[order]
            begin = np.searchsorted(group, np.arange(2 * nodes + 1)).reshape(-1)
            left, right = np.diff(begin).reshape(nodes, 2).T
            pairs = np.minimum(left, right)
            a = order[ragged(begin[0:-1:2], pairs)]
            b = order[ragged(begin[1::2], pairs)]
            move = gain[a] + gain[b] > 0
            if not move.any():
                break
            side[a[move]], side[b[move]] = 1, 0
        node = node * 2 + side
    return node


def compact(key: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, place of each key among them) of keys under ``span``; flags where they are dense, else a sort."""
    if span > 4 * len(key) + (1 << 20):
        return np.unique(key, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[key] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[key]


def postings(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, frequency) of the distinct terms of each row, by row and term."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, owner))
    o, t = owner[order], h[order]
    begin = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])]) if len(o) else np.zeros(0, np.int64)
    return o[begin], t[begin], np.diff(np.r_[begin, len(o)])


def bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) % np.uint64(FEATURES)).astype(np.int64)


class Tree:
    """The topmost halvings: a document goes to the side whose log shares of its terms sum higher, against the sample's median."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, docs: int, levels: int = LEVELS) -> None:
        self.levels = levels if docs >= 2 << levels else 0
        self.odds, self.cut = np.zeros(((1 << self.levels), FEATURES), np.float32), np.zeros(1 << self.levels, np.float32)
        leaf = bisect(owner, term, docs, self.levels)
        for level in range(self.levels):
            node = leaf >> (self.levels - level)
            side = leaf >> (self.levels - level - 1) & 1
            for k in range(1 << level):
                mine = (node == k)[owner]
                one, two = (np.bincount(term[mine & (side == s)[owner]], minlength=FEATURES) for s in (0, 1))
                odds = np.log((two + 0.5) / (one + 0.5)).astype(np.float32)
                at = (1 << level) + k
                self.odds[at] = odds - odds[one + two > 0].mean() if (one + two).any() else 0
                total = np.bincount(owner[mine], self.odds[at][term[mine]], docs)[node == k]
                self.cut[at] = np.median(total) if len(total) else 0

    def leaves(self, owner: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        at = np.ones(docs, np.int64)
        for _ in range(self.levels):
            total = np.bincount(owner, self.odds[at[owner], term], docs)
            at = at * 2 + (total > self.cut[at])
        return at - (1 << self.levels)


def fitted(docs: DataFrame) -> Tree:
    """The tree of a sample of at most 4 x ``SAMPLE`` documents, SAMPLE on average: whole texts, as sets of hashed terms."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, counts = words(b.column(0), NOT_WORD)
            owner, term, _ = postings(bucket(h), counts)
            sizes = np.bincount(owner, minlength=len(counts))
            yield pa.record_batch([pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(term.astype(np.int32)))], ["terms"])

    some = docs.select("text") if n <= SAMPLE else docs.sample(SAMPLE / n, seed=7).select("text")
    held = [np.array(r["terms"], np.int64) for r in some.mapInArrow(run, "terms array<int>").limit(4 * SAMPLE).toLocalIterator()]
    sizes = np.array([len(x) for x in held], np.int64)
    return Tree(np.repeat(np.arange(len(held)), sizes), np.concatenate(held) if held else np.zeros(0, np.int64), len(held))


# --- index ------------------------------------------------------------------------------------


def least_int(x: np.ndarray) -> bytes:
    """A byte for the width, and the numbers in as few bytes as they need."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def clusters(ids: np.ndarray, h: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Index rows, but for their number, of one block of documents."""
    owner, term, tf = postings(h, counts)
    levels = max(0, int(np.ceil(np.log2(max(1, len(ids)) / CLUSTER))))
    leaf = bisect(owner, term, len(ids), levels)
    order = np.lexsort((ids, leaf))
    new = np.empty(len(ids), np.int64)
    new[order] = np.arange(len(ids))
    begin = np.searchsorted(leaf[order], np.arange((1 << levels) + 1))
    part = leaf[owner]
    by = np.lexsort((new[owner], term, part))
    part, term, tf, owner = part[by], term[by], tf[by], owner[by]
    edge = np.searchsorted(part, np.arange((1 << levels) + 1))
    for k in range(1 << levels):
        mine = order[begin[k] : begin[k + 1]]
        if not len(mine):
            continue
        t, f, o = (x[edge[k] : edge[k + 1]] for x in (term, tf, owner))
        n = counts[mine]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(f, first) if len(t) else f
        least = np.minimum.reduceat(counts[o], first) if len(t) else f
        docs = [None if i == NULL else i for i in ids[mine].tolist()]
        yield docs, t[first].tobytes(), least_int(np.r_[first[1:], len(t)] if len(t) else first), least_int(new[o] - begin[k]), least_int(f), least_int(n), least_int(most), least_int(least), int((n > 0).sum()), int(n.sum())


def index(docs: DataFrame) -> DataFrame:
    """The clustered index as a table in the shared folder."""
    tree = fitted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tree)  # FEATURES x 2^LEVELS numbers
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in slices(batches):
            h, counts = words(b.column(1), NOT_WORD)
            owner, term, _ = postings(bucket(h), counts)
            leaf = tree.leaves(owner, term, len(counts))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(leaf.astype(np.int32))], ["doc_id", "text", "leaf"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, hs, ns, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, hs, ns, held, number
            for row in clusters(np.concatenate(ids), np.concatenate(hs), np.concatenate(ns)) if ids else ():
                yield pa.record_batch([pa.array([x]) if k != 1 else pa.array([x], pa.list_(pa.int64())) for k, x in enumerate((number, *row))], [c.split()[0] for c in INDEX.split(", ")])
                number += 1
            ids, hs, ns, held = [], [], [], 0

        for b in slices(batches, most=BLOCK_BYTES // 4):
            h, counts = words(b.column(1), NOT_WORD)
            ids.append(b.column(0).fill_null(int(NULL)).to_numpy())
            hs.append(h)
            ns.append(counts)
            held += len(flat(b.column(1))[0]) + 16 * b.num_rows
            if held >= BLOCK_BYTES:
                yield from flush()
        yield from flush()

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.mapInArrow(route, "doc_id long, text string, leaf int")
    x = x.repartitionByRange(max(8, size // PARTITION_BYTES), "leaf", F.xxhash64("doc_id")).sortWithinPartitions("leaf", F.xxhash64("doc_id"))
    return materialize(x.select("doc_id", "text").mapInArrow(build, INDEX))


# --- search -----------------------------------------------------------------------------------


class Queries:
    """A block of items: distinct terms, and for each item its terms with how often it has them."""

    def __init__(self, texts: list[str]) -> None:
        h, counts = words(pa.array(texts), NOT_WORD)
        owner, term, self.times = postings(h, counts)
        self.items = len(texts)
        self.terms, self.term = np.unique(term, return_inverse=True)
        self.owner, self.first = owner, np.searchsorted(owner, np.arange(len(texts) + 1))
        self.docs = np.zeros(len(self.terms), np.int64)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.n = self.length = 0

    def weigh(self, docs: np.ndarray, n: int, length: int) -> None:
        self.docs, self.n, self.length = docs, n, length
        self.weight = np.floor(1000 * np.log((2 * n + 2) / (2 * docs + 1))).astype(np.int64)

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 75 + 75 * n * self.n // self.length
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def where(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the block's terms, places among ``terms``) of those in both; both ascend."""
        at = np.searchsorted(terms, self.terms)
        at[at == len(terms)] = 0
        mine = np.flatnonzero(terms[at] == self.terms) if len(terms) else np.zeros(0, np.int64)
        return mine, at[mine]

    def sums(self, by_term: np.ndarray) -> np.ndarray:
        """Of each item, times x weight x ``by_term`` over its terms."""
        total = np.r_[0, np.cumsum(self.times * (self.weight * by_term)[self.term])]
        return total[self.first[1:]] - total[self.first[:-1]]


class Cluster:
    """A row of the index, as one block of items sees it."""

    def __init__(self, row: dict, queries: Queries) -> None:
        self.row, self.q, self.posts = row, queries, None
        mine, self.own = queries.where(np.frombuffer(row["terms"], np.uint64))
        top = np.zeros(len(queries.terms), np.int64)
        if len(mine):
            top[mine] = queries.impact(ints(row["most"])[self.own], ints(row["least"])[self.own])
        self.bound = queries.sums(top)
        self.at = np.full(len(queries.terms), -1)
        self.at[mine] = np.arange(len(mine))

    def scores(self, item: int) -> np.ndarray:
        """The scores of all documents of the cluster."""
        q, row = self.q, self.row
        if self.posts is None:
            ends, at, tf, n = (ints(row[c]) for c in ("ends", "at", "tf", "n"))
            begin, size = np.r_[0, ends[:-1]][self.own], np.diff(np.r_[0, ends])[self.own]
            chosen = ragged(begin, size)
            self.posts = np.r_[0, np.cumsum(size)], at[chosen], q.impact(tf[chosen], n[at[chosen]]), len(n)
        edges, at, impact, docs = self.posts
        lines = slice(q.first[item], q.first[item + 1])
        k = self.at[q.term[lines]]
        each = (q.times[lines] * q.weight[q.term[lines]])[k >= 0]
        k = k[k >= 0]
        size = edges[k + 1] - edges[k]
        chosen = ragged(edges[k], size)
        total = np.zeros(docs, np.int64)
        np.add.at(total, at[chosen], np.repeat(each, size) * impact[chosen])
        return total


def best(ids: np.ndarray, scores: np.ndarray, many: int) -> np.ndarray:
    """The places of the highest scores, equal ones by id."""
    return np.lexsort((ids, -scores))[:many]


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {n: b.column(i)[k].as_py() for i, n in enumerate(b.schema.names)}


def visits(batches: Iterator[pa.RecordBatch], q: Queries, floor: np.ndarray, many: int, most_bytes: int = 32 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, ids, scores) of what may be among the ``many`` best: clusters of a task, some MB at once, by falling bound down to the floor."""
    floor = floor.copy()
    ids = [np.zeros(0, np.int64) for _ in range(q.items)]
    scores = [np.zeros(0, np.int64) for _ in range(q.items)]

    def walk(group: list[Cluster]) -> None:
        bounds = np.stack([c.bound for c in group])
        for item in np.flatnonzero((bounds >= np.maximum(floor, 1)).any(0)):
            for k in np.argsort(-bounds[:, item], kind="stable"):
                if bounds[k, item] < max(floor[item], 1):
                    break
                found = group[k].scores(item)
                keep = np.flatnonzero(found >= max(floor[item], 1))
                own = np.array([NULL if group[k].row["docs"][i] is None else group[k].row["docs"][i] for i in keep.tolist()], np.int64)
                i, s = np.r_[ids[item], own], np.r_[scores[item], found[keep]]
                top = best(i, s, many)
                ids[item], scores[item] = i[top], s[top]
                if len(top) == many:
                    floor[item] = max(floor[item], s[top[-1]])

    group, held = [], 0
    for row in read(batches):
        group.append(Cluster(row, q))
        held += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if held >= most_bytes:
            walk(group)
            group, held = [], 0
    if group:
        walk(group)
    yield from ((k, ids[k], scores[k]) for k in range(q.items) if len(ids[k]))


def top(table: DataFrame, q: Queries, many: int = BEST) -> DataFrame:
    """(pos, rank, doc_id, score) of the items of one block."""
    spark = table.sparkSession
    total = table.agg(F.sum("held").alias("n"), F.sum("words").alias("l")).first()
    schema = "pos int, doc_id long, score long"
    if not total["l"] or not len(q.terms):
        return spark.createDataFrame([], "pos int, rank int, doc_id long, score long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(len(q.terms), np.int64)
        for row in read(batches):
            mine, own = q.where(np.frombuffer(row["terms"], np.uint64))
            docs[mine] += np.diff(np.r_[0, ints(row["ends"])])[own]
        yield pa.record_batch([pa.array(np.arange(len(docs), dtype=np.int32)), pa.array(docs)], ["k", "n"])

    docs = np.zeros(len(q.terms), np.int64)
    for r in table.select("terms", "ends").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        docs[r["k"]] = r["n"]
    q.weigh(docs, int(total["n"]), int(total["l"]))
    shared = spark.sparkContext.broadcast(q)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        high, which = np.zeros((TRIES, q.items), np.int64), np.full((TRIES, q.items), -1)
        for row in read(batches):
            b, lane = Cluster(row, q).bound, row["cluster"] % TRIES
            more = b > high[lane]
            high[lane][more], which[lane][more] = b[more], row["cluster"]
        lane, pos = np.nonzero(which >= 0)
        yield pa.record_batch([pa.array(pos.astype(np.int32)), pa.array(lane.astype(np.int32)), pa.array(high[lane, pos]), pa.array(which[lane, pos])], ["pos", "lane", "bound", "cluster"])

    def found(floor: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pos, ids, scores in visits(batches, shared.value, floor, many):
                yield pa.record_batch([pa.array(np.full(len(ids), pos, np.int32)), pa.array(ids, mask=ids == NULL), pa.array(scores)], ["pos", "doc_id", "score"])

        return run

    w = Window.partitionBy("pos").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda x: x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= many)
    tries = table.select("cluster", "terms", "most", "least").mapInArrow(bound, "pos int, lane int, bound long, cluster long").groupBy("pos", "lane").agg(F.max_by("cluster", "bound").alias("cluster")).select("cluster").distinct()
    first = table.join(F.broadcast(tries), "cluster", "left_semi").mapInArrow(found(np.zeros(q.items, np.int64)), schema)  # TRIES clusters an item
    floor = np.zeros(q.items, np.int64)
    for r in ranked(first).filter(F.col("rank") == many).collect():
        floor[r["pos"]] = r["score"]
    return ranked(table.mapInArrow(found(floor), schema)).select("pos", "rank", "doc_id", "score")


def blocks(items: DataFrame, most: int = QUERY_BYTES) -> Iterator[list]:
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append(r)
        size += len(r["text"] or "") + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, many: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``many`` documents of the highest scores over 0 for each item."""
    spark: SparkSession = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    table = None
    for held in blocks(items.select("item_id", "text")):
        table = index(docs) if table is None else table
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(held)], f"pos int, item_id {kind}")
        part = top(table, Queries([r["text"] or "" for r in held]), many).join(F.broadcast(names), "pos").select("item_id", "rank", "doc_id", "score")  # a block's items
        part = materialize(part)
        out = part if out is None else out.unionByName(part)
    if table is not None:
        discard(table)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def ranked_sql(many: int = BEST) -> str:
    """The DuckDB twin: every pair of a document and an item that share a term is scored."""
    said = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH b AS (SELECT item_id, unnest({said}) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
 d AS (SELECT doc_id, {said} AS terms FROM documents), s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
 p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d), f AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, s.n),
 r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * f.n * s.n) // s.l))))::BIGINT AS score FROM f JOIN q USING (term) JOIN w USING (term), s GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
 SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {many}"""
