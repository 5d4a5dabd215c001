"""Importance resampling, source mixing and lexical search against plain Python and DuckDB, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shoal.llm import mixing, resample, search

r = random.Random(11)
STEMS = ["ba", "lo", "ker", "min", "sto", "pel", "Qu", "zy", "é", "中", "7"]
VOCABULARY = ["".join(r.choice(STEMS) for _ in range(r.randint(1, 3))) for _ in range(150)]
GAPS = [" ", "  ", "\n", ", ", ".\t", "\x0b", "-", "\xa0"]


def text(n, seed):
    q = random.Random(seed)
    return "".join(q.choice(VOCABULARY) + q.choice(GAPS) for _ in range(n))


TEXTS = [text(20 + k % 60, k) for k in range(150)] + [text(40, 3)] * 40 + [None, "", " \n", "...", "one", "A b C", "w" * 300 + " x " + "w" * 64 + " " + "é" * 100, text(30_000, 1), "q" * 100_000]


def documents(spark, texts=TEXTS):
    rows = [(k if k % 31 else None, t, [None, "", "a", "b", "c"][k % 5], len(t or ""), "s", 1, 2.0) for k, t in enumerate(texts)]
    rows += rows[40:44]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, digest string, bin int, key double")


def items(spark, texts):
    return spark.createDataFrame([(k if k != 5 else None, t, "x") for k, t in enumerate(texts)], "item_id long, text string, doc_id string")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def runs(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resampling(docs, target, percent):
    s, t = Counter(), Counter()
    for d in docs:
        s.update(runs(d.text)[1])
    for x in target:
        t.update(runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for d in docs:
        words, f = runs(d.text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if d.doc_id is None else d.doc_id}".encode()).hexdigest()[:8], 16)
        out.append((d.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    fit = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
    return sorted(x[:4] for x in out if x[0] is not None), [(x[0], x[3]) for x in fit[: percent * len(fit) // 100]]


@pytest.mark.parametrize("percent", [5, 60])
def test_resampling_is_the_plain_one(spark, percent):
    docs, target = documents(spark), [text(60, 900), None, "", text(60, 901)]
    got = resample.resampled(docs, items(spark, target), percent).collect()
    every, best = plain_resampling(docs.collect(), target, percent)
    assert sorted((g.doc_id, g.n_features, g.weight, g.score) for g in got if g.doc_id is not None) == every
    assert [(g.doc_id, g.score) for g in sorted((g for g in got if g["rank"]), key=lambda g: g["rank"])] == best
    assert sorted(g["rank"] for g in got if g["rank"]) == list(range(1, len(best) + 1))
    assert len(got) == docs.count()


def test_resampling_weighs_copies_once_and_joins_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(resample, "HOT", 8)  # texts of a tenth of the rows are broadcast
    docs = spark.createDataFrame([(k, text(25, 3 if k % 3 == 0 else k)) for k in range(300)], "doc_id long, text string")
    assert resample.distinct(docs).filter("copies = 100").count() == 1
    got = resample.resampled(docs, items(spark, [text(50, 3)]))
    assert sorted((g.doc_id, g.n_features, g.weight, g.score) for g in got.collect()) == plain_resampling(docs.collect(), [text(50, 3)], 5)[0]


def test_many_stretches_rank_as_one_order(spark):
    rows = [(k, (k * 7919) % 50 if k % 3 else -5, k % 4) for k in range(4000)]
    got = resample.drawn(spark.createDataFrame(rows, "doc_id long, score long, fit int"), resample.F.col("fit") > 0, 30).collect()
    want = sorted((x for x in rows if x[2] > 0), key=lambda x: (-x[1], x[0]))[:900]
    assert [g.doc_id for g in sorted((g for g in got if g["rank"]), key=lambda g: g["rank"])] == [x[0] for x in want]


def test_registers_carry_on():
    data = np.frombuffer(b"abc" * 100, np.uint8)
    starts, ends = np.array([0, 5, 7, 7]), np.array([300, 6, 80, 7])
    got = resample.extend(np.full(4, resample.FULL), data, starts, ends) ^ resample.FULL
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_mixing_equals_its_twin(spark):
    docs = documents(spark)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = sorted(map(repr, (tuple(x) for x in mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken").collect())))
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.mixed_sql()})").fetchall()
    assert len(got) == len(want) == docs.count()
    assert got == sorted(map(repr, want))


def plain_targets(sizes, weights, most):
    """By resharing, as often as a target is above its cap."""
    total, capped = sum(sizes), {}
    while True:
        rest, free = total - sum(capped.values()), [k for k in range(len(sizes)) if k not in capped]
        share = {k: rest * weights[k % 3] / sum(weights[j % 3] for j in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k] + 1e-9]
        if not over:
            return [capped.get(k, share.get(k)) for k in range(len(sizes))]
        capped |= {k: float(most * sizes[k]) for k in over}


@pytest.mark.parametrize("sizes", [[5], [10, 0, 30], [1, 1, 1000], [1000, 1, 1], [3, 50, 20, 700, 1, 9, 90], [0, 0]])
def test_targets_are_those_of_resharing(spark, sizes):
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame([(f"s{k:02}" if k < len(sizes) - 1 else None, n) for k, n in enumerate(sizes)], "source string, source_size long")).collect()}
    assert [got[f"s{k:02}" if k < len(sizes) - 1 else None] for k in range(len(sizes))] == pytest.approx(plain_targets(sizes, (5, 2, 1), 3))


def test_mixing_meets_targets_and_prefers_quality(spark):
    docs = spark.createDataFrame([(k, text(10 + k % 30, k), f"s{k % 4 if k % 3 else 0}", float(k // 12 % 2) * 9 + 1) for k in range(2000)], "doc_id long, text string, source string, q double")
    got = mixing.mixed(docs, weight=mixing.F.col("q")).collect()
    assert sorted(got) == sorted(mixing.mixed(docs.repartition(7), weight=mixing.F.col("q")).collect())
    for source in {x.source_size for x in got}:
        mine = [x for x in got if x.source_size == source]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= max(x.size for x in mine) / 2
        assert {x.taken // x.size for x in mine} <= {k + int(mine[0].target // source) for k in (0, 1)}
    assert all(x.taken <= 3 * x.size for x in got)
    part = [x for x in got if 0.2 < x.target / x.source_size % 1 < 0.8]
    extra = lambda good: np.mean([x.taken > x.size * (x.target // x.source_size) for x in part if (x.doc_id // 12 % 2 == 1) == good])
    assert extra(True) > extra(False) + 0.2


def plain_search(docs, queries, many=10):
    terms = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d.text))) for d in docs]
    n, length = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    out = []
    for item in queries:
        scores = []
        for d, t in zip(docs, terms, strict=True):
            m = 25 + 75 * sum(t.values()) * n // max(length, 1)
            s = 0
            for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item)):
                if t[w]:
                    df = sum(1 for x in terms if x[w])
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * t[w] // (1000 * t[w] + 8 * m))
            if s > 0:
                scores.append((-s, math.inf if d.doc_id is None else d.doc_id))
        out.append([(-s, None if i == math.inf else i) for s, i in sorted(scores)[:many]])
    return out


QUERIES = [text(8, 70), text(4, 71) * 3, "zzzz nothing", "", None, text(12, 72), "BAKER 7 é", text(2, 73)]


@pytest.mark.parametrize("small", [False, True])
def test_search_is_the_plain_one(spark, monkeypatch, small):
    if small:  # many clusters, blocks, partitions and blocks of queries; a fitted tree
        for name, value in (("CLUSTER", 4), ("BLOCK_BYTES", 4000), ("QUERY_BYTES", 150), ("LEVELS", 3)):
            monkeypatch.setattr(search, name, value)
    docs = documents(spark)
    got = search.ranked(docs, items(spark, QUERIES)).collect()
    for k, want in enumerate(plain_search(docs.collect(), QUERIES)):
        mine = sorted((g for g in got if g.item_id == (k if k != 5 else None)), key=lambda g: g["rank"])
        assert [(g.score, g.doc_id) for g in mine] == want
        assert [g["rank"] for g in mine] == list(range(1, len(want) + 1))


def test_search_stops_at_the_floor(spark, monkeypatch):
    """Clusters of other words aren't scored, and the order puts documents of one kind together."""
    kinds = [[f"k{k}w{i}" for i in range(30)] for k in range(8)]
    q = random.Random(2)
    texts = [" ".join(q.choice(kinds[k % 8]) for _ in range(20)) for k in range(800)]
    h, counts = search.words(pa.array(texts), search.NOT_WORD)
    owner, term, _ = search.postings(h, counts)
    leaf = search.bisect(owner, term, 800, 3)
    assert np.bincount(leaf).tolist() == [100] * 8
    purity = np.mean([np.bincount(np.arange(800)[leaf == k] % 8).max() / 100 for k in range(8)])
    assert purity > 0.9
    ids = np.arange(800)
    rows = [dict(zip([c.split()[0] for c in search.INDEX.split(", ")], (k, *x), strict=True)) for k, x in enumerate(search.clusters(ids, h, counts))]
    item = search.Queries([" ".join(kinds[3][:12])])
    item.weigh(np.full(len(item.terms), 60), 800, 16_000)
    built = [search.Cluster(x, item) for x in rows]
    assert all(c.bound[0] >= c.scores(0).max() for c in built)
    seen, real = [], search.Cluster.scores
    monkeypatch.setattr(search.Cluster, "scores", lambda self, k: seen.append(self.row["cluster"]) or real(self, k))
    batch = pa.RecordBatch.from_pylist(rows)
    [(_, found, _)] = list(search.visits([batch], item, np.zeros(1, np.int64), 10))
    assert len(found) == 10 and all(i % 8 == 3 for i in found)
    assert len(seen) < len(rows) / 2


def test_empty_tables(spark):
    none, some = documents(spark, TEXTS[:30]).limit(0), documents(spark, TEXTS[:30])
    nothing = items(spark, [""]).limit(0)
    assert resample.resampled(none, items(spark, ["a b"])).collect() == []
    assert len(resample.resampled(some, nothing).collect()) == some.count()
    assert mixing.mixed(none).collect() == []
    assert search.ranked(none, items(spark, ["a b"])).collect() == []
    assert search.ranked(some, nothing).collect() == []
    blank = documents(spark, [None, "", " "])
    assert search.ranked(blank, items(spark, ["a b"])).collect() == []
    assert {x.taken for x in mixing.mixed(blank).collect()} == {0}
