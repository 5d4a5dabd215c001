"""The text operators against brute force, the tokenizers' libraries, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shoal.llm import counts, decontam, licenses, lm, media, neardup, quality, queries, spm, text, tokenbin, toxicity

random.seed(5)
ALPHABET = "aebt  \n\t.,éñ▁ß😀中ａ'ss\x00\x1cAÉİ1"
ODD = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 50))) for _ in range(400)]
ODD += ["", " ", None, "the" * 500, " " * 300, "\n" * 50, "abab" * 400, "x <|endoftext|>y <|ENDOFTEXT|> z", "it's a\xa0 b　c", "ab cd. " * 12_000, "q" * 70_000]
WORDS = [w for w in "the of and to in is that it was for on are with as at be this have from or had by but some what there we can out other were all your when up use how said each she".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "a", "on", "er"]) for _ in range(n))


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 7, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class_id int, copy_of string")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_sentencepiece_matches_library(spark):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(spm.digests(docs_of(spark, ODD), path))
    for i, t in enumerate(ODD):
        ids = sp.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_token_counts_match_library(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    c = counts.Counter(path)
    got = rows(counts.token_counts(docs_of(spark, ODD), path))
    for i, t in enumerate(ODD):
        assert got[i].n_tokens == c.whole(t or ""), repr(t)
        assert got[i].n_bytes == len((t or "").encode())
    long = prose(3000, 1)
    assert all(c.spliced(long, size, over) == c.whole(long) for size, over in ((100, 2), (1000, 8), (5000, 64)))


def test_token_codes_round_trip(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    e = tokenbin.Encoder(path)
    got = rows(tokenbin.stored(docs_of(spark, ODD), path))
    start = 0
    for i, t in enumerate(ODD):
        ids = [*e.tok.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc), repr(t)
        start += len(ids)


def test_codes_give_any_token():
    ids = np.array([random.choice([0, 255, 256, 65535, 65536, 2**31]) for _ in range(3000)], np.uint32)
    b = tokenbin.Block(tokenbin.encode_block([None, 5], np.array([1000, 2000]), ids))
    assert b.doc_ids == [None, 5]
    assert [b[i] for i in range(b.n)] == ids.tolist()
    assert all((b.slice(i, j) == ids[i:j]).all() for i, j in ((0, 3000), (7, 9), (511, 1025), (5, 5)))


def test_media_is_lossless_and_equal(spark):
    texts = ["", None, "a", "b" * 576, "same text", "same text", prose(5000, 2)]
    got = rows(media.stored(docs_of(spark, texts)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(p[-32:])
    assert got[4].feature == got[5].feature and got[0].feature == got[1].feature


def test_tensors_are_kept_with_their_shape(spark):
    paths = [text.scratch(spark) for _ in range(2)]
    loud = "".join(chr(random.randint(32, 126)) for _ in range(6000))
    media.store(docs_of(spark, ["~" * 20_000 + loud + "~" * 20_000, ""]), paths[0])
    media.keep(spark.read.parquet(paths[0]), paths[1])
    found = [b for r in spark.read.parquet(paths[1]).collect() for b in media.batches_of(pa.array([bytes(r[0])]))]
    got = {i: (t, s) for b in found for i, t, s in zip(b.column("doc_id").to_pylist(), b.column("tensor").to_numpy_ndarray(), b.column("spans").to_pylist(), strict=True)}
    assert {b.schema.field("tensor").type.shape == [16, 32] for b in found} == {True} and set(got) == {0, 1}
    tensor, spans = got[0]
    assert any(abs(s["begin"] - 20_000 / media.RATE) < 0.1 and abs(s["end"] - 26_000 / media.RATE) < 0.1 for s in spans)
    x = np.zeros(46_080, np.float32)
    raw = ("~" * 20_000 + loud + "~" * 20_000).encode()
    x[:] = (np.frombuffer(raw + b"\xff" * (46_080 - len(raw)), np.uint8).astype(np.float32) - 128) / 128
    assert np.abs(brute_tensor(x) - tensor).max() < 0.05


def brute_tensor(x):
    """The same bands frame by frame, with the filter written as a sum over taps."""
    y = brute_resample(x, 16_000, media.TARGET)
    n = -(-max(0, len(y) - media.FRAME) // media.HOP) + 1
    bank, bands = media.mel(media.TARGET), []
    for k in range(n):
        part = np.zeros(media.FRAME)
        own = y[k * media.HOP : k * media.HOP + media.FRAME]
        part[: len(own)] = own
        bands.append(np.log(np.abs(np.fft.rfft(part * media.WINDOW, media.FFT)) ** 2 @ bank + 1e-6))
    return np.array([np.mean(bands[k * n // media.BINS : max(k * n // media.BINS + 1, (k + 1) * n // media.BINS)], 0) for k in range(media.BINS)])


def brute_resample(x, rate, target):
    """A windowed sinc at each output's own time, without phases."""
    g = math.gcd(rate, target)
    up, down, wide = target // g, rate // g, max(rate, target) // g
    out = []
    for k in range(-(-len(x) * up // down)):
        i = np.arange(max(0, (k * down - 8 * wide) // up), min(len(x), (k * down + 8 * wide) // up + 1))
        d = k * down - i * up
        i, d = i[abs(d) <= 8 * wide], d[abs(d) <= 8 * wide]
        h = np.sinc(d / wide) * (0.5 + 0.5 * np.cos(np.pi * d / (8 * wide + 1))) / wide * up
        out.append(float(h @ x[i]))
    return np.array(out)


@pytest.mark.parametrize(("rate", "target"), [(16_000, 10_000), (16_000, 11_025), (8_000, 10_000), (16_000, 8_000)])
def test_every_phase_matches_the_plain_filter(rate, target):
    x = np.random.default_rng(1).normal(size=700).astype(np.float32)
    assert np.abs(media.resample(x, rate, target) - brute_resample(x, rate, target)).max() < 1e-4


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    y = media.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 16_000, 8000)
    want = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    assert np.abs(y[100:-100] - want[100:-100]).max() < 0.02
    assert media.segments(np.array([0, 0, 9, 5, 9, 0, 0], float))


def brute_tiles(a, b, k):
    out, fa, fb = [], [True] * len(a), [True] * len(b)
    k = min(k, len(b))
    while k:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < k:
            break
        out.append(best)
        for n in range(best[2]):
            fa[best[0] + n] = fb[best[1] + n] = False
    return sum(t[2] for t in out)


def greedy_tiles(a, b, k):
    """Tiles by trying every pair of places: the longest, then the leftmost in b, then in a."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        used_a.update(range(best[0], best[0] + best[2]))
        used_b.update(range(best[1], best[1] + best[2]))


def test_tiles_are_the_longest_and_leftmost():
    r = random.Random(3)
    for _ in range(300):
        letters = r.choice([1, 2, 3, 6])
        a, b = ([r.randint(1, letters) for _ in range(r.randint(0, 40))] for _ in range(2))
        k = r.choice([2, 3, 5])
        assert decontam.tile(np.array(a, np.uint64), np.array(b, np.uint64), k) == greedy_tiles(a, b, min(k, len(b)) or 1), (a, b, k)


def test_repeated_words_take_little_memory():
    import tracemalloc

    a, b = np.full(200_000, 7, np.uint64), np.full(3_000, 7, np.uint64)
    tracemalloc.start()
    assert decontam.tile(a, b) == [(0, 0, 3_000)]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    item = "spam " * 300
    bench = decontam.Bench([0, 1], pa.array([item, "one two three four five six seven"]))
    assert [f[:2] for f in bench.find(pa.array(["spam " * 60_000, "x", "one two three four five six"]), 0.5)] == [(0, 0), (2, 1)]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_tiling_matches_brute_force(spark):
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 25))] for _ in range(2))
        tiles = decontam.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sum(t[2] for t in tiles) == brute_tiles(a, b, 3)
    item = prose(40, 9)
    w = item.split()
    moved = " ".join(w[20:] + ["zz"] + w[:20]).upper().replace(" ", ", ")
    docs = docs_of(spark, [None, "", item, f"x {moved} y", prose(300, 4), " ".join(w[:12]), item])
    items = spark.createDataFrame([(1, item), (2, None), (3, "zq zr")], "item_id long, text string")
    want = [(2, 1), (3, 1), (6, 1)]
    for most in (10**6, 0):  # broadcast, and the way beyond it
        found = decontam.contaminated(docs, items, most=most)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == want
        assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items, most=most).collect()) == [0, 1, 4, 5]


def test_distance_matches_brute_force():
    def brute(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[:], i
            for j, y in enumerate(b, 1):
                d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
        return d[-1]

    r = random.Random(4)
    pairs = [tuple([r.randint(2, 5) for _ in range(r.randint(0, 20))] for _ in range(2)) for _ in range(400)]
    w = np.array([x for pair in pairs for t in pair for x in t], np.int64)
    n = np.array([len(t) for pair in pairs for t in pair], np.int64)
    begin = np.cumsum(n) - n
    for most in (0, 2, 5, 30):
        limit = np.full(400, most) if most else np.arange(400) % 9
        got = neardup.distances(w, begin[::2], n[::2], begin[1::2], n[1::2], limit)
        assert got.tolist() == [min(brute(a, b), m + 1) for (a, b), m in zip(pairs, limit.tolist(), strict=True)]


def test_near_duplicates(spark):
    base = [prose(120, s) for s in range(6)]
    near = [" ".join([*b.split()[:60], "changed", *b.split()[61:]]) for b in base[:3]]
    texts = [*base, *near, base[0], base[0], None, "", "ab cd", "ab cd"]
    got = rows(neardup.classes(docs_of(spark, texts)))
    want = [0, 1, 2, 3, 4, 5, 0, 1, 2, 0, 0, 11, 11, 13, 13]
    assert [got[i].class_id for i in range(len(texts))] == want
    assert got[9].copy_of == 0 and got[6].copy_of == 6
    assert sorted(r.doc_id for r in neardup.one_of_each(docs_of(spark, texts)).collect()) == sorted(set(want))
    assert neardup.classes(docs_of(spark, [])).count() == 0


def test_rows_without_an_id_of_their_own(spark):
    a, b, c = (prose(120, s) for s in (41, 42, 43))
    data = [(None, a), (None, b), (None, a), (7, c), (7, prose(120, 44)), (8, "changed " + b)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = sorted(neardup.one_of_each(docs).collect(), key=str)
    assert kept == sorted([data[0], data[3], data[4], data[5]], key=str)


def near_groups(texts):
    """The components of all pairs by brute force, as the least place of each."""
    w = np.array([zlib.crc32(x.encode()) for t in texts for x in t.split()], np.int64)
    n = np.array([len(t.split()) for t in texts])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        near = neardup.similar(w, np.cumsum(n) - n, n, np.full(i, i), np.arange(i))
        for j in range(i):
            if near[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_chains_and_groups_beyond_a_leader(spark, monkeypatch):
    r = random.Random(11)

    def edited(words, k, tag):
        words = list(words)
        begin = 30  # the tail of the text is common to all, so they share sketches
        for i in r.sample(range(begin), k):
            words[i] = f"{tag}x{i}"
        return words

    chain, texts = [f"c{i}" for i in range(100)], []
    first = edited(chain, 18, "l")
    middle = chain
    last = edited(chain, 18, "b")
    texts += [first, middle, last]
    # not the leader's: 2 and 3 are similar, and only by the middle ones connected with 0
    groups = [[f"g{g}w{i}" for i in range(100)] for g in range(3)]
    for g, base in enumerate(groups):
        texts += [edited(base, r.choice([10, 11, 12, 15]), f"e{g}v{k}") for k in range(14)]
    passage = [f"p{i}" for i in range(70)]
    texts += [[f"o{k}w{i}" for i in range(30)] + passage for k in range(12)]
    texts += [edited(t[:30], 8, "z") + t[30:] for t in texts[-4:]]
    texts = [" ".join(t) for t in texts]
    for order, hot, block in ((texts, 4096, 1024), (texts[::-1], 4096, 7), (texts, 2, 3)):  # cells whole, in blocks, by rare words
        monkeypatch.setattr(neardup, "BLOCK", block)
        want = near_groups(order)
        got = rows(neardup.classes(docs_of(spark, order), hot=hot))
        assert [got[i].class_id for i in range(len(order))] == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 3), (5, 6), (7, 7)], "a long, b long")
    assert {r.id: r.root for r in neardup.components(edges).collect()} == {2: 1, 3: 1, 9: 1, 6: 5}


def brute_scores(texts):
    def toks(t):
        return [bytes(w) for w in (t or "").encode().lower().split()] + [b"\xffend"]

    train = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in toks(t))
    n, v = sum(train.values()), len(train)
    return n, [(len(toks(t)), sum(w in train for w in toks(t)), sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))) for t in texts]


def test_language_model(spark):
    texts = [prose(200, s % 70) for s in range(120)] + [None, "", "É x \x0b\x0c y", prose(10, 500).upper()]
    got = rows(lm.scores(docs_of(spark, texts)))
    n, want = brute_scores(texts)
    for i, (size, known, base) in enumerate(want):
        assert (got[i].train_tokens, got[i].n_tokens, got[i].n_known) == (n, size, known)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.scores(docs_of(spark, [])).count() == 0


def test_cells_of_words_are_those_of_columns(spark):
    h = text.mix(np.arange(1, 300, dtype=np.uint64))
    got = spark.createDataFrame([(x,) for x in h.view(np.int64).tolist()], "h long").select(lm.cell_of(lm.F.col("h"))).collect()
    assert [r[0] for r in got] == lm.cells(h).tolist() and len(set(lm.cells(h).tolist())) == lm.CELLS


def test_word_probabilities_add_up():
    """Over all known words and the unknown ones of each cell, in trained weights, whatever the context."""
    r = np.random.default_rng(1)
    h = np.unique(text.mix(np.arange(1, 400, dtype=np.uint64)))
    top = np.array(sorted((x, i) for i, x in enumerate(h[: lm.TOP])), [("h", np.uint64), ("k", np.int32)])
    form = r.integers(0, lm.FORMS, len(h)).astype(np.int16)
    k, c, cell = lm.classes(h, form, top), r.integers(1, 9, len(h)), lm.cells(h)
    size, types = np.zeros((lm.CLASSES, lm.CELLS)), np.zeros((lm.CLASSES, lm.CELLS))
    np.add.at(size, (k, cell), c)
    np.add.at(types, (k, cell), 1)
    bias = np.log((size.sum(1) + 0.5) / (size.sum() + 0.5 * lm.CLASSES)).astype(np.float32)
    cell_bias = np.log((size + 0.5) / (size.sum(1, keepdims=True) + 0.5 * lm.CELLS)).astype(np.float32)
    t = lm.Trainer(lm.zeros())
    for _ in range(3):
        at = r.integers(0, len(h), 3000)
        t.learn(h[at], k[at], np.full(30, 100), bias, cell_bias)
    cells = [(a, b) for a in range(lm.TOP, lm.CLASSES) for b in range(lm.CELLS)]
    words = np.r_[h, np.array([(b << (64 - lm.CELL_BITS)) | 12345 for _, b in cells], np.uint64)]
    kinds, count = np.r_[k, np.array([a for a, _ in cells], np.int32)], np.r_[c, np.zeros(len(cells), int)]
    for context in ([5, 9], [350, 17], [44, 44]):
        n = len(words)
        seq = np.stack([np.full(n, h[context[0]]), np.full(n, h[context[1]]), words], 1).ravel()
        ks = np.stack([np.full(n, k[context[0]]), np.full(n, k[context[1]]), kinds], 1).ravel().astype(np.int32)
        p = np.exp(lm.log_word(t.w, bias, cell_bias, seq, ks, np.full(n, 3))[2::3]) * lm.word_share(count, kinds, lm.cells(words), size, types, 0.4)
        assert p.sum() == pytest.approx(1, abs=1e-4)
    # the sums of gradients in pairs are those of adding them one by one
    a, b = (lm.Trainer(lm.zeros()) for _ in range(2))
    rows, _ = lm.rows_of(h[at], k[at], np.full(30, 100))
    a.step(0, rows, k[at], bias)
    z = np.exp(np.tile(bias, (len(at), 1)))
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(at)), k[at]] -= 1
    g = np.zeros_like(b.w[0])
    np.add.at(g, rows.ravel(), np.repeat(z, 4, axis=0))
    want = -lm.RATE * g / np.sqrt(1e-3 + (g * g).sum(1))[:, None]
    assert np.abs(a.w[0] - want).max() < 1e-3


def test_toxicity(spark):
    r = random.Random(6)
    texts, marks = [], []
    for i in range(300):
        t, bad = prose(60, 1000 + i).split(), i % 4 == 0
        if bad:
            t[r.randint(0, 50)] = r.choice(["vilewort", "v1lewort", "vilewоrt", "Grimbleton", "grimbletons"])
        texts.append(" ".join(t))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = docs_of(spark, [*texts, None, ""])
    lex = toxicity.learn(toxicity.training(docs, labels))
    assert " vilewort " in lex.weights
    got = rows(toxicity.scored(docs, lex))
    held = [(i, b) for i, b in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].predicted == b for i, b in held)
    assert got[300].score == got[301].score < 0.3
    assert toxicity.fold("Ｖ1lе, w0rt! 2024 É") == " vile wort e "
    assert toxicity.drop_toxic(docs, lex).count() == 302 - 75
    assert not toxicity.learn(toxicity.training(docs, labels.filter("toxic = 0"))).weights


def test_words_of_any_length_are_entries():
    assert f" {'b' * 60} " in toxicity.features(toxicity.fold("a " + "b" * 60))


def test_exceptions_do_not_count():
    lex = toxicity.Lexicon({" clown ": 3.0}, exceptions=("clown fish",))
    auto = lex.automaton()
    assert toxicity.evidence(auto, toxicity.fold("a clown fish"), 0) == 0
    assert toxicity.evidence(auto, toxicity.fold("a clown"), 0) == 3


def test_quality(spark):
    texts = [prose(80, s) if s % 3 else prose(80, s).replace(" ", "### ").upper() for s in range(150)] + [None, ""]
    labels = spark.createDataFrame([(s, int(s % 3 > 0)) for s in range(0, 150, 2)], "doc_id long, quality int")
    docs = docs_of(spark, texts)
    got = rows(quality.posterior(docs, labels))
    assert all(got[s].keep == (s % 3 > 0) for s in range(150))
    assert {r.doc_id for r in quality.drop_poor(docs, labels).collect()} >= {s for s in range(150) if s % 3}
    assert all(r.keep for r in quality.posterior(docs, labels.filter("quality = 1")).collect())


def test_rows_without_an_id_are_judged_one_by_one(spark):
    item = prose(40, 9)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, item), (None, prose(50, 3)), (4, item), (4, prose(50, 4)), (None, None)], "doc_id long, text string")
    for most in (10**6, 0):
        left = decontam.drop_contaminated(docs, items, most=most).collect()
        assert sorted(len(r.text or "") for r in left) == sorted([len(prose(50, 3)), len(prose(50, 4)), 0])
    bad = prose(80, 3).replace(" ", "### ").upper()
    made = [(s, prose(80, s) if s % 3 else prose(80, s).replace(" ", "### ").upper(), "en", "a/b") for s in range(150)] + [(None, bad, "en", "a/b"), (None, prose(80, 1), "en", "a/b"), (None, prose(80, 1), "en", "a/b")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(s, int(s % 3 > 0)) for s in range(0, 150, 2)], "doc_id long, quality int")
    assert [r.text for r in quality.drop_poor(docs, labels).filter("doc_id is null").collect()] == [prose(80, 1)] * 2


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    word, byte, piece = (queries.tokenizer(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    lex = toxicity.learn(toxicity.training(docs, labels))
    made = [quality.posterior(docs, labels), quality.drop_poor(docs, labels), tokenbin.stored(docs, word), media.stored(docs), counts.token_counts(docs, byte), decontam.contaminated(docs, items), decontam.drop_contaminated(docs, items)]
    made += [decontam.contaminated(docs, items, most=-1), toxicity.scored(docs, lex), toxicity.drop_toxic(docs, lex), licenses.scan(docs), spm.digests(docs, piece), neardup.one_of_each(docs)]
    assert [df.count() for df in made] == [0] * len(made)


def test_licences(spark):
    mit = [licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is")]
    texts = [None, "", "Intro. Released under the MIT License.\nMore", ". ".join(s.upper() for s in mit) + ".", ". ".join(mit[::-1]), "Licensed under the Apache License, Version 2.0."]
    got = sorted((r.doc_id, r.rule) for r in licenses.scan(docs_of(spark, texts)).collect())
    assert got == [(2, "mit-name"), (3, "mit-text"), (5, "apache-2.0-name")]


def test_real_licences_wrapped_and_commented(spark):
    import textwrap

    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"]
    mit += ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."]
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."]
    bsd += ["2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
    gpl = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]
    gpl += ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."]
    apache = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0"]
    apache += ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."]
    want = [{"mit-text"}, {"bsd-3-text"}, {"gpl-3.0-notice-or-later"}, {"apache-2.0-header"}]
    for width in (72, 10_000):
        for sign in ("", "# ", "// ", " * ", "-- "):
            texts = []
            for blocks in (mit, bsd, gpl, apache):
                plain = "\n\n".join("\n".join(textwrap.wrap(b, width, initial_indent=" " * (len(b) - len(b.lstrip())))) for b in blocks)
                texts.append("\n".join((sign + x).rstrip() for x in plain.split("\n")) + "\n\ncode = 1\n")
            got = [set() for _ in texts]
            for r in licenses.scan(docs_of(spark, texts)).collect():
                got[r.doc_id].add(r.rule)
            assert got == want, (width, sign)
    got = licenses.scan(docs_of(spark, ["This file is released under the MIT License.", "A line\nAll rights reserved\nmore", "No license here"])).collect()
    assert sorted((r.doc_id, r.rule) for r in got) == [(0, "mit-name"), (1, "reserved")]


def test_more_licences_boxes_and_longer_rules(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    zlib_text = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. Misrepresent nothing."
    boxed = "=" * 3000 + " All rights reserved " + "=" * 3000 + "\n"
    two = ". ".join(licenses.SENTENCES[k] for k in ("bsd-source", "bsd-binary")) + "."
    got = sorted((r.doc_id, r.rule) for r in licenses.scan(docs_of(spark, [isc, mpl, lgpl, zlib_text, boxed, two])).collect())
    assert got == [(0, "isc-text"), (1, "mpl-2.0-header"), (2, "lgpl-2.1-notice"), (3, "zlib-text"), (4, "reserved"), (5, "bsd-2-text")]


def test_words_are_bytes_between_white_space():
    column = pa.array(["a B\x0bc", None, "", " x", "longer-than-eight-bytes y", "é\xa0é"])
    h, n = text.words(column)
    assert n.tolist() == [3, 0, 0, 1, 2, 1]
    again, _ = text.words(pa.array(["A b C"]))
    assert (h[:3] == again).all() and len(set(h.tolist())) == len(h)


def test_licence_query_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLES["op9_licence_rules"]).fetchall())
    got = sorted(tuple(r) for r in queries.op9_licence_rules(spark, sf).collect())
    assert got == want
