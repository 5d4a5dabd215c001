"""Every operator over one table of odd rows: null and repeated doc_ids, nulls, very long texts, columns with clashing names, and over empty tables."""

import random
from collections import Counter

import pytest

from shoal.llm import counts, decontam, licenses, lm, media, mixing, neardup, quality, queries, resample, search, spm, tokenbin, toxicity

r = random.Random(8)
WORDS = ["ab", "cde", "fgh", "ij", "klm", "nop", "qrs", "tu", "vw", "xyz"]
prose = lambda n, k: " ".join(random.Random(k).choice(WORDS) + str(random.Random(k * 7 + i).randint(0, 9)) for i in range(n))
CLASH = "seen string, host string, path string, x double, h long, leaf int, digest string, copies long, score double, rank int, toxic int, quality int, class_id long, bin int, key string, sentences string, part int, lane int"
LONG = prose(20_000, 99)
ROWS = [(k, prose(30 + k, k), f"s{k % 3}", "en") for k in range(24)]
ROWS += [(None, prose(40, 1), None, None), (None, None, "s1", "en"), (None, None, None, "en"), (None, "", "s1", None), (3, prose(50, 2), "s1", "en"), (3, prose(50, 2), "s1", "en"), (3, "", "s1", "en"), (90, LONG, "s2", "en"), (91, "z" * 120_000, "s2", "en"), (92, LONG, "s2", "xx")]


@pytest.fixture(scope="module")
def docs(spark):
    more = (None, "a", "b", 1.0, 2, 3, "d", 4, 0.5, 1, 0, 1, 7, 2, "k", "|mit|", 0, 1)
    return spark.createDataFrame([(*x, *more) for x in ROWS], f"doc_id long, text string, source string, lang string, {CLASH}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(24)] + [(None, 1, True), (3, 1, False)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(30, 5), 1.0), (None, None, None), (2, "", 2.0)], "item_id long, text string, score double")


def operators(docs, labels, items):
    lex = toxicity.learn(toxicity.training(docs, labels))
    return {
        "quality": quality.posterior(docs, labels), "lm": lm.scores(docs), "neardup": neardup.classes(docs), "tokenbin": tokenbin.stored(docs, queries.tokenizer("word_bpe_49k.json")), "media": media.stored(docs),
        "counts": counts.token_counts(docs, queries.tokenizer("byte_bpe_50k.json")), "toxicity": toxicity.scored(docs, lex), "spm": spm.digests(docs, queries.tokenizer("piece_bpe_32k.model")),
        "resample": resample.resampled(docs, items), "mixing": mixing.mixed(docs),
    }


def test_each_row_has_its_own_result(docs, labels, items):
    ids = Counter(x[0] for x in ROWS)
    for name, df in operators(docs, labels, items).items():
        got = df.collect()
        assert Counter(x.doc_id for x in got) == ids, name
        by_id = {x.doc_id: x.asDict() for x in got if ids[x.doc_id] == 1}
        if name in ("counts", "media", "spm", "toxicity"):  # results of the text alone
            assert {k: v for k, v in by_id[90].items() if k != "doc_id"} == {k: v for k, v in by_id[92].items() if k != "doc_id"}, name
    assert {x.doc_id for x in decontam.contaminated(docs, items).collect()} <= set(ids)
    assert decontam.drop_contaminated(docs, items).count() <= len(ROWS)
    assert 0 < search.ranked(docs, items).filter("item_id = 1").count() <= 10
    assert licenses.scan(docs).collect() == []


def test_stages_keep_columns_and_tell_rows_apart(docs, labels, items):
    kept = quality.drop_poor(docs, labels, keep=1.1)
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality.drop_poor(docs, labels, keep=-1).count() == len(ROWS)
    for df in (neardup.one_of_each(docs), toxicity.drop_toxic(docs, toxicity.Lexicon()), decontam.drop_contaminated(docs, items)):
        assert df.columns == docs.columns
    marks = [x[0] for x in docs.filter("doc_id is null").select(quality.seen().alias("s")).collect()]
    assert len(set(marks)) == 4  # nulls of text, source and language aren't taken for each other


def test_a_rejected_row_takes_no_other_with_it(spark):
    """Two rows without a doc_id that differ in what is null: one site is poor."""
    good, bad = "well said words of every kind in lines", "!!! ### $$$ ||| @@@ %%%"
    rows = [(k, good if k % 2 else bad, "fine" if k % 2 else "poor", "en") for k in range(200)] + [(None, None, "poor", "en"), (None, "poor", None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    left = quality.drop_poor(docs, labels)
    judged = {(x.doc_id, x.seen): x.keep for x in quality.judged(docs, labels, 1000, quality.KEEP).filter("doc_id is null").collect()}
    assert len(judged) == 2 and left.filter("doc_id is null").count() == sum(judged.values())


def test_empty_tables_give_empty_results(docs, labels, items):
    none = docs.limit(0)
    for name, df in operators(none, labels, items).items():
        assert df.collect() == [], name
    assert licenses.scan(none).collect() == decontam.contaminated(none, items).collect() == decontam.contaminated(docs, items.limit(0)).collect() == []
