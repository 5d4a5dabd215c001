"""The corpus pipeline over small tables whose right result is known."""

import random

import corpus_pipeline as pipeline

from .test_operators import prose

KINDS = "doc_id long, text string, lang string, source string, n_chars long, __own string, root string"


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, KINDS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_keep_clean_rows_and_no_others(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    item, docs, labels, want = prose(60, 999), [], [], set()

    def add(text, quality=1, toxic=0, keep=True):
        i = len(docs)
        docs.append((i, text, "en", f"h{i % 2}/p", len(text or ""), "x", "y"))
        labels.append((i, quality, toxic))
        want.update([i] if keep else [])

    for s in range(120):
        add(prose(90, s))
    for s in range(200, 240):
        words = prose(90, s).split()
        words[r.randint(0, 80)] = "vilewort"
        add(" ".join(words), toxic=1, keep=False)
        add(prose(90, s + 100).replace(" ", "### ").upper(), quality=0, keep=False)
    for s in range(3):
        words = prose(90, s).split()
        words[40] = "changed"
        add(" ".join(words), keep=False)
        add(f"{prose(40, 700 + s)} {item} {prose(40, 800 + s)}", keep=False)
    folder = tables(spark, tmp_path / "a", docs, labels, [(1, item), (2, None)])
    before = spark.read.parquet(f"{folder}/documents.parquet")
    rows = before
    for name, stage in pipeline.STAGES[:-1]:
        rows = pipeline.materialize(stage(spark, rows, folder))
        assert rows.schema == before.schema, name
    assert {x.doc_id for x in rows.collect()} == want
    assert {x.doc_id for x in pipeline.run(spark, folder).collect()} == want


def test_empty_and_null_rows(spark, tmp_path):
    folder = tables(spark, tmp_path / "b", [], [], [])
    assert pipeline.run(spark, folder).count() == 0
    docs = [(None, None, None, None, None, None, None), (None, "", "en", "s", 0, "a", "b"), (1, prose(40, 1), None, None, None, None, None), (1, prose(40, 2), None, None, None, None, None)]
    folder = tables(spark, tmp_path / "c", docs, [(None, None, None)], [(None, None)])
    assert pipeline.run(spark, folder).count() == 3
