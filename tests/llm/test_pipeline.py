import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with toxic rows, copies, personal data, nulls and repeats, and columns that operators add."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(160):
        lang = "de" if i % 4 == 0 else "en"
        text = " ".join(rng.choice(words) for _ in range(40)) + (" der Satz ist gut" if lang == "de" else " the line is good")
        toxic = i % 8 == 1
        rows.append((i, text + (" you idiot" if toxic else ""), lang))
        if i < 120:
            labels.append((i, int(i % 5 != 0), int(toxic)))
    rows += [(200, rows[3 - 1][1], "en"), (201, rows[2][1].replace("good", "fine"), "en"), (202, "you 1d10t " + rows[5][1], "en")]
    rows += [(300, None, "en"), (301, "", None), (None, "a text without a number", "en"), (303, "Mr. John Smith writes to j.smith@example.com", "en"), (304, "twice", "en"), (304, "twice", "en")]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, g, "s", len(t or ""), 9.0, 7) for i, t, g in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, {i: t for i, t, _ in rows}


def test_stages_one_by_one(spark, folder):
    at, texts = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    clean = pipeline.drop_toxic(spark, docs, at).cache()
    ids = Counter(r.doc_id for r in clean.collect())
    assert clean.columns == columns and ids == Counter({i: 1 for i in texts if i is None or not (i < 160 and i % 8 == 1 or i == 202)} | {304: 2})
    alone = pipeline.keep_one_of_near_copies(spark, clean, at).cache()
    ids = Counter(r.doc_id for r in alone.collect())
    assert alone.columns == columns and 200 not in ids and 201 not in ids and ids[2] == 1 and ids[304] == 2 and {300, 301, None} <= set(ids)
    hidden = pipeline.replace_pii(spark, alone, at).cache()
    got = {r.doc_id: r for r in hidden.collect()}
    assert hidden.columns == columns and "Smith" not in got[303].text and "j.smith" not in got[303].text and got[303].n_chars == len(got[303].text)
    assert got[300].text is None and all(got[i].text == texts[i] for i in got if i not in (303,) and i is not None)
    mixed = pipeline.mix_domains(spark, hidden, at).cache()
    counts = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(counts) == set(ids) and all(counts[i] >= ids[i] for i in ids) and counts[304] % 2 == 0
    pieces = pipeline.sample_pieces(spark, mixed, at).collect()
    assert {r.doc_id for r in pieces} == set(ids) and all(r.decoded for r in pieces)


def test_run_is_the_stages_in_order(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, at)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.sample_rank)
    assert sorted(docs.collect(), key=key) == sorted(pipeline.run(spark, at).collect(), key=key)


def test_empty_tables_pass_through(spark, folder, tmp_path):
    at, _ = folder
    none = str(tmp_path)
    spark.read.parquet(f"{at}/labels.parquet").limit(0).write.parquet(f"{none}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, none).count() >= docs.count() - (3 if name == "ngram_jaccard_join" else 0), name  # 200, 201, 202
    docs = docs.limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, none)
    assert docs.count() == 0
