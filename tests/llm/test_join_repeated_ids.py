import random

from brinkline.llm import ngram_join


def test_texts_of_one_id_are_one_document(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    a, b, c = text(), text(), text()
    near = lambda t: t.replace(t.split()[60], "other", 1)
    rows = [(5, a), (5, b), (6, near(b)), (7, near(near(b))), (8, near(a)), (9, c), (9, None), (10, c), (11, text()), (3, near(a)), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles > 0, r.component_id) for r in ngram_join.ngram_jaccard_join(docs, width=4, num=85, den=100, shard_docs=3).collect())
    assert got == sorted([(5, True, 3)] * 3 + [(6, True, 3), (7, True, 3), (8, True, 3), (3, True, 3), (9, True, 9), (9, False, 9), (10, True, 9), (11, True, 11)])
