import random
import time
from itertools import product

import numpy as np

from brinkline.llm import toxicity


def test_viterbi_finds_the_cheapest_of_all_readings():
    rng = np.random.default_rng(7)
    model = np.log(rng.random((64, 64, 64)))
    restorer = toxicity.Restorer(model)
    for span in ("1d1ot", "b1tch", "sssh1t", "a$$", "i-d-1-o-t", "6aaa", "x.y.z", "gr8!!!", "h3||o", "0"):
        best = np.inf
        for choice in product(*restorer._options(span), [(" ", 0.0)]):
            cost, x, y = sum(price for _, price in choice), toxicity._EDGE, toxicity._EDGE
            for c in "".join(text for text, _ in choice):
                z = toxicity._EDGE if c == " " else toxicity._OF.get(c, toxicity._OTHER)
                cost, x, y = cost - model[x, y, z], y, z
            if cost < best - 1e-12:
                best, want = cost, "".join(text for text, _ in choice)[:-1]
        assert restorer._decode(span) == want, span


def corpus(spark):
    rng = random.Random(2)
    words = ["the", "good", "people", "walk", "over", "green", "hills", "idiot", "trash"]
    rows = [(i, " ".join(rng.choice(words[:7]) for _ in range(20)) + (" " + rng.choice(words[7:]) if i % 4 == 0 else "")) for i in range(200)]
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, predicted int"), [(i, int(i % 4 == 0)) for i in range(200)]


def test_without_toxic_labels_nothing_is_toxic(spark):
    docs, labels = corpus(spark)
    for some in ([], [(i, 0) for i in range(200)], [(1, None)]):
        got = toxicity.toxicity(docs, spark.createDataFrame(some, "doc_id long, toxic int")).collect()
        assert len(got) == 200 and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = corpus(spark)
    labels = spark.createDataFrame(labels + [(0, 0), (4, 0)], "doc_id long, toxic int")  # of several labels the toxic one counts
    runs = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs.repartition(n), labels.repartition(n)).collect()) for n in (2, 16)]
    assert runs[0] == runs[1] and dict(runs[0])[0] > 0.5


def test_long_tokens_take_linear_time():
    restorer = toxicity.Restorer(np.zeros((64, 64, 64)))
    took = []
    for n in (20_000, 80_000):
        token = "aaab1" * (n // 5)
        began = time.process_time()
        assert restorer.spans(token) == [(0, len(token))] and restorer.spans(f"x {token} y") == [(2, 2 + len(token))]
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.02)
