import random

import numpy as np

from brinkline.llm import quality


def test_probabilities_do_not_depend_on_the_sample_size(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta river stone".split()
    rows = []
    for i in range(1500):  # 86 % good; texts tell the classes apart in part only
        good = i % 7 != 0
        share = min(0.95, max(0.05, rng.gauss(0.6 if good else 0.4, 0.15)))
        rows.append((i, " ".join(rng.choice(words) if rng.random() < share else rng.choice(["BUY", "NOW", "FREE"]) for _ in range(60)), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    odds = {}
    for n in (400, 100_000):
        p = np.array([r.quality for r in quality.quality_rules(docs, labels, fit_rows=n).orderBy("doc_id").collect()])
        odds[n] = np.log(p / (1 - p))
        assert abs(p.mean() - 6 / 7) < 0.07
    assert abs(np.median(odds[400]) - np.median(odds[100_000])) < 0.7
