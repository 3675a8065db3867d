import random

import numpy as np

from brinkline.llm import toxicity


def test_spans_of_spaced_leetspeak():
    spans = toxicity.Restorer(np.zeros((64, 64, 64))).spans
    for text, want in {
        "you b 1 t c h now": "b 1 t c h", "an i d 1 0 t, yes": "i d 1 0 t", "such an\ta $ $!": "a $ $", "see b-1-t-c-h": "b-1-t-c-h", "(1 d i 0 t)": "1 d i 0 t", "an i d i o t!": "i d i o t",
    }.items():
        assert [text[i:j] for i, j in spans(text)][-1:] == [want], text
    for text in ("1 2 3 4 5", "$ $ $", "a 1", "", "in 5 of 7 on 3", "1 b1 2"):
        assert all(not set(text[i:j]) <= set("12345$ ") and " " not in text[i:j] for i, j in spans(text)), text


def test_spaced_leetspeak_is_scored(spark):
    rng = random.Random(2)
    words = ["the", "good", "people", "walk", "over", "green", "hills", "idiot", "trash"]
    rows = [(i, " ".join(rng.choice(words[:7]) for _ in range(20)) + (" " + rng.choice(words[7:]) if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    mixed = ["walk over i d 1 0 t hills", "good t r 4 $ h people", "the 1 d i 0 t!", "green i.d.1.o.7 hills", "good i-d-1-0-t people"]
    clean = ["walk over 1 2 3 4 hills", "good people 5 $ 7", "the green 1 hills a 2 b 3"]
    rows += [(900 + i, t) for i, t in enumerate(mixed + clean)]
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert [got[900 + i] for i in range(8)] == [1] * 5 + [0] * 3
