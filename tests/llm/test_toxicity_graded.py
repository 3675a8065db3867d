"""The lattice's further forms, and the graded model beside the rules."""

import random

import numpy as np
import pytest

from brinkline.llm import toxicity

WORDS = "the good people walk over green hills with an idiot or a loser and some trash of moron stupid letter adds all".split()


@pytest.fixture(scope="module")
def restorer():
    counts = np.zeros(64**3)
    rng = random.Random(1)
    for _ in range(400):
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "!", "$$$"]) for _ in range(60))
        x = np.concatenate(([0, 0], toxicity.classes(text), [0]))
        counts += np.bincount((x[:-2] * 64 + x[1:-1]) * 64 + x[2:], minlength=64**3)
    return toxicity.Restorer(toxicity.log_model(counts))


@pytest.mark.parametrize(("written", "meant"), [("!d!0t", "idiot"), ("an idio+ here", "an idiot here"), ("iiddiioott", "idiot"), ("iddiot", "idiot"), ("i d  i o t", "idiot"), ("l0ser!!", "loser!!"), ("m0r0n.", "moron."), ("sstttupid", "stupid")])
def test_forms_that_are_restored(restorer, written, meant):
    assert restorer.restore(written) == meant


@pytest.mark.parametrize("text", ["! a,!", "3f2a0009bc00aa77de10", "deadbeef0001112223334445", "letter all adds", "walk! over!! hills", "", "a", "$ $ $", "+ + +", "x$$$ y###", "  ", "1  2  3"])
def test_texts_that_stay(restorer, text):
    assert restorer.restore(text) == text


def test_texts_without_a_rule_are_ranked(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        rare = [f"vile{rng.choice('abcdefgh')}{rng.choice('rstuvw')}"] if toxic else []
        rows.append((i, " ".join([rng.choice(WORDS[:8]) for _ in range(30)] + rare), int(toxic)))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, train="doc_id % 3 <> 0").collect()}
    held = [(got[i].score, y) for i, _, y in rows if i % 3 == 0]
    wins = [a > b for a, x in held if x for b, y in held if not y]
    assert sum(wins) / len(wins) > 0.97
    assert len({s for s, _ in held}) > 20
    assert got[900].score == got[901].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    few = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, graded_bytes=1 << 16).collect()}
    assert len(few) == len(got)
