import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = {"en": "the of and river stone walking".split(), "de": "der und über Steine gehen bald".split(), "fr": "les et pierre marcher bientôt une".split()}
    rows = []
    for i in range(400):
        lang = rng.choices(["en", "de", "fr"], [6, 3, 1])[0]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([1, 3, 30, 200]))), lang))
    rows += [(500, None, "en"), (501, "", "de"), (502, "the " * 30_000, "en"), (7, rows[7][1], rows[7][2]), (None, "les et", "fr")]
    return spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, rate double"), rows


def test_classifier_generalises(corpus):
    docs, rows = corpus
    known = docs.where("doc_id % 4 = 0").select("doc_id", F.col("lang").alias("domain"))
    got = {r.doc_id: r for r in mixing.mix_to_targets(docs, known).where("doc_id % 4 <> 0 and doc_id < 400").collect()}
    right = [got[i].domain == lang for i, _, lang, *_ in rows if i in got]
    assert sum(right) > 0.95 * len(right)
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in got.values())


def brute(p, tokens, goal, least, steps=20_000):
    """Least value of the weighted least-squares distance over rates >= least, by plain projected gradient on every rate."""
    a = (p * tokens[:, None]).T
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-8, hermitian=True)
    r = np.full(len(p), max(1.0, least))
    for _ in range(steps):
        r = np.maximum(least, r - p @ (inverse @ (a @ r - goal)))
    gap = a @ r - goal
    return float(gap @ inverse @ gap), a @ r


@pytest.mark.parametrize(("least", "targets"), [(0.0, {"en": 1, "de": 1, "fr": 1}), (1.0, {"en": 1, "de": 1, "fr": 1}), (0.0, {"en": 1, "de": 0, "fr": 0}), (0.5, {"en": 0.1, "de": 8, "fr": 1})])
def test_rates_reach_what_plain_least_squares_reaches(corpus, least, targets):
    docs, rows = corpus
    known = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mix_to_targets(docs, known, targets=targets, least_rate=least, evidence=2.0, passes=60, tolerance=1e-6).collect()
    assert len(got) == len(rows) and min(r.rate for r in got) >= least
    p, tokens = np.array([r.p for r in got]), np.array([r.n_tokens for r in got], float)
    names = sorted(targets)
    goal = tokens.sum() * np.array([targets[n] for n in names]) / sum(targets.values())
    want, best = brute(p, tokens, goal, least)
    reached = np.array([r.rate * r.n_tokens for r in got]) @ p
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-8, hermitian=True)
    assert (reached - goal) @ inverse @ (reached - goal) <= want + 1e-3 * tokens.sum() and got[0].settled
    assert np.abs(reached - best).sum() < 0.01 * tokens.sum()
    assert got[0].residual == pytest.approx(np.abs(reached - goal).sum() / goal.sum(), abs=1e-9)
    same = {r.rate for r in got if r.doc_id == 7}
    assert len(same) == 1 and sum(r.doc_id == 7 for r in got) == 2


def test_partitions_do_not_matter_and_too_few_passes_are_told(corpus):
    docs, _ = corpus
    known = docs.select("doc_id", F.col("lang").alias("domain"))
    runs = [sorted((r.doc_id or -1, round(r.rate, 9), r.copies) for r in mixing.mix_to_targets(docs.repartition(n), known).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    assert not mixing.mix_to_targets(docs, known, targets={"en": 0.1, "de": 8, "fr": 1}, least_rate=0.5, evidence=2.0, passes=1).first().settled
    with pytest.raises(ValueError):
        mixing.mix_to_targets(docs, known, most_domains=2)
