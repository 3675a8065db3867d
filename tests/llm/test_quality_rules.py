import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from brinkline.llm import quality

BLANK = " \t\n\x0b\x0c\r"


def brute(text):
    words = []
    for c in text:
        if c in BLANK:
            words.append("")
        else:
            words = words or [""]
            words[-1] += c
    words = [w for w in words if w]
    lines = [s for s in text.split("\n") if any(c not in BLANK for c in s)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(lines[i] in lines[:i] for i in range(len(lines))), len(repeated)


@given(st.text("ab# \n\t|é🙂 ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_base_counts_equal_brute_force(text):
    words = quality.words_of(text)
    assert quality.base_counts(text, words, quality.numbered(words)[0]) == brute(text)


def test_one_class_or_no_label_passes_all(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.random()}" for _ in range(60))) for i in range(30)] + [(90, None), (91, "short")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    for labels in ([], [(i, 0) for i in range(30)], [(i, 1) for i in range(30)], [(1, None)]):
        got = {r.doc_id: r for r in quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
        assert all(got[i].kept for i in range(30)) and not got[90].kept and not got[91].kept
    assert quality.quality_rules(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_word_pairs_tell_texts_apart_whose_words_do_not(spark):
    rng = random.Random(4)

    def text(good):
        out = []
        for _ in range(40):
            out += ["alpha", "beta"] if good else ["beta", "alpha"]
            out += [rng.choice(["one", "two", "three"])] * 1
        return " ".join(out)

    rows = [(i, text(i % 2 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r.quality for r in quality.quality_rules(docs, labels).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 0) for i in range(200, 400))
    few = {r.doc_id: r.quality for r in quality.quality_rules(docs, labels, fit_bytes=100 * 8_000).collect()}
    assert sum((few[i] > 0.5) == (i % 2 == 0) for i in range(200, 400)) > 190
