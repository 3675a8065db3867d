"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from brinkline.llm import spelling
from brinkline.llm.spelling import END, Automaton, spelling_variants

LONG = "Longest wörd " * 60_000


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs, damage=97):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def expected(docs, damage=97):
    words = counted(docs, damage)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def found(spark, docs, **options):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    rows = spelling_variants(df, **options).select("word", "n", "n_near", "form", "form_n", "root").collect()
    return sorted(tuple(r) for r in rows)


def typed(rng, vocabulary, n):
    words = []
    for _ in range(n):
        w = rng.choice(vocabulary[: rng.randint(1, len(vocabulary))])
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abéz") + w[i:], w[:i] + rng.choice("abÉz") + w[i + 1 :]])
        words.append(w if rng.random() < 0.8 else w.upper())
    return " ".join(words)


def test_variants_equal_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcé", k=rng.randint(4, 9))) for _ in range(60)]
    docs = [(i, typed(rng, vocabulary, 80)) for i in range(60)]
    want = expected(docs)
    assert any(r[3] and r[5] != r[3] for r in want)
    assert found(spark, docs) == want


def test_many_words_under_one_half(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["ab" + "".join(rng.choices("abc", k=rng.randint(3, 4))) for _ in range(90)] + ["".join(rng.choices("abc", k=4)) + "ca" for _ in range(60)]
    docs = [(i, typed(rng, vocabulary, 100)) for i in range(60)]
    monkeypatch.setattr(spelling, "SHARD_ENTRIES", 20)
    monkeypatch.setattr(spelling, "SLICE_WORDS", 7)
    assert found(spark, docs) == expected(docs)


def test_odd_rows(spark):
    docs = [(None, None), (None, "naïve naïve naïve × naive"), (1, ""), (1, "a bc ÿÿÿÿÿ"), (2, "ÿÿÿÿÿ ÿÿÿÿÿ ΩAbcdeΩabcdÉabcde 😀"), (2, "ÿÿÿÿÿ ÿÿÿÿÿ ΩAbcdeΩabcdÉabcde 😀"), (3, LONG), (4, "longes longes longes " * 3)]
    assert found(spark, docs) == expected(docs)
    assert found(spark, []) == []
    assert found(spark, docs, damage=0) == expected(docs, 0)
    with pytest.raises(ValueError, match="ratio"):
        found(spark, docs, ratio=1)


def test_counts_in_small_batches(spark, monkeypatch):
    docs = [(i, " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(i))) for i in range(60)]
    monkeypatch.setattr(spelling, "MOST_COUNTED", 10)
    assert found(spark, docs) == expected(docs)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({a + b + c for a in "ab" for b in "xyz" for c in ("", "s", "ed")})
    automaton = Automaton(words)
    assert [automaton.follow(automaton.start, 0, w) for w in words] == list(range(len(words)))
    assert automaton.follow(automaton.start, 0, "ax" + END) is None
    assert len(automaton.final) == 5  # start, behind a or b, behind x, y or z, behind e, the end
    for w in [*words, "", "axxs", "xed", "aed", "bzeds", "q"]:
        assert sorted(words[i] for i in automaton.one_error(automaton.start, 0, w)) == [v for v in words if one_apart(w, v)]
    assert Automaton([]).one_error(0, 0, "a") == set()
