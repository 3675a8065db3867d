"""Packing against tokens of the library, and the schedule against its targets."""

import random
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from brinkline.llm.packing import Schedule, Tokens, pack_mixture
from brinkline.llm.queries import TOKENIZER

LONG = "Long text, again and again. " * 20_000
TEXTS = ["", " ", "a", "Don't  stop\n\n\tnow… 12½ ² x'll 'S", "naïve café\x85\xa0Ünï 1²3", "日本語 текст 😀 a", "<|endoftext|> a <|endoftext|>", "\x1c\x1f\x00 |" * 3, "Ωœ — “quoted”", "a" * 3000, " \n " * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def check(pieces, docs, library, window=1024):
    """Every document whole and in order, every window gapless and full but for powers of two; returns tokens by window and document."""
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append(ids_of(library, text))
    got, windows = {}, {}
    for p in pieces:
        ids = list(struct.unpack(f"<{p.length}I", p.ids))
        assert p.length == len(ids) > 0
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length, p.doc_id))
    for (doc_id, n), parts in got.items():
        copies = [x for x in want[doc_id] if len(x) == n]
        whole = sorted(t for x in copies for t in x)
        assert sorted(t for _, ids in parts for t in ids) == whole
        if len(copies) == 1:
            parts.sort()
            assert [t for _, ids in parts for t in ids] == copies[0]
            assert all(s + len(a) == r for (s, a), (r, _) in zip(parts, parts[1:], strict=False))
    assert sum(len(x) for v in want.values() for x in v) == sum(p.length for p in pieces)
    assert sorted(windows) == list(range(len(windows)))
    for k in windows:
        at = 0
        for offset, length, _ in sorted(windows[k]):
            assert offset == at
            at += length
        assert at == window or k >= len(windows) - window.bit_length() and at & (at - 1) == 0
    return windows


def test_words_give_the_library_s_ids(library):
    tokens = Tokens(TOKENIZER, keep=5)
    rng = random.Random(3)
    alphabet = "ab AZ'stl\n\t  09.,!é²½ªÿ\x85\xa0\x1c×"
    for text in [*TEXTS, *("".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(2000))]:
        assert tokens.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_every_token_once_and_shares_held(spark, library):
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice(["ab ", "Word", " x1", "é\n"]) for _ in range(rng.randint(0, 900))), f"s{min(rng.randint(0, 9), 4)}") for i in range(400)]
    pieces = pack_mixture(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7), TOKENIZER).collect()
    windows = check(pieces, [d[:2] for d in docs], library)
    source, tokens = {d[0]: d[2] for d in docs}, {}
    for i, text, s in docs:
        tokens[s] = tokens.get(s, 0) + len(ids_of(library, text))
    total, seen = sum(tokens.values()), dict.fromkeys(tokens, 0)
    whole = [k for k in sorted(windows) if sum(w[1] for w in windows[k]) == 1024]
    for n, k in enumerate(whole[:-3], 1):
        for _, length, doc_id in windows[k]:
            seen[source[doc_id]] += length
        for s in tokens:
            assert abs(seen[s] - tokens[s] * 1024 * n / total) < 1.01, (k, s)


def test_targets_are_held_until_a_queue_is_empty(spark, library):
    docs = [(i, "word " * 50, ("a", "b", "c", None)[i % 4]) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    windows = check(pack_mixture(df, TOKENIZER, {"a": 3, "b": 1, "none": 1}, window=128).collect(), [d[:2] for d in docs], library, 128)
    share = {s: sum(x[1] for k in range(20) for x in windows[k] if ("a", "b", "c", None)[x[2] % 4] == s) / (20 * 128) for s in "ab"}
    assert share["a"] == pytest.approx(0.75, abs=0.02) and share["b"] == pytest.approx(0.25, abs=0.02)
    with pytest.raises(ValueError, match="two tokens"):
        pack_mixture(df, TOKENIZER, {"a": 1.0, "b": 1e-9})


def test_many_small_sources_share_a_queue(spark, library, monkeypatch):
    docs = [(i, f"text {i}", f"host{i}") for i in range(3000)] + [(9000, LONG, "large"), (9001, LONG, "large")]
    monkeypatch.setattr("brinkline.llm.packing.MOST_BROADCAST", 0)
    check(pack_mixture(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5), TOKENIZER).collect(), [d[:2] for d in docs], library)


def test_odd_rows(spark, library):
    docs = [(None, None, None), (None, "a", "x"), (1, "", "x"), (2, "same", "x"), (2, "same", "x"), (2, "other words", None), (3, LONG, ""), *[(10 + i, t, "y") for i, t in enumerate(TEXTS)]]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, n int, queue string")
    check(pack_mixture(df, TOKENIZER).collect(), [d[:2] for d in docs], library)
    assert pack_mixture(df.where("n = 2"), TOKENIZER).collect() == []
    assert [tuple(r)[:3] for r in pack_mixture(df.where("doc_id = 1"), TOKENIZER).collect()] == [(1, 0, 1)]


def test_schedules_from_any_place():
    rng = random.Random(1)
    for _ in range(60):
        window = rng.choice([16, 64, 1024])
        totals = [rng.choice([0, rng.randint(1, 50), rng.randint(1, 20_000)]) for _ in range(rng.randint(1, 8))]
        weights = [max(t, 1) for t in totals] if rng.random() < 0.5 else [rng.randint(1, 100) for _ in totals]
        weights = [max(w, 2 * sum(weights) // window + 1) for w in weights]
        schedule, fill = Schedule(totals, weights, window), {}
        for j, total in enumerate(totals):
            if not total:
                continue
            first, windows, inside = (x.tolist() for x in schedule.places(j, 0, total))
            ends = [*first[1:], total]
            for f, e, k, o in zip(first, ends, windows, inside, strict=True):
                fill.setdefault(k, []).append((o, e - f))
            lo = rng.randrange(total)
            hi = rng.randint(lo + 1, total)
            some = [x for x in zip(first, ends, windows, inside, strict=True) if x[0] < hi and x[1] > lo]
            assert [(f, k, o) for f, _, k, o in some] == list(zip(*(x.tolist() for x in schedule.places(j, lo, hi)), strict=True))
        assert sorted(fill) == list(range(schedule.windows))
        for k in fill:
            at = 0
            for offset, length in sorted(fill[k]):
                assert offset == at and length > 0
                at += length
            assert at == window or at & (at - 1) == 0


def test_places_stay_exact_at_trillions_of_tokens():
    schedule = Schedule([20_000_000_000_000, 4_999_999_999_999], [20_000_000_000_000, 4_999_999_999_999], 1024)
    first, windows, inside = schedule.places(0, 12_345_678_901_234, 12_345_678_911_234)
    for f, k in zip(first.tolist(), windows.tolist(), strict=True):
        assert f == 20_000_000_000_000 * k * 1024 // 24_999_999_999_999
    assert (inside == 0).all() and len(first) == 14
