import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brinkline.llm import chat, mixing, ngram_join, pieces, pii, quality, secrets, tiff, toxicity, warc

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, LONG), (None, "b c")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in ODD], "doc_id long, text string, score string, n_tokens double")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# n-gram join


def linked(texts, width, num, den):
    sets = {}
    for i, t in texts:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(s), root(i)) for i, s in sets.items()}


def test_join_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for base in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 30, 80, 200]))]
        if base % 3 == 0:
            words += shared
        for _ in range(rng.choice([1, 2, 6])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append((len(texts), " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for num, den, width in ((85, 100, 4), (80, 100, 5)):
        got = ngram_join.ngram_jaccard_join(docs, width=width, num=num, den=den, shard_docs=7).collect()
        assert {tuple(r) for r in got} == linked(texts, width, num, den)


def test_divide_skip_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 300).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(150, 300), replace=False), rng.integers(0, 2**60, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(80)]
    scheme = ngram_join.Scheme(85, 100)
    index = ngram_join.Lists(list(range(80)), sets)
    for i, x in enumerate(sets):
        want = {j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))}
        assert set(index.search(x, scheme)) == want, i


def test_bitmaps_drop_no_link_and_most_others(spark):
    rng = np.random.default_rng(2)
    scheme, rows, sets = ngram_join.Scheme(80, 100), [], {}
    for base in range(12):
        core = rng.integers(0, 2**63, rng.choice([3, 60, 64, 130, 500])).astype(np.uint64)
        for _ in range(6):
            x = np.unique(np.r_[core[rng.random(len(core)) > rng.choice([0, 0.05, 0.1, 0.4])], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])
            if len(x):
                sets[len(sets)] = x
    near = next(ngram_join._near_pairs(scheme)([pa.RecordBatch.from_pylist([
        {"doc_id": i, "hub": j, "n": len(x), "hub_n": len(y), "bitmap": ngram_join.parity_bitmap(x), "hub_bitmap": ngram_join.parity_bitmap(y)}
        for i, x in sets.items() for j, y in sets.items() if i < j
    ]).slice(0, 1000)]))
    got = {(r["doc_id"], r["hub"]) for r in near.to_pylist()}
    pairs = [(i, j) for i in sets for j in sets if i < j][:1000]
    linked_ = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked_ and linked_ <= got and len(got) < len(pairs) / 4
    rows = [(0, 0, 0, i % 2 == 0, i, i, len(x), bytearray(ngram_join.parity_bitmap(x))) for i, x in sets.items()]
    df = spark.createDataFrame(rows, "block long, shard long, turn long, query boolean, doc_id long, part long, n long, bitmap binary")
    kept = {r.doc_id for r in ngram_join._screened(df, 80, 100, cells=64).collect()}
    across = {(i, j) for i in sets for j in sets if i % 2 == 0 and j % 2}
    must = {k for i, j in across if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for k in (i, j)}
    assert must and must <= kept


def test_join_odd_rows(odd, empty):
    rows = Counter(tuple(r) for r in ngram_join.ngram_jaccard_join(odd).collect())
    assert rows[(1, 0, 1)] == rows[(2, 0, 2)] == rows[(3, 1, 3)] == 1 and rows[(4, 1, 3)] == 2 and rows[(None, 1, None)] == 1
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


# toxicity


def test_deobfuscation_and_score(spark):
    rng = random.Random(2)
    words = ["the", "good", "people", "walk", "over", "green", "hills", "idiot", "trash"]
    rows = [(i, " ".join(rng.choice(words[:7]) for _ in range(20)) + (" " + rng.choice(words[7:]) if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    rows += [(900, "the good 1d10t people"), (901, "walk over i d i o t hills"), (902, "green iiidiot hills"), (903, "the good people"), (904, None), (905, "")]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert [got[i].predicted for i in range(900, 906)] == [1, 1, 1, 0, 0, 0]
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200))
    assert got[904].score == got[905].score and 0 <= got[904].score < 0.5


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, none)
    assert got.count() == len(ODD) and dict(got.dtypes)["score"] == "double" and "n_tokens" in got.columns
    assert toxicity.toxicity(empty, none).count() == 0


# WARC


def test_warc_round_trip(spark):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, None), (8, "u\r\nx", ""), (1, "http://c", "é" * 5000), (2, "http://d", "other")]
    rows += [(100 + i, "http://x", f"page {i % 7}") for i in range(60)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.warc_round_trip(pages, roll_bytes=2000, shard_bytes=3000).collect()
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    want = {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), first[h or ""]) for i, _, h in rows}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to if r.record_type == "revisit" else r.page_id) for r in got} == want
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got) and len(got) == len(rows)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    names = ["▁", "a", "b", "ab", "▁a", "ba", "bb"]
    return pieces.Vocabulary(names, -np.arange(1.0, 8.0) / 2, [], 0)


def every(vocabulary, text):
    """All segmentations with their probabilities."""
    out = {(): 0.0}
    done = {}
    while out:
        after = {}
        for path, w in out.items():
            at = sum(len(vocabulary.pieces[i]) for i in path)
            if at == len(text):
                done[path] = w
                continue
            for i, p in enumerate(vocabulary.pieces):
                if text.startswith(p, at):
                    after[(*path, i)] = w + vocabulary.weights[i]
        out = after
    total = np.logaddexp.reduce(list(done.values()))
    return {k: float(np.exp(v - total)) for k, v in done.items()}


def test_samples_are_distinct_and_follow_the_distribution(vocabulary):
    p = every(vocabulary, "▁abba▁ab")
    n = 6000
    got = pieces.sample_batch(vocabulary, ["abba ab"] * n, np.arange(1, n + 1).astype(np.uint64) * np.uint64(977), 3)
    first, pairs, within = Counter(), Counter(), Counter()
    for samples in got:
        paths = [tuple(s[0].tolist()) for s in samples]
        assert len(set(paths)) == 3 and [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        assert all(np.exp(s[1]) == pytest.approx(p[k]) for s, k in zip(samples, paths, strict=True))
        first[paths[0]] += 1
        pairs[tuple(paths[:2])] += 1
        for s, k in zip(samples, paths, strict=True):
            within[k] += 1 / s[3]
    for k, q in sorted(p.items(), key=lambda x: -x[1])[:5]:
        assert first[k] / n == pytest.approx(q, abs=0.025)
        assert within[k] / n == pytest.approx(1.0, abs=0.12)  # inclusion scores make unbiased counts
    for (a, b), m in pairs.most_common(4):
        assert m / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.02)


def test_fewer_segmentations_than_asked(vocabulary):
    assert [len(s) for s in pieces.sample_batch(vocabulary, ["b", ""], np.array([1, 2], np.uint64), 5)] == [1, 1]


# PII


def test_surrogates_keep_type_and_identity(spark):
    text = "Mr. John Smith, Ann.B@mail1.example.com or ann.b@mail1.example.com, +1 (366) 555-9807, 3665559807, card 4111 1111 1111 1111, 61.131.143.218"
    rows = [(1, text), (2, "Mrs Anna Smith 61.131.143.218"), (3, None), (4, ""), (5, "nothing here 2.0 4.0")]
    got = {r.doc_id: r for r in pii.surrogate_pii(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert got[3].text is None and got[4].text == "" and got[5].text == rows[4][1]
    out = got[1].text
    assert not any(s in out for s in ("Smith", "ail1.", "366) 555-9807", "4111 1111", "61.131.143.218"))
    a, b = re.findall(r"\S+@\S+?(?=,| )", out)
    assert a.lower() == b.lower() and a[0].isupper()
    card = "".join(re.search(r"card (\d{4} \d{4} \d{4} \d{4})", out)[1].split())
    assert pii.luhn(card)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out)
    ip = re.search(r"(?:\d+\.){3}\d+", out)[0]
    assert ip in got[2].text
    name, other = re.search(r"Mr\. (\w+) (\w+)", out), re.search(r"Mrs (\w+) (\w+)", got[2].text)
    assert name[2] == other[2] and name[1] in pii.GIVEN["latin", "m"] and other[1] in pii.GIVEN["latin", "f"]


@given(st.integers(2, 400), st.text(max_size=5))
@settings(max_examples=30, deadline=None)
def test_permutation_is_one(size, tweak):
    s = pii.Surrogates(b"key")
    assert sorted(s.permute(tweak, i, size) for i in range(size)) == list(range(size))


def test_surrogates_keep_clear_of_the_corpus(spark):
    s = pii.Surrogates(b"k")
    a = "9.8.7.6"
    rows = [(1, f"at {a} now"), (2, f"at {s.of('ip', a)} now")]
    got = {r.doc_id: r.text.split()[1] for r in pii.surrogate_pii(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert len({*got.values(), a, s.of("ip", a)}) == 4
    many = {r.doc_id: r.text.split()[1] for r in pii.surrogate_pii(spark.createDataFrame(rows, "doc_id long, text string"), b"k", broadcast_rows=0).collect()}
    assert many == got


# TIFF


@given(st.binary(max_size=3000), st.sampled_from([tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.ADOBE_DEFLATE]), st.sampled_from([1, 2]), st.sampled_from([0, 16, 64]), st.sampled_from("<>"))
@settings(max_examples=60, deadline=None)
def test_tiff_round_trip(data, compression, predictor, tile, order):
    data += b"\0" * (-len(data) % 64 or 64)
    stored = tiff.write([data, data[:64]], 64, compression, predictor, tile, 7, order)
    assert [s for _, s in tiff.pages(stored)] == [data, data[:64]]


def test_lzw_fills_its_table():
    data = np.random.default_rng(0).integers(0, 256, 40_000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_media_rows(spark, odd, empty):
    got = {r.doc_id: r for r in tiff.media_features(odd).collect()}
    raw = LONG.encode()
    assert got[5].payload_sha256 == hashlib.sha256(raw + b"\0" * (-len(raw) % 64)).hexdigest() and got[5].n_bytes == len(raw)
    assert got[1].payload_bytes == got[2].payload_bytes == 64 and got[1].tail_crc32 == zlib.crc32(b"\0" * 64)
    assert tiff.media_features(empty).count() == 0
    pages = tiff.media_pages(tiff.stored_documents(odd).union(odd.sparkSession.createDataFrame([(77, 0, b"junk")], "doc_id long, n_bytes long, media binary")))
    assert [r.page for r in pages.where("doc_id = 77").collect()] == [-1]


# chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST]", "<s>[INST]user[/INST]", "plain", "", None, "a < b [x]", "[/INST", "</s"]
    rows = [(i % 4, i, ("user", "assistant", None, "sys<s>")[i % 4] if i < 8 else "assistant", nasty[i % len(nasty)], "x") for i in range(40)]
    rows += [(9, 0, "user", "hi", "x"), (9, 1, "assistant", "yo", "x"), (None, 0, "user", None, "x")]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string"))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got[9].escaped and got[0].escaped


# quality


def brute_repeats(words):
    marked, seen = set(), Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(marked)


@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeat_words(words):
    assert quality.repeat_words(quality.numbered([w.encode() for w in words])[0]) == brute_repeats(words)


def test_quality_learns_and_counts(spark, odd):
    rng = random.Random(1)
    good = [" ".join(rng.choice("alpha beta gamma delta river stone cloud".split()) + str(rng.random())[2:5] for _ in range(70)) for _ in range(60)]
    bad = [" | ".join(rng.choice("BUY NOW FREE".split()) + str(rng.random())[2:5] + "!!" for _ in range(70)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    assert all(r.kept == (r.doc_id < 60) for r in quality.quality_rules(docs, labels).collect())
    rows = {r.doc_id: r for r in quality.quality_rules(odd, labels).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept and rows[5].n_words == 30_000


# mixing


def test_mixing_meets_targets(spark, odd, empty):
    rows = [(i, ("the sh th nd of the " if i % 3 else "für keit ung ß ü ") * 20) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "en/1" if i % 3 else "de/1") for i in range(60)], "doc_id long, domain string")
    got = mixing.mix_to_targets(docs, labelled, targets={"en/1": 1.0, "de/1": 1.0})
    sums = {r.domain: (r.e, r.least) for r in got.groupBy("domain").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("e"), F.min("rate").alias("least")).collect()}
    assert sums["en/1"][0] == pytest.approx(sums["de/1"][0], rel=0.02) and all(v[1] >= 0 for v in sums.values())
    floored = mixing.mix_to_targets(docs, labelled, targets={"en/1": 1.0, "de/1": 1.0}, least_rate=1.0)
    assert floored.agg(F.min("copies")).first()[0] == 1
    assert mixing.repeated(docs, floored).count() == floored.agg(F.sum("copies")).first()[0]
    assert mixing.mix_to_targets(odd, labelled.limit(0)).count() == len(ODD)
    assert mixing.mix_to_targets(empty, labelled.limit(0)).count() == 0


# secrets


def test_secret_spans():
    key = "AKIA" + "B7" * 8
    text = f'x password = "abc" token:{"a1" * 4} {key} {"0a1b" * 6} AKIASHORT'
    base, _ = secrets.scan(text)
    assert [(k, text[i:j]) for i, k, j in base] == [("assign", "token:a1a1a1a1"), ("access", key), ("hex", "0a1b" * 6)]
    assert secrets.scan(None) == ([], []) and secrets.scan("") == ([], [])
    random_key = "q7Zp2LxW9vBn4KdR8sTf3YhG6"
    assert [text[i:j] for text in (f"see {random_key} end",) for i, _, j in secrets.scan(text)[1]] == [random_key]
    assert secrets.scan("id 123e4567-e89b-12d3-a456-426614174000 and verylongwordwithoutanydigit")[1] == []


@given(st.text("ab01xyzQRS", min_size=20, max_size=60))
def test_entropy_windows_equal_direct_computation(s):
    hot = set()
    for i in range(len(s) - secrets.WINDOW + 1):
        w = s[i : i + secrets.WINDOW]
        h = -sum(n / len(w) * np.log2(n / len(w)) for n in Counter(w).values())
        if h >= 2.5 - 1e-9 and sum(c.isdigit() for c in w) >= 2 and sum(c.isalpha() for c in w) >= 2:
            hot |= set(range(i, i + secrets.WINDOW))
    got = set()
    for i, j in secrets.entropy_runs(s, 2.5):
        got |= set(range(i, j))
    assert got == hot


def test_names_are_json_safe():
    json.dumps(sorted(" ".join(v) for v in pii.GIVEN.values()))
