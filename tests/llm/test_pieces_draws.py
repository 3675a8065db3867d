from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from brinkline.llm import pieces

NAMES = ["▁", "a", "b", "ab", "▁a", "ba", "bb"]
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def every(vocabulary, text):
    """All segmentations with their probabilities."""
    out, done = {(): 0.0}, {}
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


@pytest.mark.parametrize(("text", "k"), [("abba", 2), ("abba", 3), ("ab ba", 2), ("b", 2)])
def test_ordered_draws_follow_sampling_without_replacement(text, k):
    vocabulary = pieces.Vocabulary(NAMES, -np.arange(1.0, 8.0) / 2, [], 0)
    p = every(vocabulary, "▁" + text.replace(" ", "▁"))
    k, n = min(k, len(p)), 40_000
    seen, within = Counter(), Counter()
    for samples in pieces.sample_batch(vocabulary, [text] * n, np.arange(1, n + 1).astype(np.uint64), k):
        seen[tuple(tuple(s[0].tolist()) for s in samples)] += 1
        for s in samples:
            within[tuple(s[0].tolist())] += 1 / s[3]
    chi, df, rare, rare_seen = 0.0, -1, 0.0, 0
    for order in permutations(p, k):
        want, left = n, 1.0
        for x in order:
            want, left = want * p[x] / left, left - p[x]
        if want < 8:
            rare, rare_seen = rare + want, rare_seen + seen[order]
            continue
        chi, df = chi + (seen[order] - want) ** 2 / want, df + 1
    if rare >= 8:
        chi, df = chi + (rare_seen - rare) ** 2 / rare, df + 1
    assert sum(seen.values()) == n and chi < df + 5 * np.sqrt(2 * max(df, 1))
    if k < len(p):
        for x, q in p.items():  # inclusion scores make unbiased counts
            if q > 0.02:
                assert within[x] / n == pytest.approx(1.0, abs=0.05)


def test_rows_of_a_table(spark):
    long = " ".join(f"wörd{i % 977}x{i % 31}" for i in range(20_000)) + " \n\n  x\t ▁"
    rows = [(1, None), (2, ""), (3, "It's a test,  a test.\nIt's a test"), (3, "It's a test,  a test.\nIt's a test"), (4, long), (None, "b c"), (5, "日本 🙂 ퟿"), (6, "▁a")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, ids string, sample_rank int")
    texts = dict(rows)
    got = [pieces.sample_segmentations(d, MODEL, k=3, batch_chars=c).collect() for d, c in ((docs.repartition(1), 2_000_000), (docs.repartition(5, "doc_id"), 50))]
    key = lambda r: (r.doc_id or -1, r.sample_rank)
    assert sorted(got[0], key=key) == sorted(got[1], key=key)  # neither partitions nor batches matter
    of = {}
    for r in got[0]:
        of.setdefault(r.doc_id, []).append(r)
    assert [len(of[i]) for i in (1, 2, 3, 4, None, 5)] == [1, 1, 6, 3, 3, 1]  # bytes have one reading
    assert len({bytes(r.ids) for r in of[3]}) == 3 and all(bytes(r.ids) == b"" and r.log_prob == 0 for r in of[1] + of[2])
    vocabulary = pieces.Vocabulary.load(MODEL)
    for i in (3, 5, None):
        assert all(r.decoded and vocabulary.decode(np.frombuffer(r.ids, np.int32)) == texts[i] for r in of[i])
    assert not any(r.decoded for r in of[4] + of[6])  # a word mark of the text comes back as a blank
    assert pieces.sample_segmentations(docs.limit(0), MODEL).count() == 0
