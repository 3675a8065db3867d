"""Groups of copies and of one signature: few rows a task, the same result."""

import random

import pyarrow as pa
import pytest

from brinkline.llm import ngram_join
from brinkline.llm.ngram_join import Scheme, ngram_jaccard_join


class Hint:
    value: list = []


def test_a_text_of_many_copies_leaves_few_rows_a_task():
    rng = random.Random(1)
    ids = list(range(5000))
    rng.shuffle(ids)
    text = " ".join(f"w{i}" for i in range(40))
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 500]), pa.array([text] * 500)], names=["doc_id", "text"]) for i in range(0, 5000, 500)]
    out = list(ngram_join._signature_batches(4, Scheme(85, 100), Hint)(iter(batches)))
    given = [i for b in out for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if s]
    assert len(given) < 40 and min(given) == 0 and given == sorted(given, reverse=True)
    assert sum(b.num_rows for b in out) == 5000


@pytest.mark.parametrize("share", [0.003, 2.0])
def test_spread_groups_give_what_whole_ones_give(spark, share):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        docs.append((i, " ".join(words if i % 4 else base)))
    docs += [(1000 + i, f"other {i // 2} " + " ".join(f"y{i // 2}{k}" for k in range(20))) for i in range(30)] + [(2000, None), (2001, ""), (None, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, 4, 85, 100, shard_docs=20, frequent_share=share).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in docs if i is not None and t}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    assert got == {i: (len(s), root(i)) for i, s in sets.items()} | {2000: (0, 2000), 2001: (0, 2001), None: (1, None)}
