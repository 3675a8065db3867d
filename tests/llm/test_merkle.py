"""The Merkle manifest against trees built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from brinkline.llm.merkle import field_digest, merkle_manifest

LONG = "Ab " * 200_000


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes, fanout):
    """The root of ``nodes`` and each one's siblings by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at, strict=True):
            lo = i - i % fanout
            way.append((nodes[lo:i], nodes[i + 1 : lo + fanout]))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], ways


def expected(rows, fanout):
    by = {}
    for doc_id, lang, text, later in rows:
        now = leaf(doc_id, lang, text)
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, now, doc_id, now if later is None else leaf(doc_id, lang, later)))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([r[2] for r in sorted(by[lang], key=lambda r: r[:3])], fanout) for lang in order}
    root, above = tree([trees[lang][0] for lang in order], fanout)
    out = []
    for lang, up in zip(order, above, strict=True):
        for (*_, now, doc_id, later), way in zip(sorted(by[lang], key=lambda r: r[:3]), trees[lang][1], strict=True):
            way = [*way, *up]
            folded = later
            for before, behind in way:
                folded = H(*before, folded, *behind)
            out.append((lang, doc_id, now, trees[lang][0], root, H(*[x for pair in way for side in pair for x in side]), folded, folded == root))
    return sorted(out, key=str)


def manifest(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, new string").withColumn("tree", F.lit(1)).withColumn("digest", F.lit("x"))
    fields = [F.col("doc_id"), F.col("lang")]
    found = merkle_manifest(df, "lang", "doc_id", field_digest(*fields, F.col("text")), F.when(F.col("new").isNotNull(), field_digest(*fields, F.col("new"))), **options)
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.mark.parametrize(("n", "fanout", "levels"), [(1, 8, 4), (8, 8, 1), (9, 8, 1), (65, 8, 1), (65, 8, 2), (130, 2, 2), (130, 2, 3), (81, 3, 4)])
def test_trees_of_all_sizes(spark, n, fanout, levels):
    rows = [(i, lang, f"text {i}", f"TEXT {i}" if i % 5 == 0 else None) for k, lang in enumerate(["en", "de", None, "fr", "é"]) for i in range(max(1, n // (k + 1)))]
    assert manifest(spark, rows, fanout=fanout, levels=levels) == expected(rows, fanout)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, "en", "", "x"), (None, "en", None, None), (3, "en", "same", None), (3, "en", "same", None), (3, "en", "other", "same"), (4, "", LONG, LONG.lower()), (-2, "-", "a:b", "a:b")]
    assert manifest(spark, rows) == expected(rows, 8)
    assert manifest(spark, []) == []


def test_tampered_rows_alone_fail(spark):
    rows = [(i, "en", f"Text {i}", f"text {i}" if zlib.crc32(str(i).encode()) % 3 == 0 else None) for i in range(200)]
    for _, doc_id, *_, verified in manifest(spark, rows, levels=2):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 3 != 0)


def test_numbering_in_chunks_gives_the_same_trees(spark, monkeypatch):
    rows = [(i // 2, "en" if i % 3 else "de", f"text {i % 7}", None) for i in range(300)]
    monkeypatch.setattr("brinkline.llm.merkle.CHUNK_ROWS", 40)
    assert manifest(spark, rows, levels=2) == expected(rows, 8)


def test_bad_shapes_are_refused(spark):
    with pytest.raises(ValueError, match="fanout"):
        manifest(spark, [(1, "en", "a", None)], fanout=1)
