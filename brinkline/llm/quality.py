"""Quality rules: fixed base counts, and a hashed n-gram logistic regression trained on labelled rows.

Features of a text are the frequencies of its hashed character trigrams, words and word pairs.
The model is fitted on a bounded sample of labelled rows, calibrated by Platt scaling on a fifth of that sample
which the fit does not see, weighted back to the classes' shares among all labels, and scores Arrow batches against
a fixed threshold.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
SIZE = 1 << BITS
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SCALE = 40.0


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    mark = np.zeros(len(ids), bool)
    for i in range(3):
        mark[i : i + len(again)] |= again
    return int(mark.sum())


def base_counts(text: str, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [s for s in text.split("\n") if s.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids),
    )


def numbered(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64), seen


def hashed(text: str, ids: np.ndarray, seen: dict[bytes, int]) -> list[tuple[np.ndarray, float]]:
    """Buckets of each feature group, an entry for each occurrence, and what an occurrence counts."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    if len(c) >= 3:
        h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS), SCALE / len(h)))
    if len(ids):
        word = np.fromiter(map(zlib.crc32, seen), np.uint32, len(seen))[ids]
        out.append(((word >> np.uint32(32 - BITS)) ^ np.uint32(0x5555), SCALE / len(ids)))
        pair = word[:-1] * np.uint32(0x9E3779B1) ^ word[1:] * np.uint32(0x85EBCA6B)
        pair ^= pair >> np.uint32(15)
        out.append(((pair * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS), SCALE / len(ids)))
    return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 200, l2: float = 1e-4, rates: dict[int, float] | None = None) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, shift): Adam on the class-balanced logistic loss; Platt scaling on every fifth row.

    ``rates``: the share of each class that ``rows`` were sampled at. Each calibration row stands for 1 / rate labelled ones.
    Without rows of both classes there is nothing to tell apart, and every text gets a probability next to 1.
    """
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return np.zeros(SIZE, np.float32), 0.0, 0.0, 30.0
    stands = np.array([1 / (rates or {}).get(r[0], 1.0) for r in rows])
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    start = np.r_[0, np.cumsum([len(r[1]) for r in rows])][:-1]
    column, value = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    full = np.array([len(r[1]) > 0 for r in rows])
    share = np.where(y > 0, 0.5 / max(1, (y[~held] > 0).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    w, b = np.zeros(SIZE), 0.0
    m, v, mb, vb = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0

    def linear() -> np.ndarray:
        out = np.zeros(len(rows))
        out[full] = np.add.reduceat(value * w[column], start[full]) if full.any() else 0
        return out + b

    for t in range(1, steps + 1):
        g = share * (1 / (1 + np.exp(-np.clip(linear(), -30, 30))) - y)
        gw, gb = np.bincount(column, value * g[row], SIZE) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    use = held if held.any() else ~held
    z, t, k = linear()[use], y[use], stands[use]
    k = k * (len(k) / k.sum())
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))

    def loss(a: float, c: float) -> float:
        return float((k * (np.logaddexp(0, a * z + c) - t * (a * z + c))).sum() + 5e-4 * (a - 1) ** 2)

    a, c = 1.0, 0.0
    for _ in range(50):  # Newton steps on the two calibration parameters, halved where they overshoot
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        s = k * p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(k * (p - t) * z).sum() + 1e-3 * (a - 1), (k * (p - t)).sum()])
        size = 1.0
        while size > 1e-6 and loss(a - size * step[0], c - size * step[1]) > loss(a, c):
            size /= 2
        a, c = a - size * step[0], c - size * step[1]
    return w.astype(np.float32), float(b), float(a), float(c)


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, threshold: float = 0.3, fit_bytes: int = 256 << 20) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept.

    ``labels`` (doc_id, quality): about ``fit_rows`` rows, half of each class at most, are fitted on, fewer where their
    features would take more than ``fit_bytes`` on the driver. ``quality`` is the probability of label 1, calibrated to
    the classes' shares among all labels whatever these bounds are; kept is false where a base rule fails, else
    quality >= ``threshold``. A null text counts as empty and fails; null labels are ignored, of several labels of a
    doc_id the least counts; without labels of both classes quality is next to 1 and the model passes all. Every row
    gives a row, repeated ones too; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    dice = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) / 1_000_000
    rates = {k: min(1.0, fit_rows / 2 / n) for k, n in sizes.items()}

    def picked():
        pick = F.lit(False)
        for k, rate in rates.items():
            pick = pick | ((F.col("y") == k) & (dice < rate))
        return rows.join(F.broadcast(known.where(pick)), "doc_id").select("doc_id", "text", "y")

    # a text has no more features than buckets, nor than three a character
    need = picked().agg(F.sum(F.least(F.lit(6 * SIZE), 18 * F.length("text")))).first()[0] or 0
    if need > fit_bytes:
        rates = {k: rate * fit_bytes / need for k, rate in rates.items()}
    sample = picked().repartition(spark.sparkContext.defaultParallelism)

    def features(batches):
        for batch in batches:
            cols, vals = [], []
            for text in batch.column(1).to_pylist():
                ids, seen = numbered(words_of(text or ""))
                x = np.zeros(SIZE, np.float32)
                for h, n in hashed(text or "", ids, seen):
                    x += np.bincount(h, minlength=SIZE).astype(np.float32) * np.float32(n)
                at = np.flatnonzero(x)
                cols.append(at.astype(np.uint16).tobytes())
                vals.append(x[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], names=["doc_id", "y", "at", "x"])

    got = sample.mapInArrow(features, "doc_id long, y int, at binary, x binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.at))
    fitted = fit([(r.y, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.x, np.float32)) for r in got], rates=rates)
    model = spark.sparkContext.broadcast(fitted)

    def run(batches):
        w, b, slope, shift = model.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = words_of(text)
                ids, seen = numbered(words)
                counts = base_counts(text, words, ids)
                z = b + sum(float(w[h].sum(dtype=np.float64)) * n for h, n in hashed(text, ids, seen))
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                p = float(1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))))
                out.append((*counts, failed, p, not failed and p >= threshold))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean")
