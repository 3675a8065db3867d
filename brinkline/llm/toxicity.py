"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Spans that may be obfuscated (symbols or digits within
words or next to them, letters repeated three times or more, doubled letters that the model had rather single, single
letters or stand-ins set apart by one or two blanks) become lattices of what each character may stand for; Viterbi
decoding under the channel costs and the language model restores them. The restored text is scored twice: with word
and word-beginning evidence learned from labelled rows by sequential covering, so that words which merely accompany
toxic ones in copies earn nothing, and with a calibrated logistic regression on hashed words and word beginnings, which
grades what no rule covers. Either one may make a text toxic.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinkline.llm import quality
from brinkline.llm.common import extended, give_back, without

# Letters of the model, and what a symbol may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i",
}
SUBSTITUTE, COLLAPSE, JOIN = 1.0, 0.5, 0.3
#: Of a single letter for a doubled one; of a stand-in at the end of a word that is plain otherwise.
SINGLE, EDGE = 5.0, 4.0

_C = 64
_OTHER, _EDGE = len(LETTERS) + 1, 0
_CLASS = np.full(65536, _OTHER, np.int64)
for _i, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _i + 1
for _c in " \t\n\r\x0b\x0c.,;:?\"'()":
    _CLASS[ord(_c)] = _EDGE
_OF = {c: i + 1 for i, c in enumerate(LETTERS)}
_SYMBOL = re.compile("[" + re.escape("".join(STANDS_FOR)) + "]+")
_AROUND = "!|+.,;:*#%&?()\"'"
_MARKS = "!|+("  # stand-ins that are punctuation as well
_HEXES = re.compile(r"[^\w]*[0-9a-f-]{16,}[^\w]*")
_READ = np.array([chr(i) in _OF or chr(i) in STANDS_FOR for i in range(65536)])
_WORDLIKE = np.array([chr(i).isalnum() for i in range(65536)])


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(code, 65535)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character-class trigrams over every text; at most 64^3 cells reach the driver whatever the input."""

    def run(batches):
        total, held, size = np.zeros(_C**3, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    x = np.concatenate(([_EDGE, _EDGE], classes(text.lower()), [_EDGE]))
                    held.append((x[:-2] * _C + x[1:-1]) * _C + x[2:])
                    size += len(x)
                if size > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=_C**3)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=_C**3)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["cell", "n"])

    out = np.zeros(_C**3)
    for r in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def log_model(counts: np.ndarray, backoff: float = 2.0) -> np.ndarray:
    """log P(c | a, b), with the bigram estimate as prior of weight ``backoff``."""
    n3 = counts.reshape(_C, _C, _C)
    n2 = n3.sum(0)
    n1 = n2.sum(0) + 0.5
    p1 = n1 / n1.sum()
    p2 = (n2 + backoff * p1) / (n2.sum(1, keepdims=True) + backoff)
    return np.log((n3 + backoff * p2[None]) / (n3.sum(2, keepdims=True) + backoff))


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model = model
        self.decoded = lru_cache(50_000)(self._decode)

    def _options(self, span: str) -> list[list[tuple[str, float]]]:
        """For each position of the lattice the strings that it may stand for, with costs."""
        apart = len(span) >= 5 and all(not c.isalnum() and c not in STANDS_FOR for c in span[1::2])
        inner = any(c in STANDS_FOR for c in span[1:-1])
        out, i = [], 0
        while i < len(span):
            c, n = span[i], 1
            while i + n < len(span) and span[i + n] == c:
                n += 1
            if apart and i % 2:
                out.append([("", JOIN), (" ", 0.0)])
                i += 1
                continue
            price = SUBSTITUTE if apart or inner or 0 < i < len(span) - 1 else EDGE
            reads = [(c, 0.0)] + [(x, price) for x in STANDS_FOR.get(c, "")]
            if n >= 3 and not apart:
                out.append([(x * k, cost + (COLLAPSE if k < n else 0)) for x, cost in reads for k in (1, 2, n) if k == n or x in _OF])
                i += n
            elif n == 2 and not apart and c in _OF:
                out.append([(c * 2, 0.0), (c, SINGLE)])
                i += 2
            else:
                out.append(reads)
                i += 1
        return out

    def _decode(self, span: str) -> str:
        """Viterbi over the lattice; a state is the last two character classes."""
        model = self.model
        best = {(_EDGE, _EDGE): (0.0, None)}
        for options in self._options(span) + [[(" ", 0.0)]]:
            after: dict = {}
            for (a, b), (cost, back) in best.items():
                for text, price in options:
                    x, y, c = a, b, cost + price
                    for ch in text:
                        z = _EDGE if ch == " " else _OF.get(ch, _OTHER)
                        c -= model[x, y, z]
                        x, y = y, z
                    if (x, y) not in after or c < after[x, y][0]:
                        after[x, y] = (c, (back, text))
            best = after
        _, back = min(best.values(), key=lambda v: v[0])
        parts = []
        while back is not None:
            back, text = back
            parts.append(text)
        return "".join(reversed(parts))[:-1]

    def spans(self, low: str) -> list[tuple[int, int]]:
        """Disjoint spans of the lower-cased text that may be obfuscated."""
        x = classes(low)
        letter = (x != _EDGE) & (x != _OTHER)
        found = []
        if len(x) > 2:
            end = 0
            for i in np.flatnonzero(letter[2:] & (x[2:] == x[1:-1]) & (x[1:-1] == x[:-2])).tolist():
                if i >= end:  # once a token, however long it is
                    found.append(self._token(low, i))
                    end = found[-1][1]
        found += self._doubled(low, x, letter)
        alone = np.r_[False, letter, False]
        alone = alone[1:-1] & ~alone[:-2] & ~alone[2:]
        if len(x) > 4:
            for i in np.flatnonzero(alone[:-4] & alone[2:-2] & alone[4:]).tolist():
                if not found or i + 5 > found[-1][1] or found[-1][0] > i:
                    j = i + 5
                    while j + 1 < len(x) and alone[j + 1]:
                        j += 2
                    found.append((i, j))
        if "  " in low:
            found += self._wide(low, alone)
        found += self._mixed(low, letter)
        end = 0
        for m in _SYMBOL.finditer(low):
            if m.start() < end:
                continue
            i, j = self._token(low, m.start())
            end = j
            token = low[i:j].strip(_AROUND)
            if any(c in _OF for c in token) and not _HEXES.fullmatch(token):
                i += low[i:j].index(token)
                j = i + len(token)
                # a single stand-in next to the word may be a letter of it
                if i and low[i - 1] in STANDS_FOR and (i < 2 or low[i - 2] != low[i - 1]):
                    i -= 1
                if j < len(low) and low[j] in STANDS_FOR and (j + 1 == len(low) or low[j + 1] != low[j]):
                    j += 1
                if any(c in STANDS_FOR for c in low[i:j]):
                    found.append((i, j))
        out = []
        for i, j in sorted(set(found), key=lambda s: (s[0], -s[1])):
            if not out or i >= out[-1][1]:
                out.append((i, j))
        return out

    def _doubled(self, low: str, x: np.ndarray, letter: np.ndarray) -> list[tuple[int, int]]:
        """Tokens with a doubled letter that the model had rather single."""
        if len(x) < 3:
            return []
        y = np.r_[_EDGE, _EDGE, x, _EDGE]  # x[i] is y[i + 2]
        at = np.flatnonzero(letter[1:] & (x[1:] == x[:-1])) + 1
        if not len(at):
            return []
        a, b, after = y[at], y[at + 1], y[at + 3]
        gain = self.model[a, b, after] - self.model[a, b, b] - self.model[b, b, after]
        out, end = [], 0
        for i in at[gain > SINGLE].tolist():
            if i >= end:
                i, end = self._token(low, i)
                core = low[i:end].strip(_AROUND)
                i += low[i:end].index(core)
                if not _HEXES.fullmatch(core):
                    out.append((i, i + len(core)))
        return out

    @staticmethod
    def _wide(low: str, alone: np.ndarray) -> list[tuple[int, int]]:
        """Runs of three or more single letters set apart by one or two blanks, two at least once."""
        at = np.flatnonzero(alone)
        out, k = [], 0
        while k < len(at):
            j = k
            while j + 1 < len(at) and at[j + 1] - at[j] <= 3 and low[at[j] + 1 : at[j + 1]].isspace():
                j += 1
            if j - k >= 2 and "  " in low[at[k] : at[j]]:
                out.append((int(at[k]), int(at[j]) + 1))
            k = j + 1
        return out

    @staticmethod
    def _mixed(low: str, letter: np.ndarray) -> list[tuple[int, int]]:
        """Runs of three or more single characters a separator apart, letters as well as characters that stand for some."""
        if len(low) < 5:
            return []
        code = np.minimum(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)
        read, wordlike = _READ[code], np.r_[False, _WORDLIKE[code], False]
        apart = ~read & ~wordlike[1:-1]
        single = read & ~wordlike[:-2] & ~wordlike[2:]
        link = single[:-2] & apart[1:-1] & single[2:]  # from i to i + 2
        found = []
        start = link.copy()
        start[2:] &= ~link[:-2]
        for i in np.flatnonzero(start[:-2] & link[2:]).tolist():
            j = i
            while j < len(link) and link[j]:
                j += 2
            letters = int(letter[i : j + 1 : 2].sum())
            if 0 < letters <= (j - i) // 2 and (letters > 1 or any(c not in _MARKS and c in STANDS_FOR for c in low[i : j + 1 : 2])):
                found.append((i, j + 1))
        return found

    @staticmethod
    def _token(low: str, at: int) -> tuple[int, int]:
        i = max(low.rfind(" ", 0, at), low.rfind("\n", 0, at), low.rfind("\t", 0, at)) + 1
        ends = [e for e in (low.find(" ", at), low.find("\n", at), low.find("\t", at)) if e >= 0]
        return i, min(ends) if ends else len(low)

    def restore(self, text: str | None) -> str:
        low = (text or "").lower()
        parts, at = [], 0
        for i, j in self.spans(low):
            parts += [low[at:i], self.decoded(low[i:j].replace("  ", " "))]
            at = j
        return "".join(parts) + low[at:] if parts else low


_WORD = re.compile(r"[^\W\d_]+")


def evidence(restored: str, lengths: tuple[int, ...] = (4, 5, 6, 7, 8)) -> set[str]:
    """Whole words (marked with a closing $) and beginnings of words."""
    words = set(_WORD.findall(restored))
    return {f"{w}$" for w in words} | {w[:k] for w in words for k in lengths if len(w) > k}


def graded(restored: str) -> tuple[list[str], float]:
    """A text's different words, and what one counts: the less, the longer the text is."""
    words = _WORD.findall(restored)
    return sorted(set(words)), 1.0 / math.sqrt(1.0 + len(words) / 50.0)


def buckets(word: str, lengths: tuple[int, ...] = (4, 6)) -> list[int]:
    """Hashes of a word and its beginnings."""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) >> (32 - quality.BITS) for f in (f"{word}$", *(word[:k] for k in lengths if len(word) > k))]


def cover(docs: list[tuple[bool, list[int]]], names: list[str], negative_weight: float, strictness: float = 2.0) -> tuple[float, dict[str, float]]:
    """Sequential covering: (score without evidence, {evidence: probability}).

    Takes, again and again, the evidence that newly covers most toxic rows less ``strictness`` times the clean ones,
    and drops the covered rows, until a step gains fewer than two rows. Without any toxic row the score is under 1 / 2.
    """
    rows: dict[int, set[int]] = {}
    for i, (_, ids) in enumerate(docs):
        for f in ids:
            rows.setdefault(f, set()).add(i)
    pos = {i for i, (toxic, _) in enumerate(docs) if toxic}
    everywhere = {f: (len(r & pos), len(r - pos)) for f, r in rows.items()}
    left = set(range(len(docs)))
    rules: dict[str, float] = {}
    # of equal gains the longest name goes first, of those the last one; gains only fall, so the heap's are bounds
    rank = {f: i for i, f in enumerate(sorted(everywhere, key=lambda g: (len(names[g]), names[g]), reverse=True))}
    heap = [(-(p - strictness * negative_weight * n), rank[f], f) for f, (p, n) in everywhere.items()]
    heapq.heapify(heap)
    while heap and -heap[0][0] >= 2:
        bound, place, f = heap[0]
        now = rows[f] & left
        good = len(now & pos)
        gain = good - strictness * negative_weight * (len(now) - good)
        if gain < -bound:
            heapq.heapreplace(heap, (-gain, place, f))
            continue
        p, n = everywhere[f]
        rules[names[f]] = (p + 0.1) / (p + negative_weight * n + 0.2)
        left -= now
        heapq.heappop(heap)
    missed = len(left & pos)
    base = (missed + 0.5) / (missed + negative_weight * len(left - pos) + (1.0 if pos else 2.0))
    return base, rules


class _Grades(dict):
    """What each word adds under the graded model, remembered by word."""

    def __init__(self, weights: tuple[np.ndarray, float, float, float], most: int = 500_000):
        super().__init__()
        (self.weights, self.bias, self.slope, self.shift), self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = float(self.weights[buckets(word)].sum(dtype=np.float64))
        return found

    def probability(self, restored: str) -> float:
        words, one = graded(restored)
        z = self.slope * (self.bias + one * math.fsum(map(self.__getitem__, words))) + self.shift
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def toxicity(docs: DataFrame, labels: DataFrame, train: str = "true", fit_rows: int = 20_000, graded_rows: int = 2_000, graded_bytes: int = 32 << 20) -> DataFrame:
    """docs (doc_id, text, ...) with score, predicted (score >= 0.5) and n_restored added; every row is kept.

    ``labels`` (doc_id, toxic) rows for which the SQL condition ``train`` holds are learned from: ``fit_rows`` at
    most, half of them toxic at most, taken by hash of the doc_id. Evidence is counted over all of them, so scores
    don't depend on partitions. The graded model is fitted on about ``graded_rows`` of them, fewer where their features
    would take more than ``graded_bytes`` on the driver, and calibrated to the classes' shares among all labels. Null
    and empty texts get the score of a text without evidence; where no toxic row is learned from, every text gets it
    and it is under 0.5, and without rows of both classes nothing is graded. Rows with a null label are not learned from; of several
    labels of a doc_id the toxic one counts. Repeated rows are scored alike; existing columns of these names are
    replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    model = spark.sparkContext.broadcast(log_model(trigram_counts(docs.select(text.alias("text")))))
    known = labels.where(train).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, fit_rows / 2 / n) for k, n in sizes.items()}
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    sample = known.where(F.col("toxic") & (dice < share.get(True, 1.0)) | ~F.col("toxic") & (dice < share.get(False, 1.0)))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic", dice.alias("dice")).repartition(spark.sparkContext.defaultParallelism)

    def seen(batches):
        restore, counts = Restorer(model.value).restore, {True: Counter(), False: Counter()}
        for batch in batches:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(evidence(restore(t)))
        names = list(counts[True].keys() | counts[False].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[t][f] for f in part], pa.int64()) for t in (True, False))], names=["f", "p", "n"])

    weight = share.get(True, 1.0) / share.get(False, 1.0)
    found = rows.mapInArrow(seen, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("p") >= 2).where(F.col("p") > 2.0 * weight * F.col("n"))
    names = sorted(r.f for r in found.select("f").collect())
    number = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def held(batches):
        restore = Restorer(model.value).restore
        for batch in batches:
            ids = [sorted(number.value[f] for f in evidence(restore(t)) if f in number.value) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["toxic", "ids"])

    # a text has no more features than buckets, nor than three for every two characters
    rates = {k: min(share[k], graded_rows / 2 / n) for k, n in sizes.items()}
    few = rows.where(F.col("toxic") & (F.col("dice") < rates.get(True, 1.0)) | ~F.col("toxic") & (F.col("dice") < rates.get(False, 1.0)))
    need = few.agg(F.sum(F.least(F.lit(12 * quality.SIZE), 18 * F.length("text")))).first()[0] or 0
    if need > graded_bytes:
        rates = {k: r * graded_bytes / need for k, r in rates.items()}
        few = rows.where(F.col("toxic") & (F.col("dice") < rates.get(True, 1.0)) | ~F.col("toxic") & (F.col("dice") < rates.get(False, 1.0)))

    def features(batches):
        restore = Restorer(model.value).restore
        for batch in batches:
            at, values = [], []
            for t in batch.column(0).to_pylist():
                words, one = graded(restore(t))
                found, n = np.unique(np.array([h for w in words for h in buckets(w)], np.uint16), return_counts=True)
                at.append(found.tobytes())
                values.append((n * one).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["toxic", "dice", "at", "x"])

    weights = None
    if sizes.get(True) and sizes.get(False):
        got = sorted(few.mapInArrow(features, "toxic boolean, dice double, at binary, x binary").collect(), key=lambda r: (r.dice, r.at))
        fitted = [(int(r.toxic), np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.x, np.float32)) for r in got]
        if len({y for y, *_ in fitted}) == 2:
            weights = quality.fit(fitted, l2=1e-3, rates={int(k): r for k, r in rates.items()})
    base, rules = cover([(r.toxic, r.ids) for r in rows.mapInArrow(held, "toxic boolean, ids array<long>").collect()], names, weight)
    learned = spark.sparkContext.broadcast((base, rules, weights))
    kept = without(docs, "score", "predicted", "n_restored")

    def score(batches):
        restorer = Restorer(model.value)
        base, rules, weights = learned.value
        grade = _Grades(weights) if weights else None
        tests = [(f.rstrip("$"), re.compile(r"(?<![^\W\d_])" + re.escape(f.rstrip("$")) + (r"(?![^\W\d_])" if f.endswith("$") else "")), p) for f, p in rules.items()]
        for batch in batches:
            scores, restored = [], []
            for t in batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist():
                low = restorer.restore(t)
                miss = 1.0 - (base if grade is None else grade.probability(low) ** 2)  # squared: alone it must be sure
                for plain, pattern, p in tests:
                    if plain in low and pattern.search(low):
                        miss *= 1.0 - p
                scores.append(1.0 - miss)
                restored.append(int(low != (t or "").lower()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(restored, pa.int32())],
                names=[*batch.schema.names, "score", "predicted", "n_restored"],
            )
        give_back()

    return kept.mapInArrow(score, extended(kept.schema, score=T.DoubleType(), predicted=T.IntegerType(), n_restored=T.IntegerType()))
