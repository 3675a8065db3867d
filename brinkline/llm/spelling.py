"""Spelling variants: words that differ by one code point, grouped under their frequent form.

If two words differ by one insertion, deletion or replacement, the half of either one that the error spares is found
as it is in the other: its first half at the beginning, or its second half at the end. So each word is looked up twice,
in an automaton of the words and in one of the reversed words: a half is followed exactly, the rest is completed with
one error. The automata are minimal and acyclic, and the number of words that pass each transition gives every word its
place in order (a perfect hash), by which its count is found.

The automata are cut into shards: a word is filed under the halves that a word near it can have, two a direction, and
these entries are ranged in order. Many words under one half fill several shards; a word asks those whose common
beginning it can reach with one error. Words that ask one shard are dealt into bounded slices.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.plans.shared import materialize, shared_root

SHARD_ENTRIES = 50_000
SLICE_WORDS = 100_000
MOST_BROADCAST = 1_000_000
MOST_COUNTED = 200_000
END = "\0"  # behind the half under which a word is filed

_RUN = re.compile(rb"[a-z\xc0-\xff]+")


class Automaton:
    """Minimal acyclic automaton of distinct words in code-point order; ``follow`` and ``one_error`` give places in that order."""

    def __init__(self, words: list[str]):
        known: dict[tuple, int] = {}
        self.edges: list[dict[str, tuple[int, int]]] = []  # by state: letter, (next state, words skipped)
        self.final: list[bool] = []
        self.size: list[int] = []  # words from a state on
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]  # open states of the last word

        def close(depth: int, word: str) -> None:
            while len(path) > depth + 1:
                state = self._closed(*path.pop(), known)
                path[-1][1].append((word[len(path) - 1], state))

        last = ""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared, last)
            path += [(False, []) for _ in range(len(word) - shared)]
            path[-1] = (True, path[-1][1])
            last = word
        close(0, last)
        self.start = self._closed(*path.pop(), known)

    def _closed(self, final: bool, edges: list[tuple[str, int]], known: dict) -> int:
        key = (final, *edges)
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.final)
            skipped, out = int(final), {}
            for letter, target in edges:
                out[letter] = (target, skipped)
                skipped += self.size[target]
            self.edges.append(out)
            self.final.append(final)
            self.size.append(skipped)
        return state

    def walk(self, state: int, place: int, text: str) -> tuple[int, int] | None:
        """State and place behind ``text``."""
        edges = self.edges
        for c in text:
            e = edges[state].get(c)
            if e is None:
                return None
            state, place = e[0], place + e[1]
        return state, place

    def follow(self, state: int, place: int, text: str) -> int | None:
        end = self.walk(state, place, text)
        return end[1] if end and self.final[end[0]] else None

    def one_error(self, state: int, place: int, text: str) -> set[int]:
        """Places of the words from a state on that differ from ``text`` by exactly one inserted, deleted or replaced letter."""
        found = set()
        for i in range(len(text) + 1):
            here, rest, tail = self.edges[state], text[i:], text[i + 1 :]
            if rest:
                found.add(self.follow(state, place, tail))
            for c, (target, skipped) in here.items():
                found.add(self.follow(target, place + skipped, rest))
                if rest and c != rest[0]:
                    found.add(self.follow(target, place + skipped, tail))
            e = here.get(rest[0]) if rest else None
            if e is None:
                break
            state, place = e[0], place + e[1]
        found.discard(None)
        return found


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage: int = 97) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z in lower case.

    A run whose CRC-32 behind ``doc_id:`` (nothing for a null doc_id) is a multiple of ``damage`` loses one code point,
    as a stand-in for misspellings; 0 leaves all as they are. Null and empty texts have no words.
    """

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if not text:
                    continue
                data = text.encode("latin-1", "replace").lower()  # other characters become question marks, which end a run as they do
                begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(m[0] for m in _RUN.finditer(data)).items() if len(data) > 1 << 22 else Counter(_RUN.findall(data)).items():
                    if len(word) < least_length:
                        continue
                    if damage:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begin)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    total[word] += n
                if len(total) >= MOST_COUNTED:
                    yield pack(total)
                    total.clear()
        yield pack(total)

    def pack(total):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _filed(words: DataFrame) -> DataFrame:
    """(way, half, rest, word, n): each word under the halves of words one letter shorter, as long and one longer; way 1 is backward."""
    size, back = F.length("word"), F.reverse("word")
    halves = [(0, F.col("word"), (size - 1) / 2), (0, F.col("word"), (size + 1) / 2), (1, back, size / 2), (1, back, size / 2 + 1)]
    one = [F.struct(F.lit(w).alias("way"), F.left(s, h.cast("int")).alias("half"), s.substr(h.cast("int") + 1, size).alias("rest")) for w, s, h in halves]
    return words.select(F.explode(F.array(*one)).alias("e"), "word", "n").select("e.*", "word", "n")


def _asked(words: DataFrame) -> DataFrame:
    """(way, half, rest, word) of the two questions of each word."""
    size, back = F.length("word"), F.reverse("word")
    halves = [(0, F.col("word"), size / 2), (1, back, (size + 1) / 2)]
    one = [F.struct(F.lit(w).alias("way"), F.left(s, h.cast("int")).alias("half"), s.substr(h.cast("int") + 1, size).alias("rest")) for w, s, h in halves]
    return words.select(F.explode(F.array(*one)).alias("e"), "word").select("e.*", "word")


def _answer(key: tuple[pa.Scalar, ...], entries: pa.Table, asked: pa.Table) -> pa.Table:
    """For each word that asks a shard: how many words it finds near there, and the one of largest count."""
    rows = sorted(zip(*(entries[c].to_pylist() for c in ("way", "half", "rest", "word", "n")), strict=True), key=lambda r: (r[0], r[1] + END + r[2]))
    found = []
    for way in (0, 1):
        mine = [r for r in rows if r[0] == way]
        if not mine:
            continue
        automaton, ends = Automaton([h + END + r for _, h, r, _, _ in mine]), {}
        for w, half, rest, word in zip(*(asked[c].to_pylist() for c in ("way", "half", "rest", "word")), strict=True):
            if w != way:
                continue
            if half not in ends:
                ends[half] = automaton.walk(automaton.start, 0, half + END)
            if ends[half] is None:
                continue
            near = [mine[i] for i in automaton.one_error(*ends[half], rest)]
            if way:  # what shares the first half too has been found forward
                first = word[: len(word) // 2]
                near = [r for r in near if not r[3].startswith(first)]
            if near:
                best = min(near, key=lambda r: (-r[4], r[3]))
                found.append((word, len(near), best[3], best[4]))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.table([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["word", "n_near", "near", "near_n"])


def near_words(words: DataFrame, root: str) -> DataFrame:
    """(word, n_near, near, near_n) of words (word, n; each once) that have another one at one error: how many, and that of largest n (ties: the first)."""
    filed = _filed(words)
    shards = max(1, -(-4 * words.count() // SHARD_ENTRIES))
    ranged = filed.repartitionByRange(shards, "way", "half", "rest").withColumn("shard", F.spark_partition_id())
    ranged = materialize(ranged, root, "entries")
    owners = ranged.groupBy("way", "half", "shard").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    shared = F.aggregate(F.sequence(F.lit(0), F.length("low")), F.lit(0), lambda a, i: F.when(F.left("low", i) == F.left("high", i), i).otherwise(a))
    split = F.count("*").over(W.partitionBy("way", "half")) > 1
    owners = owners.withColumn("common", F.when(split, F.left(F.col("low"), shared)).otherwise(F.lit("")))
    # a word in reach of a common beginning has a beginning of that length at two errors or fewer
    reach = F.levenshtein("common", F.left("rest", F.length("common"))) <= 2
    asked = _asked(words).join(owners.select("way", "half", "shard", "common"), ["way", "half"]).where(reach).select("way", "half", "rest", "word", "shard")
    asked = materialize(asked, root, "asked")
    slices = asked.groupBy("shard").agg(F.ceil(F.count("*") / SLICE_WORDS).cast("int").alias("slices"))
    few = shards <= MOST_BROADCAST
    slices = F.broadcast(slices) if few else slices
    dealt = asked.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")).drop("slices")
    copies = ranged.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    found = copies.groupBy("shard", "slice").cogroup(dealt.groupBy("shard", "slice")).applyInArrow(_answer, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near", "near_n"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", "best.near_n")


def _roots(forms: DataFrame, root: str) -> DataFrame:
    """(word, root) of forms (word, form), a forest: each round doubles how far a word looks."""
    now, k = materialize(forms.select("word", F.col("form").alias("root")), root, "roots-0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        k += 1
        found = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        found = materialize(found, root, f"roots-{k}")
        now = found.select("word", "root")
        if not found.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, ratio: int = 2, **counting: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of docs (doc_id, text); see ``word_counts`` for what counts as one.

    ``n_near``: how many words differ from it by exactly one inserted, deleted or replaced code point. ``form``: that of
    them with the largest n (ties: the first in code-point order), if its n is ``ratio`` times the word's or more, else
    null. ``root``: where following forms ends, the word itself without one. ``ratio`` must be 2 or more, so that forms
    lead upwards. Repeated rows count again; null and empty texts and an empty table have no words; extra columns are
    ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    root = shared_root(docs.sparkSession)
    words = materialize(word_counts(docs, **counting), root, "words")
    near = words.join(near_words(words, root), "word", "left")
    fits = F.col("near_n") >= ratio * F.col("n")
    found = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    found = materialize(found, root, "forms")
    roots = _roots(found.where("form is not null").select("word", "form"), root)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
