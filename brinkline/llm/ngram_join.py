"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents become sets of hashed word shingles. Equal sets collapse to one representative. A signature
scheme routes representatives so that any two sets at or above the threshold meet in one block (the groups
of signatures that have one hub), and in each block an inverted index answers T-occurrence queries: the longest lists
are put aside, the short ones are heap-merged with skips, the candidates are probed in the long ones, and documents
that reach the required overlap are linked. Groups of copies are linked through hubs first, so that a block's largest component
never queries itself and no group is expanded into all its pairs.

Why no link is lost. Sets x, y with J >= num/den differ in at most
``(den - num) * (|x| + |y|) / (den + num)`` elements. Elements are dealt by hash into that bound plus ``spare``
plus one buckets, so at least ``spare + 1`` buckets agree. Frequent shingles are left out of the buckets
(leaving elements out only lowers the difference). If all agreeing buckets are empty, both sets have more than
``spare`` empty ones; such sets also emit the signatures of a second scheme that leaves nothing out and, if they
need it, its empty buckets. The choice of frequent shingles affects speed alone.

How documents are pruned. Of the ``spare + 1`` agreeing buckets of a scheme no more can be empty than a set has empty
ones, ``e``, so each set of a linked pair shares ``max(1, spare + 1 - e)`` signatures at least with the other, all of
one size class and scheme. A set of which fewer signatures met anything is linked with nothing there and leaves those
groups, which may leave others below their need; any number of such rounds is exact.

What is screened. A parity bitmap holds, for each of m places, whether an odd number of a set's hashes fall there. An
element in one of two sets only flips one place, so the places in which two bitmaps differ are never more than the
elements in which the sets differ. Pairs (or rows of a block) whose bitmaps differ in more places than the threshold
allows are dropped before any whole set is shuffled; what remains is searched on whole sets. m is a power of two of
at least twice the set's size; a bitmap is folded to half its size by xor of its halves.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from brinkline.llm.common import connected_components, give_back
from brinkline.plans.shared import materialize, shared_root

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MOST_NEED = 255


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; A-Z are lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for i in range(min(len(words), width)):
        out = _mix(out * _M1 + h[i : i + n])
    return np.unique(out)


def parity_bitmap(x: np.ndarray) -> bytes:
    """Little-endian parity bitmap of the hashes; empty for an empty set."""
    if not len(x):
        return b""
    m = max(64, 1 << (2 * len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Scheme:
    """Size classes and bucket counts of the signature scheme for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]
        self._bucket: dict[int, tuple[int, int]] = {}

    def size_class(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    def buckets(self, c: int) -> tuple[int, int]:
        """(buckets, spare) of size class c; 0 buckets where only equal sets can be linked."""
        if c not in self._bucket:
            while len(self.low) < c + 2:
                self.low.append(self.low[-1] * self.den // self.num + 1)
            differ = 2 * (self.low[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            spare = 1 + differ // 16
            self._bucket[c] = (differ + 1 + spare, spare) if differ else (0, 0)
        return self._bucket[c]

    def required(self, nx: int, ny: int) -> int:
        """Least overlap of two sets of these sizes that reaches the threshold."""
        return -(-self.num * (nx + ny) // (self.den + self.num))

    def signatures(self, x: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, needs). The last two bits of a signature tell its size class and scheme apart from the set's
        others; a need is how many signatures with those bits each set that is linked with this one shares at least.
        """
        rare = x
        if len(frequent):
            at = np.searchsorted(frequent, x)
            rare = x[frequent[np.minimum(at, len(frequent) - 1)] != x]
        c, out, needs = self.size_class(len(x)), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

        def emit(found: np.ndarray, need: int, slot: int) -> None:
            out.append((found & ~np.uint64(3)) | np.uint64(slot))
            needs.append(np.full(len(found), min(need, _MOST_NEED), np.int64))

        for tag in (c, c + 1):
            k, spare = self.buckets(tag)
            if not k:
                continue
            slot = 2 * (tag % 2)
            first, empty = self._deal(rare, k, 2 * tag)
            emit(first, max(1, spare + 1 - len(empty)), slot)
            if len(empty) > spare:
                second, empty = self._deal(x, k, 2 * tag + 1)
                need = max(1, spare + 1 - len(empty))
                emit(second, need, slot + 1)
                if len(empty) > spare:
                    emit(empty, need, slot + 1)
        return np.concatenate(out), np.concatenate(needs)

    @staticmethod
    def _deal(x: np.ndarray, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the buckets that have elements, and of those that have none."""
        b = (x % np.uint64(k)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        b, x = b[order], x[order]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
        there = b[start]
        sums = np.add.reduceat(_mix(x), start) if len(b) else np.empty(0, np.uint64)
        key = np.uint64(salt * int(_M1) & 0xFFFFFFFFFFFFFFFF)
        empty = np.setdiff1d(np.arange(k), there, assume_unique=True).astype(np.uint64)
        return _mix(_mix(there.astype(np.uint64) + key) + sums), _mix(_mix(empty + key) + np.uint64(1))


class Lists:
    """Inverted lists over sets; a list holds ascending positions, positions ascend with set size."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        self.sizes = [len(s) for s in self.sets]
        token = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        where = np.repeat(np.arange(len(self.sets)), self.sizes)
        by = np.argsort(token, kind="stable")
        self.where, token = where[by], token[by]
        self.tokens, self.start = np.unique(token, return_index=True)
        self.end = np.r_[self.start[1:], len(token)]

    def search(self, x: np.ndarray, scheme: Scheme) -> list[int]:
        """Ids of the sets that reach the threshold with x (x itself too if it is indexed)."""
        nx = len(x)
        lo = bisect_left(self.sizes, -(-scheme.num * nx // scheme.den))
        hi = bisect_left(self.sizes, nx * scheme.den // scheme.num + 1)
        if lo >= hi or not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, x), len(self.tokens) - 1)
        hit = self.tokens[at] == x
        at = at[hit]
        least = scheme.required(nx, self.sizes[lo])
        if len(at) < least:
            return []
        size = self.end[at] - self.start[at]
        order = np.argsort(-size, kind="stable")
        # DivideSkip: set the longest lists aside, as many as pay by the usual ratio of probing to merging
        n_long = min(least - 1, int(least / (0.0085 * np.log2(max(2, size.max())) + 1)))
        long_tokens = self.tokens[at[order[:n_long]]]
        short = [self.where[self.start[j] : self.end[j]] for j in at[order[n_long:]]]
        short = [s for s in (s[np.searchsorted(s, lo) : np.searchsorted(s, hi)].tolist() for s in short) if s]
        found = []
        for y, count in self._merge_skip(short, least - n_long):
            need = scheme.required(nx, self.sizes[y])
            if count + n_long < need:
                continue
            s = self.sets[y]
            probe = np.minimum(np.searchsorted(s, long_tokens), len(s) - 1)
            if count + int((s[probe] == long_tokens).sum()) >= need:
                found.append(self.ids[y])
        return found

    @staticmethod
    def _merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
        """Heap merge that yields (position, lists that hold it) where at least ``least`` do, skipping ahead between."""
        heap = [(s[0], i, 0) for i, s in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) >= least:
            y, popped = heap[0][0], []
            while heap and heap[0][0] == y:
                popped.append(heapq.heappop(heap))
            if len(popped) >= least:
                yield y, len(popped)
                target = y + 1
            else:
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    return
                target = heap[0][0]
            for v, i, j in popped:
                s = lists[i]
                j = bisect_left(s, max(target, v), j)
                if j < len(s):
                    heapq.heappush(heap, (s[j], i, j))


_SETS = "doc_id long, n_shingles long, set_hi long, set_lo long, bitmap binary"
_ROWS = "block long, shard long, turn long, query boolean, doc_id long, part long"
_SIGNED = "doc_id long, signatures array<long>, keys array<long>"


def _digest(x: np.ndarray, salt: np.uint64) -> int:
    return int(np.add.reduce(_mix(x + salt)).view(np.int64)) if len(x) else 0


def _set_batches(width: int):
    """Sizes, digests and parity bitmaps of the sets."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 1000):
                n, hi, lo, maps = [], [], [], []
                for text in texts.slice(at, 1000).to_pylist():
                    x = shingles(text, width)
                    n.append(len(x))
                    hi.append(_digest(x, _M1))
                    lo.append(_digest(x, _M3))
                    maps.append(parity_bitmap(x))
                cols = [ids.slice(at, 1000), *(pa.array(v, pa.int64()) for v in (n, hi, lo)), pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_hi", "set_lo", "bitmap"])
        give_back()

    return run


def _signature_batches(width: int, scheme: Scheme, frequent, most_seen: int = 200_000):
    """Signatures of the sets, each with a key: the set's digest, its last byte replaced by the signature's need.

    Of equal sets that a task meets only those are given whose doc_id is smaller than all before (``most_seen`` sets are
    remembered at a time), so that a text of a million copies leaves a few rows a task.
    """

    def run(batches):
        hot = np.sort(np.asarray(frequent.value, np.int64).view(np.uint64))
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 1000):
                sigs, keys, ends = [], [], [0]
                for doc_id, text in zip(ids.slice(at, 1000).to_pylist(), texts.slice(at, 1000).to_pylist(), strict=True):
                    x = shingles(text, width)
                    digest = (_digest(x, _M1), _digest(x, _M3))
                    new = len(x) and seen.get(digest, doc_id + 1) > doc_id
                    found, needs = scheme.signatures(x, hot) if new else (np.empty(0, np.uint64), np.empty(0, np.int64))
                    sigs.append(found.view(np.int64))
                    keys.append((np.int64(digest[0]) & np.int64(~_MOST_NEED)) | needs)
                    ends.append(ends[-1] + len(found))
                    if new:
                        if len(seen) >= most_seen:
                            seen.clear()
                        seen[digest] = doc_id
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v))) for v in (sigs, keys)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1000), *lists], names=["doc_id", "signatures", "keys"])
        give_back()

    return run


def _by_group(rows: DataFrame, root: str, name: str, several: dict[str, tuple], keep: str) -> DataFrame:
    """``rows`` (sig, salt, ...), written, with aggregates over each signature's group, where ``keep`` holds.

    ``several``: by name the aggregate and how its parts are put together. Groups of salt -1 are whole; frequent ones
    (salt 0 and more; a bounded list) are spread, and their totals are broadcast.
    """
    spread = W.partitionBy("sig", "salt")
    held = rows.withColumns({c: one.over(spread) for c, (one, _) in several.items()}).where(f"{keep} or salt >= 0")
    held = materialize(held, root, name)
    whole = held.where("salt >= 0").select("sig", "salt", *several).distinct().groupBy("sig").agg(*[both.alias(f"whole_{c}") for c, (_, both) in several.items()])
    told = held.join(F.broadcast(whole), "sig", "left").withColumns({c: F.coalesce(f"whole_{c}", c) for c in several})
    return told.drop(*[f"whole_{c}" for c in several]).where(keep)


def _counted(rows: DataFrame, root: str, name: str) -> DataFrame:
    """``rows`` with n, the size of their signature's group, where that is two or more."""
    return _by_group(rows, root, name, {"n": (F.count("*"), F.sum("n"))}, "n > 1")


def _pruned(met: DataFrame, root: str, name: str) -> DataFrame:
    """Rows (sig, salt, doc_id, need, n) of sets that have their need of met signatures, in groups that still have two."""
    slot = W.partitionBy("doc_id", F.col("sig").bitwiseAND(F.lit(3)))
    enough = met.drop("n").withColumn("had", F.count("*").over(slot)).where("had >= need").drop("had")
    return _counted(enough, root, name)


def _open(rest: DataFrame, root: str, name: str) -> DataFrame:
    """Rows (sig, salt, doc_id, need, hub, part) of sets that have their need of open groups, where groups still hold two parts."""
    slot = W.partitionBy("doc_id", F.col("sig").bitwiseAND(F.lit(3)))
    enough = rest.withColumn("had", F.count("*").over(slot)).where("had >= need").drop("had")
    ends = {"low": (F.min("part"), F.min("low")), "high": (F.max("part"), F.max("high"))}
    return _by_group(enough, root, name, ends, "low < high").drop("low", "high")


def _sampled(docs: DataFrame, sample_docs: int) -> tuple[DataFrame, int]:
    """About ``sample_docs`` documents by a hash of their id, and how many rows there are."""
    total = docs.count()
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_docs / max(total, 1)))), total


def _frequent_signatures(part: DataFrame, width: int, scheme: Scheme, frequent, least: int, most: int) -> DataFrame:
    """(sig) of signatures in at least ``least`` documents of a sample, ``most`` at most; like frequent shingles they only affect routing."""
    signed = part.where("doc_id is not null").mapInArrow(_signature_batches(width, scheme, frequent, 1), _SIGNED)
    return signed.select(F.explode("signatures").alias("sig")).groupBy("sig").count().where(F.col("count") >= least).orderBy(F.desc("count"), "sig").limit(most).select("sig")


def _frequent(part: DataFrame, width: int, least: int, most: int) -> list[int]:
    """Shingles in at least ``least`` documents of a bounded sample; a routing hint that never affects results."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t, width) for t in batch.column(1).slice(at, 500).to_pylist()]
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                keep = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

    rows = part.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return [r.token for r in rows.orderBy(F.desc("n"), "token").limit(most).collect()]


def _near_pairs(scheme: Scheme):
    """Rows (doc_id, hub) of (doc_id, hub, n, hub_n, bitmap, hub_bitmap) whose bitmaps leave the threshold in reach."""

    def folded(a: bytes, size: int) -> int:
        x, n = int.from_bytes(a, "little"), len(a)
        while n > size:
            n //= 2
            x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
        return x

    def near(nx: int, ny: int, a: bytes, b: bytes) -> bool:
        least = scheme.required(nx, ny)
        if least > min(nx, ny):
            return False
        size = min(len(a), len(b))
        return (folded(a, size) ^ folded(b, size)).bit_count() <= nx + ny - 2 * least

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keep = [near(*row) for row in zip(*(part.column(c).to_pylist() for c in ("n", "hub_n", "bitmap", "hub_bitmap")))]
                yield part.select(["doc_id", "hub"]).filter(pa.array(keep, pa.bool_()))

    return run


def _screened(rows: DataFrame, num: int, den: int, cells: int = 1 << 21) -> DataFrame:
    """Of ``rows`` (block, shard, turn, query, doc_id, part, n, bitmap) those with a partner in their (block, shard, turn), of the
    other kind and another part, whose bitmap leaves the threshold in reach. At most ``cells`` words are compared at once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        query, part, n = (pdf[c].to_numpy() for c in ("query", "part", "n"))
        maps = [np.frombuffer(b, np.uint64) for b in pdf["bitmap"]]
        words, keep = np.array([len(b) for b in maps], np.int64), np.zeros(len(pdf), bool)

        def stacked(of: np.ndarray, size: int) -> np.ndarray:
            found = np.stack([maps[i] for i in of])
            while found.shape[1] > size:
                found = found[:, : found.shape[1] // 2] ^ found[:, found.shape[1] // 2 :]
            return found

        sizes = np.unique(words)
        for wq in sizes:
            asks = np.flatnonzero(query & (words == wq))
            for wi in sizes:
                held = np.flatnonzero(~query & (words == wi))
                if not len(asks) or not len(held):
                    continue
                w = int(min(wq, wi))
                index, step = stacked(held, w), max(1, cells // (len(held) * w))
                for at in range(0, len(asks), step):
                    q = asks[at : at + step]
                    both = n[q][:, None] + n[held][None, :]
                    least = -(-num * both // (den + num))
                    ok = (part[q][:, None] != part[held][None, :]) & (least <= np.minimum(n[q][:, None], n[held][None, :]))
                    if ok.any():
                        differ = np.bitwise_count(stacked(q, w)[:, None, :] ^ index[None, :, :]).sum(2, dtype=np.int64)
                        ok &= differ <= both - 2 * least
                        keep[q] |= ok.any(1)
                        keep[held] |= ok.any(0)
        return pdf.loc[keep, ["block", "shard", "turn", "query", "doc_id", "part"]]

    return rows.groupBy("block", "shard", "turn").applyInPandas(run, _ROWS)


def _searched(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) found in each (block, shard, turn) of ``rows`` (block, shard, turn, query, doc_id, part, tokens).

    A turn holds some of the queries of a shard, and all of its index. A query row is searched against the index rows of its shard whose ``part`` differs from its own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scheme = Scheme(num, den)
        sets = [np.asarray(t, np.int64).view(np.uint64) for t in pdf["tokens"]]
        ids, parts, query = pdf["doc_id"].tolist(), pdf["part"].tolist(), pdf["query"].tolist()
        index = Lists([ids[i] for i in range(len(ids)) if not query[i]], [sets[i] for i in range(len(ids)) if not query[i]])
        of = {ids[i]: parts[i] for i in range(len(ids)) if not query[i]}
        a, b = [], []
        for i in range(len(ids)):
            if query[i]:
                hits = [y for y in index.search(sets[i], scheme) if of[y] != parts[i]]
                a += [ids[i]] * len(hits)
                b += hits
        return pd.DataFrame({"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64)})

    return rows.groupBy("block", "shard", "turn").applyInPandas(run, "a long, b long")


def ngram_jaccard_join(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    shard_docs: int = 500,
    broadcast_ids: int = 1_000_000,
    prune_rounds: int = 1,
    sample_docs: int = 10_000,
    frequent_share: float = 0.003,
    frequent_most: int = 50_000,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents are linked when the Jaccard similarity of their shingle sets is at least ``num / den``;
    component_id is the smallest doc_id reachable over links. Null and empty texts have no set, are linked with
    nothing and form their own component. A text of fewer than ``width`` words is one shingle. Rows with a null
    doc_id are returned with component_id null. Repeated rows are returned as often as they occur; texts of one
    doc_id that have shingles are linked with one another, and so is all that is linked with any of them. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    root = shared_root(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scheme = Scheme(num, den)
    part, total = _sampled(docs, sample_docs)
    part, least = materialize(part, root, "sample"), max(8, int(frequent_share * min(total, sample_docs)))
    frequent = spark.sparkContext.broadcast(_frequent(part, width, least, frequent_most))
    hot = materialize(_frequent_signatures(part, width, scheme, frequent, least, frequent_most), root, "hot")
    # groups of one signature, after equal sets have collapsed to their smallest doc_id: one shuffle, keyed by signature
    signed = docs.where("doc_id is not null").mapInArrow(_signature_batches(width, scheme, frequent), _SIGNED)
    by_sig = signed.select(F.explode(F.arrays_zip("signatures", "keys")).alias("s"), "doc_id").select("s.signatures", "s.keys", "doc_id")
    by_sig = by_sig.toDF("sig", "key", "doc_id").join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left")
    dealt = F.pmod(F.xxhash64("key"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    by_sig = by_sig.withColumn("salt", F.when(F.col("hot"), dealt).otherwise(F.lit(-1)))
    by_sig = by_sig.repartition("sig", "salt").groupBy("sig", "salt", "key").agg(F.min("doc_id").alias("doc_id"))
    met = _counted(by_sig.select("sig", "salt", "doc_id", F.col("key").bitwiseAND(F.lit(_MOST_NEED)).alias("need")), root, "met-0")
    for k in range(prune_rounds):
        met = _pruned(met, root, f"met-{k + 1}")
    # a signature's hub is the member that meets most others: the original among its edited copies
    degree = met.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    central = (
        met.join(degree, "doc_id")
        .groupBy("sig")
        .agg(F.max(F.struct("degree", F.col("doc_id").alias("hub"))).alias("top"))
        .select("sig", F.col("top.hub").alias("hub"))
    )
    central = materialize(central, root, "central")
    pairs = met.select("sig", "doc_id").join(central, "sig").select("doc_id", "hub")
    pairs = materialize(pairs.where("doc_id <> hub").distinct(), root, "pairs")

    # bitmaps of the documents that met any other
    sets = materialize(docs.mapInArrow(_set_batches(width), _SETS), root, "sets")
    wanted = pairs.select("doc_id").union(pairs.select("hub")).distinct()
    maps = sets.join(wanted, "doc_id", "left_semi").where("n_shingles > 0").dropDuplicates(["doc_id", "set_hi", "set_lo"])
    maps = materialize(maps.select("doc_id", F.col("n_shingles").alias("n"), "bitmap"), root, "maps")
    both = pairs.join(maps, "doc_id").join(maps.toDF("hub", "hub_n", "hub_bitmap"), "hub")
    pairs = materialize(both.mapInArrow(_near_pairs(scheme), "doc_id long, hub long").distinct(), root, "near")

    def tokens(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets_ = [shingles(t, width).view(np.int64) for t in batch.column(1).slice(at, 500).to_pylist()]
                ends = np.r_[0, np.cumsum([len(s) for s in sets_])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets_)))], names=["doc_id", "tokens"])

    def with_sets(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the whole sets of their documents."""
        ids = materialize(rows.select("doc_id").distinct(), root, f"{name}-ids")
        small = ids.count() <= broadcast_ids
        found = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
        held = found.mapInArrow(tokens, "doc_id long, tokens array<long>").where("size(tokens) > 0")
        return rows.join(materialize(held.dropDuplicates(["doc_id", "tokens"]), root, f"{name}-sets"), "doc_id")

    # hubs query the documents that may reach them, dealt into shards so that no hub's group lands in one task
    shards = pairs.select(F.col("hub").alias("block"), "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("r"))
    sizes = materialize(pairs.groupBy(F.col("hub").alias("block")).agg(F.count("*").alias("m")), root, "hub-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= broadcast_ids else sizes
    shards = shards.join(sizes, "block").withColumn("shard", (F.col("r") % F.ceil(F.col("m") / shard_docs)).cast("long"))
    once = F.lit(0).cast("long").alias("turn")
    members = shards.select("block", "shard", once, F.lit(False).alias("query"), "doc_id", F.lit(0).cast("long").alias("part"))
    hubs = shards.select("block", "shard").distinct().select("block", "shard", once, F.lit(True).alias("query"), F.col("block").alias("doc_id"), F.lit(1).cast("long").alias("part"))
    links = materialize(_searched(with_sets(members.union(hubs), "hub"), num, den), root, "links")

    # what hubs did not settle: in a group of one signature, members of different parts; a hub has met all of its group,
    # so it leaves, and a pair still open has all its shared signatures in open groups, so that the needs prune again
    parts = connected_components(links, root, "parts").select(F.col("id").alias("doc_id"), F.col("component").alias("part"))
    rest = met.join(central, "sig").where("doc_id <> hub").drop("n").join(parts, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    for k in range(prune_rounds):
        rest = _open(rest, root, f"open-{k}")
    # groups of one hub are searched together. A part of a shard's size or more has shards of its own, in order of
    # size; the others lie whole in shards behind those
    placed = rest.select(F.col("hub").alias("block"), "doc_id", "part").distinct()
    part_size = materialize(placed.groupBy("block", "part").agg(F.count("*").alias("m")), root, "part-sizes")
    along = W.partitionBy("block").orderBy(F.desc("m"), "part").rowsBetween(W.unboundedPreceding, -1)
    own = F.ceil(F.col("m") / shard_docs)
    large = part_size.where(F.col("m") >= shard_docs).withColumn("shards", own).withColumn("before", F.coalesce(F.sum("shards").over(along), F.lit(0)))
    blocks = part_size.groupBy("block").agg(F.sum(F.when(F.col("m") >= shard_docs, own).otherwise(0)).alias("taken"), F.sum(F.when(F.col("m") < shard_docs, F.col("m")).otherwise(0)).alias("rest"))
    blocks = materialize(blocks, root, "blocks")
    blocks = F.broadcast(blocks) if blocks.count() <= broadcast_ids else blocks
    small = part_size.where(F.col("m") < shard_docs).join(blocks, "block")
    dealt = F.col("taken") + F.pmod(F.xxhash64("part"), F.ceil(F.col("rest") / shard_docs))
    ranked = large.select("block", "part", "shards", F.col("before").alias("first"), (F.col("before") - 1).alias("last"))
    ranked = ranked.union(small.select("block", "part", F.lit(1).alias("shards"), dealt.alias("first"), dealt.alias("last")))
    shard = (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("shards"))).cast("long").alias("shard")
    placed = materialize(placed.join(ranked, ["block", "part"]).select("block", "part", "doc_id", shard, "last"), root, "placed")
    # a part asks the shards before its own, and its own where other parts lie there too; a shard takes its queries in
    # turns, each against the whole index of the shard
    asks = placed.where("last >= 0").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("shard"), "doc_id", "part")
    turns = asks.groupBy("block", "shard").agg(F.ceil(F.count("*") / shard_docs).cast("long").alias("turns"))
    turns = materialize(turns, root, "turns")
    turns = F.broadcast(turns) if turns.count() <= broadcast_ids else turns
    index = placed.select("block", "shard", "doc_id", "part").join(turns, ["block", "shard"])
    index = index.select("block", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("query"), "doc_id", "part")
    asks = asks.join(turns, ["block", "shard"]).select("block", "shard", F.pmod(F.xxhash64("doc_id"), F.col("turns")).alias("turn"), F.lit(True).alias("query"), "doc_id", "part")
    likely = materialize(_screened(index.union(asks).join(maps, "doc_id"), num, den).distinct(), root, "likely")
    more = _searched(with_sets(likely, "open"), num, den)

    # equal sets collapsed to their smallest doc_id; the texts of a doc_id are one document
    told = sets.where("doc_id is not null and n_shingles > 0")
    equal = materialize(told.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep")), root, "equal")
    same = F.struct("set_hi", "set_lo")
    several = told.groupBy("doc_id").agg(F.min(same).alias("least"), F.max(same).alias("most")).where("least <> most").select("doc_id")
    united = told.join(several, "doc_id", "left_semi").select("doc_id", "set_hi", "set_lo").distinct().join(equal, ["set_hi", "set_lo"])
    links = materialize(links.union(more).union(united.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")), root, "all-links")

    final = connected_components(links, root, "final").select(F.col("id").alias("rep"), "component")
    equal = equal.join(final, "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"))
    told = told.drop("bitmap").join(equal, ["set_hi", "set_lo"]).select("doc_id", "n_shingles", "component_id")
    alone = sets.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.union(alone)
