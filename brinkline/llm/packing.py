"""Mixture-controlled packing: documents of many sources cut into windows of target token proportions.

Each source is a queue of tokens, and a deficit round robin serves the queues: every window adds a queue's quantum
(its share of the window) to its deficit and takes whole tokens of what it is owed; what remains, under one token, is
carried to the next window. While the same queues have tokens, the deficits have a closed form: after n windows of W
tokens the first j queues together have been served floor(n * W * their share). So a task that knows where its tokens
lie in their queue finds their windows and places without the tasks before it, and deficits are carried across tasks
as across windows. Where queues run out, single windows are dealt out on the driver and the others share what follows.

Tokens are counted where they are made, by task and source; running sums of these few counts give each task its places
in the queues. Tokens themselves are written once and never shuffled, unless the counts are too many to be broadcast.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinkline.llm.common import give_back
from brinkline.operators.positions import running_sums
from brinkline.plans.shared import materialize, shared_root

MOST_BROADCAST = 1_000_000
BATCH_BYTES = 8 << 20
REST = "-"  # the queue of sources too small for a token a window; others are named "=" and their source, null is "-" too

# The split of byte-level BPE, in general and for texts of Latin letters alone, where plain classes do.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ˁ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BYTE_CHARS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b if b in _BYTE_CHARS else 256 + sum(x not in _BYTE_CHARS for x in range(b)) for b in range(256)}


class Tokens:
    """Ids of texts by a file of the ``tokenizers`` library, as little-endian unsigned 32-bit bytes.

    Where the file's split is the plain byte-level one, texts of Latin-1 characters are cut into words here, and the
    library's model gives each different word its ids; recent words are kept. All other texts go to the library whole.
    """

    def __init__(self, path: str, keep: int = 300_000, keep_chars: int = 64):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        about = json.loads(self.library.to_str())
        pre, model = about.get("pre_tokenizer") or {}, about.get("model", {})
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not about.get("normalizer")
        plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.marks = [t["content"] for t in about.get("added_tokens", [])]
        self.plain = bool(plain)
        self.words = _Words(self.library.model, keep, keep_chars)

    def ids(self, text: str) -> bytes:
        if self.plain and _latin(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.words.__getitem__, _LATIN.findall(text)))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Words(dict):
    """Ids of words; of the last ``keep`` to twice as many different ones they are remembered."""

    def __init__(self, model, keep: int, keep_chars: int):
        super().__init__()
        self.model, self.keep, self.keep_chars, self.old = model, keep, keep_chars, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))], "<u4").tobytes()
        if len(word) <= self.keep_chars:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


class Schedule:
    """Which tokens of which queue go to which window.

    ``totals``: tokens by queue; ``weights``: their target shares, as whole numbers. Segments are runs of windows with
    the same queues, by the closed form, and single windows where some run out; what is left in the end goes to windows
    of a power of two each.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.window = window
        self.first: list[int] = []  # number of a segment's first window
        self.count: list[int] = []
        self.size: list[int] = []  # tokens of each of its windows
        self.bounds: list[list[int]] = []  # running weights of queues, or running quotas of a single window
        served, at, k = [[0] * len(totals)], [0] * len(totals), 0
        while any(a < t for a, t in zip(at, totals, strict=True)):
            left = [t - a for t, a in zip(totals, at, strict=True)]
            now = [w if x else 0 for w, x in zip(weights, left, strict=True)]
            n, took = self._whole(left, now)
            size, shares = window, now
            if not n:
                size = min(window, 1 << (sum(left).bit_length() - 1))
                n, took = 1, _quotas(left, now, size)
                shares = took
            self.first.append(k)
            self.count.append(n)
            self.size.append(size)
            self.bounds.append(_running(shares))
            at = [a + x for a, x in zip(at, took, strict=True)]
            served.append(at)
            k += n
        self.windows = k
        self.served = np.array(served, np.int64).reshape(len(served), len(totals))

    def _whole(self, left: list[int], weights: list[int]) -> tuple[int, list[int]]:
        """The most windows that ask no queue for more than it has, and what they take."""
        bounds, total = _running(weights), sum(weights)
        n = 1 + min(x * total // (w * self.window) for x, w in zip(left, weights, strict=True) if w)
        while n > 0:
            ends = [b * n * self.window // total for b in bounds]
            took = [b - a for a, b in zip(ends, ends[1:], strict=False)]
            if all(t <= x for t, x in zip(took, left, strict=True)):
                return n, took
            n -= 1
        return 0, []

    def places(self, queue: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that hold tokens ``lo`` to ``hi`` of a queue: its first token there, their numbers, where in them it lies."""
        column, found = self.served[:, queue], []
        s = int(np.searchsorted(column, lo, "right")) - 1
        while s < len(self.first) and column[s] < hi:
            start, end = int(column[s]), int(column[s + 1])
            if end > start:
                found += self._in_segment(s, queue, max(lo, start) - start, min(hi, end) - start, start)
            s += 1
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def _in_segment(self, s: int, queue: int, lo: int, hi: int, start: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        bounds, n, size = self.bounds[s], self.count[s], self.size[s]
        before, upto, total = bounds[queue], bounds[queue + 1], bounds[-1]
        weight = upto - before
        i, last = max(0, lo * total // (weight * size) - 2), min(n, -(-hi * total // (weight * size)) + 2)
        step = max(1, (1 << 62) // (total * size))
        while i < last:
            k = min(last - i, step)
            steps = np.arange(k + 1, dtype=np.int64)
            ends = [q + (r + b * size * steps) // total for b in (before, upto) for q, r in [divmod(b * size * i, total)]]
            mine = ends[1] - ends[0]
            keep = (mine[1:] > lo) & (mine[:-1] < hi) & (mine[1:] > mine[:-1])
            yield start + mine[:-1][keep], self.first[s] + i + steps[:-1][keep], np.diff(ends[0])[keep]
            i += k


def _running(values: list[int]) -> list[int]:
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


def _quotas(left: list[int], weights: list[int], size: int) -> list[int]:
    """``size`` tokens by weights, none asked for more than it has; who is owed most gets what is left over."""
    took = [0] * len(left)
    while (rest := size - sum(took)) > 0:
        open_ = [j for j in range(len(left)) if took[j] < left[j]]
        total = sum(weights[j] for j in open_)
        given = {j: min(left[j] - took[j], rest * weights[j] // total) for j in open_}
        if not any(given.values()):
            owed = sorted(open_, key=lambda j: (-(rest * weights[j] % total), j))
            given = dict.fromkeys(owed[:rest], 1)
        for j, x in given.items():
            took[j] += x
    return took


def tokenized(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, queue, part, at, n, ids) of docs (doc_id, text, source): ids with ``end_id`` behind them, in the order of their task.

    ``at`` counts the tokens of the source before a document in its task ``part``.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens, part, counts = tokens_of(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                doc_id, text, source = (c[i] for c in batch.columns)
                ids = tokens.ids(text.as_py() or "") + end
                name, n = source.as_py(), len(ids) // 4
                rows.append((doc_id, name, counts.get(name, 0), n, ids))
                counts[name] = counts.get(name, 0) + n
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield pack(rows, part, batch.schema.field(0).type)
                    rows, size = [], 0
            if rows:
                yield pack(rows, part, batch.schema.field(0).type)
        give_back()

    def pack(rows, part, kind):
        ids, names, at, n, data = zip(*rows, strict=True)
        columns = [pa.array([i.as_py() for i in ids], kind), pa.array(names), pa.array([part] * len(rows), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "queue", "part", "at", "n", "ids"])

    named = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(REST)).alias("queue"))
    kind = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    rest = T._parse_datatype_string("queue string, part int, at long, n long, ids binary")
    return named.mapInArrow(run, T.StructType([kind, *rest.fields]))


def pack_mixture(docs: DataFrame, path: str, targets: dict[str, float] | None = None, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of docs (doc_id, text, source) packed into windows.

    ``path``: a file of the ``tokenizers`` library. A document is its ids and ``end_id``; ``start`` counts those before
    a piece. ``targets``: shares by source (None: the sources' shares of all tokens), at least two tokens a window each;
    sources without one share a queue that gets a token a window until others run out. Without targets, sources under a
    token a window share a queue, or that of the smallest other source if together they are under one. While no queue is
    empty, a window's tokens of each queue, and the sum of those of all windows so far, differ from the targets by less
    than one. All windows are full, but for a last rest under ``window``, in windows of a power of two.

    A null source counts as a source of small share. A null or empty text is ``end_id`` alone. Every row is packed,
    rows that repeat a doc_id too. An empty table gives no pieces. Queues follow the order in which tasks read the rows.
    """
    spark = docs.sparkSession
    root = shared_root(spark)
    rows = materialize(tokenized(docs.select("doc_id", "text", "source"), path, end_id), root, "tokens")
    parts = materialize(rows.groupBy(F.col("queue").alias("source"), "part").agg(F.sum("n").alias("n")), root, "parts")
    by_source = parts.groupBy("source").agg(F.sum("n").alias("n"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    if targets is None:
        large = sorted((r.source, int(r.n)) for r in by_source.where((F.col("n") * window >= total) & (F.col("source") != REST)).collect())  # at most ``window``
        weights = dict(large)
    else:
        whole = sum(targets.values())
        if not targets or min(targets.values()) * window < 2 * whole:
            raise ValueError("a target must be two tokens a window or more")
        weights = {f"={s}": int(w / whole * (1 << 30)) for s, w in sorted(targets.items())}
        counted = by_source.where(F.col("source").isin(list(weights))).collect()  # at most half of ``window``
        large = sorted((r.source, int(r.n)) for r in counted)
    rest = total - sum(n for _, n in large)
    totals, names = [n for _, n in large], [s for s, _ in large]
    if rest and (not large or targets is not None or rest * window >= total):
        totals, names = [*totals, rest], [*names, REST]
        weights[REST] = rest if targets is None else -(-sum(weights.values()) // (window - 1))
    elif rest:
        least = min(range(len(totals)), key=lambda j: (totals[j], names[j]))
        totals[least] += rest
        weights[names[least]] += rest
    elsewhere = names.index(REST) if REST in names else (least if rest else 0)
    schedule = Schedule(totals, [weights[s] for s in names], window)

    number = F.coalesce(*[F.when(F.col("source") == s, F.lit(j)) for j, s in enumerate(names) if s != REST], F.lit(elsewhere)) if len(names) > 1 else F.lit(elsewhere)
    placed = running_sums(parts.withColumn("number", number), ["number"], ["part", "source"], {"upto": F.col("n")})
    base = materialize(placed.select(F.col("source").alias("queue"), "part", F.col("number").cast("int").alias("number"), (F.col("upto") - F.col("n")).alias("base")), root, "places")
    few = base.count() <= MOST_BROADCAST
    ready = rows.join(F.broadcast(base) if few else base, ["queue", "part"]).select("doc_id", "number", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    sent = spark.sparkContext.broadcast(schedule)

    def run(batches):
        for batch in batches:
            number, at, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            order = np.lexsort((at, number))
            number, at, n = number[order], at[order], n[order]
            cut = np.flatnonzero((np.diff(number) != 0) | (at[1:] != at[:-1] + n[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(order)], strict=True):
                yield from pieces(batch, order[lo:hi], int(number[lo]), at[lo:hi], n[lo:hi])

    def pieces(batch, rows, queue, at, n):
        """The pieces of documents that follow each other in a queue."""
        first, windows, inside = sent.value.places(queue, int(at[0]), int(at[-1] + n[-1]))
        starts = np.union1d(at, first[first > at[0]])
        doc = np.searchsorted(at, starts, "right") - 1
        slot = np.searchsorted(first, starts, "right") - 1
        begin = starts - at[doc]
        length = np.diff(np.append(starts, at[-1] + n[-1]))
        offset = inside[slot] + starts - first[slot]
        ids, doc_ids = batch.column(4), batch.column(0).take(pa.array(rows))
        sums = np.cumsum(length * 4)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
            held, data = -1, []
            for d, a, b in zip(doc[lo:hi].tolist(), begin[lo:hi].tolist(), length[lo:hi].tolist(), strict=True):
                if d != held:
                    held, whole = d, ids[int(rows[d])].as_py()
                data.append(whole[4 * a : 4 * (a + b)])
            numbers = [begin[lo:hi], length[lo:hi], n[doc[lo:hi]], windows[slot[lo:hi]], offset[lo:hi]]
            start, size, tokens, sequence, place = (pa.array(x, pa.int64()) for x in numbers)
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(doc[lo:hi])), start, size, pa.array(data, pa.binary()), tokens, sequence, place],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            lo = hi

    kind = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    rest_of = T._parse_datatype_string("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return ready.mapInArrow(run, T.StructType([kind, *rest_of.fields]))
