"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text is cut where no piece of the vocabulary can cross (before a run of word marks, around line ends), and the
segments' lattices are laid end to end. Backward sums over the lattice give each node's exact log mass, which makes
perturbed A-star search exact: a subtree's best perturbed score is a Gumbel variable located at its mass, so the
frontier is a heap of (perturbed bound, node), the first path is an ancestral draw, and every further one is popped
from the frontier, leaves its parent path at that node and continues with ancestral draws. The k paths are distinct
and ordered; the bound left on the heap is the threshold from which inclusion scores follow. All randomness is a
hash of (seed, row key, purpose, number of the path, place), so no two decisions share a number and results don't
depend on partitions.
"""

from __future__ import annotations

import heapq
import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinkline.llm.common import give_back

MARK = "▁"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x100000001B3)
_MARK = ord(MARK)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys and counters."""
    return ((_mix(_mix(key) + counter * _M1) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Vocabulary:
    """Pieces, log weights and ids of a SentencePiece model.

    A unigram model's scores are its log weights. The scores of a BPE model are ranks; Zipf's law turns rank r into
    the log weight -log(r + 1). Characters without a piece fall back to their bytes at ``byte_cost`` each.
    """

    def __init__(self, pieces: list[str], weights: np.ndarray, byte_ids: list[int], unknown: int, byte_cost: float = 12.0):
        self.pieces, self.weights, self.byte_ids, self.unknown, self.byte_cost = pieces, weights, byte_ids, unknown, byte_cost

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
        ranks = bool(plain.any()) and bool((scores[plain] == np.round(scores[plain])).all())
        weights = np.where(plain, -np.log1p(np.maximum(0, -scores)) if ranks else scores, np.nan)
        at = {p: i for i, p in enumerate(pieces) if sp.is_byte(i)}
        byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)] if len(at) == 256 else []
        return cls(pieces, weights, byte_ids, sp.unk_id())

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length - 1: sorted hashes of pieces, their ids, sorted hashes of beginnings that longer pieces have."""
        whole: list[list[tuple[int, int]]] = []
        begins: list[set[int]] = []
        for i, p in enumerate(self.pieces):
            if np.isnan(self.weights[i]) or not p:
                continue
            if re.search(rf"[^{MARK}]{MARK}", p) or "\n" in p:
                raise ValueError("a piece of this model crosses a cut")
            while len(whole) < len(p):
                whole.append([])
                begins.append(set())
            h = 0
            for k, c in enumerate(p):
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                (begins[k].add(h) if k + 1 < len(p) else whole[k].append((h, i)))
        out = []
        for w, b in zip(whole, begins, strict=True):
            w.sort()
            out.append((np.array([h for h, _ in w], np.uint64), np.array([i for _, i in w], np.int64), np.array(sorted(b), np.uint64)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of a piece sequence: bytes are joined, word marks become spaces, the leading one goes."""
        if not self._high[ids].any():
            return "".join(map(self._shown.__getitem__, ids.tolist())).replace(MARK, " ")[1:]
        parts, raw = [], bytearray()
        of = self._byte_of
        ids = ids.tolist()
        for i in ids:
            if i in of:
                raw.append(of[i])
            else:
                if raw:
                    parts.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                parts.append(self.pieces[i])
        parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ")[1:]

    def spells(self, ids: np.ndarray, marked: np.ndarray, text: str) -> bool:
        """Whether decoding gives ``text``, whose code points with word marks are ``marked``."""
        if MARK in text or self._high[ids].any():
            return self.decode(ids) == text
        codes, start, size = self._spelled
        size = size[ids]
        at = np.repeat(start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return len(at) == len(marked) and bool((codes[at] == marked).all())

    @cached_property
    def _spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all that pieces show, laid end to end, and where each starts and how long it is."""
        size = np.array([len(p) for p in self._shown], np.int64)
        return np.frombuffer("".join(self._shown).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size

    @cached_property
    def _shown(self) -> list[str]:
        """What a piece shows by itself; bytes under 0x80 are characters."""
        return [chr(self._byte_of[i]) if self._byte_of.get(i, 128) < 128 else p for i, p in enumerate(self.pieces)]

    @cached_property
    def _high(self) -> np.ndarray:
        """Pieces that are bytes of a longer sequence."""
        return np.array([self._byte_of.get(i, 0) >= 128 for i in range(len(self.pieces))])

    @cached_property
    def _byte_of(self) -> dict[int, int]:
        return {i: b for b, i in enumerate(self.byte_ids)}


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


class Lattice:
    """The lattices of different segments laid end to end, as edges sorted by start, with backward log masses.

    ``code`` holds the segments' code points, ``lengths`` their sizes. What is computed for a segment depends on that
    segment alone, so it is the same in whatever batch the segment occurs.
    """

    def __init__(self, vocabulary: Vocabulary, code: np.ndarray, lengths: np.ndarray):
        n = len(code)
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        self.code = code
        wide = code.astype(np.uint64)
        stop = np.repeat(self.end, lengths)
        at, h = np.arange(n), np.zeros(n, np.uint64)
        starts, sizes, ids = [], [], []
        for k, (whole, whole_ids, begins) in enumerate(vocabulary.tables):
            live = at + k < stop[at]
            if not live.all():
                at, h = at[live], h[live]
            if not len(at):
                break
            h = h * _BASE + wide[at + k] + np.uint64(1)
            where, hit = _find(whole, h)
            starts.append(at[hit])
            sizes.append(np.full(len(starts[-1]), k + 1))
            ids.append(whole_ids[where[hit]])
            _, more = _find(begins, h)
            at, h = at[more], h[more]
        first = np.zeros(n, bool)
        if starts:
            first[starts[0]] = True
        lost = np.flatnonzero(~first)  # characters without a piece: an edge whose id is -1 stands for their bytes
        starts.append(lost)
        sizes.append(np.ones(len(lost), np.int64))
        ids.append(np.full(len(lost), -1))
        self.fan = np.zeros(n, np.int64)
        for x in starts:
            self.fan[x] += 1  # a length gives a node one edge at most
        self.first = np.r_[0, np.cumsum(self.fan)]
        # edges of a node in order of length: each length fills the next free place of its nodes
        m = int(self.first[-1])
        self.source, self.target, self.piece = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m, np.int32)
        free = self.first[:-1].copy()
        for x, size, piece in zip([lost, *starts[:-1]], [sizes[-1], *sizes[:-1]], [ids[-1], *ids[:-1]]):
            place = free[x]
            self.source[place], self.target[place], self.piece[place] = x, x + size, piece
            free[x] += 1
        c = code[self.source]
        weight = vocabulary.weights[np.maximum(self.piece, 0)]
        bare = np.flatnonzero(self.piece < 0)
        if len(bare):
            c = code[self.source[bare]]
            weight[bare] = -vocabulary.byte_cost * (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF))
        # backward masses, all segments at once, one step towards the front at a time; a segment's end has mass 0
        beta = np.zeros(n)
        inner = self.target < stop[self.source]  # edges that don't close their segment
        back = stop - np.arange(n)
        by = np.argsort(back.astype(np.int16) if n and back.max() < 32_000 else back, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(back, minlength=1)[1:])]
        score = weight
        for i in range(len(cuts) - 1):
            nodes = by[cuts[i] : cuts[i + 1]]
            f = self.fan[nodes]
            offset = np.cumsum(f) - f
            edges = np.repeat(self.first[nodes] - offset, f) + np.arange(int(f.sum()))
            v = score[edges]
            if i:
                on = inner[edges]
                v[on] += beta[self.target[edges[on]]]
                score[edges] = v
            top = np.maximum.reduceat(v, offset)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, f)), offset))
        self.logp = score - beta[self.source]
        # from a node's last edge to its first, the probability that one so far was drawn
        self.last = self.first[1:] - 1
        self.least = np.exp(self.logp)
        for j in range(1, int(self.fan.max()) if n else 0):
            some = np.flatnonzero(self.fan > j)
            edge = self.last[some] - j
            self.least[edge] += self.least[edge + 1]
        self.least[self.first[:-1]] = 1.0
        self.closing = ~inner

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by its probability; long pieces, which are the likeliest, are tried first."""
        edge = self.last[node]
        go = np.flatnonzero(u > self.least[edge])
        while len(go):
            edge[go] -= 1
            go = go[u[go] > self.least[edge[go]]]
        return edge


def _walk(lattice: Lattice, node: np.ndarray, end: np.ndarray, key: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ancestral draws from each ``node`` to its ``end``: edges in order of walkers, and how many each has.

    A step's counter is its place in the text, which is ``shift`` from its place in the lattice.
    """
    pos, live, steps = node.copy(), np.flatnonzero(node < end), []
    count = np.zeros(len(node), np.int64)
    while len(live):
        at = pos[live]
        edge = lattice.draw(at, uniform(key[live], (at + shift[live]).astype(np.uint64)))
        steps.append((live, edge))
        count[live] += 1
        at = lattice.target[edge]
        pos[live] = at
        live = live[at < end[live]]
    offset = np.r_[0, np.cumsum(count)]
    out = np.empty(offset[-1], np.int64)
    for s, (who, edge) in enumerate(steps):
        out[offset[who] + s] = edge
    return out, count


def _truncated(location: np.ndarray, u: np.ndarray, bound) -> np.ndarray:
    """Gumbel variables at ``location`` given that they are at most ``bound``."""
    g = location - np.log(-np.log(u))
    v = np.logaddexp(-g, -bound)
    return np.where(np.isneginf(location), -np.inf, -v)


#: What a random number is for. Each purpose and each path of a text has its own key, so no number is used twice.
ROOT, STEP, SIDE, BRANCH, REST = range(5)


def _keyed(keys: np.ndarray, purpose: int, path: int) -> np.ndarray:
    return _mix(keys ^ _mix(np.array([8 * path + purpose + 1], np.uint64) * _M1))


def _segmented(code: np.ndarray, begins: np.ndarray, verified: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each segment, its number among the different ones, the first place of each different one).

    ``code`` holds texts with word marks for blanks, ``begins`` marks where texts begin. Segments are told apart by a
    hash, and all are then compared with the first of their number; a collision is met with another hash.
    """
    mark, line = code == _MARK, code == 10
    cut = begins | line
    cut[1:] |= line[:-1] | (mark[1:] & ~mark[:-1])
    start = np.flatnonzero(cut)
    lengths = np.diff(np.r_[start, len(code)])
    place = np.arange(len(code)) - np.repeat(start, lengths)
    for salt in range(verified):
        odd = _mix(np.arange(1, (int(lengths.max()) if len(lengths) else 0) + 1, dtype=np.uint64) + np.uint64(salt << 32)) | np.uint64(1)
        x = (code.astype(np.uint64) + _M1) * odd[place]
        h = _mix(np.add.reduceat(x ^ (x >> np.uint64(29)), start) + lengths.astype(np.uint64)) if len(start) else np.empty(0, np.uint64)
        _, index, number = np.unique(h, return_index=True, return_inverse=True)
        like = index[number]
        if (lengths == lengths[like]).all() and (code == code[np.repeat(start[like], lengths) + place]).all():
            return start, number, index
    raise ValueError("different segments have equal hashes")


def sample_batch(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float, bool]]]:
    """For each text its k samples at most: (piece ids, log probability, perturbed score, inclusion score, whether the ids decode to the text)."""
    n = len(texts)
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    size = np.array([len(t) for t in marked], np.int64)
    text_end = np.cumsum(size)
    text_start = text_end - size
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(code), bool)
    begins[text_start[size > 0]] = True
    start, word, different = _segmented(code, begins)
    lengths = np.diff(np.r_[start, len(code)])
    own = lengths[different]
    inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    lattice = Lattice(vocabulary, code[np.repeat(start[different], own) + inner], own)
    first_word = np.searchsorted(start, np.r_[text_start, len(code)])  # a text's words
    shift = start - np.repeat(text_start, np.diff(first_word)) - lattice.start[word]  # from lattice to place in the text
    tails = _byte_pieces(vocabulary, lattice)
    paths: list[list[np.ndarray]] = [[] for _ in range(n)]
    infos: list[list[tuple[float, float]]] = [[] for _ in range(n)]
    heaps: list[list] = [[] for _ in range(n)]
    bounds = -np.log(-np.log(uniform(_keyed(keys, ROOT, 0), np.zeros(n, np.uint64))))  # the root's mass is 1
    # (text, edges kept from the parent path, their log probability, word the walk starts in, node it starts from, bound, edges left out at the branch)
    todo = [(d, np.empty(0, np.int64), 0.0, 0, -1, float(bounds[d]), None) for d in range(n)]
    for r in range(k):
        if not todo:
            break
        docs = np.array([t[0] for t in todo], np.int64)
        from_word = first_word[docs] + np.array([t[3] for t in todo], np.int64)
        sizes = first_word[docs + 1] - from_word
        which = np.repeat(from_word - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        node, end = lattice.start[word[which]], lattice.end[word[which]]
        inside = np.array([t[4] for t in todo], np.int64)
        move = (inside >= 0) & (sizes > 0)
        node[(np.cumsum(sizes) - sizes)[move]] = inside[move]
        edges, count = _walk(lattice, node, end, np.repeat(_keyed(keys[docs], STEP, r), sizes), shift[which])
        at = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(sizes)]]
        logp = lattice.logp[edges]
        before = np.empty(len(edges))  # log probability of a path up to each new edge
        for i, t in enumerate(todo):
            a, b = int(at[i]), int(at[i + 1])
            along = np.cumsum(np.r_[t[2], logp[a:b]])
            before[a:b] = along[:-1]
            paths[t[0]].append(np.concatenate((t[1], edges[a:b])))
            infos[t[0]].append((float(along[-1]), t[5]))
        rest = -np.expm1(np.minimum(logp, 0.0))
        rest[lattice.fan[lattice.source[edges]] < 2] = 0.0
        per, kept_edges = np.diff(at), np.array([len(t[1]) for t in todo], np.int64)
        place = np.arange(len(edges)) - np.repeat(at[:-1] - kept_edges, per)  # number of each edge in its path
        u = uniform(np.repeat(_keyed(keys[docs], SIDE, r), per), place.astype(np.uint64))
        with np.errstate(divide="ignore"):
            v = _truncated(before + np.log(np.maximum(rest, 0.0)), u, np.repeat(np.array([t[5] for t in todo]), per))
        left_over = uniform(_keyed(keys[docs], REST, r), np.zeros(len(docs), np.uint64))
        for i, (d, kept, ahead, _, _, bound, out) in enumerate(todo):
            heap, a, b = heaps[d], int(at[i]), int(at[i + 1])
            if out is not None:  # siblings that remain where this path left its parent
                j, edge = len(kept) - 1, int(kept[-1])
                remain = 1.0 - float(np.exp(lattice.logp[np.array([*out, edge])]).sum())
                if len(out) + 1 < lattice.fan[lattice.source[edge]] and remain > 0:
                    x = float(_truncated(np.array([ahead - float(lattice.logp[edge]) + np.log(remain)]), left_over[i : i + 1], bound)[0])
                    heapq.heappush(heap, (-x, len(paths[d]) - 1, j, out))
            # of a path's nodes no more than the k best bounds can ever be popped
            for j in np.argpartition(-v[a:b], k)[: k + 1].tolist() if b - a > k + 1 else range(b - a):
                if v[a + j] > -np.inf:
                    heapq.heappush(heap, (-float(v[a + j]), len(paths[d]) - 1, len(kept) + j, []))
        if r + 1 == k:
            break
        after = []
        dice = uniform(_keyed(keys, BRANCH, r), np.zeros(n, np.uint64))
        for d in docs.tolist():
            if not heaps[d]:
                continue
            bound, parent, j, out = heapq.heappop(heaps[d])
            path = paths[d][parent]
            out = [*out, int(path[j])]
            node = lattice.source[path[j]]
            options = [e for e in range(int(lattice.first[node]), int(lattice.first[node + 1])) if e not in out]
            p = np.cumsum(np.exp(lattice.logp[options]))
            edge = options[min(int(np.searchsorted(p / p[-1], dice[d])), len(options) - 1)]
            w0 = int(np.count_nonzero(lattice.closing[path[:j]]))
            ahead = float(np.cumsum(np.r_[0.0, lattice.logp[path[:j]], lattice.logp[edge]])[-1])
            done = bool(lattice.closing[edge])
            after.append((d, np.r_[path[:j], edge], ahead, w0 + done, -1 if done else int(lattice.target[edge]), -bound, out))
        todo = after
    out = []
    for d in range(n):
        limit = -heaps[d][0][0] if heaps[d] else -np.inf
        rows = []
        for path, (logp, score) in zip(paths[d], infos[d], strict=True):
            inclusion = 1.0 if np.isneginf(limit) else float(-np.expm1(-np.exp(min(logp - limit, 50.0))))
            ids = _ids(lattice, path, tails)
            rows.append((ids, logp, score, inclusion, vocabulary.spells(ids, code[text_start[d] : text_end[d]], texts[d])))
        out.append(rows)
    return out


def _byte_pieces(vocabulary: Vocabulary, lattice: Lattice) -> dict[int, list[int]]:
    """Piece numbers of the bytes of each edge that has no piece."""
    return {int(e): ([vocabulary.byte_ids[b] for b in chr(int(lattice.code[lattice.source[e]])).encode("utf-8", "surrogatepass")] if vocabulary.byte_ids else [vocabulary.unknown]) for e in np.flatnonzero(lattice.piece < 0)}


def _ids(lattice: Lattice, path: np.ndarray, tails: dict[int, list[int]]) -> np.ndarray:
    ids = lattice.piece[path]
    lost = np.flatnonzero(ids < 0)
    if not len(lost):
        return ids
    parts, at = [], 0
    for j in lost.tolist():
        parts += [ids[at:j], np.array(tails[int(path[j])], np.int32)]
        at = j + 1
    return np.concatenate([*parts, ids[at:]]).astype(np.int32)


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, seed: int = 17, batch_chars: int = 1_500_000) -> DataFrame:
    """A row for each sample of each row of ``docs`` (doc_id, text): doc_id, sample_rank, ids, log_prob, perturbed, inclusion, decoded.

    ids holds the piece numbers as packed 32-bit little-endian integers (``unpack``); decoded tells whether decoding
    them gives the text back. A text has as many samples as it has segmentations if those are fewer than ``k``; null
    and empty texts have one, without pieces. The row key is doc_id: rows that repeat it with an equal text repeat
    its samples. A null doc_id is a key like any other. Extra columns are ignored.
    """
    spark = docs.sparkSession
    if not os.path.exists(model_path):
        raise FileNotFoundError(model_path)
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model_path))
    salt = np.uint64(seed * int(_M1) & 0xFFFFFFFFFFFFFFFF)
    schema = pa.schema([("doc_id", pa.int64()), ("sample_rank", pa.int32()), ("ids", pa.binary()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("decoded", pa.bool_())])

    def run(batches):
        v = vocabulary.value
        for batch in batches:
            at, sizes = 0, [len(t or "") for t in batch.column(1).to_pylist()]
            while at < len(sizes):
                n, chars = 0, 0
                while at + n < len(sizes) and (not n or chars + sizes[at + n] <= batch_chars):
                    chars += sizes[at + n]
                    n += 1
                ids = batch.column(0).slice(at, n).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(at, n).to_pylist()]
                keys = _mix(np.array([-1 if i is None else i for i in ids], np.int64).view(np.uint64) + salt)
                rows = []
                for i, samples in zip(ids, sample_batch(v, texts, keys, k), strict=True):
                    for rank, (path, logp, score, inclusion, decoded) in enumerate(samples):
                        rows.append((i, rank, path.tobytes(), logp, score, inclusion, decoded))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(7)], schema=schema)
                at += n
                del rows, texts
                give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sample_rank int, ids binary, log_prob double, perturbed double, inclusion double, decoded boolean")


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, np.int32).tolist()
