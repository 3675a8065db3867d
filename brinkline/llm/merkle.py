"""Merkle dataset manifest: digest trees over the rows of a table, a proof for each row and its verification.

The rows of a tree are numbered in order of their key and cut into aligned blocks of ``fanout ** levels`` leaves, one
table row a block. A task holds a block's digests as one contiguous matrix of 64-byte hex leaves, which it reshapes by
``fanout`` and hashes row by row, level by level; a node's siblings are slices of a level's bytes, found by index
arithmetic. Blocks' own roots are the leaves of the next round, so that no task holds more than a block whatever the
size of a tree. The way back hands each block the siblings above it, and its rows get theirs from the block's levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinkline.operators.positions import numbered
from brinkline.plans.shared import materialize, shared_root

HEX = 64
UNCHANGED = b"-" * HEX
CHUNK_ROWS = 1 << 17
MOST_BROADCAST = 1_000_000

_BLOCK = "tree string, block long, total long, keys binary, nodes binary, later binary, digest string"
_PROVED = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
_STEPS = "array<struct<before:string,behind:string>>"


def field_digest(*columns: Column) -> Column:
    """H of the columns: ``-`` for null, else the UTF-8 byte count, ``:`` and the value (whole numbers in decimal)."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def next_level(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """Digests of each run of ``fanout`` rows of a matrix of hex digests; the last run may be shorter."""
    whole = len(nodes) // fanout
    runs = nodes[: whole * fanout].reshape(whole, fanout * HEX)
    out = [digest(r.data) for r in runs]
    if whole * fanout < len(nodes):
        out.append(digest(nodes[whole * fanout :].tobytes()))
    return as_matrix(b"".join(out))


def as_matrix(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, HEX)


def height(total: int, fanout: int) -> int:
    """Levels above the leaves of a tree."""
    n = 0
    while total > 1:
        total, n = -(-total // fanout), n + 1
    return n


def levels_of(data: bytes, total: int, fanout: int, levels: int) -> list[bytes]:
    """The levels of a block, leaves first; the last one is the block's own root."""
    now, out = as_matrix(data), [data]
    for _ in range(min(levels, height(total, fanout))):
        now = next_level(now, fanout)
        out.append(now.tobytes())
    return out


def siblings(levels: list[bytes], i: int, fanout: int) -> Iterator[tuple[bytes, bytes]]:
    """For node ``i`` of a block, by level: the digests of its run before it and behind it."""
    for level in levels[:-1]:
        start = i - i % fanout
        yield level[HEX * start : HEX * i], level[HEX * (i + 1) : HEX * (start + fanout)]
        i //= fanout


def _each(batches) -> Iterator[tuple]:
    """Rows one at a time: a row holds a whole block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _group_blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Block rows of (tree, ix, total, key, digest, later); ``later`` is null where it equals ``digest``."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("ix")
        tree, block = key[0].as_py(), key[1].as_py()
        total = group["total"][0].as_py()
        nodes = "".join(group["digest"].to_pylist()).encode()
        later = b"".join(x.encode() if x else UNCHANGED for x in group["later"].to_pylist()) if group["later"].null_count < len(group) else b""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([group.schema.field("key")])) as out:
            out.write_table(group.select(["key"]))
        top = levels_of(nodes, total, fanout, levels)[-1].decode()
        columns = [[tree], [block], [total], [sink.getvalue().to_pybytes()], [nodes], [later], [top]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "block", "total", "keys", "nodes", "later", "digest"])

    cut = nodes.withColumn("block", F.floor(F.col("ix") / (fanout**levels)).cast("long"))
    return cut.select("tree", "block", "ix", "total", "key", "digest", "later").groupBy("tree", "block").applyInArrow(run, _BLOCK)


def _climb(nodes: DataFrame, most: int, root: str, name: str, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, until each tree has one node; and (tree, digest) of those nodes."""
    tables, tops = [], None
    while True:
        blocks = materialize(_group_blocks(nodes, fanout, levels), root, f"{name}-{len(tables)}")
        tables.append(blocks)
        size = fanout**levels
        done = blocks.where(F.col("total") <= size).select("tree", "digest")
        tops = done if tops is None else tops.union(done)
        most = -(-most // size)
        if most <= 1:
            return tables, tops
        rest = F.ceil(F.col("total") / size).cast("long")
        nodes = blocks.where(F.col("total") > size).select("tree", F.col("block").alias("ix"), rest.alias("total"), F.col("block").alias("key"), "digest", F.lit(None).cast("string").alias("later"))


def _descend(blocks: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, block, steps) of the nodes of ``blocks``, that is of the blocks below them, from the steps above each block."""

    def run(batches):
        kind = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))
        for tree, nodes, total, keys, steps in _each(batches):
            mine = levels_of(nodes, total, fanout, levels)
            below = pa.ipc.open_stream(keys).read_all()["key"].to_pylist()
            for lo in range(0, len(below), 256):
                part = range(lo, min(lo + 256, len(below)))
                own = [[{"before": a.decode(), "behind": b.decode()} for a, b in siblings(mine, i, fanout)] + steps for i in part]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(own)), pa.array([below[i] for i in part], pa.int64()), pa.array(own, kind)], names=["tree", "block", "steps"])

    joined = blocks.join(above, ["tree", "block"])
    return joined.select("tree", "nodes", "total", "keys", "steps").mapInArrow(run, f"tree string, block long, steps {_STEPS}")


def merkle_manifest(rows: DataFrame, tree: str, key: str, leaf: Column, later: Column | None = None, fanout: int = 8, levels: int = 4) -> DataFrame:
    """(tree and key columns, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``leaf`` is a row's hex SHA-256 digest as listed, ``later`` the digest of what is to be verified (null or left out:
    the same). Leaves of a tree ascend by key, null keys first, rows of one key by leaf; of rows that are equal in both
    any order gives the same trees, and each has a place and a proof of its own. Runs of ``fanout`` nodes, the last one
    maybe shorter, become their digest until one is left, the subroot; a lone leaf is its tree's subroot. Subroots in
    order of their tree (null first, then by UTF-8 bytes) give the root likewise. ``proof_sha256`` is the digest of all
    siblings on the way to the root; ``folded_root`` is folded from ``later`` and these siblings, and ``verified`` says
    whether it is the root. An empty table gives an empty result; columns that are not named are ignored.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("fanout must be 2 or more, levels 1 or more")
    spark = rows.sparkSession
    root = shared_root(spark)
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))  # sorts null before all others
    thin = rows.select(name.alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), (F.lit(None) if later is None else later).cast("string").alias("later"))
    thin = thin.withColumn("later", F.when(F.col("later") != F.col("digest"), F.col("later"))).withColumn("tie", F.monotonically_increasing_id())
    thin = materialize(thin, root, "leaves")
    counts = materialize(thin.groupBy("tree").agg(F.count("*").alias("total")), root, "trees")
    trees, most = counts.agg(F.count("*"), F.coalesce(F.max("total"), F.lit(0))).first()
    placed = numbered(thin, ["tree"], ["key", "digest", "tie"], chunk_rows=CHUNK_ROWS)
    placed = placed.join(F.broadcast(counts) if trees <= MOST_BROADCAST else counts, "tree")
    tables, tops = _climb(placed, most, root, "blocks", fanout, levels)

    subroots = materialize(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), root, "subroots")
    forest = numbered(subroots, ["tree"], ["key"], chunk_rows=CHUNK_ROWS)
    forest = forest.select("tree", "ix", F.lit(trees).cast("long").alias("total"), F.col("ix").alias("key"), "digest", F.lit(None).cast("string").alias("later"), F.col("key").alias("of"))
    forest = materialize(forest, root, "forest")
    upper, whole = _climb(forest.drop("of"), trees, root, "upper", fanout, levels)

    first = F.lit(0).cast("long").alias("block")
    steps = whole.select("tree", first, F.array().cast(_STEPS).alias("steps"))
    for blocks in reversed(upper):
        steps = _descend(blocks, steps, fanout, levels)
    named = forest.select("ix", F.col("of").alias("tree"), F.col("digest").alias("subroot")).join(steps.select(F.col("block").alias("ix"), "steps"), "ix").drop("ix")
    named = materialize(named, root, "above-trees")
    top = whole.first()
    top = top.digest if top else ""

    # a tree's steps enter where it has one block; all blocks below take them from there
    steps = None
    for n, blocks in reversed(list(enumerate(tables))):
        entered = blocks.where(F.col("total") <= fanout**levels).select("tree", "block").join(named.select("tree", "steps"), "tree")
        steps = entered if steps is None else entered.unionByName(steps)
        if n:
            steps = materialize(_descend(blocks, steps, fanout, levels), root, f"steps-{n}")
    ends = tables[0].join(steps, ["tree", "block"]).join(named.select("tree", "subroot"), "tree")
    ends = ends.select("tree", "subroot", "nodes", "total", "keys", "later", "steps")

    def prove(batches):
        for tree, subroot, nodes, total, keys, later, above in _each(batches):
            below = pa.ipc.open_stream(keys).read_all()["key"].combine_chunks()
            mine, n = levels_of(nodes, total, fanout, levels), len(below)
            above = [(s["before"].encode(), s["behind"].encode()) for s in above]
            proofs, folded = [], []
            for i in range(n):
                way = [*siblings(mine, i, fanout), *above]
                proofs.append(hashlib.sha256(b"".join(x for pair in way for x in pair)).hexdigest())
                now = later[HEX * i : HEX * (i + 1)]
                now = nodes[HEX * i : HEX * (i + 1)] if now in (b"", UNCHANGED) else now
                for a, b in way:
                    now = digest(a + now + b)
                folded.append(now.decode())
            leaves = [nodes[HEX * i : HEX * (i + 1)].decode() for i in range(n)]
            told = [leaves, [subroot] * n, [top] * n, proofs, folded, [f == top for f in folded]]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * n), below, *map(pa.array, told)], names=["tree", "key", *_PROVED])

    kind = thin.schema["key"].dataType.simpleString()
    schema = f"tree string, key {kind}, " + ", ".join(f"{c} {'boolean' if c == 'verified' else 'string'}" for c in _PROVED)
    back = F.when(F.col("tree") != "-", F.expr("substring(tree, 2)")).cast(rows.schema[tree].dataType)
    return ends.mapInArrow(prove, schema).select(back.alias(tree), F.col("key").alias(key), *_PROVED)
