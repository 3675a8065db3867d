"""Positions and running sums along each key's order, so that a task holds a chunk of rows where a key is too long for one.

Small tables take one window a key. Larger ones are ranged by key and order into chunks, which are written to the
shared folder; what a window must see beyond a chunk comes from chunk totals or from copies of the rows at its edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.plans.shared import materialize, shared_root

CHUNK_ROWS = 2_000_000
TASK_ROWS = 1_000_000


def same_keys(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Equal keys, NULL equal to NULL."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs.items()], F.lit(True))


def dealt_by_size(df: DataFrame, by: list[str], total: int, task_rows: int | None = None) -> DataFrame:
    """``df`` dealt by the hash of ``by`` over a task for every ``task_rows`` of ``total`` rows, and no fewer than a shuffle has.

    What a task holds then doesn't grow with the table, as it does where the number of tasks is the session's. Small
    tables stay as they are.
    """
    task_rows = task_rows or TASK_ROWS
    if total <= task_rows:
        return df
    return df.repartition(max(-(-total // task_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def running_sums(df: DataFrame, keys: list[str], order: list[str], terms: dict[str, Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with a column for each term: its sum over the key's rows up to and with each one, NULL counting as 0.

    Rows of a key that are equal in ``order`` follow each other in any order, and stay in one chunk. In ranges only the
    first key of a chunk can have begun before it, so what is carried over is at most a row a chunk and is broadcast.
    """
    named = {n: F.coalesce(t, F.lit(0)) for n, t in terms.items()}
    total = df.count()
    if total <= chunk_rows:
        up_to = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(t).over(up_to).alias(n) for n, t in named.items()])
    held = {n: f"brinkline_term_{n}" for n in named}
    rows = df.select("*", *[t.alias(held[n]) for n, t in named.items()]).repartitionByRange(-(-total // chunk_rows), *keys, *order)
    rows = materialize(rows.withColumn("brinkline_chunk", F.spark_partition_id()), shared_root(df.sparkSession), "chunks")
    totals = rows.groupBy(*keys, "brinkline_chunk").agg(*[F.sum(h).alias(h) for h in held.values()])
    before = W.partitionBy(*keys).orderBy("brinkline_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"brinkline_key_{k}") for k in keys],
        F.col("brinkline_chunk").alias("brinkline_at"),
        F.count("*").over(before).alias("brinkline_begun"),
        *[F.sum(h).over(before).alias(f"{h}_before") for h in held.values()],
    ).where("brinkline_begun > 0")
    here = (rows["brinkline_chunk"] == carried["brinkline_at"]) & same_keys(rows, carried, {k: f"brinkline_key_{k}" for k in keys})
    inside = W.partitionBy(*keys, "brinkline_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(carried), here, "left")
    sums = [(F.sum(h).over(inside) + F.coalesce(f"{h}_before", F.lit(0))).alias(n) for n, h in held.items()]
    return joined.select(*[rows[c] for c in df.columns], *sums)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "ix", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with each row's position in its key, from 0."""
    return running_sums(df, keys, order, {name: F.lit(1)}, chunk_rows).withColumn(name, F.col(name) - 1)


def segments(df: DataFrame, back: int, ahead: int, position: str = "ix", length: int = CHUNK_ROWS) -> DataFrame:
    """Rows by ``brinkline_segment`` of ``length`` positions, with copies of those that frames of a neighbouring segment reach.

    A frame of up to ``back`` positions before a row and ``ahead`` behind it then lies inside a key's segment; only rows
    with ``brinkline_own`` are to be kept once the window is done.
    """
    length = max(length, back, ahead, 1)
    rest = F.col(position) % length
    at = ((F.col(position) - rest) / length).cast("long")
    places = F.array(at, F.when(rest >= length - back, at + 1), F.when((rest < ahead) & (at > 0), at - 1))
    rows = df.withColumn("brinkline_segment", F.explode(F.array_compact(places)))
    return rows.withColumn("brinkline_own", F.col("brinkline_segment") == at)


def own_rows(df: DataFrame, *extra: str) -> DataFrame:
    """Drops the copies that ``segments`` made, its columns and those named."""
    return df.where("brinkline_own").drop("brinkline_segment", "brinkline_own", *extra)
