"""What several operators share: reading tables, connected components."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinkline.plans.shared import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """A schema with nullable columns behind it."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add, so that clashing extra columns do no harm."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def give_back() -> None:
    """Let the allocator return what a worker has freed, so that idle workers don't hold the memory of their largest batch."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a function of the GNU C library
    if trim:
        trim(0)


def connected_components(edges: DataFrame, root: str, name: str) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); component is the smallest id reachable.

    Alternates the large-star and small-star contractions, each one join on the node, and writes
    every round to the shared folder. Stops when a round changes nothing.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), root, f"{name}-0"
    )
    seen, k = None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lows, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        k += 1
        now = materialize(small, root, f"{name}-{k}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    found = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
