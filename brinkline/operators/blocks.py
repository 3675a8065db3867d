"""Block maxima over keyed series (rows of keys, time, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.operators.positions import CHUNK_ROWS, numbered, own_rows, same_keys, segments


def clean(df: DataFrame, value: str = "value") -> DataFrame:
    """NaN to NULL, once: Spark orders NaN above every number."""
    return df.withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))


def temporal_block_maxima(df: DataFrame, unit: str, keys: list[str], time: str = "t", value: str = "value", min_count: int = 1) -> DataFrame:
    """Maximum and count of each calendar block; NULL where fewer than ``min_count`` values are there."""
    blocks = clean(df, value).groupBy(*keys, F.date_trunc(unit, F.col(time)).alias("block")).agg(F.max(value).alias("m"), F.count(value).alias("n"))
    return blocks.select(*keys, "block", F.when(F.col("n") >= min_count, F.col("m")).alias("maximum"), "n")


def sliding_block_maxima(df: DataFrame, size: int, keys: list[str], order: list[str], value: str = "value", stride: int = 1, min_count: int | None = None, chunk_rows: int = CHUNK_ROWS, segment_rows: int = CHUNK_ROWS) -> DataFrame:
    """Maximum of the last ``size`` rows at every ``stride``-th row; NULL until ``min_count`` (default: size) values are there."""
    frame = W.partitionBy(*keys, "brinkline_segment").orderBy("ix").rowsBetween(1 - size, 0)
    rows = segments(numbered(clean(df, value), keys, order, chunk_rows=chunk_rows), size - 1, 0, length=segment_rows)
    rows = rows.withColumn("maximum", F.when(F.count(value).over(frame) >= (size if min_count is None else min_count), F.max(value).over(frame)))
    return own_rows(rows.where(F.col("ix") % stride == 0))


def tile_maxima(df: DataFrame, sizes: dict[str, int], extents: dict[str, int], keys: list[str], value: str = "value") -> DataFrame:
    """Maximum of every whole tile of a grid; incomplete tiles at the end are trimmed."""
    rows = clean(df, value)
    for c, n in sizes.items():
        rows = rows.where(F.col(c) < extents[c] // n * n)
    return rows.groupBy(*keys, *[F.floor(F.col(c) / n).alias(f"{c}_tile") for c, n in sizes.items()]).agg(F.max(value).alias("maximum"))


def r_largest(df: DataFrame, r: int, keys: list[str], block: str, tie: list[str], value: str = "value") -> DataFrame:
    """The r largest values of each block, order 1 the largest; ties by ``tie``."""
    w = W.partitionBy(*keys, block).orderBy(F.desc(value), *tie)
    rows = clean(df, value).where(F.col(value).isNotNull())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= r)


def fixed_blocks(df: DataFrame, size: int, keys: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Numbers blocks of ``size`` rows along ``order`` and trims the incomplete tail."""
    rows = numbered(df, keys, order, chunk_rows=chunk_rows).withColumn("block", F.floor(F.col("ix") / size))
    lengths = df.groupBy(*[F.col(k).alias(f"brinkline_key_{k}") for k in keys]).agg(F.count("*").alias("brinkline_n"))
    joined = rows.join(lengths, same_keys(rows, lengths, {k: f"brinkline_key_{k}" for k in keys}))
    return joined.where((F.col("block") + 1) * size <= F.col("brinkline_n")).select(*[rows[c] for c in rows.columns])


def with_empty_blocks(maxima: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """``maxima`` of calendar blocks with the blocks in between that hold nothing: maximum NULL, n 0."""
    ends = maxima.groupBy(*keys).agg(F.min("block").alias("first"), F.max("block").alias("last"))
    step = F.expr(f"interval 1 {unit}")
    spine = ends.select(*keys, F.explode(F.sequence("first", "last", step)).alias("block"))
    return spine.join(maxima, [*keys, "block"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def padded_r_largest(df: DataFrame, r: int, keys: list[str], block: str, tie: list[str], value: str = "value") -> DataFrame:
    """(keys, block, rank, value): exactly r rows a block, NULL where the block has fewer values."""
    found = r_largest(df, r, keys, block, tie, value).select(*keys, block, "rank", value)
    spine = df.select(*keys, block).distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(r))))
    return spine.join(found, [*keys, block, "rank"], "left")
