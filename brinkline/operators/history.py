"""What a sequence has seen so far: number, last time, last mark and sum of marks before each event or at any time.

Numbers and sums are counted along each key in chunks; the event before is the neighbouring position. What is known at
other times is looked up by the number of events before them, so that no task holds a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.operators.positions import CHUNK_ROWS, own_rows, running_sums, segments

NAMES = ("n_before", "last_t", "last_mark", "mark_sum")


@dataclass(frozen=True)
class History:
    """Columns of the events strictly before: ``n``, ``last_t`` and ``last_mark`` (null without one), ``mark_sum``."""

    n: Column
    last_t: Column
    last_mark: Column
    mark_sum: Column

    @classmethod
    def of(cls) -> History:
        """The columns that ``with_history`` and ``history_at`` add."""
        return cls(*map(F.col, NAMES))

    def last_time(self, default: Column | float = 0.0) -> Column:
        return F.coalesce(self.last_t, F.lit(default) if isinstance(default, (int, float)) else default)

    def time_since_last(self, t: Column, default: Column | float = 0.0) -> Column:
        """Time since the last event, or since ``default`` without one."""
        return t - self.last_time(default)

    def mean_mark(self, default: float = 0.0) -> Column:
        return F.when(self.n > 0, self.mark_sum / self.n).otherwise(float(default))


def with_history(events: DataFrame, keys: list[str], order: list[str] | None = None, mark: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``events`` (keys, t, ...) with n_before, last_t, last_mark and mark_sum of the events before each one in its key.

    ``order`` (t and what tells ties apart) decides which events come before; NULL marks count as events, not in sums.
    Existing columns of the added names are replaced.
    """
    order = order or ["t"]
    kept = events.drop(*NAMES)
    value = F.col(mark).cast("double") if mark else F.lit(None).cast("double")
    rows = running_sums(kept.withColumn("brinkline_mark", value), keys, order, {"n_before": F.lit(1).cast("long"), "mark_sum": F.col("brinkline_mark")}, chunk_rows)
    rows = rows.withColumn("n_before", F.col("n_before") - 1).withColumn("mark_sum", F.col("mark_sum") - F.coalesce("brinkline_mark", F.lit(0.0)))
    along = W.partitionBy(*keys, "brinkline_segment").orderBy("n_before")
    rows = segments(rows, 1, 0, position="n_before", length=chunk_rows)
    rows = rows.withColumn("last_t", F.lag("t").over(along)).withColumn("last_mark", F.lag("brinkline_mark").over(along))
    return own_rows(rows).select(*kept.columns, *NAMES)


def history_at(events: DataFrame, queries: DataFrame, keys: list[str], order: list[str] | None = None, mark: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``queries`` (keys, t, ...) with the same columns of the events strictly before their own t."""
    kept = queries.drop(*NAMES)
    times = events.select(*keys, F.col("t").cast("double").alias("t"), F.lit(1).alias("brinkline_event"))
    asked = kept.select(*keys, F.col("t").cast("double").alias("t"), F.lit(0).alias("brinkline_event")).distinct()
    counted = running_sums(times.union(asked), keys, ["t", "brinkline_event"], {"n_before": F.col("brinkline_event").cast("long")}, chunk_rows)
    counted = counted.where("brinkline_event = 0").select(*[F.col(k).alias(f"brinkline_{k}") for k in keys], F.col("t").alias("brinkline_t"), "n_before")
    value = F.col(mark).cast("double") if mark else F.lit(None).cast("double")
    past = with_history(events.select(*events.columns, value.alias("brinkline_value")), keys, order, "brinkline_value", chunk_rows)
    past = past.select(
        *[F.col(k).alias(f"past_{k}") for k in keys],
        (F.col("n_before") + 1).alias("brinkline_n"),
        F.col("t").alias("last_t"),
        F.col("brinkline_value").alias("last_mark"),
        (F.col("mark_sum") + F.coalesce("brinkline_value", F.lit(0.0))).alias("mark_sum"),
    )
    here, there = kept["t"].cast("double") == counted["brinkline_t"], counted["n_before"] == past["brinkline_n"]
    for k in keys:
        here, there = here & kept[k].eqNullSafe(counted[f"brinkline_{k}"]), there & counted[f"brinkline_{k}"].eqNullSafe(past[f"past_{k}"])
    # sizes before an explode, or of well packed files, say little of the rows: none of these is to be broadcast
    found = kept.join(counted.hint("merge"), here).join(past.hint("merge"), there, "left")
    return found.select(*[kept[c] for c in kept.columns], "n_before", "last_t", "last_mark", F.coalesce("mark_sum", F.lit(0.0)).alias("mark_sum"))


def marks_log_prob(events: DataFrame, keys: list[str], log_density: Callable[[Column, Column, History], Column], mark: str, order: list[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, n, mark_ll): the sum of ``log_density(t, mark, history)``, where history is what came before the event."""
    rows = with_history(events, keys, order, mark, chunk_rows)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(log_density(F.col("t"), F.col(mark), History.of())).alias("mark_ll"))


def marked_log_prob(ground: DataFrame, events: DataFrame, keys: list[str], log_density: Callable[[Column, Column, History], Column], mark: str, order: list[str] | None = None) -> DataFrame:
    """``ground`` (keys, log_lik, ...) with mark_ll and log_lik raised by it; sequences without events keep theirs."""
    marks = marks_log_prob(events, keys, log_density, mark, order).drop("n")
    joined = ground.join(marks, keys, "left")
    return joined.withColumn("mark_ll", F.coalesce("mark_ll", F.lit(0.0))).withColumn("log_lik", F.col("log_lik") + F.col("mark_ll"))
