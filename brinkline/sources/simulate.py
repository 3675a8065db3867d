"""Random choices and draws for rows at hand: they follow from a row's keys and a seed, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from brinkline.functions.distributions import uniform_of


def thinned(rows: DataFrame, retention: Column, ids: list[str], seed: int = 0) -> DataFrame:
    """Rows kept with probability ``retention``."""
    return rows.where(uniform_of(*ids, seed=seed) < retention)


def drawn(rows: DataFrame, model, ids: list[str], name: str = "value", seed: int = 0) -> DataFrame:
    """``rows`` with a draw from ``model``, a distribution whose parameters may be columns of theirs."""
    return rows.withColumn(name, model.sample_by(*ids, seed=seed))
