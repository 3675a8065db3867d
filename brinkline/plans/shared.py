"""Tables written to the folder that all executors share, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="brinkline-")


def shared_root(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are threads of the driver (a master ``local[...]``) gets a temporary
    folder of its own; on any other master it is an error, as executors could not read each other's local folders.
    """
    base = spark.conf.get(KEY, None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{KEY} is not set: start the session with a folder there that all executors can read and write")
        base = _own_folder(context.applicationId)
    return f"{base.rstrip('/')}/brinkline-{uuid.uuid4().hex}"


def materialize(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write ``df`` under ``root`` and return the reread table, whose plan is a plain scan."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
