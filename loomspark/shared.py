"""The folder that the driver and all executors share, for tables that outlive a query."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Own folders by application, where the session names none.
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a session on one machine has a folder of its own, removed in the end; on a
    cluster that is an error."""
    if have := spark.conf.get("spark.checkpoint.dir", None):
        return have
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        own = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[app] = f"file://{own}"
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as Parquet files, read back with a lineage of one scan."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
