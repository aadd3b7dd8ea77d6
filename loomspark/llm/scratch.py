"""Tables written between the jobs of an operator, in the folder all executors share."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Own folders by application, where the session names none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a session on one machine (as in tests) gets a folder of its own, removed in
    the end; on a cluster, whose executors would each write to their own disk, that is an error."""
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


class _Open(threading.local):
    """Of a thread: the folders of the tables written inside each open `passing`, the innermost last."""

    def __init__(self):
        self.tables: list[list[str]] = []


_here = _Open()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as Parquet files that outlive any executor, read back with a lineage of one scan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _here.tables:
        _here.tables[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """The tables that this thread writes inside are removed in the end but for the last one, which has to hold all that is needed of the others."""
    _here.tables.append([])
    try:
        yield _here.tables[-1]
    finally:
        *gone, last = _here.tables.pop() or [""]
        if _here.tables and last:
            _here.tables[-1].append(last)
        for path in gone:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: What the modules of this subpackage remember in a worker from task to task.
_REMEMBERED = {"packing": "_encoders", "tokencount": "_counters", "alignment": "_aligners", "decontam": "_automata"}


def alone(own: str = "") -> None:
    """At the start of a task: what other operators have left in this worker, which serves one after another, goes, and its free memory back
    to the system."""
    for module, name in _REMEMBERED.items():
        found = sys.modules.get(f"{__package__}.{module}")
        if module != own and found is not None:
            getattr(found, name).clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def width(spark: SparkSession) -> int:
    """Partitions that the cluster is set to deal a shuffle to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bytes_of(column):
    """UTF-8 bytes of a text column, so that tasks needn't encode."""
    return column.cast("string").cast("binary")
