"""Tables that grow by appends, whose rows are numbered on without gaps, in versions that are whole or absent.

An append first writes its rows, numbered among themselves, to a folder of its own, and then one small file that names the folder and the first
number: the version. That file appears by a rename that fails where it is there already; whoever loses such a race takes the next version
and the numbers after it, without writing its rows again. Readers see the versions that are there, never a part of one.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS = 33
#: Tasks that write the rows of one value of the columns that files are partitioned by.
_SALTS = 4
#: Local file systems check and rename in two steps, so appends of one driver take turns there.
_turn = threading.Lock()


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _text(spark: SparkSession, path: str) -> str:
    jvm, where, files = _files(spark, path)
    stream = files.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The versions of a table in order: {version, folder, first, rows, parts}; none where nothing was appended."""
    _, where, files = _files(spark, f"{path}/versions")
    if not files.exists(where):
        return []
    names = sorted(s.getPath().toString() for s in files.listStatus(where) if s.getPath().getName().endswith(".json"))
    return [json.loads(_text(spark, n)) for n in names]


def _committed(spark: SparkSession, path: str, entry: dict) -> bool:
    """Whether the version's file could be put in place: false if another one is there."""
    jvm, where, files = _files(spark, f"{path}/versions/{entry['version']:09d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/drafts/{uuid.uuid4().hex}")
    files.mkdirs(where.getParent())
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    with _turn:
        if files.exists(where):
            files.delete(draft, False)
            return False
        return bool(files.rename(draft, where))


def appended(rows: DataFrame, path: str, order: list[str], by: list[str] | None = None) -> tuple[int, int]:
    """Appends `rows` in the order of some columns; (first number, rows). `by`: columns that the files are partitioned by.

    Rows without an `id` get one when they are read: the first number plus their place. Nulls are values; no rows make a version
    of no rows.
    """
    spark, folder = rows.sparkSession, f"batch={uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    placed = dealt.withColumn("_at", F.monotonically_increasing_id())
    if by:  # a value's rows come from a few tasks, whatever their numbers
        placed = placed.repartition(*by, F.pmod(F.xxhash64("_at"), F.lit(_SALTS)))
    placed.write.partitionBy(*(by or [])).parquet(f"{path}/data/{folder}")
    kept = spark.read.schema(placed.schema).option("basePath", f"{path}/data/{folder}").parquet(f"{path}/data/{folder}")
    sizes = kept.groupBy(F.shiftright("_at", _BITS).alias("part")).count().orderBy("part").collect()  # a row a partition
    parts, n = [], 0
    for r in sizes:
        parts.append([r["part"], n])
        n += r["count"]
    while True:
        known = versions(spark, path)
        first = known[-1]["first"] + known[-1]["rows"] if known else 0
        entry = {"version": len(known), "folder": folder, "first": first, "rows": n, "parts": parts, "schema": kept.schema.json()}
        if _committed(spark, path, entry):
            return first, n


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of all versions up to one, the last if none is named, each with its number as `id`."""
    known = versions(spark, path)
    known = [v for v in known if version is None or v["version"] <= version]
    if not known:
        raise ValueError(f"{path} has no such version")
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(known[0]["schema"]))
    full = [v for v in known if v["rows"]]
    if not full:
        return spark.createDataFrame([], schema).withColumn("id", F.lit(0).cast("long")).drop("_at")
    rows = spark.read.schema(schema.add("batch", "string")).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{v['folder']}" for v in full])
    # a row a partition of each append
    starts = spark.createDataFrame([(v["folder"].partition("=")[2], p, v["first"] + n) for v in full for p, n in v["parts"]], "batch string, _part long, _first long")
    rows = rows.withColumn("_part", F.shiftright("_at", _BITS)).join(F.broadcast(starts), ["batch", "_part"])
    return rows.withColumn("id", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("batch", "_part", "_first", "_at")


def length(spark: SparkSession, path: str) -> int:
    """Rows of all versions, without reading them."""
    return sum(v["rows"] for v in versions(spark, path))
