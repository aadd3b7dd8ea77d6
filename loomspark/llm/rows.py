"""A unique, ordered number for every row of a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.scratch import bytes_of, width, written


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it as long as `df` has such a column (names differ in more than case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def ranked(df: DataFrame, name: str, *order: str) -> DataFrame:
    """`df` with `name`, its position from 0 by the columns `order`: rows are dealt out by range, numbered in
    each range, and the counts of the ranges before are added (one small row a range)."""
    spark, at, part, before, tie = df.sparkSession, *(unused(df, x) for x in ("_at", "_part", "_before", "_tie"))
    # rows that are equal in all of `order` may be very many: their place in the input tells them apart, so they spread over ranges
    df = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = df.repartitionByRange(width(spark), *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    dealt = written(dealt.withColumn(at, F.monotonically_increasing_id()), "ranked")
    sizes = dealt.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias("n"))
    # one row a range, so this window without keys holds as many rows as the shuffle has partitions
    sizes = sizes.select(part, (F.sum("n").over(W.orderBy(part)) - F.col("n")).alias(before))
    numbered = dealt.join(sizes, F.shiftright(at, 33) == F.col(part))
    return numbered.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, before)


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """`docs` with a unique number `name`, a name it hasn't (see `unused`), that ascends with doc_id.

    doc_id itself serves where it is unique and never null; otherwise rows are ranked by doc_id
    (null first), equal ones in an order fixed by their text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    twice = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if twice.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    text = unused(docs, "_text")
    return ranked(docs.withColumn(text, F.xxhash64(bytes_of(F.col("text")))), name, "doc_id", text).drop(text)


def documents(docs: DataFrame) -> DataFrame:
    """(row, doc_id, data): the text's UTF-8 bytes under the row of `numbered`."""
    return numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row", "doc_id", bytes_of(F.col("text")).alias("data"))
