"""The session and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are written for: UTC, AQE, one shuffle partition a core."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
