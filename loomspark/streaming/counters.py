"""Counters of a job or stream that are taken while its rows pass, without reading them again."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def of_requests(tokens: Column, prompt: Column, finish: Column) -> list[Column]:
    """What a server counts: requests by outcome, tokens read and written."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    done = finish.isin("length", "stop")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [F.count("*").alias("requests"), one(done).alias("completed"), one(finish == "cancelled").alias("cancelled"), total(F.when(done, prompt)).alias("prompt_tokens"), total(F.when(done, tokens)).alias("output_tokens"), F.coalesce(F.max(tokens), F.lit(0)).cast("long").alias("longest")]


def counted(rows: DataFrame, counters: list[Column], sink) -> DataFrame:
    """One row of counters over all rows that went through `sink(rows)`, an action that reads each of them once."""
    seen = Observation()
    sink(rows.observe(seen, *counters))
    found = seen.get
    return rows.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


class Totals(StreamingQueryListener):
    """Sums, over the batches of a stream, of the counters observed under a name; those called in `largest` are maxima. Retried batches report once."""

    def __init__(self, name: str, largest: tuple[str, ...] = ()):
        self._name, self._largest, self._lock = name, largest, threading.Lock()
        self.totals: dict[str, int] = {}
        self.batches = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self._name)
        if found is None:
            return
        with self._lock:
            self.batches += 1
            for k, v in found.asDict().items():
                self.totals[k] = max(self.totals.get(k, 0), v) if k in self._largest else self.totals.get(k, 0) + v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watched(spark: SparkSession, stream: DataFrame, name: str, counters: list[Column], largest: tuple[str, ...] = ()) -> tuple[DataFrame, Totals]:
    """A stream whose counters are summed up as its batches end; take the listener off with spark.streams.removeListener."""
    totals = Totals(name, largest)
    spark.streams.addListener(totals)
    return stream.observe(name, *counters), totals
