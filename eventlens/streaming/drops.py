"""Rows that a stream's watermark drops, counted per batch and operator."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = "query string, run string, batch bigint, operator int, kind string, dropped bigint"


class DropCounter(StreamingQueryListener):
    """Keeps what each batch of the streams started meanwhile reports, a row for each stateful operator.

    In batch n an operator drops rows that are older than the watermark that batch n - 2 left behind. An aggregation sees rows that were aggregated
    within their task already, so it counts those; deduplication, joins and keyed state count rows as they came.
    """

    def __init__(self):
        self.rows: list[tuple] = []
        self.ended: set[str] = set()
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = [(p.name or str(p.id), str(p.runId), p.batchId, k, o.operatorName, o.numRowsDroppedByWatermark) for k, o in enumerate(p.stateOperators)]
        with self.change:
            self.rows += found

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.runId))
            self.change.notify_all()

    def wait(self, run: str, seconds: float = 60) -> None:
        """Until the end of a run, and so all that came before it, has been reported."""
        with self.change:
            if not self.change.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError(f"run {run} has not reported its end")

    def counts(self, spark: SparkSession) -> DataFrame:
        """query, run, batch, operator, kind and dropped; a batch that ran twice counts once, as it did last."""
        with self.change:
            last = {(r[0], *r[2:4]): r for r in self.rows}
        return spark.createDataFrame(sorted(last.values()), COUNTS)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append the counts so far to a table and forget them."""
        with self.change:
            rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, COUNTS).coalesce(1).write.mode("append").parquet(path)


@contextmanager
def counted_drops(spark: SparkSession) -> Iterator[DropCounter]:
    """Counts for all streams of the session while inside."""
    counter = DropCounter()
    spark.streams.addListener(counter)
    try:
        yield counter
    finally:
        spark.streams.removeListener(counter)
