"""Metrics as rows: of running queries by a listener, of chains by the indexer, and their sinks."""

from __future__ import annotations

import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("query", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("input_rows_per_s", T.DoubleType()),
        T.StructField("processed_rows_per_s", T.DoubleType()),
        T.StructField("state_rows", T.LongType()),
    ]
)
#: Rows that a recorder keeps before the oldest go.
KEEP = 10_000


class ProgressRecorder(StreamingQueryListener):
    """Keeps the newest progress rows; ``flush`` appends them to a folder."""

    def __init__(self, keep: int = KEEP):
        self.keep, self.rows = keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(op.numRowsTotal for op in p.stateOperators)
        self.rows.append((datetime.now(UTC).replace(tzinfo=None), p.name or str(p.id), p.batchId, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond, state))
        del self.rows[: -self.keep]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def flush(self, spark: SparkSession, path: str) -> None:
        if self.rows:
            self.frame(spark).coalesce(1).write.mode("append").parquet(path)
            self.rows = []


GAUGES = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("chain_id", T.LongType()),
        T.StructField("blocks_total", T.LongType()),
        T.StructField("events_total", T.LongType()),
        T.StructField("blocks_per_s", T.DoubleType()),
        T.StructField("events_per_s", T.DoubleType()),
        T.StructField("head", T.LongType()),
        T.StructField("checkpoint", T.LongType()),
        T.StructField("checkpoint_lag", T.LongType()),
    ]
)
#: Days that gauges are kept, and seconds between their files.
TTL_DAYS, FLUSH_SECONDS = 7, 10.0


class ChainGauges:
    """The gauges of a chain's batches, in a folder a day; whole days beyond the TTL are dropped."""

    def __init__(self, spark: SparkSession, path: str, chain_id: int, days: int = TTL_DAYS):
        self.spark, self.path, self.chain_id, self.days = spark, path, chain_id, days
        self.rows: list[tuple] = []
        self.blocks = self.events = 0
        self.flushed = time.monotonic()

    def record(self, blocks: int, events: int, head: int, checkpoint: int, seconds: float) -> None:
        """A batch that is committed."""
        self.blocks, self.events = self.blocks + blocks, self.events + events
        per_s = (blocks / seconds, events / seconds) if seconds > 0 else (0.0, 0.0)
        self.rows.append((datetime.now(UTC), self.chain_id, self.blocks, self.events, *per_s, head, checkpoint, max(0, head - checkpoint)))
        if time.monotonic() - self.flushed >= FLUSH_SECONDS:
            self.flush()

    def _folder(self):
        from loglattice.streaming.commits import Folder

        return Folder(self.spark, self.path)

    def exists(self) -> bool:
        return any(n.startswith("day=") for n in self._folder().names())

    def read(self) -> DataFrame:
        return self.spark.read.schema(GAUGES).parquet(f"{self.path}/day=*")

    def flush(self, now: datetime | None = None) -> None:
        """Appends what was recorded, and drops the days beyond the TTL."""
        if self.rows:
            frame = self.spark.createDataFrame(self.rows, GAUGES).coalesce(1)
            frame.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(self.path)
            self.rows, self.flushed = [], time.monotonic()
        oldest = ((now or datetime.now(UTC)) - timedelta(days=self.days)).date().isoformat()
        folder = self._folder()
        for name in folder.names():
            if name.startswith("day=") and name.removeprefix("day=") < oldest:
                folder.delete(name)
