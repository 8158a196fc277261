"""Tables on shared storage: immutable segments, named by a commit.

A segment is a folder of Parquet under a name that is never used again,
partitioned by stretches of blocks and sorted by the table's order. Nothing is
ever overwritten: which segments make up a table is said by a commit alone
(``streaming.commits``), so what a failed job leaves behind is never read, and a
rollback drops the segments above a block and rewrites only those that cross it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.types import ORDER
from loglattice.operators import compaction

BUCKET = 100_000
#: Segments of like size that are merged into one.
FAN_IN = 16


@dataclass(frozen=True)
class Segment:
    """A folder, the first and the last block that its batch covers, and its rows."""

    name: str
    first: int
    last: int
    rows: int

    @property
    def level(self) -> int:
        """The power of ``FAN_IN`` that its rows reach."""
        level, n = 0, self.rows
        while n >= FAN_IN * 1000:
            level, n = level + 1, n // FAN_IN
        return level


@dataclass
class Table:
    """Writes and reads segments; ``order`` is the sort key."""

    spark: SparkSession
    path: str
    schema: T.StructType
    order: tuple[str, ...] = ORDER
    bucket: int = BUCKET

    def read(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([*self.schema.fields, T.StructField("segment", T.StringType()), T.StructField("block_bucket", T.LongType())])
        found = self.spark.read.schema(full).option("basePath", self.path).parquet(*[f"{self.path}/segment={s.name}" for s in segments])
        return found.select(*self.schema.fieldNames())

    def write(self, rows: DataFrame, first: int, last: int) -> Segment:
        """A new segment of rows clustered by bucket and sorted by the table's order."""
        bucket = F.floor(F.col("block_number") / self.bucket).cast("long")
        counted = Observation()
        out = rows.select(*self.schema.fieldNames()).withColumn("block_bucket", bucket)
        own = [c for c in self.order if c in self.schema.fieldNames()]
        spread = out.repartitionByRange("block_bucket", *own) if own else out.repartition("block_bucket")
        name = uuid.uuid4().hex
        # Counted behind the exchange: what comes before it runs twice, once for the sample of its ranges.
        ready = spread.sortWithinPartitions("block_bucket", *own).observe(counted, F.count(F.lit(1)).alias("n"))
        ready.write.partitionBy("block_bucket").parquet(f"{self.path}/segment={name}")
        return Segment(name, first, last, int(counted.get.get("n") or 0))

    def rolled_back(self, segments: list[Segment], block: int) -> list[Segment]:
        """The segments without what lies above a block; only those that cross it are rewritten."""
        out = []
        for one in segments:
            if one.last <= block:
                out.append(one)
            elif one.first <= block:
                out.append(self.write(compaction.rolled_back(self.read([one]), block), one.first, block))
        return out

    def compacted(self, segments: list[Segment], keys: list[str], interval: int, head: int, lower: int = 0) -> list[Segment]:
        """Keeps of each key and interval the newest row below the head's margin; segments outside of the window stay."""
        span = compaction.window(lower, head, interval)
        touched = [s for s in segments if span and s.last > span[0] and s.first <= span[1]]
        if not touched:
            return segments
        kept = compaction.compacted(self.read(touched), keys, interval, head, lower)
        whole = self.write(kept, min(s.first for s in touched), max(s.last for s in touched))
        return sorted([*(s for s in segments if s not in touched), whole], key=lambda s: s.first)

    def merged(self, segments: list[Segment], final: int) -> list[Segment]:
        """Neighbours of one level up to a final block, once there are ``FAN_IN``, as one: each row is rewritten a few times at most."""
        for k in range(len(segments) - FAN_IN + 1):
            run = segments[k : k + FAN_IN]
            if run[-1].last <= final and len({s.level for s in run}) == 1:
                whole = self.write(self.read(run), run[0].first, run[-1].last)
                return self.merged([*segments[:k], whole, *segments[k + FAN_IN :]], final)
        return segments
