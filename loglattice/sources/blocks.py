"""Block pages: one JSON object a line, a header and its logs. Batch, stream, and ranges over HTTP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = T.StructType([T.StructField("number", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("timestamp", T.LongType())])
LOG = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("transactionHash", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("transactionIndex", T.LongType()),
        T.StructField("logIndex", T.LongType()),
    ]
)
#: What the source told with a page: its final head, and its newest block. Files tell nothing.
HEADS = T.StructType([T.StructField("finalized_number", T.LongType()), T.StructField("finalized_hash", T.StringType()), T.StructField("latest", T.LongType())])
PAGE = T.StructType([T.StructField("header", HEADER), T.StructField("logs", T.ArrayType(LOG)), T.StructField("heads", HEADS)])
#: Topics of a log that are looked at.
TOPICS = 4


def read_pages(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Pages of JSON-lines files, which may be compressed. Blank lines are skipped; a bad line fails the read, or is dropped."""
    return spark.read.schema(PAGE).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def stream_pages(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """The same as a stream over the files that arrive in a folder."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_a_batch).option("mode", "FAILFAST").json(path)


def headers_of(pages: DataFrame) -> DataFrame:
    """Number, hash and timestamp of each block; the logs are not read."""
    return pages.select(F.col("header.number").alias("block_number"), F.col("header.hash").alias("block_hash"), F.timestamp_seconds("header.timestamp").alias("block_timestamp"))


def logs_of(pages: DataFrame, chain_id: int, end_block: int | None = None) -> DataFrame:
    """A row a log; a block without logs gives none. Times are UTC; missing texts are empty."""
    if end_block is not None:
        pages = pages.where(F.col("header.number") <= end_block)
    log = F.explode("logs").alias("log")
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    return pages.select("header", log).select(
        F.lit(chain_id).cast("long").alias("chain_id"),
        F.col("header.number").alias("block_number"),
        F.timestamp_seconds("header.timestamp").alias("block_timestamp"),
        empty("header.hash").alias("block_hash"),
        empty("log.address").alias("address"),
        empty("log.transactionHash").alias("transaction_hash"),
        F.slice(F.coalesce("log.topics", F.array().cast("array<string>")), 1, TOPICS).alias("topics"),
        empty("log.data").alias("data"),
        F.coalesce("log.transactionIndex", F.lit(0)).alias("transaction_index"),
        F.coalesce("log.logIndex", F.lit(0)).alias("log_index"),
    )


def filter_condition(filters: list[dict]) -> Column:
    """Any of the filters: lists are alternatives, fields all have to hold; no filter takes all."""
    if not filters:
        return F.lit(True)
    found = F.lit(False)
    for one in filters:
        ok = F.lit(True)
        if one.get("address"):
            ok = ok & F.lower("address").isin(*[a.lower() for a in one["address"]])
        for k in range(TOPICS):
            if one.get(f"topic{k}"):
                ok = ok & F.coalesce(F.lower(F.get("topics", F.lit(k))).isin(*[t.lower() for t in one[f"topic{k}"]]), F.lit(False))
        found = found | ok
    return found


def natural_order(events: DataFrame) -> DataFrame:
    return events.orderBy("block_number", "transaction_index", "log_index")


def timeline(kinds: dict[str, DataFrame]) -> DataFrame:
    """Events of several kinds as one table, each named by ``kind``; a column that a kind lacks is null.

    ``natural_order`` of it is the order in which they happened.
    """
    found = None
    for kind, rows in kinds.items():
        named = rows.withColumn("kind", F.lit(kind))
        found = named if found is None else found.unionByName(named, allowMissingColumns=True)
    if found is None:
        raise ValueError("a timeline needs a kind of event")
    return found
