"""Rates, latest gauges and time buckets over metric rows, and catalogue questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.operators.latest import latest


def rates(samples: DataFrame, counters: list[str], chain: str = "chain_id", time: str = "ts", stretch: str = "day", ties: tuple[str, ...] = (), still: float = 0.0) -> DataFrame:
    """Adds ``<counter>_per_s``: the growth since the chain's sample before, by the seconds; 0 for the first.

    Samples of one time follow each other by ``ties``; where no time has passed
    since the sample before, the rate is ``still``.

    A chain's samples are dealt by stretches of time (a unit of ``date_trunc``),
    so that no task has all of them; those without a time get 0. The first sample of a stretch is compared with the last of the stretch
    before that has any; these are found among one row a stretch.
    """
    taken = {c.lower() for c in samples.columns}
    part, last = (next(n for k in range(len(taken) + 1) if (n := f"_{own}{k}") not in taken) for own in ("stretch", "last"))
    own = [time, *counters]
    parted = samples.withColumn(part, F.date_trunc(stretch, F.col(time)))
    ends = parted.where(F.col(part).isNotNull()).groupBy(chain, part).agg(*[F.max_by(c, F.struct(time, *ties) if ties else F.col(time)).alias(c) for c in own])
    earlier = F.lag(F.struct(*own)).over(Window.partitionBy(chain).orderBy(part))
    ends = ends.select(F.col(chain).alias(f"{last}c"), F.col(part).alias(f"{last}p"), earlier.alias(last))
    met = parted.join(ends, parted[chain].eqNullSafe(F.col(f"{last}c")) & (parted[part] == F.col(f"{last}p")), "left")
    before = Window.partitionBy(chain, part).orderBy(time, *ties)
    first = F.row_number().over(before) == 1
    lagged = {c: F.when(first, F.col(last)[c]).otherwise(F.lag(c).over(before)) for c in own}
    micros = F.timestamp_diff("MICROSECOND", lagged[time], F.col(time))
    growth = {c: F.col(c) - lagged[c] for c in counters}
    rate = lambda c: F.coalesce(F.when(micros > 0, growth[c] * F.lit(1e6) / micros).when((micros == 0) & growth[c].isNotNull(), F.lit(still)), F.lit(0.0))
    return met.select(*[F.col(f"`{c}`") for c in samples.columns], *[rate(c).alias(f"{c}_per_s") for c in counters])


def lag_behind(head: Column, checkpoint: Column) -> Column:
    """Blocks behind the head; never below 0."""
    return F.greatest(head - checkpoint, F.lit(0))


def newest(samples: DataFrame, aggregates: dict[str, Column], time: str = "ts") -> DataFrame:
    """Aggregates over the samples of the newest time: one pass keeps what the newest has."""
    by_time = samples.groupBy(time).agg(*[c.alias(n) for n, c in aggregates.items()])
    return by_time.orderBy(F.desc(time)).limit(1)


def by_bucket(samples: DataFrame, width: str, aggregates: dict[str, Column], time: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by stretches of time, as ``bucket``."""
    bucket = F.window(time, width)["start"].alias("bucket")
    return samples.groupBy(bucket, *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def average_where(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


#: The rank of an approximate quantile is off by at most one part in so many.
ACCURACY = 10_000


def quantile_or_zero(column: str, share: float, exact: bool = False) -> Column:
    """A quantile, 0 over no rows; approximate unless asked for exactly."""
    found = F.percentile(column, share) if exact else F.percentile_approx(column, share, ACCURACY)
    return F.coalesce(found, F.lit(0))


def recovery_rows(rows: DataFrame, share: float = 0.95, block: str = "block_number") -> DataFrame:
    """Rows whose block is at or above the share's quantile; the one number makes the scan's filter."""
    floor = rows.agg(quantile_or_zero(block, share, exact=True)).first()[0]
    return rows.where(F.col(block) >= floor)


def high_water(rows: DataFrame, column: str = "block_number") -> DataFrame:
    """The largest value, 0 where there is none, and the number of rows."""
    return rows.agg(F.coalesce(F.max(column), F.lit(0)).alias("last"), F.count("*").alias("n"))


def latest_checkpoint(sync: DataFrame) -> DataFrame:
    """Of each chain the newest checkpoint; the higher block among equal times."""
    return latest(sync, ["chain_id"], ("updated_at", "last_block"))


def catalogue(spark: SparkSession, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """The session's catalogue as (database, table, engine) and (database, table, name), of tables whose name begins so."""
    tables = [t for t in spark.catalog.listTables() if t.name.startswith(prefix)]
    columns = [(t.database or "", t.name, c.name) for t in tables for c in spark.catalog.listColumns(t.name)]
    return (
        spark.createDataFrame([(t.database or "", t.name, t.tableType) for t in tables], "database string, table string, engine string"),
        spark.createDataFrame(columns, "database string, table string, name string"),
    )


def tables_with(columns: DataFrame, tables: DataFrame, needed: str = "block_number", marked: str = "chain_id", unlike: str = "%View") -> DataFrame:
    """Of a catalogue, the tables that have a column, and whether they have another."""
    chosen = columns.join(tables.where(~F.col("engine").like(unlike)), ["database", "table"])
    found = chosen.groupBy("database", "table").agg(F.count_if(F.col("name") == needed).alias("n"), (F.count_if(F.col("name") == marked) > 0).alias("has_chain"))
    return found.where("n > 0").select("database", "table", "has_chain")
