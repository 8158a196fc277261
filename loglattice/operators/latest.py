"""The newest row of each key: of all time, as of a block, or of each stretch of blocks.

The position of a row is packed into one decimal, which a hash aggregation keeps
in place: partial in the map tasks, without a sort, and a key with a third of
the rows costs each task one entry. Columns of fixed width are carried along by
``max_by``. Where a row has texts, bytes or nested values as well, the
aggregation carries a hash of the row instead, and the rows are fetched by a
join on key, position and hash: broadcast, or behind Spark's runtime filter, so
that only the newest rows are moved.

Defined results: a null key is a key; a null in a position sorts below all
others; of rows equal in key and position one stays; an empty table gives none.
A position that does not fit its part of the decimal fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.types import ORDER

#: Digits of a decimal, and of one part of a position.
DIGITS, WIDE = 38, 18
#: Kinds of a fixed width, whose aggregation buffers are changed in place.
FIXED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.TimestampType, T.TimestampNTZType)


def position(rows: DataFrame, order: tuple[str, ...]) -> Column | None:
    """One decimal that sorts as the columns of ``order`` do; None if their kinds cannot be packed.

    One column has 18 digits and more, two have 18 each, three 12 each.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    if len(order) > 3 or not all(isinstance(kinds[c], (*WHOLE, *TIMES)) for c in order):
        return None
    digits = min(WIDE, DIGITS // len(order)) if len(order) > 1 else 19
    unit, packed = 10**digits, None
    for c in order:
        number = F.unix_micros(F.col(f"`{c}`").cast("timestamp")) if isinstance(kinds[c], TIMES) else F.col(f"`{c}`").cast("long")
        part = F.coalesce(number, F.lit(-1)) + 1
        if digits < 19:
            part = F.when(part.between(0, unit - 1), part).otherwise(F.raise_error(F.lit(f"a position in {c} has more than {digits} digits")).cast("long"))
        part = part.cast(T.DecimalType(DIGITS, 0))
        packed = part if packed is None else (packed * F.lit(unit).cast(T.DecimalType(digits + 1, 0))).cast(T.DecimalType(DIGITS, 0)) + part
    return packed.cast(T.DecimalType(DIGITS, 0))


def _newest(rows: DataFrame, keys: list[Column], order: tuple[str, ...]) -> DataFrame:
    packed = position(rows, order)
    if packed is None:
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")
    key_names = [f"_key{k}" for k in range(len(keys))]
    marked = rows.select("*", *[k.alias(n) for k, n in zip(keys, key_names, strict=True)], packed.alias("_at"))
    if all(isinstance(f.dataType, FIXED) for f in rows.schema.fields):
        best = marked.groupBy(*key_names).agg(*[F.max_by(F.col(f"`{c}`"), "_at").alias(c) for c in rows.columns])
        return best.select(*[F.col(f"`{c}`") for c in rows.columns])
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    best = marked.select(*key_names, "_at", digest.alias("_digest")).groupBy(*key_names)
    best = best.agg(F.max("_at").alias("_best"), F.max_by("_digest", "_at").alias("_same")).select(*[F.col(n).alias("_own" + n) for n in key_names], "_best", "_same")
    on = (F.col("_at") == F.col("_best")) & (digest == F.col("_same"))
    for n in key_names:
        on = on & F.col(n).eqNullSafe(F.col("_own" + n))
    found = marked.join(best, on, "left_semi").dropDuplicates()
    return found.select(*[F.col(f"`{c}`") for c in rows.columns])


def latest(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    return _newest(rows, [F.col(f"`{k}`") for k in keys], order)


def as_of(rows: DataFrame, keys: list[str], block: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """What ``latest`` was when ``block`` was the newest."""
    return latest(rows.where(F.col("block_number") <= block), keys, order)


def latest_by_bucket(rows: DataFrame, keys: list[str], blocks: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row a key and stretch of ``blocks`` blocks: its newest."""
    bucket = F.floor(F.col("block_number") / F.lit(blocks))
    return _newest(rows, [*[F.col(f"`{k}`") for k in keys], bucket], order)


def latest_version(rows: DataFrame, keys: list[str], version: str = "updated_at_block") -> DataFrame:
    """A replacing table: of each key the row with the highest version, the later position among equals."""
    order = (version, *[c for c in ORDER if c in rows.columns])
    return latest(rows, keys, order)


def top(rows: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest value; ``ties`` make the order total."""
    return rows.orderBy(F.desc(by), *[F.asc(t) for t in ties]).limit(n)
