"""What the text operators share: shared-storage checkpoints, bounded memos and Arrow loops."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many characters, which bounds a task's memory.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a
    local session, as in tests, gets a folder of its own; a cluster is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loglattice-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def fresh_name(wanted: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Keys that hold more rows than the larger of these, a number and a share of all rows, are crowded: at most 1 / share of them.
CROWD, CROWD_SHARE = 1000, 1e-4


def join_crowded(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to a ``table`` of one row a ``key``, of which ``count`` rows have it; the count is dropped.

    The crowded keys, at most 10,000 whatever the input, are broadcast, so that
    their rows stay where they are; only the others are brought together by key.
    """
    edge = max(CROWD, int(total * CROWD_SHARE))
    if total <= CROWD:
        return rows.join(table.drop(count), key, how)
    crowded = durable(table.where(F.col(count) > edge))
    if crowded.isEmpty():
        return rows.join(table.drop(count), key, how)
    few = F.broadcast(crowded.drop(count))
    others = rows.join(F.broadcast(crowded.select(key)), key, "left_anti").join(table.where(F.col(count) <= edge).drop(count), key, how)
    return rows.join(few, key).unionByName(others)


class BoundedMemo:
    """A memo of two generations, each of about ``limit`` entries; one of over 64 letters counts for more.

    What was not asked for during a whole generation is forgotten, so that an
    unbounded vocabulary, or texts without blanks, take bounded memory.
    """

    def __init__(self, limit: int = 250_000):
        self.limit, self.young, self.old, self.weight = limit, {}, {}, 0

    def admit(self, keys: Iterable[str], compute: Callable[[list[str]], Iterable]) -> None:
        """Make every key present in ``young``."""
        keys = set(keys)
        fresh = keys - self.young.keys()
        if not fresh:
            return
        if self.weight + len(fresh) > self.limit:
            self.old, self.young, self.weight = self.young, {}, 0
            fresh = keys
        self.weight += len(fresh) + (sum(map(len, fresh)) >> 6)
        unknown = []
        for key in fresh:
            value = self.old.get(key)
            if value is None:
                unknown.append(key)
            else:
                self.young[key] = value
        if unknown:
            self.young.update(zip(unknown, compute(unknown), strict=True))


_WORKER: dict = {}


def worker_state(key, make: Callable):
    """What a worker keeps between its tasks: of one operator at a time, since workers are reused."""
    if key not in _WORKER:
        _WORKER.clear()
        if key is not None:
            _WORKER[key] = make()
    return _WORKER.get(key)


def array_slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of consecutive parts of a text column of about ``limit`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(column)
    while start < n:
        done = int(ends[start - 1]) if start else 0
        end = min(n, int(np.searchsorted(ends, done + limit)) + 1)
        yield start, column.slice(start, end - start)
        start = end


def text_slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list]]:
    """(first row, texts) of the same parts; only one at a time is made into Python strings."""
    for start, part in array_slices(column, limit):
        yield start, part.to_pylist()


def keep_rows(docs: DataFrame, accepts: Callable[[], Callable[[list], list]], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is accepted.

    ``accepts`` is called once in each task and returns a function from a list
    of texts to a list of booleans.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = accepts()
        for batch in batches:
            mask = [ok for _, texts in text_slices(batch.column(batch.schema.get_field_index(text))) for ok in judge(texts)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
