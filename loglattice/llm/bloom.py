"""Bloom filters as broadcast values: built by the tasks, merged by a tree, tested where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import durable, fresh_name, worker_state

PROBES = 5
#: Bits for each entry, and of a filter at least and at most (32 MB); a full one only lets more rows through.
EACH, LEAST_BITS, MOST_BITS = 10, 1 << 13, 1 << 28
#: Filters that one task merges.
FAN_IN = 16


class Bloom:
    """A Bloom filter; the probes are taken from the entries' own bytes, at least eight of them."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(bits // 8, np.uint8) if words is None else words

    def _places(self, entries: np.ndarray) -> np.ndarray:
        own = entries.view(np.uint8).reshape(len(entries), -1)[:, :16]
        raw = np.zeros((len(entries), 16), np.uint8)
        raw[:, : own.shape[1]] = own
        raw = raw.view("<u8")
        mixed = (raw[:, 0] ^ raw[:, 0] >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)  # where an entry has eight bytes only
        step = (raw[:, 1] ^ mixed ^ mixed >> np.uint64(29)) | np.uint64(1)
        return (raw[:, :1] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(self.bits)

    def add(self, entries: np.ndarray) -> None:
        if len(entries):
            at = self._places(entries).ravel()
            np.bitwise_or.at(self.words, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, entries: np.ndarray) -> np.ndarray:
        if not len(entries):
            return np.zeros(0, bool)
        at = self._places(entries)
        return ((self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def bits_for(entries: int) -> int:
    """A power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (EACH * max(1, entries)).bit_length()))


def built(hashes: DataFrame, entries: int) -> tuple[int, bytes]:
    """(bits, words) of the filter of a frame of one long column; its size follows from ``entries`` and is bounded."""
    bits = bits_for(entries)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Bloom(bits)
        for batch in batches:
            found.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([found.words.tobytes()], pa.binary())], ["words"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for words in batch.column(0):
                whole |= np.frombuffer(words.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["words"])

    # No more tasks than their filters are worth: what they hand on is bounded as the filter is.
    width = max(1, min(256, (1 << 31) // bits))
    parts = hashes.coalesce(width).mapInArrow(own, "words binary")
    while width > 1:
        width = -(-width // FAN_IN)
        parts = parts.repartition(width).mapInArrow(merged, "words binary")
    found = parts.first()
    return bits, bytes(found.words) if found else bytes(bits // 8)


class Shared:
    """A filter by broadcast, tested as a column."""

    def __init__(self, hashes: DataFrame, entries: int):
        self.bits, words = built(hashes, entries)
        self.broadcast = hashes.sparkSession.sparkContext.broadcast(words)

    def test(self) -> Callable[[pa.Array], np.ndarray]:
        """For a worker: whether the filter may hold each of some longs."""
        bits, shared = self.bits, self.broadcast

        def own(values: pa.Array) -> np.ndarray:
            worker_state(None, None)
            return Bloom(bits, np.frombuffer(shared.value, np.uint8)).may_hold(values.to_numpy(zero_copy_only=False).astype(np.int64))

        return own

    def may_hold(self, hashed: Column) -> Column:
        test = self.test()
        return F.arrow_udf(lambda values: pa.array(test(values)), "boolean")(hashed)


ALONE, GONE, OPEN = range(3)


def keep_chosen(rows: DataFrame, group: str, doc_id: str, chosen: DataFrame, several: DataFrame, entries: int) -> DataFrame:
    """Of each group of rows the chosen one, each as it is; texts stay where they are but for the groups' winners.

    ``chosen`` (group, doc_id) names the row of every group; ``several`` (group),
    of about ``entries``, the groups that have more than one. A filter of these
    shows which rows are alone for certain, and stay; a filter of the chosen
    shows which of the rest are certainly not chosen, and go. Only what is left,
    about one row a group, is joined by group and doc_id, and repeated rows of one
    doc_id are brought down to one.
    """
    crowd = Shared(several.select(F.xxhash64(group)), entries)
    group_, doc_id_ = fresh_name("group_", rows), fresh_name("doc_id_", rows)
    picked = durable(chosen.where(crowd.may_hold(F.xxhash64(group))).select(F.col(group).alias(group_), F.col(doc_id).alias(doc_id_)))
    winners = Shared(picked.select(F.xxhash64(group_, doc_id_)), entries)
    in_crowd, wins = crowd.test(), winners.test()

    def verdict(groups: pa.Array, both: pa.Array) -> pa.Array:
        return pa.array(np.where(in_crowd(groups), np.where(wins(both), OPEN, GONE), ALONE).astype(np.int32))

    found = F.arrow_udf(verdict, "int")(F.xxhash64(group), F.xxhash64(group, doc_id))
    left = rows.where(found == OPEN).join(picked, (F.col(group) == F.col(group_)) & F.col(doc_id).eqNullSafe(F.col(doc_id_)), "left_semi")
    return rows.where(found == ALONE).unionByName(left.dropDuplicates([group, doc_id]))
