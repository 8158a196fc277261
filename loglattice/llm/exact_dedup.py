"""Exact deduplication by a log-structured merge index of text digests.

Each task feeds its documents to an ``LsmIndex``: a memtable of digests that is
flushed as a sorted run with a Bloom filter; runs of like size are compacted,
and a compaction keeps the surviving identifier and the count of each digest. So
a task hands on one entry for each digest it has met, however many copies there
are, and the merge of all tasks' entries (the last compaction) is an aggregation
with map-side combining.

Digests that are met more than once are hits, and hits receive byte
verification: a Bloom filter of the hit digests, sized by their number and
bounded, picks the texts in a second narrow pass; each task compares the texts of
a digest with the first one it has met and hands on that one; and sorted streams
of those compare them between tasks. Texts with no copy are never moved. Digests
that turn out to stand for different texts are regrouped by the texts themselves.

As a stage, ``drop_copies`` decides by row, that is by text and doc_id: of equal
texts one row stays, whatever rows share a doc_id, and only the texts of rows
that stay in a group of several are moved.

Defined results: a null text counts as empty; texts of any length are read whole
and compared byte by byte; the largest doc_id of a group stays (or the smallest,
on request), null counting below all; of repeated rows (same doc_id, same text)
one is kept; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm import bloom
from loglattice.llm.bloom import Bloom
from loglattice.llm.common import durable, fresh_name, join_crowded, text_slices, worker_state

#: Entries of a memtable before it is flushed.
MEMTABLE = 1 << 15
#: Runs of a level before they are compacted.
FAN_IN = 4


def sha256(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


class Run:
    """Digests in order, the identifier that stays for each, and their counts."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.digests, self.ids, self.counts = digests, ids, counts
        self.filter = Bloom(max(1 << 10, 1 << (10 * len(digests)).bit_length()))
        self.filter.add(digests)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The place of each digest, or -1; the filter answers most misses."""
        out = np.full(len(digests), -1)
        maybe = np.flatnonzero(self.filter.may_hold(digests))
        if len(maybe) and len(self.digests):
            at = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self.digests) - 1)
            hit = self.digests[at] == digests[maybe]
            out[maybe[hit]] = at[hit]
        return out


class LsmIndex:
    """Memtable, sorted runs in levels, compaction. ``keep`` is np.maximum or np.minimum.

    Digests are held as fixed-width bytes with a closing one, so that trailing
    zero bytes count.
    """

    def __init__(self, keep=np.maximum, memtable: int = MEMTABLE):
        self.keep, self.memtable_size = keep, memtable
        self.memtable: dict[bytes, list[int]] = {}
        self.levels: list[list[Run]] = []

    def put(self, digest: bytes, doc_id: int) -> None:
        entry = self.memtable.get(digest)
        if entry is None:
            if len(self.memtable) >= self.memtable_size:
                self.flush()
            self.memtable[digest] = [doc_id, 1]
        else:
            entry[0] = int(self.keep(entry[0], doc_id))
            entry[1] += 1

    def flush(self) -> None:
        if not self.memtable:
            return
        digests = np.array([d + b"\1" for d in self.memtable], f"S{1 + len(next(iter(self.memtable)))}")
        values = np.array(list(self.memtable.values()), np.int64)
        self.memtable = {}
        order = np.argsort(digests, kind="stable")
        ids, counts = values[order, 0], values[order, 1]
        digests = digests[order]
        # A digest that a run already has is folded into it; the filters skip the other runs.
        fresh = np.ones(len(digests), bool)
        for run in (run for level in self.levels for run in level):
            at = run.find(digests)
            hit = (at >= 0) & fresh
            run.ids[at[hit]] = self.keep(run.ids[at[hit]], ids[hit])
            run.counts[at[hit]] += counts[hit]
            fresh &= ~hit
        if fresh.any():
            self._add(0, Run(digests[fresh], ids[fresh], counts[fresh]))

    def _add(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_IN:
            merged = self.compact(self.levels[level])
            self.levels[level] = []
            self._add(level + 1, merged)

    def compact(self, runs: list[Run]) -> Run:
        """One run of several; the identifier to keep and the sum of counts of each digest."""
        digests = np.concatenate([run.digests for run in runs])
        order = np.argsort(digests, kind="stable")
        digests = digests[order]
        first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
        ids = self.keep.reduceat(np.concatenate([run.ids for run in runs])[order], first)
        counts = np.add.reduceat(np.concatenate([run.counts for run in runs])[order], first)
        return Run(digests[first], ids, counts)

    def finish(self) -> Run | None:
        self.flush()
        runs = [run for level in self.levels for run in level]
        return self.compact(runs) if runs else None


_NULL = {True: np.iinfo(np.int64).min, False: np.iinfo(np.int64).max}


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def digests_of(docs: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """(doc_id, digest) of each row of (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, None)
        for batch in batches:
            made = [digest(_raw(text)) for _, texts in text_slices(batch.column(1)) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "digest"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, "doc_id long, digest binary")


def index_entries(members: DataFrame, largest: bool) -> DataFrame:
    """(digest, keep_id, n): what each task's index holds of (doc_id, digest)."""
    null = _NULL[largest]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex(np.maximum if largest else np.minimum)
        for batch in batches:
            for doc_id, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index.put(key, null if doc_id is None else doc_id)
        if (run := index.finish()) is not None:
            for a in range(0, len(run.digests), MEMTABLE):
                part = slice(a, a + MEMTABLE)
                keys = pa.array([key[:-1] for key in run.digests[part].tolist()], pa.binary())
                ids = pa.array(run.ids[part], mask=run.ids[part] == null)
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array(run.counts[part])], ["digest", "keep_id", "n"])

    return members.select("doc_id", "digest").mapInArrow(rows, "digest binary, keep_id long, n long")


def _hashed(digests: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for each digest."""
    return np.array([xxhash.xxh64_intdigest(d, 42) for d in digests], np.uint64).view(np.int64)


def hit_filter(groups: DataFrame) -> tuple[int, bytes]:
    """The Bloom filter of the digests met more than once: (bits, words)."""
    hits = groups.where("n > 1").select(F.xxhash64("digest"))
    return bloom.built(hits, hits.count())


def collided(docs: DataFrame, found: tuple[int, bytes], digest: Callable[[bytes], bytes]) -> DataFrame:
    """The digests, among the hits, that stand for texts that differ in a byte."""
    bits, shared = found[0], docs.sparkSession.sparkContext.broadcast(found[1])

    def first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Bloom(bits, np.frombuffer(shared.value, np.uint8))
        held: dict[bytes, bytes] = {}
        size = 0

        def out(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["digest", "raw"])

        for raws in ([_raw(text) for text in texts] for batch in batches for _, texts in text_slices(batch.column(0))):
            keys = [digest(raw) for raw in raws]
            differ = []
            for i in np.flatnonzero(hits.may_hold(_hashed(keys))).tolist():
                known = held.setdefault(keys[i], raws[i])
                if known is raws[i]:
                    size += len(known)
                elif known != raws[i]:
                    differ.append((keys[i], raws[i]))
            if differ:
                yield out(differ)
            if size > 1 << 24:
                yield out(list(held.items()))
                held, size = {}, 0
        if held:
            yield out(list(held.items()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = reported = None
        for batch in batches:
            found = []
            for now, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != key:
                    key, first = now, raw
                elif raw != first and reported != key:
                    found.append(key)
                    reported = key
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    texts = docs.select("text").mapInArrow(first_texts, "digest binary, raw binary")
    return texts.repartition("digest").sortWithinPartitions("digest").mapInArrow(compare, "digest binary")


def _indexed(docs: DataFrame, largest: bool, digest: Callable[[bytes], bytes]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest) of each row, (digest, keep_id, group_size) of each digest, and the digests of several texts."""
    members = durable(digests_of(docs, digest))
    pick = F.max if largest else F.min
    entries = index_entries(members, largest).groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    entries = durable(entries)
    return members, entries, durable(collided(docs, hit_filter(entries.withColumnRenamed("group_size", "n")), digest))


def _mixed(docs: DataFrame, bad: DataFrame, largest: bool, digest: Callable[[bytes], bytes]) -> DataFrame:
    """digest, text, doc_id, copies, keep_id and group_size of the rows whose digests stand for several texts, by their texts."""
    make = F.arrow_udf(lambda texts: pa.array([digest(_raw(t)) for t in texts.to_pylist()], pa.binary()), "binary")
    pick = F.max if largest else F.min
    own = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text").withColumn("digest", make("text")).join(bad, "digest", "left_semi")
    apart = own.groupBy("digest", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return own.groupBy("digest", "text", "doc_id").agg(F.count("*").alias("copies")).join(apart, ["digest", "text"])


def exact_groups(docs: DataFrame, largest: bool = True, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, digest."""
    members, entries, bad = _indexed(docs, largest, digest)
    rows = members.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    out = join_crowded(rows, entries.withColumn("n", F.col("group_size")), "digest", "n", members.count())
    if not bad.isEmpty():
        mixed = _mixed(docs, bad, largest, digest)
        out = out.join(bad, "digest", "left_anti").unionByName(mixed.select(*out.columns))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", "digest", copy).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_copies(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows of ``docs``, columns as they are, without copies: of equal texts the row with the largest doc_id.

    The decision is by row. A row goes if its text has a row with a larger
    doc_id, or is repeated with the same one; rows that share a doc_id but not
    the text do not touch each other. A null doc_id is below all others.
    """
    _, entries, bad = _indexed(docs, largest, sha256)
    key, own = fresh_name("digest", docs), fresh_name("own_id", docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(key, F.unhex(F.sha2(text.cast("binary"), 256))).withColumn(own, F.col("doc_id").cast("long"))
    chosen = entries.select(F.col("digest").alias(key), F.col("keep_id").alias(own))
    several = entries.where("group_size > 1").select(F.col("digest").alias(key))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if bad.isEmpty():
        return bloom.keep_chosen(rows, key, own, chosen, several, several.count()).select(*columns)
    # Different texts with one digest: their rows are parted by the texts themselves.
    parted = rows.join(bad.select(F.col("digest").alias(key)), key, "left_semi").groupBy(text.alias("_text"))
    apart = parted.agg((F.max_by if largest else F.min_by)(F.struct(*columns), own).alias("_row")).select("_row.*")
    rest = rows.join(bad.select(F.col("digest").alias(key)), key, "left_anti")
    return bloom.keep_chosen(rest, key, own, chosen, several, several.count()).select(*columns).unionByName(apart)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The report of ``exact_groups`` with the digest in hexadecimal."""
    found = exact_groups(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
