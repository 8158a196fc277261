"""From pages to tables and state, exactly once, in batches that may be rolled back.

A batch is staged, decoded once per event and written as new segments; then the
state rows that it changes are; then one commit names all of them and the
checkpoint (``streaming.commits``). Whatever fails before the commit has changed
nothing. Blocks at or below the checkpoint are left out, so a batch that Spark
repeats is empty; one that was never stored, and is not final, is an error. On a fork the tables are cut back to the last
shared block and reading goes on there. State needs no undoing: the newest row
of each key at the end of the last whole batch is the state, and the events
between that and the block are folded again from their tables.

One root holds one chain.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.types import METADATA, ORDER
from loglattice.operators.latest import as_of, latest
from loglattice.operators.metrics import latest_checkpoint
from loglattice.operators.tables import Segment, Table
from loglattice.plans.project import EventSpec, Project, StateSpec, system_tables
from loglattice.sources import blocks as pages_
from loglattice.sources import http
from loglattice.streaming.chain import Block, Checkpoint, ForkTracker, effective_finalized, gate, resume
from loglattice.streaming.commits import CommitLog, State
from loglattice.streaming.progress import ChainGauges

#: The callback of a state: (state as of the batch's start, decoded events by table) to changed rows.
#: An object may stand for it that has ``process`` and, if it likes, ``flush(block)`` and ``restore(block)``.
Processor = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
#: A callback without state: (last block of the batch, decoded events by table); called again if the batch fails later.
Callback = Callable[[Block, dict[str, DataFrame]], None]
#: Seconds between looks for new blocks, and the name of the file that ends a stream.
POLL_SECONDS, STOP = 5.0, "_stop"


class LateBlock(ValueError):
    """A block that may not be left out and cannot be added: later ones are stored."""


@dataclass
class Indexer:
    """One chain of a project over a folder of tables."""

    spark: SparkSession
    project: Project
    chain_id: int
    root: str
    processors: dict[str, Processor] = field(default_factory=dict)
    callbacks: list[Callback] = field(default_factory=list)
    bucket: int = 100_000
    tracker: ForkTracker = field(default_factory=ForkTracker)

    def __post_init__(self):
        missing = [s.name for s in self.project.states if s.name not in self.processors]
        if missing:
            raise ValueError(f"state {missing[0]} has no processor")
        self.log = CommitLog(self.spark, self.root)
        self.state: State = self.log.load()
        self.gauges = ChainGauges(self.spark, f"{self.root}/indexer_metrics", self.chain_id)

    # Tables.

    @property
    def specs(self) -> list[EventSpec]:
        return [s for s in self.project.events if s.chain_id == self.chain_id]

    def _table(self, name: str, schema: T.StructType, order: tuple[str, ...] = ORDER) -> Table:
        return Table(self.spark, f"{self.root}/{name}", schema, order, self.bucket)

    def tables(self) -> dict[str, Table]:
        """All tables by name; the chain is stored even where an event's view does not show it."""
        found = {}
        for spec in self.specs:
            kinds = list(spec.schema.fields)
            if "chain_id" not in spec.metadata:
                kinds.insert(0, T.StructField("chain_id", METADATA["chain_id"]))
            found[spec.table] = self._table(spec.table, T.StructType(kinds), tuple(spec.sort_key))
        for state in self.project.states:
            found[state.tables[0]] = self._table(state.tables[0], state.schema, (*state.key, *ORDER))
        wanted = {"blocks": self.project.config.store_blocks, "logs": self.project.config.store_raw_logs}
        for name, schema, order in system_tables():
            if wanted.get(name):
                found[name] = self._table(name, schema, tuple(order))
        return found

    def rows(self, name: str) -> DataFrame:
        """The rows of a table, or of the history of a state."""
        return self.tables()[name].read(self.state.tables.get(name, []))

    def live(self, state: StateSpec, block: int | None = None) -> DataFrame:
        log = self.rows(state.tables[0])
        return latest(log, state.key) if block is None else as_of(log, state.key, block)

    def register_views(self) -> list[str]:
        """Temporary views of all tables, of the newest state, and of the checkpoints."""
        names = []
        for spec in self.specs:
            self.rows(spec.table).select(*spec.schema.fieldNames()).createOrReplaceTempView(spec.table)
            names.append(spec.table)
        for state in self.project.states:
            log, live = state.tables
            self.rows(log).createOrReplaceTempView(log)
            self.live(state).createOrReplaceTempView(live)
            names += [log, live]
        for name in ("blocks", "logs"):
            if name in self.tables():
                self.rows(name).createOrReplaceTempView(name)
                names.append(name)
        if "logs" in names:
            for spec in self.specs:
                self.spark.sql(self.project.view_sql(spec)).createOrReplaceTempView(f"{spec.table}_view")
        self.checkpoints().createOrReplaceTempView("sync_state")
        if self.gauges.exists():
            self.gauges.read().createOrReplaceTempView("indexer_metrics")
            names.append("indexer_metrics")
        return [*names, "sync_state"]

    # Checkpoints.

    def checkpoints(self) -> DataFrame:
        schema = next(s for n, s, _ in system_tables() if n == "sync_state")
        rows = [(*[r[n] for n in schema.fieldNames()[:-1]], datetime.fromisoformat(r["updated_at"])) for r in self.state.checkpoints]
        return self.spark.createDataFrame(rows, schema)

    def load_checkpoint(self) -> Checkpoint | None:
        row = latest_checkpoint(self.checkpoints()).first()
        if row is None:
            return None
        final = Block(row.finalized_block, row.finalized_hash or "") if row.finalized_block is not None else None
        return Checkpoint(Block(row.last_block, row.last_hash), final, [Block(*b) for b in json.loads(row.rollback_chain or "[]")])

    @property
    def current(self) -> Block | None:
        """The last block that is stored."""
        row = self.state.checkpoints[-1] if self.state.checkpoints else None
        return Block(row["last_block"], row["last_hash"]) if row else None

    def _commit(self, tables: dict[str, list[Segment]], last: Block | None, generation: int | None = None) -> None:
        """Names the tables' segments and a checkpoint, in place of those at or above its block."""
        final, now = self.tracker.finalized, datetime.now(UTC).replace(tzinfo=None)
        before = [r for r in self.state.checkpoints if last and r["last_block"] < last.number]
        if before:  # a clock that was set back does not make an older checkpoint the newest
            now = max(now, datetime.fromisoformat(before[-1]["updated_at"]))
        mark = [] if last is None else [{
            "chain_id": self.chain_id, "last_block": last.number, "last_hash": last.hash,
            "finalized_block": final.number if final else None, "finalized_hash": final.hash if final else None,
            "rollback_chain": json.dumps([list(b) for b in self.tracker.chain]), "updated_at": now.isoformat(),
        }]
        self.state = self.log.commit(State(self.state.version, self.state.generation if generation is None else generation, tables, [*before, *mark]))

    # Batches.

    def decode(self, logs: DataFrame) -> dict[str, DataFrame]:
        """The typed rows of each table; tables of one event of several contracts get each its own."""
        found: dict[str, DataFrame] = {}
        for spec in self.specs:
            rows = self.project.decode(logs, spec)
            rows = rows.drop("_chain_id") if "chain_id" in spec.metadata else rows.withColumnRenamed("_chain_id", "chain_id")
            found[spec.table] = found[spec.table].unionByName(rows) if spec.table in found else rows
        return found

    def _staged(self, pages: DataFrame) -> tuple[DataFrame, str]:
        """The pages as Parquet under the root: read from the source once, by block and by column after that."""
        if "heads" not in pages.columns:
            pages = pages.withColumn("heads", F.lit(None).cast(pages_.HEADS))
        name = f"_staging/{uuid.uuid4().hex}"
        pages.select("header", "logs", "heads").write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(pages_.PAGE).parquet(f"{self.root}/{name}"), name

    def process(self, pages: DataFrame, finalized: Block | None = None) -> Block | None:
        """One batch of pages behind the checkpoint. Returns its last block, or None if nothing is new.

        ``finalized`` is the final head; where it is not given, what the pages
        tell counts. Pages that name another hash for a block that may still
        fork raise ``ForkDetected``.
        """
        staged, name = self._staged(pages)
        try:
            return self._process(staged, finalized)
        finally:
            self.log.root.delete(name)

    def _process(self, staged: DataFrame, finalized: Block | None) -> Block | None:
        chain = next(c for c in self.project.config.chains if c.id == self.chain_id)
        number, begun = F.col("header.number"), time.monotonic()
        if chain.end_block is not None:
            staged = staged.where(number <= chain.end_block)
        if self.current:
            self._find_fork(staged.where(number <= self.current.number))
            staged = staged.where(number > self.current.number)
        found = staged.select("header.number", "header.hash", "heads").orderBy(F.desc("number")).limit(self.tracker.depth).collect()
        if not found:
            return None
        blocks = [Block(r.number, r.hash or "") for r in found][::-1]
        told = max((Block(r.heads.finalized_number, r.heads.finalized_hash or "") for r in found if r.heads and r.heads.finalized_number is not None), default=None)
        first = staged.agg(F.min("header.number")).first()[0]
        last = blocks[-1]
        logs = pages_.logs_of(staged, self.chain_id)
        events = self.decode(logs)
        outputs = dict(events)
        if self.project.config.store_blocks:
            outputs["blocks"] = self._event_blocks(events, staged)
        if self.project.config.store_raw_logs:
            for spec in self.specs:
                one = self.project.params_json(logs, spec)
                outputs["logs"] = one if "logs" not in outputs else outputs["logs"].unionByName(one)
        tables, known = dict(self.state.tables), self.tables()
        for name, rows in outputs.items():
            tables[name] = [*tables.get(name, []), known[name].write(rows, first, last.number)]
        written = {name: known[name].read(tables[name][-1:]) for name in events}
        self._fold(tables, written, first, last.number)
        for callback in self.callbacks:
            callback(last, written)
        for block in blocks:
            self.tracker.push(block)
        self.tracker.finalize(effective_finalized(self.tracker.chain, finalized or told, self.tracker.finalized))
        settled = gate(last, None, self.tracker.finalized, self.tracker.chain) or last
        tables = {name: known[name].merged(segments, settled.number) if name in known else segments for name, segments in tables.items()}
        self._commit(tables, last)
        latest_ = max((r.heads.latest for r in found if r.heads and r.heads.latest is not None), default=last.number)
        self.gauges.record(last.number - first + 1, sum(tables[n][-1].rows for n in events), latest_, last.number, time.monotonic() - begun)
        return last

    def _find_fork(self, again: DataFrame) -> None:
        """Raises ForkDetected if pages that are stored already come with other hashes, LateBlock for one that is not stored."""
        ours = {b.number: b.hash for b in self.tracker.chain}
        if not ours:
            return
        final = self.tracker.finalized
        # Below the final head, or what a full tracker has forgotten, a block cannot be told from one that is stored.
        known = final.number if final else min(ours) - 1 if len(ours) >= self.tracker.depth else -1
        rows = again.where(F.col("header.number") > known).select("header.number", "header.hash").distinct().orderBy("number", "hash")
        theirs = {r.number: r.hash or "" for r in rows.limit(2 * self.tracker.depth).collect()}
        if any(n in ours and ours[n] != digest for n, digest in theirs.items()):
            # Files name no parents: what lies below the first page is shared.
            below = [b for b in (final, *self.tracker.chain) if b and b.number < min(theirs)]
            raise http.ForkDetected([*map(tuple, below), *sorted(theirs.items())])
        if late := [n for n in theirs if n not in ours]:
            raise LateBlock(f"block {late[0]} comes behind block {self.current.number}: pages have to come in the order of their blocks")

    def _event_blocks(self, events: dict[str, DataFrame], staged: DataFrame) -> DataFrame:
        """A row for each block that has a decoded event."""
        seen = None
        for rows in events.values():
            one = rows.select("block_number")
            seen = one if seen is None else seen.unionByName(one)
        heads = pages_.headers_of(staged).join(seen.distinct(), "block_number", "left_semi")
        return heads.select(F.lit(self.chain_id).cast("long").alias("chain_id"), "block_number", "block_timestamp", "block_hash").dropDuplicates(["block_number"])

    def _fold(self, tables: dict[str, list[Segment]], events: dict[str, DataFrame], first: int, last: int) -> None:
        """Appends to each state what the events of a stretch of blocks change."""
        known = self.tables()
        for state in self.project.states:
            name = state.tables[0]
            before = latest(known[name].read(tables.get(name, [])), state.key)
            own = self.processors[state.name]
            changed = getattr(own, "process", own)(before, events)
            tables[name] = [*tables.get(name, []), known[name].write(changed, first, last)]
            if hasattr(own, "flush"):
                own.flush(last)

    # Going back.

    def rollback(self, block: Block | None, tracker: ForkTracker, anew: bool = True) -> None:
        """Cuts every table back to a block, folds again what lies behind the last whole batch, and commits.

        ``anew``: stream offsets of before do not count any more.
        """
        number, known = block.number if block else -1, self.tables()
        states = {s.tables[0]: s for s in self.project.states}
        tables = {name: known[name].rolled_back(segments, number) for name, segments in self.state.tables.items() if name in known and name not in states}
        events = {spec.table: tables.get(spec.table, []) for spec in self.specs}
        for name, state in states.items():
            whole = [s for s in self.state.tables.get(name, []) if s.last <= number]
            settled = max((s.last for s in whole), default=-1)
            tables[name] = whole
            between = {n: known[n].read([s for s in segments if s.last > settled]).where((F.col("block_number") > settled) & (F.col("block_number") <= number)) for n, segments in events.items()}
            if settled < number and any(s.last > settled for segments in events.values() for s in segments):
                before = latest(known[name].read(whole), state.key)
                own = self.processors[state.name]
                changed = getattr(own, "process", own)(before, between)
                tables[name] = [*whole, known[name].write(changed, settled + 1, number)]
        self.tracker = tracker
        self._commit(tables, block, self.state.generation + anew)
        for own in self.processors.values():
            if hasattr(own, "restore"):
                own.restore(number)

    def fork(self, theirs: list[Block], anew: bool = True) -> Block | None:
        """Resolves a fork and rolls back to the shared block; None: nothing is shared and none is final, so start anew."""
        tracker = replace(self.tracker, chain=list(self.tracker.chain))
        shared = tracker.handle(theirs)
        self.rollback(shared, tracker, anew)
        return shared

    def recover(self) -> Block | None:
        """After a restart: the block to go on behind, with everything above, and all that no commit names, deleted."""
        self.state = self.log.load()
        self.log.clean(self.state)
        point = resume(self.load_checkpoint())
        if point is None:
            return None
        self.tracker = point.tracker
        if point.block.number < self.current.number:
            self.rollback(point.block, point.tracker)
        return point.block

    def reindex(self, first: int) -> None:
        """Deletes from a block on; the block before it is the checkpoint."""
        self.rollback(Block(first - 1, ""), ForkTracker())

    def restart(self) -> None:
        """Drops every table and all stream offsets."""
        for name in self.log.root.names():
            self.log.root.delete(name)
        self.state, self.tracker = State(), ForkTracker()

    def compact(self, interval: int, head: int, lower: int = 0) -> None:
        """Keeps one history row a key and interval of all state tables, and the checkpoints from the margin on."""
        tables, known = dict(self.state.tables), self.tables()
        for state in self.project.states:
            name = state.tables[0]
            tables[name] = known[name].compacted(tables.get(name, []), state.key, interval, head, lower)
        self.state = self.log.commit(State(self.state.version, self.state.generation, tables, self.state.checkpoints))
        self.log.clean(self.state)

    # Streams.

    def _accept(self, pages: DataFrame) -> None:
        """A micro-batch; pages of files that replace stored ones roll these back first."""
        try:
            self.process(pages)
        except http.ForkDetected as fork:
            self.fork([Block(*b) for b in fork.previous], anew=False)
            self.process(pages)

    def stream(self, pages: DataFrame, offsets: str | None = None, trigger: dict | None = None):
        """A streaming query over pages; its offsets are those of the tables' generation."""
        query = pages.writeStream.foreachBatch(lambda rows, _: self._accept(rows))
        where = offsets or f"{self.root}/_offsets/{self.state.generation}"
        return query.option("checkpointLocation", where).trigger(**(trigger or {"availableNow": True})).start()

    def request_stop(self) -> None:
        """Asks whoever follows this root to end after its micro-batch."""
        self.log.root.write(STOP, "")

    def follow(self, url: str, first: int = 0, last: int | None = None, poll: float = POLL_SECONDS, options: dict | None = None) -> Block | None:
        """Streams a service from the checkpoint on, through forks, until ``last`` is stored or a stop is asked for.

        Offsets live no longer than the query: where it begins is the checkpoint
        and its hash, so every start asks the service whether they still stand.
        """
        self.spark.dataSource.register(http.BlockRanges)
        self.log.root.delete(STOP)
        settings = {"url": url, "filters": json.dumps(self.project.source_filters(self.chain_id)), **(options or {})}
        while True:
            at = self.current
            begin = max(first, at.number + 1 if at else 0)
            if last is not None and begin > last:
                return at
            source = self.spark.readStream.format("block_ranges").options(**settings).option("from", begin)
            if at and at.hash and begin == at.number + 1:
                source = source.option("parent", at.hash)
            if last is not None:
                source = source.option("to", last)
            offsets = f"_offsets/follow-{uuid.uuid4().hex}"
            query = self.stream(source.load(), f"{self.root}/{offsets}", {"processingTime": f"{poll} seconds"})
            try:
                while not query.awaitTermination(min(poll, 1.0)):
                    if self.log.root.exists(STOP) or (last is not None and self.current and self.current.number >= last):
                        break
                self.gauges.flush()
                return self.current
            except StreamingQueryException:
                if (theirs := self._forked(url)) is None:
                    raise
                self.fork(theirs)
            finally:
                query.stop()
                self.log.root.delete(offsets)

    def _forked(self, url: str) -> list[Block] | None:
        """The service's own blocks if it does not know the checkpoint's hash any more."""
        at = self.current
        try:
            if at and at.hash:
                http.fetch(url, http.query(at.number + 1, at.number + 1, at.hash, True, []))
        except http.ForkDetected as fork:
            return [Block(*b) for b in fork.previous]
        return None
