"""The commit log of a chain: one small file a commit, and the newest is all that is true.

A commit names the live segments of every table, the checkpoint with the chain
that may still be rolled back, the newest checkpoints before it, and the
generation of stream offsets. It is written beside the log and renamed into it,
so all tables and the checkpoint change together or not at all; a job that fails
before its commit has changed nothing. Driver-side and small: the segments of a
table are bounded by merging, the checkpoints by a number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from loglattice.operators.tables import Segment

#: Commit files, and checkpoints, that are kept.
FILES, CHECKPOINTS = 8, 1024


@dataclass
class State:
    """What a commit says."""

    version: int = 0
    generation: int = 0
    tables: dict[str, list[Segment]] = field(default_factory=dict)
    #: Rows of sync_state; the last one is the checkpoint.
    checkpoints: list[dict] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def parse(cls, text: str) -> State:
        raw = json.loads(text)
        raw["tables"] = {name: [Segment(**s) for s in segments] for name, segments in raw["tables"].items()}
        return cls(**raw)


class Folder:
    """Small files of a folder through Hadoop's file systems, so that any shared storage will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, sub: str = "") -> list[str]:
        at = self._path(f"{self.path}/{sub}" if sub else self.path)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(f"{self.path}/{name}"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return not self.exists(new) and self.fs.rename(self._path(f"{self.path}/{old}"), self._path(f"{self.path}/{new}"))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}" if name else self.path), True)


class CommitLog:
    """The log under ``<root>/_commits``."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.folder = Folder(spark, root), Folder(spark, f"{root}/_commits")

    def _files(self) -> list[str]:
        return [n for n in self.folder.names() if n.endswith(".json") and n[0] != "."]

    def load(self) -> State:
        files = self._files()
        return State.parse(self.folder.read(files[-1])) if files else State()

    def commit(self, state: State) -> State:
        """Makes ``state`` the truth; an error if another writer has committed meanwhile."""
        state.version += 1
        state.checkpoints = state.checkpoints[-CHECKPOINTS:]
        name, draft = f"{state.version:020d}.json", f".draft-{uuid.uuid4().hex}"
        self.folder.write(draft, state.text())
        if not self.folder.rename(draft, name):
            self.folder.delete(draft)
            raise RuntimeError(f"commit {state.version} exists: the tables have another writer")
        for old in self._files()[:-FILES]:
            self.folder.delete(old)
        return state

    def clean(self, state: State) -> None:
        """Deletes what no commit names: segments of failed or replaced work, drafts, staged pages."""
        for name in self.root.names():
            if name == "_staging":
                self.root.delete(name)
            elif not name.startswith(("_", ".", "indexer_metrics")):
                live = {f"segment={s.name}" for s in state.tables.get(name, [])}
                for segment in self.root.names(name):
                    if segment.startswith("segment=") and segment not in live:
                        self.root.delete(f"{name}/{segment}")
        for draft in self.folder.names():
            if draft.startswith(".draft-"):
                self.folder.delete(draft)
