"""Block ranges from an HTTP service, as a Python data source: one partition a range.

    spark.dataSource.register(BlockRanges)
    spark.read.format("block_ranges").option("url", ...).option("from", 0).option("to", 9999).load()

A request is JSON in, compressed JSON lines out; 204 is an empty range, 409 a
fork, whose body names the service's own blocks. Answers may stop early, and may
go beyond the range: a reader goes on behind the last block it was given, and
leaves out what lies beyond. Filters on address and topics go to the service,
and the heads that it tells come with every page.

As a stream, an offset is a block and its hash. Each micro-batch is admitted by
blocks (``sources.pacing``), and its first request names the hash of the block
before, so that a fork ends the query instead of passing unseen.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from loglattice.sources.blocks import PAGE
from loglattice.sources.pacing import ATTEMPTS, Admission, RequestRate, pause, tasks

FIELDS = {
    "block": {"number": True, "hash": True, "timestamp": True},
    "log": {"address": True, "topics": True, "data": True, "transactionHash": True, "transactionIndex": True, "logIndex": True},
}
DETAIL = 4096


class ForkDetected(Exception):
    """The service's chain is not ours; its last blocks, by number and hash."""

    def __init__(self, previous: list[tuple[int, str]]):
        super().__init__(f"fork: {previous[-3:]}")
        self.previous = previous


@dataclass
class Head:
    """The heads that an answer's headers tell."""

    finalized: tuple[int, str] | None = None
    latest: int | None = None


def query(start: int, end: int | None, parent: str | None, every_block: bool, filters: list[dict]) -> dict:
    """The body of a request."""
    body: dict = {"type": "evm", "fromBlock": start, "includeAllBlocks": every_block, "logs": filters, "fields": FIELDS}
    if end is not None:
        body["toBlock"] = end
    if parent:
        body["parentBlockHash"] = parent
    return body


def heads(headers, prefix: str = "X-") -> Head:
    """The prefix of the header names is the service's."""
    number, digest, latest = (headers.get(f"{prefix}{name}") for name in ("Finalized-Head-Number", "Finalized-Head-Hash", "Head-Number"))
    return Head((int(number), digest or "") if number else None, int(latest) if latest else None)


def decompressed(raw: bytes) -> bytes:
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(raw) as lines:
            return lines.read()
    return raw


def fetch(url: str, body: dict, timeout: float = 60.0, send: Callable = urllib.request.urlopen) -> tuple[bytes, Head]:
    """The lines of an answer and the heads; raises ForkDetected, or OSError with the start of what the service says."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Accept-Encoding": "zstd"})
    try:
        with send(request, timeout=timeout) as answer:
            return (b"" if answer.status == 204 else decompressed(answer.read())), heads(answer.headers)
    except urllib.error.HTTPError as error:
        detail = error.read(1 << 20)
        if error.code == 409:
            blocks = json.loads(detail).get("previousBlocks", [])
            raise ForkDetected([(int(b["number"]), b["hash"]) for b in blocks]) from None
        raise OSError(f"{url}: {error.code}: {detail[:DETAIL].decode(errors='replace')}") from None


def pages_of(raw: bytes, last: int | None = None) -> Iterator[dict]:
    """The pages of JSON lines, blank ones skipped, up to a block."""
    for line in raw.split(b"\n"):
        if line.strip():
            page = json.loads(line)
            if "number" not in page.get("header", {}):
                raise ValueError("a page has no block number")
            if last is not None and page["header"]["number"] > last:
                return
            yield page


def as_row(page: dict, head: Head) -> tuple:
    header = page["header"]
    logs = [(x.get("address"), x.get("transactionHash"), x.get("topics") or [], x.get("data"), x.get("transactionIndex"), x.get("logIndex")) for x in page.get("logs") or []]
    number, digest = head.finalized or (None, None)
    return (header["number"], header.get("hash"), header.get("timestamp")), logs, (number, digest, head.latest)


def read_range(url: str, start: int, end: int, filters: list[dict], rate: RequestRate, ask: Callable = fetch, sleep: Callable = time.sleep, parent: str | None = None) -> Iterator[tuple]:
    """The rows of a range, in as many requests as the service needs; the first names the parent's hash."""
    at, failures = start, 0
    while at <= end:
        rate.take()
        try:
            raw, head = ask(url, query(at, end, parent if at == start else None, False, filters))
        except OSError:
            failures += 1
            if failures >= ATTEMPTS:
                raise
            sleep(pause(failures))
            continue
        failures, covered = 0, None
        for page in pages_of(raw, end):
            covered = page["header"]["number"]
            yield as_row(page, head)
        if covered is None:
            return
        at = covered + 1


@dataclass
class BlockRange(InputPartition):
    start: int
    end: int
    parent: str | None = None


class _Ranges:
    """What the batch and the stream reader share: options, and reading a partition."""

    def __init__(self, options: dict):
        self.url, self.first = options["url"], int(options.get("from", 0))
        self.size = int(options.get("rangeSize", 10_000))
        self.filters = json.loads(options.get("filters", "[]"))
        self.readers = int(options.get("readers", 8))

    def read(self, partition: BlockRange) -> Iterator[tuple]:
        return read_range(self.url, partition.start, partition.end, self.filters, RequestRate().share(self.readers), parent=partition.parent)


class _Reader(_Ranges, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.start, self.end = self.first, int(options["to"])

    def partitions(self) -> list[BlockRange]:
        return [BlockRange(a, b) for a, b in tasks(self.start, self.end, None, self.size)]


class _PushingReader(_Reader):
    """Chosen by the option ``pushdown``; Spark then wants ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the block number narrow the range; Spark applies all filters as well."""
        for one in filters:
            if getattr(one, "attribute", None) == ("header", "number"):
                if isinstance(one, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.start = max(self.start, one.value + isinstance(one, GreaterThan))
                if isinstance(one, (EqualTo, LessThanOrEqual, LessThan)):
                    self.end = min(self.end, one.value - isinstance(one, LessThan))
            yield one


class _Tail(_Ranges, DataSourceStreamReader):
    """Blocks behind ``from``, as they come; ``parent`` is the hash of the block before, ``to`` the last one."""

    def __init__(self, options: dict):
        super().__init__(options)
        #: Offsets: the block, its hash, and the final head that the service told, -1 if none.
        self.begin = {"block": self.first - 1, "hash": options.get("parent", ""), "final": -1}
        self.last, self.poll, self.idle_since = self.begin, float(options.get("pollSeconds", 1.0)), None
        self.to = int(options["to"]) if options.get("to") else None
        self.admission, self.asked = Admission(target=float(options.get("targetSeconds", Admission.target))), None

    def initialOffset(self) -> dict:
        return dict(self.begin)

    def latestOffset(self) -> dict:
        """As many blocks on as are admitted; the same offset where there are none, or it is too early to ask again."""
        now, begun = time.monotonic(), self.last["block"]
        if self.idle_since is not None and now - self.idle_since < self.poll:
            return dict(self.last)
        raw, head = fetch(self.url, query(begun + 1, begun + 1, self.last["hash"] or None, True, self.filters))
        top = head.latest if head.latest is not None else max((p["header"]["number"] for p in pages_of(raw)), default=begun)
        end = min(x for x in (top, begun + self.admission.blocks, self.to) if x is not None)
        self.idle_since = None
        if end <= begun:
            self.asked, self.idle_since = None, now
            return dict(self.last)
        if self.asked is not None:
            self.admission.seen(self.asked[0], now - self.asked[1])
        self.asked = end - begun, now
        last, _ = fetch(self.url, query(end, end, None, True, []))
        digest = next((p["header"].get("hash") for p in pages_of(last, end)), None)
        self.last = {"block": end, "hash": digest or "", "final": head.finalized[0] if head.finalized else -1}
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[BlockRange]:
        ranges = tasks(start["block"] + 1, end["block"], end["final"], self.size)
        return [BlockRange(a, b, start.get("hash") or None if k == 0 else None) for k, (a, b) in enumerate(ranges)]

    def commit(self, end: dict) -> None:
        pass


class BlockRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_ranges"

    def schema(self) -> StructType:
        return PAGE

    def reader(self, schema: StructType) -> _Reader:
        pushes = str(self.options.get("pushdown", "false")).lower() == "true"
        return (_PushingReader if pushes else _Reader)(self.options)

    def streamReader(self, schema: StructType) -> _Tail:
        return _Tail(self.options)


def endpoint(base: str, datasets: dict[int, str], chain_id: int, live: bool, override: str | None = None) -> str:
    """The address of a chain's stream; a chain without a dataset is an error."""
    if override:
        return override
    if chain_id not in datasets:
        raise ValueError(f"no dataset for chain {chain_id}")
    return f"{base.rstrip('/')}/{datasets[chain_id]}/{'stream' if live else 'finalized-stream'}"
