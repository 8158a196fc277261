"""URL filters as a sort-merge range join of urls and nested rules.

A host's labels in reverse order, each closed by a full stop, make its key
(``com.example.www.``), so that a rule holds for an interval of keys: all that
begin with its own. Urls and rules are dealt out by the same cut points of the
key range (a few for each partition, from a sample; they only balance the work).
A rule goes to each range that its interval meets, behind the key a hash spreads
the urls of a large host, so no range has to hold one host. In each range a
sorted sweep keeps the stack of rules whose intervals are open; a url asks the
stack for the longest rule whose path begins its own.

Defined results: a null url, or one without ``://``, has an empty host and path
and meets only rules of the empty host; a rule of the empty host holds for all
hosts; the longest rule is the one with most characters in host and path, of two
equal ones the deeper host wins; one rule given with two verdicts blocks;
repeated rows give repeated results; no rules, or no urls, are allowed; further
columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled keys for each range.
SAMPLE = 32
DEFAULT = "allow"


def parsed(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and the reversed-host key."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, UPPER, LOWER)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return urls.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit(""))).withColumn("key", key_of(F.col("host")))


def key_of(host: F.Column) -> F.Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def python_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Stack:
    """The rules whose intervals are open, the widest first."""

    def __init__(self):
        self.open: list[tuple[str, str, dict[str, str], list[int]]] = []

    def close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, host, {}, []))
        _, _, paths, lengths = self.open[-1]
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule, as host and path, and its verdict."""
        self.close(key)
        best, found = -1, (None, None)
        for _, host, paths, lengths in reversed(self.open):
            for n in lengths:
                if len(host) + n <= best:
                    break
                if n <= len(path) and (verdict := paths.get(path[:n])) is not None:
                    best, found = len(host) + n, (host + path[:n], verdict)
                    break
        return found


ROW = "range int, key string, is_url boolean, page_id long, host string, path string, verdict string"


def judge_urls(urls: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], url: str = "url", page_id: str = "page_id", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``urls``.

    ``rules`` has (host, path, verdict); a path begins with ``/`` or is empty.
    """
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = parsed(urls.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url")))
    spread = F.concat("key", F.lit("\x01"), F.lower(F.hex(F.xxhash64("page_id", "url"))))
    pages = pages.withColumn("at", spread)
    n = pages.count()
    share = min(1.0, ranges * SAMPLE / max(1, n))
    sample = sorted(row.at for row in pages.select("at").sample(share, 7).limit(4 * ranges * SAMPLE).collect())
    cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [bisect_right(cuts, at) for at in batch.column(4).to_pylist()]
            yes, none = pa.array([True] * len(to)), pa.nulls(len(to), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), batch.column(1), yes, batch.column(0), batch.column(2), batch.column(3), none], NAMES)

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, verdict in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                key = python_key((host or "").translate(str.maketrans(UPPER, LOWER)))
                low = bisect_right(cuts, key)
                high = bisect_left(cuts, key + chr(0x10FFFF)) if key else len(cuts)
                rows += [(k, key, False, None, host or "", path or "", verdict) for k in range(low, high + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS)], NAMES)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, now = Stack(), None
        for batch in batches:
            out: list[tuple] = []
            for where, key, is_url, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != now:
                    stack, now = Stack(), where
                if is_url:
                    rule, found = stack.find(key, path)
                    out.append((page, host, path, rule, found or DEFAULT))
                else:
                    stack.add(key, host, path, verdict)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), *[pa.string()] * 4))], ["page_id", "host", "path", "rule", "verdict"])

    placed = pages.select("page_id", "key", "host", "path", "at").mapInArrow(place_urls, ROW)
    opened = rules.select("host", "path", "verdict").mapInArrow(place_rules, ROW)
    both = placed.unionByName(opened).repartitionById(ranges, "range").sortWithinPartitions("range", "key", "is_url", "path")
    return both.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


NAMES = ["range", "key", "is_url", "page_id", "host", "path", "verdict"]
KINDS = (pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string())
