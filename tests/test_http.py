"""The HTTP range source against a small service: short answers, overshoot, forks, compression."""

import json
import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
import zstandard
from pyspark.sql import functions as F

from loglattice.plans import config as configs
from loglattice.plans.project import Project, state_spec
from loglattice.sources import blocks, http
from loglattice.sources.blocks import logs_of
from loglattice.streaming.chain import Block
from loglattice.streaming.indexer import Indexer
from tests.test_engine import YAML, amounts, page, positions, transfer, write

CHAIN = {n: page(n, [transfer(n, 0, 1, 2, n)] if n % 3 == 0 else []) for n in range(0, 60, 2)}


class Service(BaseHTTPRequestHandler):
    asked: list[dict] = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.asked.append(body)
        if body.get("parentBlockHash") == "0xother":
            self.answer(409, json.dumps({"previousBlocks": [{"number": 8, "hash": "0x8"}]}).encode())
            return
        found = [p for n, p in CHAIN.items() if n >= body["fromBlock"]][:5]
        if not found:
            self.answer(204, b"")
        elif body["fromBlock"] > 1000:
            self.answer(500, b"x" * 10_000)
        else:
            lines = b"\n\n".join(json.dumps(p).encode() for p in found)
            self.answer(200, zstandard.ZstdCompressor().compress(lines))

    def answer(self, code, data):
        self.send_response(code)
        self.send_header("X-Finalized-Head-Number", "50")
        self.send_header("X-Finalized-Head-Hash", "0x32")
        self.send_header("X-Head-Number", "58")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/stream"
    server.shutdown()


def test_fetch(url):
    raw, head = http.fetch(url, http.query(0, 9, None, False, []))
    assert [p["header"]["number"] for p in http.pages_of(raw, 5)] == [0, 2, 4] and head == http.Head((50, "0x32"), 58)
    assert http.fetch(url, http.query(99, None, None, False, []))[0] == b""
    with pytest.raises(http.ForkDetected) as fork:
        http.fetch(url, http.query(9, None, "0xother", False, []))
    assert fork.value.previous == [(8, "0x8")]
    with pytest.raises(ValueError):
        list(http.pages_of(b'{"header":{}}'))


def test_ranges_as_a_data_source(spark, url):
    spark.dataSource.register(http.BlockRanges)
    read = spark.read.format("block_ranges").option("url", url).option("from", 3).option("to", 41).option("rangeSize", 10).load()
    assert sorted(r.n for r in read.select(F.col("header.number").alias("n")).collect()) == list(range(4, 42, 2))
    assert read.rdd.getNumPartitions() == 4 and logs_of(read, 1).count() == 6


def test_pushing_in_a_query(spark, url):
    spark.dataSource.register(http.BlockRanges)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("block_ranges").option("url", url).option("from", 0).option("to", 1_000_000).option("pushdown", "true").load()
        assert sorted(r.n for r in read.where("header.number <= 9").select(F.col("header.number").alias("n")).collect()) == [0, 2, 4, 6, 8]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_block_bounds_are_pushed():
    reader = http._PushingReader({"url": "u", "from": "0", "to": "100", "rangeSize": "50"})
    number = ("header", "number")
    filters = [http.GreaterThan(number, 10), http.LessThanOrEqual(number, 80), http.GreaterThan(("logs",), 3)]
    assert list(reader.pushFilters(filters)) == filters and [(p.start, p.end) for p in reader.partitions()] == [(11, 60), (61, 80)]


def test_tail_as_a_stream(spark, url, tmp_path):
    spark.dataSource.register(http.BlockRanges)
    stream = spark.readStream.format("block_ranges").option("url", url).option("from", 40).load()
    query = stream.select("header.number").writeStream.format("memory").queryName("tail_blocks").option("checkpointLocation", str(tmp_path)).start()
    try:
        query.processAllAvailable()
        assert sorted(r.number for r in spark.table("tail_blocks").collect())[:3] == [40, 42, 44]
    finally:
        query.stop()


class ForkingChain:
    """A service whose chain changes once blocks up to ``turn`` have been read."""

    def __init__(self, turn):
        self.turn, self.forked, self.lock = turn, False, threading.Lock()
        self.old = {n: page(n, [transfer(n, 0, 1, 2, n)], "" if n <= 5 else "a") for n in range(1, 11)}
        self.new = {n: page(n, [transfer(n, 0, 1, 3 if n > 5 else 2, 10 * n if n > 5 else n)], "" if n <= 5 else "b") for n in range(1, 15)}

    def answer(self, body):
        with self.lock:
            pages = self.new if self.forked else self.old
            parent, start = body.get("parentBlockHash"), body["fromBlock"]
            known = pages.get(start - 1)
            if parent and known and known["header"]["hash"] != parent:
                return 409, json.dumps({"previousBlocks": [p["header"] for n, p in pages.items() if start - 7 <= n < start]}).encode()
            found = [p for n, p in pages.items() if start <= n <= body.get("toBlock", 99)][:3]
            if not self.forked and start > self.turn:
                self.forked = True
            return (200, b"\n".join(json.dumps(p).encode() for p in found)) if found else (204, b"")

    def heads(self):
        return (4, "0x4", 14 if self.forked else 10)


@pytest.fixture
def forking():
    chain = ForkingChain(10)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            code, data = chain.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            final, digest, head = chain.heads()
            self.send_response(code)
            for name, value in (("X-Finalized-Head-Number", final), ("X-Finalized-Head-Hash", digest), ("X-Head-Number", head), ("Content-Length", len(data))):
                self.send_header(name, str(value))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield chain, f"http://127.0.0.1:{server.server_port}/stream"
    server.shutdown()


def test_following_through_a_fork_ends_with_the_canonical_tables(spark, tmp_path, forking):
    chain, url = forking
    state = state_spec("PositionSchema", [("account", "address"), ("amount", "uint256")])
    project = Project.plan(configs.validate(configs.parse(YAML)), [state])
    one = Indexer(spark, project, 1, str(tmp_path / "live"), {"PositionSchema": positions}, bucket=4)
    one.gauges.flushed = -1e9  # a file at once
    assert one.follow(url, 1, 14, poll=0.2) == Block(14, "0xeb") and chain.forked
    want = Indexer(spark, project, 1, str(tmp_path / "want"), {"PositionSchema": positions})
    want.process(blocks.read_pages(spark, write(tmp_path / "new.jsonl", chain.new.values())), Block(4, "0x4"))
    assert amounts(one) == amounts(want) == {2: 15, 3: 10 * sum(range(6, 15))}
    key = lambda df: sorted(map(tuple, df.collect()))
    assert all(key(one.rows(n)) == key(want.rows(n)) for n in ("token_transfer_events", "any_moved_events", "blocks", "logs"))
    assert one.tracker.finalized == Block(4, "0x4") and one.load_checkpoint().finalized == Block(4, "0x4")
    gauges = one.gauges.read().orderBy("ts").collect()
    assert gauges[-1].head == 14 and {r.chain_id for r in gauges} == {1}
    one.gauges.flush(datetime.now(UTC) + timedelta(days=30))
    assert not one.gauges.exists()
    stopping = threading.Timer(3.0, one.request_stop)
    stopping.start()
    assert one.follow(url, 1, None, poll=0.2) == Block(14, "0xeb")  # ends by the request
