"""Config, plans, sources, tables, forks and the indexer end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loglattice.functions import u256
from loglattice.operators import compaction, fold, latest, metrics
from loglattice.operators.tables import Table
from loglattice.plans import config as configs
from loglattice.plans.project import Project, split_statements, state_spec
from loglattice.sources import blocks, http, pacing
from loglattice.streaming.chain import Block, Checkpoint, ForkError, ForkTracker, common_prefix, effective_finalized, gate, resume
from loglattice.streaming.indexer import Indexer, LateBlock

TOKEN = "0x00000000000000000000000000000000000000aa"
YAML = f"""
name: demo
store_blocks: true
store_raw_logs: true
include_metadata: [blockHash, contract_address]
exclude_metadata:
  - Noted: text
chains:
  - id: 1
    start_block: 1
    contracts:
      - name: Token
        address: "{TOKEN}"
        events:
          - event: Transfer(address indexed from, address indexed to, uint256 value)
      - name: Any
        events:
          - event: Transfer(address indexed from, address indexed to, uint256 value)
            name: Moved
          - event: Noted(string text, bool flag)
"""


def topic(n):
    return "0x" + n.to_bytes(32, "big").hex()


def transfer(block, index, sender, receiver, value, address=TOKEN, data=None):
    return {
        "address": address, "transactionHash": "0x" + f"{block:064x}", "topics": ["0xDDF252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef", topic(sender), topic(receiver)],
        "data": "0x" + value.to_bytes(32, "big").hex() if data is None else data, "transactionIndex": 0, "logIndex": index,
    }


def page(number, logs=None, branch=""):
    out = {"header": {"number": number, "hash": f"0x{number:x}{branch}", "timestamp": 1_700_000_000 + number}}
    return out | ({"logs": logs} if logs is not None else {})


def write(path, pages):
    path.write_text("\n\n".join(json.dumps(p) for p in pages) + "\n")
    return str(path)


def test_config_rules(tmp_path):
    config = configs.validate(configs.parse(YAML))
    assert config.includes("block_hash") and config.includes("CONTRACTADDRESS") and not config.includes("chain_id")
    assert config.chains[0].contracts[1].events[1].omit == ["text"] and config.chains[0].contracts[0].address == [TOKEN]
    for bad, message in (
        ("name: x\nunknown: 1", "unknown field unknown"),
        ("chains: [{id: 1}]", "name is required"),
        ("name: x", "at least one chain"),
        ("name: x\nchains: [{start_block: 3}]", "id is required"),
        ("name: x\nchains: [{id: 1, start_block: 5, end_block: 4}]", "end_block must be"),
        ("name: x\nchains: [{id: 1, contracts: [{name: A}]}]", "events is required"),
        ("name: x\nchains: [{id: 1}]\nstate: [{name: S, mode: other}]", "mode must be"),
        ("name: x\nchains: [{id: 1, contracts: [{name: A, address: 5, events: [{event: E()}]}]}]", "address must be"),
    ):
        with pytest.raises(configs.ConfigError, match=message):
            configs.validate(configs.parse(bad))
    (tmp_path / "config.yml").write_text(YAML)
    assert configs.load(str(tmp_path)).name == "demo"
    assert configs.parse("name: x\nchains: [{id: 1, contracts: [{name: A, address: 0xab, events: [{event: E()}]}]}]").chains[0].contracts[0].address == ["0xab"]
    assert configs.override(configs.parse(YAML), end_block=0, chain="ethereum").chains[0].end_block is None


def test_plan():
    project = Project.plan(configs.validate(configs.parse(YAML)), [state_spec("PositionSchema", [("account", "address"), ("amount", "uint256")])])
    assert [s.table for s in project.events] == ["token_transfer_events", "any_moved_events", "any_noted_events"]
    assert project.events[0].sort_key == ["from", "to", "block_number", "transaction_index", "log_index"] and project.events[2].columns == ["flag"]
    assert project.source_filters(1) == [{"address": [TOKEN], "topic0": [project.events[0].event.topic]}, {"topic0": [project.events[0].event.topic, project.events[2].event.topic]}]
    assert project.route(TOKEN.upper(), project.events[0].event.topic).contract == "Token" and project.route("0x1", project.events[0].event.topic).contract == "Any"
    ddl = project.ddl()
    assert any("CREATE TABLE IF NOT EXISTS positions_log" in s for s in ddl) and "max_by" in ddl[-1]
    assert json.loads(project.manifest())["chains"][0]["contracts"][0]["events"][0]["table"] == "token_transfer_events"
    assert "get_json_object(params, '$.flag')" in project.view_sql(project.events[2])
    assert split_statements("a; -- x;\n b 'c;d' /* ; */;") == ["a", "b 'c;d'"]
    with pytest.raises(configs.ConfigError):
        state_spec("X", [("a", "string")], key=["b"])


def test_pages_and_decoding(spark, tmp_path):
    pages = [
        page(1, [transfer(1, 0, 1, 2, 100), transfer(1, 1, 2, 3, 5, address="0xbb"), transfer(1, 2, 1, 2, 0, data="0x"), transfer(1, 3, 4, 5, 0, data="0x12")]),
        page(2), page(3, []), page(4, [transfer(4, 0, 7, 8, 2**200) | {"topics": []}]),
    ]
    path = write(tmp_path / "p.jsonl", pages)
    read = blocks.read_pages(spark, path)
    assert [r.block_number for r in blocks.headers_of(read).orderBy("block_number").collect()] == [1, 2, 3, 4]
    logs = blocks.logs_of(read, 1)
    assert logs.count() == 5 and blocks.logs_of(read, 1, end_block=0).count() == 0
    project = Project.plan(configs.parse(YAML))
    own = project.decode(logs, project.events[0]).collect()
    assert len(own) == 1 and u256.unpack(own[0].value) == 100 and own[0]["from"][-1] == 1 and own[0].block_hash == "0x1"
    assert project.decode(logs, project.events[1]).count() == 2  # of any contract; data too short is left out
    params = project.params_json(logs, project.events[0]).first()
    assert json.loads(params.params) == {"from": "0x" + "00" * 19 + "01", "to": "0x" + "00" * 19 + "02", "value": "100"}
    assert logs.where(blocks.filter_condition(project.source_filters(1))).count() == 4
    project.params_json(logs, project.events[0]).createOrReplaceTempView("logs")
    assert spark.sql(project.view_sql(project.events[0])).first().value == "100"
    (tmp_path / "bad.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        blocks.logs_of(blocks.read_pages(spark, str(tmp_path / "bad.jsonl")), 1).count()


def test_params_are_read_back(spark):
    """What params_json shows of every kind of argument comes back as decode gives it; broken JSON gives zeros."""
    text = "E(address indexed who, string indexed tag, int256 below, bytes4 mark, uint256[] many, bool[2] flags, (uint8 a, bytes[] b) part, string note)"
    project = Project.plan(configs.validate(configs.parse(f"name: n\nchains: [{{id: 1, contracts: [{{name: C, events: [{{event: '{text}'}}]}}]}}]")))
    spec = project.events[0]
    word = lambda v: v if isinstance(v, bytes) else u256.pack(v)
    words = lambda *v: b"".join(map(word, v))
    many, part, note = words(2, 7, 2**255), words(3, 64, 1, 32, 2, b"ab".ljust(32, b"\0")), words(2, b"hi".ljust(32, b"\0"))
    head = 32 * 7
    data = words(-5 % 2**256, b"mark".ljust(32, b"\0"), head, 1, 0, head + len(many), head + len(many) + len(part)) + many + part + note
    row = (1, 5, "0x1", "0x" + "02" * 32, 0, 3, "0x" + "cc" * 20, [spec.event.topic, "0x" + "00" * 12 + "ab" * 20, "0x" + "ef" * 32], "0x" + data.hex())
    logs = spark.createDataFrame([row], "chain_id long, block_number long, block_hash string, transaction_hash string, transaction_index long, log_index long, address string, topics array<string>, data string")
    logs = logs.withColumn("block_timestamp", F.lit("2024-01-01").cast("timestamp"))
    shown = project.params_json(logs, spec)
    straight = project.decode(logs, spec)
    own = [n for n in straight.columns if n != "_chain_id"]
    assert project.typed_params(shown, spec).select(own).collect() == straight.select(own).collect()
    assert u256.signed(straight.first().below) == -5 and [bytes(x) for x in straight.first().part.b] == [b"ab"]
    broken = project.typed_params(shown.withColumn("params", F.lit('{"many": ["7", "x"], "mark": "0xzz", "note": "n"}')), spec).first()
    assert broken.many == [] and bytes(broken.mark) == bytes(4) and broken.note == "n" and bytes(broken.below) == bytes(32) and broken.part.b == []


def test_rates_by_stretches(spark):
    rows = [("a", "2024-01-01 00:00:00", 10), ("a", "2024-01-01 00:00:10", 30), ("a", "2024-01-04 00:00:10", 30 + 259200), ("a", "2024-01-04 00:00:11", None), ("b", "2024-01-04 00:00:00", 5), (None, "2024-01-04 00:00:00", 1), ("a", None, 4)]
    df = spark.createDataFrame(rows, "chain_id string, t string, n long").select("chain_id", F.col("t").cast("timestamp").alias("ts"), "n", F.lit(1).alias("_stretch0"))
    found = metrics.rates(df, ["n"])
    assert found.columns == [*df.columns, "n_per_s"]
    assert sorted((str(r.chain_id), str(r.ts), r.n_per_s) for r in found.collect()) == [
        ("None", "2024-01-04 00:00:00", 0.0), ("a", "2024-01-01 00:00:00", 0.0), ("a", "2024-01-01 00:00:10", 2.0), ("a", "2024-01-04 00:00:10", 1.0), ("a", "2024-01-04 00:00:11", 0.0), ("a", "None", 0.0), ("b", "2024-01-04 00:00:00", 0.0),
    ]
    assert metrics.rates(df.limit(0), ["n"]).count() == 0


def test_pacing():
    admission = pacing.Admission(target=6.0, least=100, most=10_000)
    assert admission.blocks == pacing.FIRST_BLOCKS
    admission.seen(600, 2.0)
    assert admission.blocks == 1800
    admission.seen(600, 6.0)
    assert admission.blocks == 1200
    admission.seen(0, 5.0)
    admission.seen(1_000_000, 1.0)
    assert admission.blocks == 10_000
    assert pacing.tasks(0, 9, None, 4) == [(0, 3), (4, 7), (8, 9)] and pacing.tasks(5, 4, None, 4) == []
    assert pacing.tasks(0, 1000, 522, 6) == [(0, 5), (6, 10), (11, 1000)] and pacing.tasks(20, 30, 100, 4) == [(20, 30)]
    slept, now = [], [0.0]
    rate = pacing.RequestRate(5, 2, lambda: now[0], slept.append)
    for _ in range(3):
        rate.take()
    assert slept == [pytest.approx(0.2)] and rate.share(2).rate == 2.5
    assert pacing.pause(9, lambda: 1.0) == 8.0 and pacing.pause(1, lambda: 0.0) == 0.25


def test_range_reader():
    have = {n: page(n, []) for n in range(0, 40, 3)}
    asked = []

    def ask(url, body):
        asked.append(body["fromBlock"])
        if len(asked) == 2:
            raise OSError("busy")
        found = [p for n, p in have.items() if n >= body["fromBlock"]][:4]  # short pages that go beyond the end
        return b"\n".join(json.dumps(p).encode() for p in found), http.Head()

    got = [row[0][0] for row in http.read_range("u", 4, 31, [], pacing.RequestRate(1e9, 1e9), ask, lambda s: None)]
    assert got == [6, 9, 12, 15, 18, 21, 24, 27, 30] and asked.count(16) == 2
    assert http.query(1, 2, "0x9", True, [])["parentBlockHash"] == "0x9"
    with pytest.raises(ValueError):
        http.endpoint("https://example.org", {1: "main"}, 5, True)
    assert http.endpoint("https://example.org/", {1: "main"}, 1, False).endswith("main/finalized-stream")


A = [Block(5, "5"), Block(6, "6"), Block(7, "7")]


def test_forks():
    assert common_prefix(A, [Block(5, "5"), Block(6, "6a"), Block(7, "7a")]) == 0
    assert common_prefix(A, [Block(4, "4"), Block(5, "5"), Block(8, "8")]) == 0
    assert common_prefix(A[:2], [Block(5, "5a"), Block(6, "6a")]) == -1
    tracker = ForkTracker(Block(4, "4"), list(A))
    assert tracker.resolve([Block(5, "5"), Block(6, "x")]) == Block(5, "5") and tracker.chain == A[:1]
    assert ForkTracker(Block(4, "4"), list(A)).resolve([Block(2, "2"), Block(3, "3")]) == Block(4, "4")
    assert ForkTracker(Block(4, "4"), list(A)).resolve([Block(4, "4"), Block(5, "x")]) == Block(4, "4")
    for theirs in ([Block(4, "x")], [Block(5, "x")], []):
        with pytest.raises(ForkError):
            ForkTracker(Block(4, "4"), list(A)).resolve(theirs)
    assert ForkTracker(None, list(A)).handle([Block(5, "x")]) is None
    tracker = ForkTracker(depth=3)
    for block in [*A, Block(7, "7b"), Block(6, "old"), Block(8, "8")]:
        tracker.push(block)
    assert tracker.chain == [Block(6, "6"), Block(7, "7b"), Block(8, "8")]
    tracker.finalize(Block(7, "7b"))
    tracker.finalize(Block(3, "3"))
    assert tracker.finalized == Block(7, "7b") and tracker.chain == [Block(8, "8")]
    assert effective_finalized(A, Block(6, "z"), Block(2, "2")) == Block(6, "6") and effective_finalized(A, Block(1, "1"), Block(2, "2")) == Block(2, "2")


def test_checkpoints():
    assert resume(None) is None and resume(Checkpoint(A[2], A[0], A)).block == A[0]
    point = resume(Checkpoint(A[2], None, A))
    assert point.block == A[2] and point.tracker.chain == A
    assert gate(A[2], 6, None, A) == A[1] and gate(A[2], None, A[0], A) == A[0] and gate(A[2], None, None, A) == A[2]


def test_compaction_vector(spark):
    rows = spark.createDataFrame([("k", b, 0, 0) for b in (100, 150, 250, 350, 450, 550, 900)], "key string, block_number long, transaction_index long, log_index long")
    kept = [r.block_number for r in compaction.compacted(rows, ["key"], 200, 2000).orderBy("block_number").collect()]
    assert kept == [150, 350, 550, 900]
    assert compaction.compacted(rows, ["key"], 0, 2000).count() == 7 and compaction.compacted(rows, ["key"], 200, 1000).count() == 7


def test_positions(spark):
    zero, a, b = bytes(20), b"a" * 20, b"b" * 20
    rows = [(zero, a, 2**200), (a, b, 7), (b, b, 3), (a, zero, 1)]
    df = spark.createDataFrame([(s, r, u256.pack(v), k, 0, 0) for k, (s, r, v) in enumerate(rows)], "from binary, to binary, value binary, block_number long, transaction_index long, log_index long")
    found = fold.transfer_positions(df.withColumn("block_timestamp", F.timestamp_seconds("block_number")))
    shown = {bytes(r.address): (r.i, r.o, r.transfer_count, r.balance, r.updated_at_block) for r in found.select("address", u256.to_text("total_in" if False else F.col("total_in")).alias("i"), u256.to_text(F.col("total_out")).alias("o"), "transfer_count", fold.balance(F.col("total_in"), F.col("total_out")).alias("balance"), "updated_at_block").collect()}
    assert shown == {a: (str(2**200), "8", 3, str(2**200 - 8), 3), b: ("10", "3", 3, "7", 2)}
    assert fold.weighted_average(0, 5, 0, 9) == 9 and fold.trade_step(fold.trade_step(None, {"quantity": 2, "price": 10}), {"quantity": -1, "price": 15})["realised"] == 5


def test_table_batches(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField(n, LongType()) for n in ("v", "block_number", "transaction_index", "log_index")])
    table = Table(spark, str(tmp_path / "t"), schema, bucket=10)
    assert table.read([]).count() == 0
    rows = lambda *blocks_: spark.createDataFrame([(b, b, 0, 0) for b in blocks_], schema)
    seen = lambda segments: sorted(r.v for r in table.read(segments).collect())
    one, two, empty = table.write(rows(1, 5, 15), 1, 16), table.write(rows(17, 26), 17, 26), table.write(rows().limit(0), 27, 30)
    assert (one.rows, two.rows, empty.rows) == (3, 2, 0) and seen([one, two, empty]) == [1, 5, 15, 17, 26] and seen([two]) == [17, 26]
    cut = table.rolled_back([one, two, empty], 17)
    assert cut[0] is one and len(cut) == 2 and seen(cut) == [1, 5, 15, 17] and seen(table.rolled_back(cut, 0)) == []
    small = [table.write(rows(n), n, n) for n in range(16)]
    assert [s.rows for s in table.merged(small, 14)] == [1] * 16
    assert [(s.first, s.last, s.rows) for s in table.merged(small, 15)] == [(0, 15, 16)]


def positions(before, events):
    """The batch's transfers by receiver, added to what was there."""
    got = events["token_transfer_events"].groupBy(F.col("to").alias("account")).agg(u256.sum_of(F.col("value")).alias("more"), F.max("block_number").alias("block_number"), F.max("transaction_index").alias("transaction_index"), F.max("log_index").alias("log_index"))
    old = before.select("account", F.col("amount").alias("had"))
    return got.join(old, "account", "left").select("account", u256.add(F.coalesce("had", u256.literal(0)), F.col("more")).alias("amount"), "block_number", "transaction_index", "log_index")


@pytest.fixture
def indexer(spark, tmp_path):
    state = state_spec("PositionSchema", [("account", "address"), ("amount", "uint256")])
    project = Project.plan(configs.validate(configs.parse(YAML)), [state])
    with pytest.raises(ValueError):
        Indexer(spark, project, 1, str(tmp_path / "none"))
    return lambda name: Indexer(spark, project, 1, str(tmp_path / name), {"PositionSchema": positions}, bucket=2)


def amounts(one):
    state = one.project.states[0]
    return {r.account[-1]: u256.unpack(r.amount) for r in one.live(state).collect()}


def test_reorganisation_equals_the_canonical_branch(spark, tmp_path, indexer):
    common = [page(n, [transfer(n, 0, 1, 2, n)]) for n in (1, 2, 3)]
    wrong = [page(n, [transfer(n, 0, 1, 3, 100)], "bad") for n in (4, 5)]
    right = [page(n, [transfer(n, 0, 1, 4, 7 * n)], "ok") for n in (4, 5, 6)]
    first = indexer("a")
    first.process(blocks.read_pages(spark, write(tmp_path / "1.jsonl", common)), Block(2, "0x2"))
    first.process(blocks.read_pages(spark, write(tmp_path / "2.jsonl", wrong)), Block(2, "0x2"))
    assert amounts(first) == {2: 6, 3: 200}
    shared = first.fork([Block(2, "0x2"), Block(3, "0x3"), Block(4, "0x4ok")])
    assert shared == Block(3, "0x3") and amounts(first) == {2: 6}
    first.process(blocks.read_pages(spark, write(tmp_path / "3.jsonl", right)), Block(3, "0x3"))
    other = indexer("b")
    other.process(blocks.read_pages(spark, write(tmp_path / "4.jsonl", common + right)), Block(3, "0x3"))
    assert amounts(first) == {2: 6, 4: 7 * 15} and amounts(other) == amounts(first)
    key = lambda df: sorted(map(tuple, df.collect()))
    for mine, theirs in zip(first.specs, other.specs, strict=True):
        assert key(first.rows(mine.table)) == key(other.rows(theirs.table))
    assert key(first.rows("blocks")) == key(other.rows("blocks")) and key(first.rows("logs")) == key(other.rows("logs"))
    again = indexer("a")
    assert again.recover() == Block(3, "0x3") and amounts(again) == {2: 6}
    again.reindex(2)
    assert amounts(again) == {2: 1} and again.load_checkpoint().current.number == 1
    assert "positions_live" in again.register_views() and spark.sql("select count(*) n from positions_live").first().n == 1


def test_stream_of_files(spark, tmp_path, indexer):
    folder = tmp_path / "in"
    folder.mkdir()
    one = indexer("s")
    for k, n in enumerate((1, 2, 3)):
        write(folder / f"{k}.json", [page(n, [transfer(n, 0, 1, 2, n)])])
        query = one.stream(blocks.stream_pages(spark, str(folder), 1), str(tmp_path / "offsets"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert amounts(one) == {2: 6} and one.rows(one.specs[0].table).count() == 3


def test_latest_views(spark):
    rows = spark.createDataFrame([("a", 1, 0, 0), ("a", 9, 0, 1), ("a", 9, 0, 0), ("b", 3, 0, 0)], "k string, block_number long, transaction_index long, log_index long")
    assert sorted(map(tuple, latest.latest(rows, ["k"]).collect())) == [("a", 9, 0, 1), ("b", 3, 0, 0)]
    assert sorted(map(tuple, latest.as_of(rows, ["k"], 5).collect())) == [("a", 1, 0, 0), ("b", 3, 0, 0)]
    assert latest.latest_by_bucket(rows, ["k"], 5).count() == 3 and latest.latest(rows.limit(0), ["k"]).count() == 0


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, indexer, monkeypatch):
    first, more = ([page(n, [transfer(n, 0, 1, 2, n)]) for n in span] for span in ((1, 2), (3, 4, 5)))
    paths = [write(tmp_path / f"{k}.jsonl", pages) for k, pages in enumerate((first, more))]
    clean = indexer("clean")
    for path in paths:
        clean.process(blocks.read_pages(spark, path), Block(1, "0x1"))
    crash = lambda *a, **k: (_ for _ in ()).throw(OSError("lost"))
    one = indexer("crash")
    for path in paths:  # before the first checkpoint, and before a later one
        for broken, name in ((Indexer, "_fold"), (type(one.log), "commit")):
            with monkeypatch.context() as patch:
                patch.setattr(broken, name, crash)
                with pytest.raises(OSError):
                    one.process(blocks.read_pages(spark, path), Block(1, "0x1"))
        one = indexer("crash")
        one.recover()
        one.process(blocks.read_pages(spark, path).where(F.col("header.number") > 0), Block(1, "0x1"))
    one = indexer("crash")
    one.recover()  # back to the final block
    for path in paths:
        one.process(blocks.read_pages(spark, path), Block(1, "0x1"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert amounts(one) == amounts(clean) and all(key(one.rows(n)) == key(clean.rows(n)) for n in ("token_transfer_events", "any_moved_events", "blocks", "logs"))
    live = {s.name for segments in one.state.tables.values() for s in segments}
    one.log.clean(one.state)
    assert {d.name.removeprefix("segment=") for d in (tmp_path / "crash").glob("*/segment=*")} == live and not (tmp_path / "crash/_staging").exists()
    other = indexer("crash")
    other.process(blocks.read_pages(spark, write(tmp_path / "9.jsonl", [page(9, [])])))
    with pytest.raises(RuntimeError):  # two writers: the later commit fails
        one.process(blocks.read_pages(spark, write(tmp_path / "8.jsonl", [page(8, [])])))


def test_streams_reindexed_and_restarted(spark, tmp_path, indexer):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda n, pages: (write(folder / f"{n}.json", pages), os.utime(folder / f"{n}.json", (1000 + n, 1000 + n)))
    for n in (1, 2, 3):
        put(n, [page(n, [transfer(n, 0, 1, 2, n)])])

    def run(one):
        one.recover()
        assert one.stream(blocks.stream_pages(spark, str(folder), 1)).awaitTermination(120)
        return amounts(one), one.rows("token_transfer_events").count()

    one = indexer("s")
    assert run(one) == ({2: 6}, 3) and run(indexer("s")) == ({2: 6}, 3)
    one = indexer("s")
    one.reindex(2)
    assert amounts(one) == {2: 1} and run(one) == ({2: 6}, 3)
    one.restart()
    assert not (tmp_path / "s/_offsets").exists() and run(one) == ({2: 6}, 3)
    put(4, [page(n, [transfer(n, 0, 1, 3, 50)], "other") for n in (3, 4, 6)])  # files replace block 3
    assert run(indexer("s")) == ({2: 3, 3: 150}, 5)
    with pytest.raises(LateBlock):
        one = indexer("s")
        one.recover()
        one.process(blocks.read_pages(spark, write(tmp_path / "late.jsonl", [page(5, [])])))


def test_state_folds_are_stamped(spark):
    state = state_spec("HoldingSchema", [("account", "string"), ("amount", "int64"), ("updated_at_block", "int64"), ("updated_at", "int64")], ["account"])
    rows = [("a", 5, 3, 0, 1), ("a", 2, 3, 0, 0), ("b", 7, 4, 1, 0)]
    events = spark.createDataFrame(rows, "who string, v long, block_number long, transaction_index long, log_index long").withColumn("block_timestamp", F.timestamp_seconds("block_number"))
    before = spark.createDataFrame([("a", 10, 1, 1000, 1, 0, 0), ("c", 1, 1, 1000, 1, 0, 0)], state.schema)
    one = fold.state_fold(state, "moves", {"account": "who"}, lambda s, e: {"amount": (s["amount"] if s else 0) + e["v"]})
    many = fold.state_fold(state, "moves", {"account": "who"}, lambda s, batch: {"amount": (s["amount"] if s else 0) + sum(batch.column("v").to_pylist())}, columnar=True)
    for process in (one, many):
        found = {r.account: tuple(r)[1:] for r in process(before, {"moves": events}).collect()}
        assert found == {"a": (17, 3, 3000, 3, 0, 1), "b": (7, 4, 4000, 4, 1, 0)}
    every = fold.ordered_fold(events.withColumnRenamed("who", "account"), ["account"], lambda s, e: {"amount": (s["amount"] if s else 0) + e["v"]}, state.schema, every=True)
    assert sorted(tuple(r)[:2] for r in every.collect()) == [("a", 2), ("a", 7), ("b", 7)]


def test_newest_rows_of_ties_and_odd_kinds(spark):
    rows = [(None, "x", 5, 0, 0), (None, "y", 6, 0, 0), ("k", "same", 7, 0, 0), ("k", "same", 7, 0, 0), ("n", "null", None, 0, 0), ("n", "some", 0, 0, 0)]
    df = spark.createDataFrame(rows, "k string, v string, block_number long, transaction_index long, log_index long")
    found = latest.latest(df, ["k"])
    assert sorted((str(r.k), r.v) for r in found.collect()) == [("None", "y"), ("k", "same"), ("n", "some")]
    plan = found._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "SortAggregate" not in latest.latest(df.drop("v"), ["k"])._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="digits"):
        latest.latest(df.withColumn("block_number", F.lit(10**15)), ["k"]).collect()
