"""Hashing, signatures, 256-bit numbers, decimals, hex and ABI against Python's integers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglattice.functions import abi, dec256, hexes, u256
from loglattice.functions.keccak import keccak256
from loglattice.functions.signature import entity_tables, event_table, events_of_abi, parse_event, plural, snake_case

TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


def test_keccak():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"Transfer(address,address,uint256)").hex() == TRANSFER[2:]
    assert len({keccak256(b"a" * n) for n in range(130, 145)}) == 15


def test_event_signatures():
    event = parse_event("event Transfer(address indexed from, address indexed to, uint value);")
    assert event.canonical == "Transfer(address,address,uint256)" and event.topic == TRANSFER
    assert [a.name for a in event.indexed] == ["from", "to"] and event.head_words == 1
    assert parse_event("Ping()").arguments == () and [a.name for a in parse_event("E(bool, bytes32 x)").arguments] == ["p0", "x"]
    assert parse_event("E(uint256[3] a, uint8[] b)").head_words == 4
    for bad in ("", "E(", "E(foo x)", "E(uint256 a b)", "E(uint256,)"):
        with pytest.raises(ValueError):
            parse_event(bad)


def test_abi_json():
    text = '[{"type":"event","name":"Approval","inputs":[{"name":"owner","type":"address","indexed":true},{"name":"value","type":"uint256"}]},{"type":"function","name":"f"}]'
    assert events_of_abi(text) == ["Approval(address indexed owner, uint256 value)"]


def test_names():
    assert [snake_case(x) for x in ("LBTC", "UniswapV2Pair", "NegRisk", "a-b c")] == ["lbtc", "uniswap_v2_pair", "neg_risk", "a_b_c"]
    taken: set[str] = set()
    assert [event_table("Token", "Transfer", taken) for _ in range(3)] == ["token_transfer_events", "token_transfer_events_2", "token_transfer_events_3"]
    assert entity_tables("UserPositionSchema") == ("user_positions_log", "user_positions_live") and plural("entity") == "entities"


NUMBERS = [0, 1, 9, 10, 2**32 - 1, 2**32, 2**64, 10**18, 10**38, 10**68 + 123456789, 1234567890123456789012345678901234567890, 2**255, 2**256 - 1]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    rows = [(a, b) for a in NUMBERS for b in NUMBERS] + [(rng.getrandbits(rng.randint(1, 256)), rng.getrandbits(rng.randint(1, 256))) for _ in range(300)]
    return rows, spark.createDataFrame([(k, u256.pack(a), u256.pack(b)) for k, (a, b) in enumerate(rows)], "k int, a binary, b binary").repartition(4).persist()


def test_unsigned_operations(pairs):
    rows, df = pairs
    a, b, m = F.col("a"), F.col("b"), u256.MODULUS
    found = df.select(
        "k", u256.add(a, b).alias("add"), u256.sub(a, b).alias("sub"), u256.mul(a, b).alias("mul"), u256.div(a, b).alias("div"), u256.mod(a, b).alias("mod"),
        u256.bit_and(a, b).alias("and_"), u256.bit_or(a, b).alias("or_"), u256.bit_xor(a, b).alias("xor"), u256.bit_not(a).alias("not_"),
        u256.shift_left(a, F.col("k") % 300).alias("shl"), u256.shift_right(a, F.col("k") % 300).alias("shr"), u256.div_by(a, 10**18).alias("by"),
    ).collect()
    for row in found:
        x, y = rows[row.k]
        n = row.k % 300
        want = [x + y, x - y, x * y, x // y if y else 0, x % y if y else 0, x & y, x | y, x ^ y, m - 1 - x, x << n, x >> n, x // 10**18]
        assert [u256.unpack(v) for v in row[1:]] == [w % m for w in want], (x, y)


def test_text_comparison_and_sums(pairs):
    rows, df = pairs
    a, b = F.col("a"), F.col("b")
    for row in df.select("k", u256.to_text(a).alias("t"), u256.to_signed_text(a).alias("s"), (a < b).alias("lt"), u256.add_overflows(a, b).alias("o"), u256.fits_long(a).alias("f"), u256.is_zero(a).alias("z")).collect():
        x, y = rows[row.k]
        assert row[1:] == (str(x), str(u256.signed(u256.pack(x))), x < y, x + y >= u256.MODULUS, x < 2**64, x == 0)
    total = df.agg(u256.to_text(u256.sum_of(a)).alias("t")).first().t
    assert total == str(sum(x for x, _ in rows) % u256.MODULUS)


def test_long_round_trip(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 12345]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", u256.to_signed_text(u256.from_long(F.col("v"))).alias("t"))
    assert all(str(r.v) == r.t for r in df.collect())


def test_unsigned_parse(spark):
    assert u256.parse(" +1_000,000 ") == 1000000
    for bad in ("-1", "", "1.5", str(2**256), "x"):
        with pytest.raises(ValueError):
            u256.parse(bad)
    df = spark.createDataFrame([("12",), ("-1",), (None,)], "t string").select(u256.to_text(u256.from_text(F.col("t"))).alias("n"))
    assert [r.n for r in df.collect()] == ["12", None, None]


@given(st.integers(-(2**255), 2**255 - 1), st.integers(0, 76))
@settings(max_examples=200, deadline=None)
def test_decimal_text_round_trip(value, scale):
    assert dec256.parse(dec256.to_string(value, scale), scale) == value


def test_decimal_parse():
    one = 10**18
    assert dec256.parse("1,234.56") == dec256.parse("1.234,56") == dec256.parse("1_234.56") == 123456 * one // 100
    assert dec256.parse("1,234") == 1234 * one and dec256.parse("1,5") == 15 * one // 10 and dec256.parse("-2.25") == -225 * one // 100
    assert dec256.parse(".5") == one // 2 and dec256.to_string(0) == "0" and dec256.to_string(-one // 2) == "-0.5"
    for bad in ("", "-", "abc", "1." + "0" * 19, "9" * 78):
        with pytest.raises(ValueError):
            dec256.parse(bad)


def test_decimal_operations(spark):
    unit = 10**18
    rng = random.Random(3)
    values = [0, 1, -1, unit, -unit, 3 * unit // 2, -9 * unit // 4, dec256.HIGH, dec256.LOW] + [rng.randint(-(10**40), 10**40) for _ in range(60)]
    rows = [(x, y) for x in values for y in values[:20]]
    df = spark.createDataFrame([(k, u256.pack(x), u256.pack(y)) for k, (x, y) in enumerate(rows)], "k int, a binary, b binary")
    a, b = F.col("a"), F.col("b")
    found = df.select("k", dec256.add(a, b), dec256.sub(a, b), dec256.mul(a, b), dec256.div(a, b), dec256.mod(a, b), dec256.neg(a), (dec256.order_key(a) < dec256.order_key(b)), dec256.to_text(F.when(a != u256.literal(dec256.LOW), a))).collect()
    fit = lambda v: v if v is not None and dec256.LOW <= v <= dec256.HIGH else None
    for row in found:
        x, y = rows[row[0]]
        want = [x + y, x - y, dec256.truncated(x * y, unit), dec256.truncated(x * unit, y) if y else None, x - y * dec256.truncated(x, y) if y else None, -x]
        assert [None if v is None else u256.signed(v) for v in row[1:7]] == [fit(w) for w in want], (x, y)
        assert row[7] == (x < y) and row[8] == (None if x == dec256.LOW else dec256.to_string(x))


def test_lenient_hex(spark):
    cases = {"0xabc": "0abc", "0X00ff": "00ff", "zz": "", "12zz34": "12", "": "", None: "", "0x": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.lower(F.hex(hexes.lenient_bytes(F.col("t")))).alias("h"))
    assert {r.t: r.h for r in df.collect()} == cases


def test_topics(spark):
    df = spark.createDataFrame([("0x" + "00" * 12 + "ab" * 20,), ("0x" + "00" * 31 + "01",), ("0x" + "00" * 31 + "02",), (None,)], "t string")
    found = df.select(F.lower(F.hex(hexes.topic_address(F.col("t")))).alias("a"), hexes.topic_bool(F.col("t")).alias("b")).collect()
    assert found[0].a == "ab" * 20 and [r.b for r in found] == [False, True, False, False] and found[3].a == "00" * 20


def words(*values):
    return b"".join(v if isinstance(v, bytes) else u256.pack(v) for v in values)


def test_abi_decoding(spark):
    event = parse_event("E(address indexed who, bool flag, uint256[] many, string note, bytes32[2] pair, bytes raw)")
    assert event.head_words == 6
    many, note, raw = words(2, 7, 8), words(5) + b"hello".ljust(32, b"\0"), words(3) + b"abc".ljust(32, b"\0")
    head = 6 * 32
    good = words(1, head, head + 96, b"p" * 32, b"q" * 32, head + 160) + many + note + raw
    bad_flag = words(2) + good[32:]
    bad_offset = good[:32] + words(33) + good[64:]
    short = good[: 5 * 32]
    huge = good[:32] + words(2**200) + good[64:]
    rows = [("good", good), ("flag", bad_flag), ("offset", bad_offset), ("short", short), ("huge", huge), ("cut", good[:-32])]
    topic = "0x" + "00" * 12 + "cd" * 20
    df = spark.createDataFrame([(n, d, [event.topic, topic]) for n, d in rows], "n string, data binary, topics array<string>")
    shown = df.where(abi.fits(event, F.col("data"))).select("n", abi.decodes(event, F.col("topics"), F.col("data")).alias("ok"), *[c.alias(k) for k, c in abi.decoded(event, F.col("topics"), F.col("data")).items()])
    found = {r.n: r for r in shown.collect()}
    assert set(found) == {"good", "flag", "offset", "huge", "cut"}
    one = found["good"]
    assert one.ok and bytes(one.who) == b"\xcd" * 20 and one.flag is True and [u256.unpack(x) for x in one.many] == [7, 8]
    assert one.note == "hello" and [bytes(x) for x in one.pair] == [b"p" * 32, b"q" * 32] and bytes(one.raw) == b"abc"
    assert not found["flag"].ok and found["flag"].flag is False and found["flag"].note == "hello"
    assert not found["offset"].ok and found["offset"].many == [] and found["huge"].many == []
    assert not found["cut"].ok and bytes(found["cut"].raw) == b"" and found["cut"].note == "hello"


def test_nested_abi(spark):
    event = parse_event("E(string[] names, uint256[][] grid, (uint256 id, string note, address[2] both)[] parts, (bool ok, bytes4 tag) flat)")
    assert event.canonical == "E(string[],uint256[][],(uint256,string,address[2])[],(bool,bytes4))" and event.head_words == 5

    def text(value):
        return words(len(value)) + value.encode().ljust(-(-len(value) // 32) * 32, b"\0")

    def heads(*tails):
        out, at = [], 32 * len(tails)
        for tail in tails:
            out.append(at)
            at += len(tail)
        return words(*out) + b"".join(tails)

    names = words(2) + heads(text("one"), text(""))
    grid = words(3) + heads(words(1, 7), words(0), words(2, 2**200, 9))
    part = words(5, 4 * 32, b"\0" * 12 + b"a" * 20, b"\0" * 12 + b"b" * 20) + text("note")
    parts = words(1) + heads(part)
    start = 5 * 32
    data = words(start, start + len(names), start + len(names) + len(grid), 1, b"tag!".ljust(32, b"\0")) + names + grid + parts
    rows = [("good", data), ("cut", data[:-64]), ("flag", data[: 3 * 32] + words(2) + data[4 * 32 :])]
    df = spark.createDataFrame([(n, d, [event.topic]) for n, d in rows], "n string, data binary, topics array<string>")
    values = abi.decoded(event, F.col("topics"), F.col("data"))
    found = {r.n: r for r in df.select("n", abi.decodes(event, F.col("topics"), F.col("data")).alias("ok"), *[c.alias(k) for k, c in values.items()]).collect()}
    one = found["good"]
    assert one.ok and one.names == ["one", ""] and [[u256.unpack(x) for x in row] for row in one.grid] == [[7], [], [2**200, 9]]
    assert u256.unpack(one.parts[0].id) == 5 and one.parts[0].note == "note" and [bytes(x) for x in one.parts[0].both] == [b"a" * 20, b"b" * 20]
    assert one.flat.ok is True and bytes(one.flat.tag) == b"tag!"
    assert not found["cut"].ok and found["cut"].parts == [] and found["cut"].names == ["one", ""]
    assert not found["flag"].ok and found["flag"].flat.ok is False and bytes(found["flag"].flat.tag) == bytes(4)
    with pytest.raises(ValueError):
        parse_event("E((uint256 a, string b x)")
    abi_json = '[{"type":"event","name":"P","inputs":[{"name":"x","type":"tuple[]","components":[{"name":"a","type":"uint8"},{"name":"b","type":"string[]"}]}]}]'
    assert events_of_abi(abi_json) == ["P((uint8 a, string[] b)[] x)"] and parse_event(events_of_abi(abi_json)[0]).canonical == "P((uint8,string[])[])"


def test_array_bounds(spark):
    """Places and lengths at and beyond the ends of the data, and empty and broken arrays."""
    event = parse_event("E(bool[] flags, address[] who)")
    flags, who = words(2, 1, 0), words(1, 2**160 - 1)
    good = words(64, 64 + len(flags)) + flags + who
    cases = {
        "good": (good, [True, False], 1),
        "none": (words(64, 96) + words(0) + who, [], 1),
        "flag": (words(64, 160) + words(2, 1, 2) + who, None, 1),
        "odd": (words(65) + good[32:], None, 1),
        "far": (words(2**31 - 32) + good[32:], None, 1),
        "farther": (words(2**255) + good[32:], None, 1),
        "end": (words(len(good)) + good[32:], None, 1),
        "long": (words(64, 64 + len(flags)) + words(2**31 - 1, 1, 0) + who, None, 1),
        "past": (words(64, 64 + len(flags)) + words(9, 1, 0) + who, None, 1),
        "last": (good[:-32], [True, False], None),
    }
    df = spark.createDataFrame([(n, d, [event.topic]) for n, (d, _, _) in cases.items()], "n string, data binary, topics array<string>")
    values = abi.values_of(event, F.col("topics"), F.col("data"))
    found = {r.n: r for r in df.select("n", *[c.alias(k) for k, c in values.items()]).collect()}
    for name, (_, flags_, n) in cases.items():
        assert found[name].flags == flags_, name
        assert (None if found[name].who is None else [bytes(x) for x in found[name].who]) == (None if n is None else [b"\xff" * 20]), name


def test_topics_guard(spark):
    event = parse_event("Transfer(address indexed from, address indexed to, uint256 value)")
    df = spark.createDataFrame([(["t", "a", "b"], bytes(32)), (["t", "a"], bytes(32)), (["t", "a", "b", "c"], b"")], "topics array<string>, data binary")
    assert [r.f for r in df.select(abi.fits(event, F.col("data"), F.col("topics")).alias("f")).collect()] == [True, False, False]


def test_decimal_bytes_and_whole_calls(spark):
    df = spark.createDataFrame([(b"\xfe\xff", u256.pack(5), u256.pack(0)), (b"", u256.pack(7), u256.pack(2)), (None, None, u256.pack(1))], "raw binary, a binary, b binary")
    little, back = dec256.from_integer_bytes(F.col("raw"), little=True), dec256.to_integer_bytes(F.col("a"), little=True)
    found = df.select(little.alias("n"), back.alias("b")).collect()
    assert u256.signed(found[0].n) == -2 and found[1].n is None and found[2].n is None
    assert bytes(found[0].b) == u256.pack(5)[::-1] and found[2].b is None
    stand = lambda f: df.agg(dec256.all_stand(f(F.col("a"), F.col("b")), F.col("a"), F.col("b")).alias("ok")).first().ok
    assert stand(dec256.add) and not stand(dec256.div)
    money = spark.createDataFrame([("1.5",), ("-0.25",)], "t string").select(dec256.from_decimal(F.col("t").cast("decimal(30,10)")).alias("v"))
    assert [u256.signed(r.v) for r in money.collect()] == [15 * 10**17, -25 * 10**16]
