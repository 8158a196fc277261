"""Near-duplicates by SimHash, their pairs found by pigeonring filtering.

A fingerprint of 64 bits is cut into four segments on a ring. If two
fingerprints differ in at most three bits, then from some segment on, the first
k segments of the chain differ in at most floor(3 k / 4) bits, for each k: 0, 1,
2, 3. So the chain of two segments is the join key: one side gives its 32 bits
as they are, the other with no or one bit of the second segment turned, and of
two fingerprints only the one with a 0 there turns it. Equal keys are brought
together by a shuffle and a sort, streamed through, pruned by the chain of
three, and only then checked by the full Hamming distance.

A key that more than ``RUN`` rows share is never paired: its fingerprints go on
to the chain of three (48 bits, at most two bits turned). There, those that give
a key as it is differ in one segment only, so a table of its 65,536 values takes
them all, and whoever comes with turned bits looks up the few values that the
budget leaves. Links are handed on as forests, never as all pairs.

Fingerprints that many documents share are one vertex. The components of the
vertices come from large-star/small-star steps. Where documents meet their
vertex again, the few fingerprints that very many share are broadcast.

As a stage, ``drop_near`` links documents that are near in any of several
independent fingerprints, keeps one row of each component, and moves no text but
those of components with several rows that stay.

Defined results: a null or empty text, or one of blanks only, has fingerprint
zero and is linked like any other; fewer words than a shingle has make one
shingle; texts of any length are read whole; repeated rows give repeated rows;
a null doc_id is never a component's id unless it is alone; further columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm import bloom
from loglattice.llm.common import durable, fresh_name, join_crowded, text_slices, worker_state
from loglattice.llm.components import connected_components

BITS, DISTANCE, SEGMENT = 64, 3, 16
SHINGLE, SEED = 3, 42
#: Rows of a key that are compared with one another at most; beyond, the chain grows.
RUN = 4096
PAIRS = 1 << 20


def table_fingerprints(text: str | None, shingle: int, seeds: list[int]) -> list[int]:
    """SimHashes over word shingles, repeats included, one for each seed: the bits set in over half the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * len(seeds)
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    digest = xxhash.xxh64_intdigest
    shingles = words if shingle == 1 else [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
    out = []
    for seed in seeds:
        hashes = np.array([digest(x, seed) for x in shingles], np.uint64)
        n, counts = len(hashes), np.zeros(BITS, np.int64)
        for a in range(0, n, 1 << 14):
            bits = np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, BITS)
            whole = len(bits) // 255 * 255
            if whole:
                counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            counts += bits[whole:].sum(axis=0, dtype=np.uint8)
        out.append(int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]))
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of the contract's seed."""
    return table_fingerprints(text, shingle, [SEED])[0]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row of (doc_id, text); fp is the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, None)
        for batch in batches:
            made = np.array([fingerprint(text, shingle) for _, texts in text_slices(batch.column(1)) for text in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, "doc_id long, fp long")


def budget(chain: int) -> int:
    """Bits that the first ``chain`` segments may differ in."""
    return chain * DISTANCE * SEGMENT // BITS


@lru_cache(maxsize=8)
def masks(chain: int) -> np.ndarray:
    """Bits of a chain, first segment lowest, that may be turned; none first."""
    found = [0]
    for k in range(1, chain):
        ring = [(m, m.bit_count()) for m in found]
        found = [m | sum(1 << (SEGMENT * k + b) for b in extra) for m, n in ring for more in range(budget(k + 1) - n + 1) for extra in combinations(range(SEGMENT), more)]
    return np.array(sorted(found, key=lambda m: (m.bit_count(), m)), np.uint64)


def rotated(fps: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Fingerprints with the segment ``start`` lowest."""
    by = np.asarray(start, np.uint64) * np.uint64(SEGMENT)
    return fps >> by | fps << ((np.uint64(BITS) - by) % np.uint64(BITS))


def chain_keys(fps: np.ndarray, starts: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, whether bits are turned, fingerprint) of every fingerprint and start.

    A turned bit set is given only by the fingerprint that has a 0 at its lowest bit.
    """
    low = rotated(fps, starts) & np.uint64((1 << SEGMENT * chain) - 1)
    turn = masks(chain)
    lowest = turn & (~turn + np.uint64(1))
    given = (low[:, None] & lowest) == 0
    row, which = np.nonzero(given)
    return (low[row] ^ turn[which] | starts[row] << np.uint64(SEGMENT * chain)).view(np.int64), which > 0, fps[row]


KEYS = "key long, turned boolean, fp long"
LINKS = "a long, b long, start int"


def _key_batch(fps: np.ndarray, starts: np.ndarray, chain: int) -> Iterator[pa.RecordBatch]:
    step = max(1, (1 << 18) // len(masks(chain)))
    for at in range(0, len(fps), step):
        key, turned, own = chain_keys(fps[at : at + step], starts[at : at + step], chain)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(turned), pa.array(own.view(np.int64))], ["key", "turned", "fp"])


def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        yield from _key_batch(np.repeat(fps, 4), np.tile(np.arange(4, dtype=np.uint64), len(fps)), 2)


def longer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _key_batch(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint64), 3)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``a`` and ``b`` join: each node but the roots, and its root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def close_pairs(fps: np.ndarray, turned: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within runs; each row knows the bounds and the start of its run.

    Each unturned row meets every other row of its run: the chain of three
    segments first, then the whole distance.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(~turned)
    size = (end - begin)[rows]
    ends = np.cumsum(size)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own, n = rows[at:to], size[at:to]
        x = np.repeat(own, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
        differ = fps[x] ^ fps[y]
        chain = rotated(differ, start[x]) & np.uint64((1 << 3 * SEGMENT) - 1)
        fit = np.flatnonzero((np.bitwise_count(chain) <= budget(3)) & (x != y))
        fit = fit[np.bitwise_count(differ[fit]) <= DISTANCE]
        if len(fit):
            out.append(forest(fps[x[fit]], fps[y[fit]]))
        at = to
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))


def _links(a: np.ndarray, b: np.ndarray, start: int | np.ndarray = -1) -> pa.RecordBatch:
    start = np.full(len(a), start) if np.isscalar(start) else start
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(start.astype(np.int32))], ["a", "b", "start"])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)


def link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to links (start -1); rows of a key with over RUN rows to (fp, fp, start)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    crowded = None

    def work(parts: list) -> Iterator[pa.RecordBatch]:
        key, turned, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[begins[1:], len(key)]
        run = np.repeat(np.arange(len(begins)), ends - begins)
        plain = np.bincount(run, ~turned) > 0
        many = ends - begins > RUN
        if (far := np.flatnonzero(many[run])).size:
            yield _links(fps[far], fps[far], key[far] >> (2 * SEGMENT))
        use = np.flatnonzero(((ends - begins > 1) & plain & ~many)[run])
        if use.size:
            run = run[use]
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            n = np.diff(np.r_[first, len(run)])
            a, b = close_pairs(fps[use], turned[use], np.repeat(first, n), np.repeat(first + n, n), (key[use] >> (2 * SEGMENT)).astype(np.uint64))
            if len(a):
                yield _links(a, b)

    for batch in batches:
        key, turned, fps = _columns(batch)
        if not len(key):
            continue
        if crowded is not None:  # the rest of a key that is known to be crowded
            n = int(np.searchsorted(key, crowded, "right"))
            if n:
                yield _links(fps[:n], fps[:n], crowded >> (2 * SEGMENT))
            if n == len(key):
                continue
            crowded, key, turned, fps = None, key[n:], turned[n:], fps[n:]
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1][0][-1] != key[-1]):
            yield from work([*held, (key[:last], turned[:last], fps[:last])])
            held = []
        held.append((key[last:], turned[last:], fps[last:]))
        if sum(len(x[0]) for x in held) > RUN:
            crowded = key[-1]
            for _, _, own in held:
                yield _links(own, own, crowded >> (2 * SEGMENT))
            held = []
    if held:
        yield from work(held)


@lru_cache(maxsize=1)
def near_values() -> list[np.ndarray]:
    """By the bits left: what a segment may be turned by."""
    every = np.arange(1 << SEGMENT, dtype=np.uint64)
    return [every[np.bitwise_count(every) <= n] for n in range(DISTANCE + 1)]


def link_long_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three-segment keys, unturned ones first in each key, to links.

    The unturned rows of a key differ in their last segment only: a table of its
    values holds them. All rows of the key then look up what is left of the
    budget.
    """
    now, there, values = None, None, []
    for batch in batches:
        key, turned, fps = _columns(batch)
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for begin, end in zip(begins, [*begins[1:], len(key)], strict=True):
            if key[begin] != now:
                now, there, values = key[begin], np.zeros(1 << SEGMENT, bool), 0
            start = int(now) >> (3 * SEGMENT)
            own, plain = fps[begin:end], ~turned[begin:end]
            turn = rotated(own, start)
            top = turn >> np.uint64(3 * SEGMENT)
            there[top[plain]] = True
            values += int(plain.sum())
            if not values:
                continue
            low = np.uint64(now & ((1 << 3 * SEGMENT) - 1))
            used = np.bitwise_count(turn & np.uint64((1 << 3 * SEGMENT) - 1) ^ low)
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for n in range(budget(3) + 1):
                mine = np.flatnonzero(used == n)
                near = near_values()[DISTANCE - n]
                for at in range(0, len(mine), max(1, PAIRS // len(near))):
                    rows = mine[at : at + max(1, PAIRS // len(near))]
                    want = top[rows][:, None] ^ near
                    row, which = np.nonzero(there[want])
                    other = rotated(want[row, which] << np.uint64(3 * SEGMENT) | low, (4 - start) % 4)
                    apart = other != own[rows[row]]
                    if apart.any():
                        ends.append(forest(own[rows[row]][apart], other[apart]))
            if ends:
                yield _links(*forest(np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends])))


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all within the distance."""
    keys = fps.select("fp").mapInArrow(first_keys, KEYS)
    met = durable(keys.repartition("key").sortWithinPartitions("key", "turned").mapInArrow(link_runs, LINKS))
    links = met.where("start < 0").select("a", "b")
    crowded = met.where("start >= 0").select(F.col("a").alias("fp"), "start").distinct()
    if met.where("start >= 0").isEmpty():
        return links
    longer = crowded.mapInArrow(longer_keys, KEYS).distinct().repartition("key").sortWithinPartitions("key", "turned")
    return links.unionByName(longer.mapInArrow(link_long_runs, LINKS).select("a", "b"))


def _components(members: DataFrame) -> tuple[DataFrame, int]:
    """(fp, component, n, least) of each fingerprint: its component's root, its rows, their least doc_id; and all rows."""
    vertices = durable(members.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = durable(connected_components(near_links(vertices.select("fp"))))
    known = vertices.join(parts.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return known.select("fp", F.coalesce("root", "fp").alias("component"), "n", "least"), members.count()


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id."""
    members = durable(fingerprints(docs, shingle))
    found, total = _components(members)
    ids = found.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    by_print = join_crowded(found, ids, "component", "prints", total).select("fp", "component_id", "n")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_crowded(members, by_print, "fp", "n", total).select("doc_id", text, "component_id")


#: Words of a shingle, and independent fingerprints, of the stage.
STAGE_SHINGLE, TABLES = 2, 1


def with_fingerprints(docs: DataFrame, names: list[str], shingle: int) -> DataFrame:
    """``docs`` with fingerprints of its text, each of a seed of its own, as signed longs."""
    seeds = [SEED + 1000 * k for k in range(len(names))]
    fields = [f"f{k}" for k in range(len(names))]

    def of(texts: pa.Array) -> pa.Array:
        worker_state(None, None)
        found = [table_fingerprints(text, shingle, seeds) for _, part in text_slices(texts) for text in part]
        prints = np.array(found, np.uint64).reshape(-1, len(seeds)).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(prints[:, k])) for k in range(len(seeds))], fields)

    made = F.arrow_udf(of, "struct<" + ", ".join(f"{f}: bigint" for f in fields) + ">")("text")
    whole = fresh_name("prints", docs)
    return docs.withColumn(whole, made).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{whole}.{f}").alias(n) for f, n in zip(fields, names, strict=True)])


def _table_edges(signatures: DataFrame, table: int) -> DataFrame:
    """(a, b): signatures (signature, fp) and the fingerprints of one table that join any two of them."""
    counts = durable(signatures.groupBy("fp").agg(F.count("*").alias("n")))
    links = durable(near_links(counts.select("fp")))
    ends = links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).distinct()
    joining = counts.where("n > 1").unionByName(counts.where("n = 1").join(ends, "fp", "left_semi"))
    node = lambda c: F.xxhash64(F.lit(table), F.col(c))
    own = join_crowded(signatures, joining, "fp", "n", signatures.count())
    return own.select(F.col("signature").alias("a"), node("fp").alias("b")).unionByName(links.select(node("a").alias("a"), node("b").alias("b")))


def drop_near(docs: DataFrame, shingle: int = STAGE_SHINGLE, tables: int = TABLES) -> DataFrame:
    """The rows of ``docs``, columns as they are, one of each component of near-duplicates.

    Documents are linked if in any of ``tables`` independent fingerprints they
    differ in at most three bits. More tables find more of the pairs that differ
    in some words, at the cost of each in time and disk. Of a component the row with the least doc_id
    stays, null above all others; of several rows with that one, the one with
    the least fingerprints' hash, and of rows equal in both any one.
    """
    own, signature, names = fresh_name("own_id", docs), fresh_name("signature", docs), []
    for k in range(tables):
        names.append(fresh_name(f"fp{k}", docs))
    made = with_fingerprints(docs, names, shingle)
    rows = durable(made.withColumn(own, F.col("doc_id").cast("long")).withColumn(signature, F.xxhash64(*names)))
    vertices = rows.groupBy(F.col(signature).alias("signature"), *[F.col(n).alias(f"f{k}") for k, n in enumerate(names)])
    vertices = durable(vertices.agg(F.min(own).alias("least"), F.count("*").alias("n")))
    edges = None
    for k in range(tables):
        some = _table_edges(vertices.select("signature", F.col(f"f{k}").alias("fp")), k)
        edges = some if edges is None else edges.unionByName(some)
    parts = connected_components(edges).select(F.col("node").alias("signature"), F.col("root").alias("component"))
    found = durable(vertices.join(parts, "signature", "left").select("signature", F.coalesce("component", "signature").alias("component"), "n", "least"))
    place = F.struct(F.col("least").isNull().alias("none"), "least", "signature")
    best = found.groupBy("component").agg(F.min(place).alias("best"), F.sum("n").alias("n"), F.count("*").alias("members"))
    winners = best.select("component", F.col("best.signature").alias("won"), F.col("best.least").alias(own), "n", "members")
    # Every signature of a component with several rows stands for the component; only the winner's is chosen.
    several = join_crowded(found.select("component", "signature"), winners.where("n > 1").select("component", "members"), "component", "members", found.count())
    several = durable(several.select(F.col("signature").alias(signature)))
    chosen = winners.select(F.col("won").alias(signature), own)
    kept = bloom.keep_chosen(rows, signature, own, chosen, several, several.count())
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
