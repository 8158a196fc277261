"""Exact and near deduplication against brute force."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loglattice.llm import exact_dedup, simhash
from loglattice.llm.components import connected_components
from tests.llm.conftest import TEXTS


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 1000)), max_size=300))
@settings(max_examples=50, deadline=None)
def test_merge_index(rows):
    index = exact_dedup.LsmIndex(memtable=5)
    want: dict[bytes, list[int]] = defaultdict(list)
    for key, doc_id in rows:
        digest = exact_dedup.sha256(str(key).encode())
        index.put(digest, doc_id)
        want[digest].append(doc_id)
    run = index.finish()
    found = {} if run is None else {k[:-1]: (int(i), int(n)) for k, i, n in zip(run.digests.tolist(), run.ids, run.counts, strict=True)}
    assert found == {k: (max(v), len(v)) for k, v in want.items()}
    if run is not None:
        assert (run.find(run.digests) == np.arange(len(run.digests))).all() and run.find(np.array([b"x" * 32 + b"\1"]))[0] == -1


def exact_brute(rows, largest=True):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[text or ""].append(doc_id)
    pick = max if largest else min
    return {(doc_id, pick([x for x in groups[text or ""] if x is not None], default=None), len(groups[text or ""])) for doc_id, text, _ in rows}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda raw: bytes([len(raw) % 3])])
@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups(odd_docs, no_docs, digest, largest):
    """With a true digest, and with one that collides everywhere: the bytes decide."""
    found = exact_dedup.exact_groups(odd_docs, largest, digest).collect()
    assert len(found) == len(TEXTS)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == exact_brute(TEXTS, largest)
    assert sum(r.kept for r in found) == len({t or "" for _, t, _ in TEXTS})
    assert exact_dedup.exact_groups(no_docs).count() == 0


#: Rows that share a doc_id but not the text, repeated rows, nulls, and columns named as those that the stages use.
SHARED_IDS = [(9, "A"), (7, "A"), (7, "B"), (7, "B"), (3, None), (2, ""), (None, "A"), (None, "lone"), (None, "lone"), (5, "B" * 70_000)]


@pytest.fixture(scope="module")
def shared_ids(spark):
    rows = [(i, t, 10 * k, "d", k, "g") for k, (i, t) in enumerate(SHARED_IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, _copy long, digest string, own_id long, _group string").repartition(3).persist()


@pytest.mark.parametrize("largest", [True, False])
def test_drop_copies_decides_by_row(shared_ids, odd_docs, no_docs, largest):
    out = exact_dedup.drop_copies(shared_ids, largest)
    assert out.schema == shared_ids.schema
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()), key=str)
    ids = (9, 7, 3) if largest else (7, 7, 2)
    assert kept == sorted([(False, ids[0], "A"), (False, ids[1], "B"), (False, ids[2], None if largest else ""), (True, 0, "lone"), (False, 5, "B" * 70_000)], key=str)
    assert all(r._copy == 10 * r.own_id and r._group == "g" and r.digest == "d" for r in out.collect())
    found = exact_dedup.drop_copies(odd_docs)
    assert found.schema == odd_docs.schema and exact_dedup.drop_copies(no_docs).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found.collect()) == sorted((i is None, i or 0) for i in [2, 4, 5, 6, 7, 8, 9, None, -5, 2**62])


def test_crowded_keys_and_full_filters(spark, monkeypatch):
    """The same rows where every key is crowded, and where the filters let everything through."""
    from loglattice.llm import bloom, common

    rows = [(k, "same") for k in range(300)] + [(1000 + k, f"pair {k % 40}") for k in range(80)] + [(2000 + k, f"only {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).persist()
    want = {(299, "same"), *((1040 + k, f"pair {k}") for k in range(40)), *((2000 + k, f"only {k}") for k in range(50))}
    for crowd, bits in ((10_000, 1 << 28), (5, 1 << 28), (5, 8)):
        monkeypatch.setattr(common, "CROWD", crowd)
        monkeypatch.setattr(common, "CROWD_SHARE", 0.0)
        monkeypatch.setattr(bloom, "MOST_BITS", bits)
        assert {tuple(r) for r in exact_dedup.drop_copies(docs).collect()} == want
        assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()} == exact_brute([(*r, None) for r in rows])
        found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
        assert found == near_brute([(*r, None) for r in rows])
        near = [r.doc_id for r in simhash.drop_near(docs).collect()]
        assert sorted(near) == sorted(near_ids([(*r, None) for r in rows]))


def test_drop_near_decides_by_row(spark, shared_ids, odd_docs, no_docs, docs):
    out = simhash.drop_near(shared_ids)
    assert out.schema == shared_ids.schema and all(r._copy == 10 * r.own_id for r in out.collect())
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()), key=str)
    assert kept == sorted([(False, 7, "A"), (False, 7, "B"), (False, 2, ""), (True, 0, "lone"), (False, 5, "B" * 70_000)], key=str)
    assert simhash.drop_near(no_docs).count() == 0 and simhash.drop_near(odd_docs).schema == odd_docs.schema
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    assert {r.doc_id for r in simhash.drop_near(docs).collect()} == near_ids(rows)
    assert {r.doc_id for r in simhash.drop_near(docs, 3, 1).collect()} == {root for _, root in near_brute(rows).values()}


def test_more_tables_find_more_near_copies(spark):
    """Texts with two of a hundred words changed."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(60):
        own = rng.choice(words, 100).tolist()
        other = list(own)
        for at in rng.choice(100, 2, replace=False):
            other[at] = "changed"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {t: simhash.drop_near(df, 2, t).count() for t in (1, 4)}
    assert 60 <= left[4] < left[1] <= 120 and 120 - left[4] >= 30


def slow_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(spark, odd_docs):
    found = {(r.doc_id): r.fp % 2**64 for r in simhash.fingerprints(odd_docs).collect()}
    assert found == {i: slow_fingerprint(t) for i, t, _ in TEXTS}
    import pyspark.sql.functions as F

    spark_hash = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s").alias("h")).first().h
    assert spark_hash % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def crowd(seed, centres, each):
    rng = np.random.default_rng(seed)
    found = set()
    for _ in range(centres):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2))
        for _ in range(each):
            for bit in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
                x ^= 1 << bit
            found.add(x)
    return np.array(sorted(found), np.uint64)


def components_of(nodes, a, b):
    hung, roots = simhash.forest(np.asarray(a, np.uint64), np.asarray(b, np.uint64))
    up = dict(zip(hung.tolist(), roots.tolist(), strict=True))
    return {n: up.get(n, n) for n in nodes.tolist()}


@pytest.mark.parametrize("run", [4096, 8, 2])
@pytest.mark.parametrize("seed,centres,each", [(1, 60, 12), (2, 3, 300), (3, 1500, 1)])
def test_links_lose_no_pair(monkeypatch, run, seed, centres, each):
    """All pairs within the distance are connected, however crowded a key is; none further is linked."""
    monkeypatch.setattr(simhash, "RUN", run)
    fps = crowd(seed, centres, each)
    differ = np.bitwise_count(fps[:, None] ^ fps[None])
    x, y = np.nonzero((differ <= 3) & (differ > 0))
    keys = pa.Table.from_batches(list(simhash.first_keys([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])])))
    keys = keys.sort_by([("key", "ascending"), ("turned", "ascending")])
    links = pa.Table.from_batches(list(simhash.link_runs(iter(keys.to_batches(max_chunksize=57)))) or [simhash._links(fps[:0], fps[:0])])
    a, b, start = (links.column(k).to_numpy() for k in range(3))
    far = sorted(set(zip(a[start >= 0].tolist(), start[start >= 0].tolist(), strict=True)))
    a, b = a[start < 0], b[start < 0]
    if far:
        longer = simhash.longer_keys([pa.RecordBatch.from_arrays([pa.array([f for f, _ in far]), pa.array([s for _, s in far], pa.int32())], ["fp", "start"])])
        longer = pa.Table.from_batches(list(longer)).sort_by([("key", "ascending"), ("turned", "ascending")])
        for more in simhash.link_long_runs(iter(longer.to_batches(max_chunksize=57))):
            a, b = np.r_[a, more.column(0).to_numpy()], np.r_[b, more.column(1).to_numpy()]
    assert components_of(fps, a.view(np.uint64), b.view(np.uint64)) == components_of(fps, fps[x], fps[y])


def test_mask_counts():
    assert [len(simhash.masks(k)) for k in (1, 2, 3)] == [1, 17, 409] and [simhash.budget(k) for k in (1, 2, 3, 4)] == [0, 1, 2, 3]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(-5, -5)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    assert found == {n: root(n) for e in edges for n in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_ids(rows, shingle=simhash.STAGE_SHINGLE, tables=simhash.TABLES):
    """The doc_ids that the stage keeps of rows with distinct ones: the least of each component over all tables."""
    seeds = [simhash.SEED + 1000 * k for k in range(tables)]
    prints = np.array([simhash.table_fingerprints(t, shingle, seeds) for _, t, _ in rows], np.uint64)
    ids = [i for i, _, _ in rows]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero((np.bitwise_count(prints ^ prints[k]) <= 3).any(axis=1)).tolist():
            a, b = root(i), root(ids[j])
            up[max(a, b)] = min(a, b)
    return {root(i) for i in ids}


def near_brute(rows):
    prints = {i: slow_fingerprint(t) for i, t, _ in rows}
    ids = [i for i in prints if i is not None]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def test_near_groups(odd_docs, no_docs, docs):
    found = simhash.near_groups(odd_docs).collect()
    assert len(found) == len(TEXTS)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found if r.doc_id is not None} == near_brute(TEXTS)
    assert simhash.near_groups(no_docs).count() == 0
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()} == near_brute(rows)
