"""Sharding by a k-d tree over metadata, split at distributed weighted medians.

Each document is a point whose coordinates are metadata of its text (by default
the logarithm of its size, its bytes per character, and its checksum), weighted
by its size. A node is split along the dimension in which its points lie widest,
where the weight on either side is in proportion to the leaves that either side
will have; so ``shards`` leaves of near equal bytes come about, or as many as
the target bytes ask for.

The upper nodes hold more points than a task should: their weighted medians are
found without sorting or moving points. All nodes of a level take part in one
aggregation into bins, which is repeated within the bin that the median falls
into; the cuts of a level are a small table that the rows are joined to. What
comes to the driver is bounded by ``COLLECTED`` rows a job, and the upper nodes
by ``ROWS`` and ``SHARE``. Once a node's points fit a task they are brought
together, and all its levels below are running sums over windows within that
task: no more jobs, nothing on the driver, however many leaves there are.

Equal texts are the same point, and a cut between points keeps them together; a
point that weighs over ``heavy`` of a leaf (a twentieth by default), as a large
group of copies does, is parted by a hash of doc_id into points below that. The
larger ``heavy``, the more copies stay together, and the further a leaf may be
from the mean: by about half of it for each cut.

Only built-in functions; each shard's slots are numbered by parts of bounded
size, whose offsets are running counts.

Defined results: a null or empty text has size 16 and checksum 0; texts of any
length are measured whole; rows with equal doc_id and equal text always share a
shard; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import durable

OVERHEAD = 16
#: Bits of a coordinate, of the checksum behind it, and of the part of a heavy point.
COORDINATE, CHECK, WITHIN = 20, 22, 20
#: Shares of a leaf: how near a cut of an upper node has to be, and from what weight on a point is parted.
NEAR, HEAVY = 0.002, 0.05
#: Rows of a node that one task takes: the larger of a number and a share of all.
ROWS, SHARE = 1 << 16, 1 / 4096
#: Bins that are collected in one job, and those of a node at most.
COLLECTED, BINS = 1 << 18, 2048
#: Heavy points that are broadcast at most; more are joined by a shuffle.
BROADCAST = 200_000
#: Levels whose windows stand in one plan.
LEVELS = 6
#: Rows of a shard that are numbered together.
PART = 4096


def default_dimensions() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.log2(F.col("size")), F.octet_length(text) / F.greatest(F.char_length(text), F.lit(1)), F.col("text_crc32").cast("double")]


def points(docs: DataFrame, dimensions: list[Column]) -> DataFrame:
    """(doc_id, size, text_crc32, d0, d1, ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return measured.select("doc_id", "size", "text_crc32", *[F.coalesce(d.cast("double"), F.lit(0.0)).alias(f"d{k}") for k, d in enumerate(dimensions)])


@dataclass
class Node:
    """An upper node; ``first`` is the number of its first leaf."""

    first: int
    leaves: int
    dim: int = 0
    low: int = 0
    high: int = 1
    weight: int = 0
    rows: int = 0
    cut: int | None = None


def keyed(found: DataFrame, n: int, shards: int, bounds: dict, total: int, heavy: float) -> DataFrame:
    """Points with a sortable long for each dimension: coordinate, checksum, part of a heavy point."""
    edge = heavy * total / shards
    weights = found.groupBy("text_crc32", "size").agg(F.sum("size").alias("w")).where(F.col("w") > edge)
    parts = weights.select("text_crc32", "size", F.least(F.lit((1 << WITHIN) - 1), F.ceil(F.col("w") / F.lit(edge))).alias("parts"))
    # Together they weigh no more than all, so there are at most shards / heavy of them.
    few = F.broadcast(parts) if shards / heavy <= BROADCAST else parts
    rows = found.join(few, ["text_crc32", "size"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))
    most = (1 << COORDINATE) - 1
    keys = []
    for k in range(n):
        low, high = bounds[f"min{k}"] or 0.0, bounds[f"max{k}"] or 0.0
        share = (F.col(f"d{k}") - F.lit(low)) / F.lit((high - low) or 1.0)
        place = F.greatest(F.lit(0), F.least(F.lit(most), (share * most).cast("long")))
        point = F.shiftleft(place.cast("long"), CHECK).bitwiseOR(F.shiftright("text_crc32", 32 - CHECK))
        keys.append(F.shiftleft(point, WITHIN).bitwiseOR(part).alias(f"k{k}"))
    return rows.select("doc_id", "size", "text_crc32", *keys)


def node_table(like: DataFrame, **columns: list[int]) -> DataFrame:
    """A row a node: its place as ``node``, and a column of longs for each list; one constant each, however long."""
    one = lambda values: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>"), F.col("id").cast("int"))
    size = len(next(iter(columns.values())))
    return F.broadcast(like.sparkSession.range(size).select(F.col("id").alias("node"), *[one(v).alias(k) for k, v in columns.items()]))


def _key(dim: Column, n: int) -> Column:
    """The key of a row in a dimension that is given by row."""
    found = F.col("k0")
    for k in range(1, n):
        found = F.when(dim == k, F.col(f"k{k}")).otherwise(found)
    return found


def _widest(spans: list[Column]) -> Column:
    """The dimension of the largest span, the first of equal ones."""
    best = F.greatest(*spans) if len(spans) > 1 else spans[0]
    found = F.lit(len(spans) - 1)
    for k in range(len(spans) - 2, -1, -1):
        found = F.when(spans[k] == best, F.lit(k)).otherwise(found)
    return found


def measure(at: DataFrame, nodes: list[Node], n: int) -> None:
    """Sets weight, rows, the widest dimension and its bounds of each node; ``at`` has the node's place as ``node``."""
    spans = [f(f"k{k}").alias(f"{f.__name__}{k}") for k in range(n) for f in (F.min, F.max)]
    for row in at.groupBy("node").agg(F.sum("size").alias("w"), F.count("*").alias("n"), *spans).collect():
        node = nodes[row.node]
        node.weight, node.rows = row.w, row.n
        node.dim = max(range(n), key=lambda k: ((row[f"max{k}"] >> CHECK + WITHIN) - (row[f"min{k}"] >> CHECK + WITHIN), -k))
        node.low, node.high = row[f"min{node.dim}"], row[f"max{node.dim}"] + 1


def find_cuts(at: DataFrame, nodes: list[Node], open_: list[int], n: int, near: float) -> None:
    """Sets the cuts of the open nodes: all their searches are narrowed by one job at a time."""
    #: Of each search: [lower end, upper end, weight below the lower end, weight to be below the cut]
    searches = {i: [nodes[i].low, nodes[i].high, 0, nodes[i].weight * (nodes[i].leaves // 2) / nodes[i].leaves] for i in open_}
    while searches:
        bins = max(2, min(BINS, COLLECTED // len(searches)))
        widths = {i: -(-(s[1] - s[0]) // bins) for i, s in searches.items()}
        each = lambda f, none: [f(i) if i in searches else none for i in range(len(nodes))]
        bounds = node_table(at, dim=[x.dim for x in nodes], low=each(lambda i: searches[i][0], 1), high=each(lambda i: searches[i][1], 0), width=each(widths.get, 1))
        here = at.join(bounds, "node").select("node", "size", _key(F.col("dim"), n).alias("key"), "low", "high", "width")
        inside = here.where("key >= low AND key < high").groupBy("node", F.expr("(key - low) div width").alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        found: dict[int, list] = {}
        for row in inside.collect():
            found.setdefault(row.node, []).append((row.bin, row.w, row.n))
        for i in list(searches):
            begin, end, under, want = searches[i]
            leaf = nodes[i].weight / nodes[i].leaves
            for k, w, rows in sorted(found.get(i, [])):
                if under + w < want:
                    under += w
                    continue
                a, b = begin + k * widths[i], min(end, begin + (k + 1) * widths[i])
                if rows == 1 or b - a == 1 or w <= near * leaf:
                    nodes[i].cut = b if 2 * under + w <= 2 * want else a
                    del searches[i]
                else:
                    searches[i][:3] = a, b, under
                break
            else:
                nodes[i].cut = end
                del searches[i]


def upper_nodes(rows: DataFrame, shards: int, n: int, most: int, near: float) -> tuple[DataFrame, list[Node]]:
    """``rows`` with their node's place, and the nodes, none of which has more than ``most`` rows and several leaves."""
    at, nodes = rows.withColumn("node", F.lit(0).cast("long")), [Node(0, shards)]
    while True:
        measure(at, nodes, n)
        open_ = [i for i, x in enumerate(nodes) if x.leaves > 1 and x.rows > most]
        if not open_:
            return at, nodes
        find_cuts(at, nodes, open_, n, near)
        below: list[Node] = []
        left, cuts = [], []
        for node in nodes:
            left.append(len(below))
            if node.cut is None:
                below.append(Node(node.first, node.leaves))
                cuts.append((1 << 63) - 1)
            else:
                half = node.leaves // 2
                below += [Node(node.first, half), Node(node.first + half, node.leaves - half)]
                cuts.append(node.cut)
        known = at.join(node_table(at, dim=[x.dim for x in nodes], cut=cuts, left=left), "node")
        place = F.col("left") + (_key(F.col("dim"), n) >= F.col("cut")).cast("long")
        at, nodes = known.select(*rows.columns, place.alias("node")), below


def lower_levels(at: DataFrame, nodes: list[Node], n: int) -> DataFrame:
    """Rows with their shard: below an upper node every level is two windows within one task."""
    rows = at.join(node_table(at, first=[x.first for x in nodes], leaves=[x.leaves for x in nodes]), "node")
    levels = max((x.leaves - 1).bit_length() for x in nodes)
    if levels:
        rows = rows.repartition("node")
    for level in range(levels):
        if level and level % LEVELS == 0:
            rows = durable(rows).repartition("node")
        own = Window.partitionBy("node", "first")
        spans = [F.shiftright(F.max(f"k{k}").over(own), CHECK + WITHIN) - F.shiftright(F.min(f"k{k}").over(own), CHECK + WITHIN) for k in range(n)]
        seen = rows.select("*", F.sum("size").over(own).alias("total"), *[c.alias(f"span{k}") for k, c in enumerate(spans)])
        seen = seen.withColumn("key", _key(_widest([F.col(f"span{k}") for k in range(n)]), n))
        so_far = Window.partitionBy("node", "first").orderBy("key")
        upto, before = F.sum("size").over(so_far), F.coalesce(F.sum("size").over(so_far.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        half = F.floor(F.col("leaves") / 2)
        middle = seen.select(*rows.columns, (upto + before).alias("twice"), (2.0 * F.col("total") * half / F.col("leaves")).alias("want"), half.alias("half"))
        right = (F.col("leaves") > 1) & (F.col("twice") > F.col("want"))
        kept = [c for c in rows.columns if c not in ("first", "leaves")]
        rows = middle.select(
            *kept, F.when(right, F.col("first") + F.col("half")).otherwise(F.col("first")).alias("first"),
            F.when(F.col("leaves") <= 1, F.col("leaves")).when(right, F.col("leaves") - F.col("half")).otherwise(F.col("half")).alias("leaves"),
        )
    return rows.select("doc_id", "size", "text_crc32", F.col("first").cast("int").alias("shard"))


def slotted(rows: DataFrame, shards: int, count: int) -> DataFrame:
    """Adds slot: gapless from 0 in each shard."""
    parts = max(1, count // (shards * PART))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("own"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: list[Column] | None = None, heavy: float = HEAVY, near: float = NEAR) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs`` (doc_id, text).

    Give the number of shards, or the bytes that a leaf is to have.
    """
    dimensions = dimensions or default_dimensions()
    n, found = len(dimensions), points(docs, dimensions)
    bounds = found.agg(F.count("*").alias("count"), F.sum("size").alias("total"), *[f(f"d{k}").alias(f"{f.__name__}{k}") for k in range(n) for f in (F.min, F.max)]).first().asDict()
    count, total = bounds["count"], bounds["total"] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    rows = durable(keyed(found, n, shards, bounds, total, heavy))
    at, nodes = upper_nodes(rows, shards, n, max(ROWS, int(count * SHARE)), near)
    sharded = durable(lower_levels(at, nodes, n))
    out = slotted(sharded, shards, count)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
