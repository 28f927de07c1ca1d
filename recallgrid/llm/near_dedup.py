"""SimHash near-duplicates: fingerprints within a Hamming distance, by vantage-point trees.

``fingerprints`` scans whole texts once.  Copies then collapse to distinct
fingerprints.  A routing tree of vantage points, fitted on a bounded sample of
them, deals every fingerprint to its home shard by Hamming distance, and also
to each later shard whose distance bounds its ball touches (triangle
inequality), so every close pair meets in exactly one shard.  Shards are split
into blocks of bounded size; a task holds one block as a local vantage-point
tree and streams the visitors past it.  A block returns a spanning forest of
its links, never its pairs, so rows stay linear in large groups.  Components
come from alternating star contraction over written tables.

Null and empty texts have fingerprint zero and link like any other; repeated
rows get a row each; a null doc_id never names a component unless all its
documents have none; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.tables import stage
from recallgrid.llm.worker import id_type, texts_of

SEED = 42
SAMPLE = 16_384  # fingerprints that the routing tree is fitted on
SHARD = 131_072  # distinct fingerprints aimed at in a shard, and held in a block
MAX_SHARDS = 4_096
LEAF = 64


# Fingerprints


def simhash(text: str, width: int) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(octets), 65_536):  # counts a slice at a time
        set_bits += np.unpackbits(octets[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit number."""
    own = id_type(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([simhash(t, width) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.record_batch([batch["doc_id"], pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return texts_of(df, id_col, text_col).mapInArrow(run, f"doc_id {own}, fp long")


def apart(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


# Vantage-point trees


class Node:
    """A vantage point; inner has distances of at most ``cut``, outer the rest."""

    __slots__ = ("point", "cut", "inner", "outer", "leaf", "rows")

    def __init__(self):
        self.point = self.cut = self.inner = self.outer = self.leaf = self.rows = None


def split(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point of three candidates and the cut that divides best."""
    best = None
    for point in points[[0, len(points) // 2, len(points) - 1]]:
        distance = apart(points, point)
        counts = np.cumsum(np.bincount(distance, minlength=65))
        cut = int(np.argmin(np.abs(counts - len(points) / 2)))
        inner = counts[cut]
        if 0 < inner < len(points):
            band = counts[min(cut + 4, 64)] - (counts[cut - 4] if cut >= 4 else 0)
            if best is None or band < best[0]:
                best = band, point, cut, distance
    return best and best[1:]


def grow(points: np.ndarray, rows: np.ndarray, size: int) -> Node:
    node = Node()
    divided = split(points) if len(points) > size else None
    if divided is None:
        node.rows, node.point = rows, points
        return node
    node.point, node.cut, distance = divided
    near = distance <= node.cut
    node.inner = grow(points[near], rows[near], size)
    node.outer = grow(points[~near], rows[~near], size)
    return node


def number_leaves(node: Node, first: int = 0) -> int:
    if node.rows is not None:
        node.leaf, node.rows, node.point = first, np.zeros(0, np.int64), None
        return first + 1
    return number_leaves(node.outer, number_leaves(node.inner, first))


def descend(node: Node, points: np.ndarray, rows: np.ndarray, radius: int, visit) -> None:
    """Call ``visit(leaf node, rows)`` for all points whose balls reach a leaf."""
    if not len(rows):
        return
    if node.rows is not None:
        visit(node, rows)
        return
    distance = apart(points[rows], node.point).astype(np.int16)
    descend(node.inner, points, rows[distance - radius <= node.cut], radius, visit)
    descend(node.outer, points, rows[distance + radius > node.cut], radius, visit)


def routing_tree(sample: list[int], total: int) -> Node:
    points = np.unique(np.array(sample, np.int64).view(np.uint64))
    np.random.default_rng(0).shuffle(points)
    shards = min(MAX_SHARDS, max(1, -(-total // SHARD)))
    root = grow(points, np.arange(len(points)), max(1, len(points) // shards))
    number_leaves(root)
    return root


# Links


class Forest:
    """Union-find over the rows of a block, joined many at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if (above == self.parent).all():
                return above
            self.parent = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join row by row; pairs that are together already cost no loop."""
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            differ = a != b
            a, b = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
            np.minimum.at(self.parent, a, b)  # each root hangs under the least of its partners


class Block:
    """The home fingerprints of one block, and the links found among and to them."""

    def __init__(self, points: np.ndarray, radius: int):
        self.points, self.radius = points, radius
        self.tree = grow(points, np.arange(len(points)), LEAF)
        self.forest = Forest(len(points))
        self.compare(points, np.arange(len(points)))

    def compare(self, visitors: np.ndarray, first: np.ndarray) -> None:
        """Join all home points close to the same visitor; ``first`` gets one of them (-1: none)."""

        def visit(leaf: Node, rows: np.ndarray) -> None:
            for at in range(0, len(rows), 16_384):
                part = rows[at : at + 16_384]
                who, whom = np.nonzero(apart(visitors[part][:, None], leaf.point[None, :]) <= self.radius)
                who, whom = part[who], leaf.rows[whom]
                new = first[who] < 0
                first[who[new]] = whom[new]
                self.forest.join(first[who], whom)

        descend(self.tree, visitors, np.arange(len(visitors)), self.radius, visit)

    def links_of(self, visitors: np.ndarray) -> np.ndarray:
        first = np.full(len(visitors), -1)
        self.compare(visitors, first)
        linked = first >= 0
        return np.stack([visitors[linked], self.points[first[linked]]])

    def links(self) -> np.ndarray:
        roots = self.forest.roots()
        return np.stack([self.points, self.points[roots]])[:, roots != np.arange(len(roots))]


def as_edges(pairs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate([np.zeros((2, 0), np.uint64), *pairs], axis=1).view(np.int64)
    return pa.record_batch([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def close_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints ``fp`` at most ``radius`` bits apart."""
    total = distinct.count()
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    root = routing_tree(sample, total)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            home = np.zeros(len(points), np.int64)
            descend(root, points, np.arange(len(points)), 0, lambda leaf, rows: home.__setitem__(rows, leaf.leaf))
            shards, fps, visits = [home], [points], [np.zeros(len(points), bool)]

            def visit(leaf: Node, rows: np.ndarray) -> None:
                rows = rows[home[rows] < leaf.leaf]  # the pair meets in the later of both homes
                shards.append(np.full(len(rows), leaf.leaf))
                fps.append(points[rows])
                visits.append(np.ones(len(rows), bool))

            descend(root, points, np.arange(len(points)), radius, visit)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate(shards)),
                    pa.array(np.concatenate(fps).view(np.int64)),
                    pa.array(np.concatenate(visits)),
                ],
                ["shard", "fp", "visit"],
            )

    routed = stage(distinct.select("fp").mapInArrow(route, "shard long, fp long, visit boolean"), "routed")
    # Shards that came out larger than a block: at most MAX_SHARDS rows reach the driver.
    sizes = {r["shard"]: r["n"] for r in routed.filter(~F.col("visit")).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    blocks = {s: -(-n // SHARD) for s, n in sizes.items()}
    known = distinct.sparkSession.createDataFrame(list(blocks.items()) or [(0, 1)], "shard long, blocks long")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # A visitor meets all blocks; a home point is held by its own and visits the later ones.
    first = F.when(F.col("visit"), F.lit(0)).otherwise(own)
    cells = (
        routed.join(F.broadcast(known), "shard")
        .withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1)))
        .withColumn("visit", F.col("visit") | (F.col("block") != own))
        .select("shard", "block", "visit", "fp")
    )
    tasks = max(1, sum(blocks.values()))
    dealt = cells.repartition(min(tasks, 4096), "shard", "block").sortWithinPartitions("shard", "block", "visit")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        edges: list = []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "block", "visit")]).astype(np.int64)
            points = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for part in np.split(np.arange(len(points)), cuts):
                own = tuple(keys[:2, part[0]].tolist())
                if own != cell:
                    if block is None and held:
                        block = Block(np.concatenate(held), radius)
                    if block is not None:
                        edges.append(block.links())
                    cell, held, block = own, [], None
                if not keys[2, part[0]]:
                    held.append(points[part])
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(np.concatenate(held), radius)
                edges.append(block.links_of(points[part]))
            yield as_edges(edges)
            edges = []
        if block is None and held:
            block = Block(np.concatenate(held), radius)
        if block is not None:
            edges.append(block.links())
        yield as_edges(edges)

    return dealt.mapInArrow(link, "a long, b long")


# Components


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, the root being the smallest node reached.

    Alternates large-star and small-star steps on a written table until the
    links no longer change; only their number and a checksum reach the driver.
    """

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.bit_xor(F.xxhash64("a", "b"))).first())

    def lowest(directed: DataFrame) -> DataFrame:
        return directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = both.join(lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u <> v").distinct(), "large")
        low = lowest(large)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = stage(small.filter("a <> b").distinct(), "small")
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(
    df: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fp, fingerprint (hex) and component_id, the smallest doc_id reached."""
    marked = stage(fingerprints(df, width, id_col, text_col), "fingerprints")
    return assigned(marked, radius)


def assigned(marked: DataFrame, radius: int) -> DataFrame:
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(close_links(distinct, radius))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = linked.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(
    df: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``df`` for every component, that of its component_id, with its columns.

    Where an id has several rows, or a component has no id at all, the row with
    the least fingerprint and text is the one that stays.
    """
    spark = df.sparkSession
    marked = stage(fingerprints(df, width, id_col, text_col), "fingerprints")
    found = stage(assigned(marked, radius).select("doc_id", "fp", "component_id"), "components")
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # An id is single if the whole table has it once; a head of one group may stand on rows of others, too.
    heads = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("head")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), heads).filter("head")
    single = ids.filter("n = 1 and doc_id is not null").select(F.col("doc_id").alias("_kept_id"))
    repeated_n = ids.filter("n > 1 or doc_id is null").count()
    main = df.join(single, F.col(id_col) == F.col("_kept_id"), "left_semi")
    if not repeated_n:
        return main
    # The few rows of repeated or missing ids: told apart by what they hold.
    several = ids.filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_kept_id"))
    rows = df.join(several, F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi").withColumn("_at", F.struct(*df.columns))
    rows = stage(rows.select(F.to_json("_at").alias("_json"), "_at", F.monotonically_increasing_id().alias("_row")), "several")
    prints = fingerprints(rows.select("_row", F.col(f"_at.{text_col}").alias("text")), width, "_row", "text")
    named = prints.withColumnRenamed("doc_id", "_row").join(rows, "_row").withColumn("_own", F.col(f"_at.{id_col}"))
    roots = chosen.select(F.col("doc_id").alias("_own2"), "fp").distinct()
    met = named.join(roots, (named["_own"].eqNullSafe(roots["_own2"])) & (named["fp"] == roots["fp"])).drop(roots["fp"])
    linked = components_of(found, radius)
    met = met.join(linked, "fp")
    least = met.groupBy("root").agg(F.min(F.struct("fp", "_json", "_row")).alias("_least"))
    keep = least.select(F.col("_least._row").alias("_row"))
    return main.unionByName(rows.join(keep, "_row", "left_semi").select("_at.*"))


def components_of(found: DataFrame, radius: int) -> DataFrame:
    """(fp, root) where a component may have no id: fingerprints by their own links."""
    distinct = stage(found.select("fp").distinct(), "distinct")
    roots = components(close_links(distinct, radius))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
