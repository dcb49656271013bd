"""SimHash fingerprints and exact near-duplicate links by vantage-point trees.

The search is a self-join at Hamming distance ``radius`` over distinct fingerprints. A tree of
vantage points, built from a bounded sample, cuts the space into shards: at each node a
fingerprint is inside if it lies within the node's distance of its point. By the triangle
inequality a pair can lie across a cut only if both are within ``radius`` of it, so the inner
fingerprints near a cut also go to the other side, whose shards their boundary overlaps. A
node is cut only while its shard would be too large, where the cut lies and round which point
is chosen by the comparisons that both sides, overlap included, will cost. In each shard a
vantage-point tree is built and searched by all members at once. A shard returns links to one
representative per local group (a forest), never its pairs, so large groups of near copies stay
linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import bounded_sample, join_groups, slices, texts_of, whole_text, with_fields, without
from tidewell.operators.components import connected_components
from tidewell.session import materialize

#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Fingerprints link at this many differing bits or fewer.
RADIUS = 3
#: Distinct fingerprints that a shard holds: a share of all, but not fewer, and at most (a shard that holds more is cut into blocks).
SHARD_SHARE, SHARD_ROWS, BLOCK_ROWS = 256, 8192, 65536
#: Fingerprints from which the tree of cuts is made: one in so many, at least and at most; and candidates for a node's point.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST, CANDIDATES = 256, 4096, 1 << 19, 12
#: Sampled fingerprints under which a shard is not cut further.
SAMPLE_SHARD = 16
#: Fingerprints of a tree's leaf.
LEAF = 256


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """SimHash of the word ``k``-shingles of one text, as an unsigned 64-bit integer."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(k))))) if len(words) >= k else [b" ".join(words)]
    digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    ones = np.zeros(64, np.int64)
    step = 1 << 19  # bits of very long texts are counted in parts
    for i in range(0, len(digests), step):
        ones += np.unpackbits(np.frombuffer(digests[i : i + step], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit), and the columns ``carry``, of every row; null text counts as empty, and empty gives zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, k) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in carry), pa.array(fps)], ["doc_id", *carry, "fp"])

    frame = docs.select(F.col("doc_id").cast("long"), *carry, "text")
    return frame.mapInArrow(run, with_fields(frame.drop("text").schema, "fp long"))


class Cuts:
    """A tree of vantage points. Node ``i`` has a point and a distance, and the nodes inside and outside; leaves are shards."""

    def __init__(self, sample: np.ndarray, rows: int, radius: int, shard_rows: int):
        self.radius = radius
        points, cuts, inner, outer = [], [], [], []
        per_sample = rows / max(1, len(sample))

        def add() -> int:
            for column, value in ((points, 0), (cuts, 0), (inner, -1), (outer, -1)):
                column.append(value)
            return len(points) - 1

        stack = [(add(), sample)]
        while stack:
            node, own = stack.pop()
            if len(own) * per_sample <= shard_rows or len(own) < SAMPLE_SHARD:
                continue
            best = self._best(own)
            if best is None:
                continue
            points[node], cuts[node], d = best
            inner[node], outer[node] = add(), add()
            stack += [(inner[node], own[d <= cuts[node]]), (outer[node], own[d > cuts[node] - radius])]
        self.points, self.cuts, self.inner, self.outer = np.array(points, np.uint64), np.array(cuts, np.int16), np.array(inner), np.array(outer)

    def _best(self, own: np.ndarray) -> tuple[int, int, np.ndarray] | None:
        """Point, distance and the sample's distances of the cut that costs fewest comparisons; None if none saves a tenth."""
        best, least = None, 0.9 * len(own) ** 2
        for v in own[np.linspace(0, len(own) - 1, CANDIDATES).astype(int)]:
            d = np.bitwise_count(own ^ v)
            upto = np.cumsum(np.bincount(d, minlength=65))
            inside = upto[:-1].astype(float)  # for each distance
            outside = len(own) - np.concatenate([np.zeros(self.radius), upto[: 64 - self.radius]])
            cost = np.where(inside < len(own), inside**2 + outside**2, np.inf)
            at = int(np.argmin(cost))
            if cost[at] < least:
                best, least = (v, at, d), cost[at]
        return best

    def shards(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``fps`` and the shards that they belong to.

        A fingerprint goes to its own side of each cut, and from the inside also to the other
        side if the cut is nearer than ``radius``. Two fingerprints within ``radius`` share a
        shard: where a cut parts them, the inner one also goes outside.
        """
        at, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        done_at, done_node = [], []
        while len(at):
            leaf = self.inner[node] < 0
            done_at.append(at[leaf])
            done_node.append(node[leaf])
            at, node = at[~leaf], node[~leaf]
            d = np.bitwise_count(fps[at] ^ self.points[node]).astype(np.int16)
            inside, outside = d <= self.cuts[node], d > self.cuts[node] - self.radius
            at, node = np.concatenate([at[inside], at[outside]]), np.concatenate([self.inner[node[inside]], self.outer[node[outside]]])
        return np.concatenate(done_at or [at]), np.concatenate(done_node or [node])


class _Groups:
    """Union-find over positions, with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shard_links(fps: np.ndarray, indexed: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For every fingerprint of a shard, the position of its local group's first member.

    ``indexed`` marks those that the tree holds; the others only query. Groups join all
    fingerprints that chains of links of at least one indexed end connect.
    """
    groups = _Groups(len(fps))
    stack = [(np.flatnonzero(indexed), np.arange(len(fps)))]
    while stack:
        inner, query = stack.pop()
        if not len(inner) or not len(query):
            continue
        split = None
        if len(inner) > LEAF:
            v = fps[inner[len(inner) // 2]]
            d, q = np.bitwise_count(fps[inner] ^ v).astype(np.int16), np.bitwise_count(fps[query] ^ v).astype(np.int16)
            cut = int(np.median(d))
            if cut >= int(d.max()):
                cut -= 1
            near = d <= cut
            sides = [(inner[near], query[q <= cut + radius]), (inner[~near], query[q > cut - radius])]
            if all(len(i) * len(j) <= 0.9 * len(inner) * len(query) for i, j in sides) and sum(len(i) * len(j) for i, j in sides) < 0.95 * len(inner) * len(query):
                split = sides
        if split:
            stack += split
            continue
        right = fps[inner]
        step = max(1, (1 << 20) // len(inner))
        for i in range(0, len(query), step):
            part = query[i : i + step]
            a, b = np.nonzero(np.bitwise_count(fps[part][:, None] ^ right[None, :]) <= radius)
            a, b = part[a], inner[b]
            for x, y in _forest(a[a != b], b[a != b]):
                groups.union(x, y)
    return np.array([groups.find(i) for i in range(len(fps))], np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what ``(a, b)`` connect, but few where groups are dense: min-label rounds in numpy."""
    if len(a) < 4096:
        return list(zip(a.tolist(), b.tolist()))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return list(zip(ids.tolist(), ids[label].tolist()))
        label = new


def _search(radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        fps, nodes, indexed = batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy(), batch["indexed"].to_numpy()
        first = shard_links(fps, indexed, radius)
        linked = first != np.arange(len(fps))
        return pd.DataFrame({"src": nodes[linked], "dst": nodes[first[linked]]})

    return run


def block_pairs(placed: DataFrame, block_rows: int) -> DataFrame:
    """Groups ``shard, low, high`` of the members ``fp, node`` of each shard, and which of them are ``indexed``.

    Shards beyond the bound (dense groups) are cut into blocks, and every pair of blocks is a group
    of its own: the lower block is indexed there, both query. So no group holds more than two blocks.
    """
    wide = placed.groupBy("shard").count().where(F.col("count") > block_rows).select("shard", F.ceil(F.col("count") / block_rows).alias("blocks"))
    sent = placed.join(wide, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    sent = sent.select("fp", "node", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return sent.select("fp", "node", "shard", low.alias("low"), high.alias("high"), (F.col("own") == low).alias("indexed"))


def placed(distinct: DataFrame, cuts: Cuts) -> DataFrame:
    """``fp, node, shard`` for every shard of each fingerprint."""
    spread = distinct.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, shard = spread.value.shards(b.column("fp").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column("fp").take(pa.array(at)), b.column("node").take(pa.array(at)), pa.array(shard)], ["fp", "node", "shard"])

    return distinct.select("fp", "node").mapInArrow(run, "fp long, node long, shard long")


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``src, dst`` between the ``node`` ids of distinct fingerprints ``fp, node``.

    The edges connect exactly what links of ``radius`` bits or fewer connect. Each cut copies
    fingerprints near it, so there are as many shards as keep a cluster busy and no more.
    """
    n = distinct.count()
    shard_rows = shard_rows or min(max(SHARD_ROWS, n // SHARD_SHARE), block_rows)
    most = min(max(n // SAMPLE_SHARE, SAMPLE_LEAST), SAMPLE_MOST)
    sample = bounded_sample(distinct.select("fp"), "fp", most).toArrow().column("fp").to_numpy().view(np.uint64) if n > shard_rows else np.zeros(0, np.uint64)
    members = placed(distinct, Cuts(sample, n, radius, shard_rows))
    if n > block_rows:  # the members of each shard are counted, then read
        members, _ = materialize(members, "placed")
    return block_pairs(members, block_rows).groupBy("shard", "low", "high").applyInPandas(_search(radius), "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``, and the columns ``carry``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of ``radius`` bits or
    fewer, the row's own included; it is null only where no document that can be reached has
    an id. Null and empty texts have fingerprint zero and link like any other. Repeated rows
    share a fingerprint. Other columns are ignored; an empty table gives an empty result.
    """
    found = _grouped(docs, k, radius, carry)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carry)


def _grouped(docs: DataFrame, k: int, radius: int, carry: tuple[str, ...]) -> DataFrame:
    """One row per input row: ``doc_id, fp, component`` (the smallest fingerprint reachable), ``component_id`` and ``carry``."""
    fps, _ = materialize(fingerprints(docs, k, carry), "fingerprints")
    distinct, _ = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    # Written before tasks contract them: a stage of two Python functions keeps two workers a core, each with all that its stages load.
    found, _ = materialize(links(distinct.select("fp", F.col("fp").alias("node")), radius), "links")
    labels, _ = materialize(connected_components(found), "labels")
    of_group = labels.join(distinct, labels.node == distinct.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = labels.join(of_group, "component").select(F.col("node").alias("fp"), "component", "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    return join_groups(fps, named, "fp", fps.count(), ["doc_id"]).drop("n")


def without_near_copies(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` less near copies: of each component one row stays, that of the smallest ``doc_id``.

    Rows without an id come last; ties go to the smaller fingerprint, then to the smaller hash
    of the text; of rows that repeat with id and text one stays. An empty table stays empty.
    """
    version = F.xxhash64(whole_text())
    rows, _ = materialize(_grouped(docs.withColumn("version", version), k, radius, ("version",)), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "version")
    first = rows.groupBy("component").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = join_groups(rows, first, "component", rows.count(), ["doc_id", "version"]).where("n > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    twins = members.where(stays).groupBy("doc_id", "version").count().where("count > 1").drop("count")
    return without(docs, version, members.where(~stays).select("doc_id", "version").distinct(), twins)
