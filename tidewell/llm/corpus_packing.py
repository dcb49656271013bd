"""Packing by neighbours from the whole corpus: the exact way beside the shards of ``packing``.

Every rest asks every other rest: rests are dealt into blocks, and each pair of a block of queries and a block
of the inverted index is a group in a task, which keeps the best neighbours of its queries. So the ``K`` best by BM25
over the whole corpus are found for every rest, and no pair but these leaves a task. The work grows with the
square of the rests, which is why ``packing.pack`` asks its own shard only; README gives the cost of both.

Rests then form windows in rounds. In each, the rests that come before all their unused neighbours, longest first, are
seeds; every other rest that some seed has listed accepts the one for which it scores best (ties: the smaller
number), and a seed takes those that accepted, best first, until its window is full. A rest is taken once. When
no unused rest has an unused neighbour, what is left stands alone. A seed and what it took are a unit: it fills a
window, and what the last neighbour has beyond it, like units that fill none, fills up windows as in ``packing``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm import packing
from tidewell.session import drop_path, materialize

#: Neighbours of a rest, and ids of a block.
K, BLOCK_TOKENS = 10, 1 << 22


def _idf(counts: packing.Counts) -> np.ndarray:
    return np.maximum(0, np.log((counts.docs - counts.df + 0.5) / (counts.df + 0.5))).astype(np.float32)


def neighbours(tokens: DataFrame, counts: packing.Counts, k: int = K, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``seed, other, score``: for every rest of ``packing.tokenised`` the ``k`` others of greatest positive BM25 score (ties: the smaller number).

    Rests are named by ``at``. Weights are those of the whole corpus.
    """
    idf, mean = _idf(counts), max(1, counts.rests) / max(1, counts.docs)
    blocks = max(1, -(-counts.rests // block_tokens))
    rests = tokens.where("n_rest > 0 and frequencies is null").select("at", "rest", F.pmod(F.xxhash64("at"), F.lit(blocks)).alias("block"))
    every = F.explode(F.sequence(*(F.lit(b).cast("bigint") for b in (0, blocks - 1))))
    asking = rests.select("at", "rest", F.col("block").alias("asks"), every.alias("asked"))
    index = rests.select("at", "rest", every.alias("asks"), F.col("block").alias("asked"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        seeds, others, scores = [], [], []
        if left.num_rows and right.num_rows:
            own = np.array(right.column("at").to_pylist(), np.int64)
            order = np.argsort(own)
            own = own[order]
            rest = right.column("rest").to_pylist()
            shard = packing.Shard([np.frombuffer(rest[i], "<u4") for i in order.tolist()], idf, mean)
            for at, ids in zip(left.column("at").to_pylist(), left.column("rest").to_pylist()):
                score = shard.scores(np.frombuffer(ids, "<u4"))
                score[own == at] = 0
                top = np.argpartition(-score, k)[:k] if len(score) > k else np.arange(len(score))
                top = np.flatnonzero(score >= max(score[top].min(), 1e-12)) if len(top) else top
                top = top[np.argsort(-score[top], kind="stable")][:k]
                seeds += [at] * len(top)
                others.append(own[top])
                scores.append(score[top])
        empty = np.zeros(0)
        return pa.table({"seed": pa.array(seeds, pa.int64()), "other": pa.array(np.concatenate([empty.astype(np.int64), *others])), "score": pa.array(np.concatenate([empty, *scores]))})

    pair = ("asks", "asked")
    found = asking.groupBy(*pair).cogroup(index.groupBy(*pair)).applyInArrow(best, "seed long, other long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("score"), "other")))
    return ranked.where(F.col("rank") <= k).drop("rank")


def units(tokens: DataFrame, found: DataFrame, window: int = packing.WINDOW) -> DataFrame:
    """``at, unit, place, n_rest``: which rests stand together (``unit`` is their seed) and in what order."""
    spark = tokens.sparkSession
    rests, _ = materialize(tokens.where("n_rest > 0 and frequencies is null").select("at", "n_rest"), "rests")
    sizes = [rests.select(F.col("at").alias(c), F.col("n_rest").alias(f"n_{c}")) for c in ("seed", "other")]
    links, path = materialize(found.join(sizes[0], "seed").join(sizes[1], "other"), "links")
    parts = []
    while links.take(1):
        rank = {c: F.struct(F.col(f"n_{c}").alias("n"), (-F.col(c)).alias("at")) for c in ("seed", "other")}
        ends = links.select(F.col("seed").alias("at"), rank["seed"].alias("own"), rank["other"].alias("theirs")).unionAll(links.select("other", rank["other"], rank["seed"]))
        first = ends.groupBy("at").agg(F.first("own").alias("own"), F.max("theirs").alias("most")).where("own > most").select(F.col("at").alias("seed"), F.lit(True).alias("leads"))
        offers = links.join(first, "seed")
        taken = offers.groupBy("other").agg(F.max(F.struct("score", (-F.col("seed")).alias("back"), "n_seed", "n_other")).alias("o")).select("other", (-F.col("o.back")).alias("seed"), "o.score", "o.n_seed", "o.n_other")
        order = W.partitionBy("seed").orderBy(F.desc("score"), "other")
        taken = taken.withColumn("held", F.col("n_seed") + F.sum("n_other").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
        members = taken.where(F.col("held") - F.col("n_other") < window).select(F.col("other").alias("at"), F.col("seed").alias("unit"), "place", F.col("n_other").alias("n_rest"))
        seeds = links.select("seed", "n_seed").distinct().join(first, "seed").select(F.col("seed").alias("at"), F.col("seed").alias("unit"), F.lit(0).alias("place"), F.col("n_seed").alias("n_rest"))
        sunk = first.join(seeds.select(F.col("at").alias("seed")), "seed", "left_anti").select(F.col("seed").alias("at"))  # listed by others, lists none
        alone = sunk.join(rests, "at").select("at", F.col("at").alias("unit"), F.lit(0).alias("place"), "n_rest")
        part, _ = materialize(seeds.unionAll(members).unionAll(alone), "units")
        parts.append(part)
        used = part.select("at")
        after = links.join(used.withColumnRenamed("at", "seed"), "seed", "left_anti").join(used.withColumnRenamed("at", "other"), "other", "left_anti")
        after, new_path = materialize(after.select(*links.columns), "links")
        drop_path(spark, path)
        links, path = after, new_path
    drop_path(spark, path)
    placed = None
    for part in parts:
        placed = part if placed is None else placed.unionAll(part)
    lone = rests.select("at", F.col("at").alias("unit"), F.lit(0).alias("place"), "n_rest")
    return lone if placed is None else placed.unionAll(lone.join(placed.select("at"), "at", "left_anti"))


def pack(docs: DataFrame, path: str, window: int = packing.WINDOW, shard_tokens: int = packing.SHARD_TOKENS, k: int = K, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """As ``packing.pack``, with its rows and rules, but windows are made of neighbours from the whole corpus first."""
    tokens = packing.tokenised(docs, path, window)
    counts = packing.corpus_counts(tokens)
    idf, mean = _idf(counts), max(1, counts.rests) / max(1, counts.docs)
    grouped, _ = materialize(units(tokens, neighbours(tokens, counts, k, block_tokens), window), "grouped")
    rests = tokens.where("n_rest > 0 and frequencies is null").select("at", "doc_id", "n_tokens", "rest").join(grouped.drop("n_rest"), "at")
    parts = max(1, counts.rests // (packing.PARTITION_SHARDS * shard_tokens))
    ordered = rests.repartition(parts, "unit").sortWithinPartitions("unit", "place").select("unit", "doc_id", "n_tokens", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int | None, int, np.ndarray]] = []  # unit, document, its tokens, ids

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            first = [i for i, r in enumerate(held) if not i or r[0] != held[i - 1][0]]
            ends = [*first[1:], len(held)]
            together = [np.concatenate([r[3] for r in held[a:b]]) for a, b in zip(first, ends)]
            starts = [np.cumsum([0, *(len(r[3]) for r in held[a:b])]) for a, b in zip(first, ends)]
            rows = []

            def put(unit: int, at: int, length: int, number: int, offset: int) -> None:
                while length:
                    member = int(np.searchsorted(starts[unit], at, "right")) - 1
                    _, doc, size, ids = held[first[unit] + member]
                    inside = at - int(starts[unit][member])
                    take = min(length, len(ids) - inside)
                    rows.append((doc, size - len(ids) + inside, take, size, number, offset, ids[inside : inside + take].tobytes()))
                    at, offset, length = at + take, offset + take, length - take

            left = []
            for unit, ids in enumerate(together):
                if len(ids) >= window:  # its neighbours fill its window
                    put(unit, 0, window, sequence, 0)
                    sequence += 1
                if len(ids) != window:
                    left.append((unit, window if len(ids) > window else 0))
            last = -1
            if left:
                for i, at, length, last, offset in packing.Shard([together[u][cut:] for u, cut in left], idf, mean).pack(window):
                    put(left[i][0], left[i][1] + at, length, sequence + last, offset)
            for i in range(0, len(rows), 4096):
                columns = zip(*rows[i : i + 4096])
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            sequence += last + 1

        size = 0
        for b in batches:
            for unit, doc, n, ids in zip(*(b.column(c).to_pylist() for c in ("unit", "doc_id", "n_tokens", "rest"))):
                if size >= shard_tokens and unit != held[-1][0]:
                    yield from flush()
                    held, size = [], 0
                held.append((unit, doc, n, np.frombuffer(ids, "<u4")))
                size += len(held[-1][3])
        if held:
            yield from flush()

    return packing.own_windows(tokens, window).unionAll(ordered.mapInArrow(run, packing._PIECES))
