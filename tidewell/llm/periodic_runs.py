"""Periodic runs of words, by Kruskal's order over the suffixes of each text.

A run is a stretch of words with smallest period ``q``, of ``max(least, power * q)`` words or more,
that no neighbouring word extends. The first word of a run and the word ``q`` later begin suffixes whose
longest common prefix (LCP) is the run's length less ``q``, and no suffix that shares this prefix
begins between them: a rotation of the repeated words would equal them, so ``q`` were not smallest.
So each run is seen where its two first places become neighbours:

* Suffixes are ordered by prefix doubling, which also gives the LCP of neighbours in that order.
* By decreasing LCP, union-find unites the classes of both suffixes of a pair. A class holds its
  positions in order; the smaller class is merged into the larger one.
* Positions of the two classes that come to stand next to each other, at a distance within the LCP,
  seed a run: the LCP says where it ends, and it begins there unless the words before agree too.

A run's LCP is at least ``least * (power - 1) / power`` words, so lower ones are not united, and a text in
which no stretch of that many words occurs twice (found by hashing windows of a whole batch) has no runs.
Texts are independent: nothing is shuffled, and a task holds one batch of bounded size, or one text.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import slices, with_fields

#: A run has at least ``LEAST`` words and ``POWER`` periods.
LEAST, POWER = 24, 3

_ADDED = "runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in an order that keeps suffixes with a common prefix together, and the LCP of each with the next.

    ``levels[k]`` numbers the stretches of ``2**k`` ids; those cut by the end differ from all others.
    """
    n = len(ids)
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1]
    while len(levels[-1]) and levels[-1].max() < n:
        last, width = levels[-1], 1 << (len(levels) - 1)
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - width)] = last[width:]
        levels.append(np.unique(last * (n + 1) + follow, return_inverse=True)[1] + 1)
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = order[:-1] + common, order[1:] + common
        inside = (i < n) & (j < n)
        same = np.zeros(len(common), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        common[same] += 1 << k
    return order, common


def seeds(order: np.ndarray, common: np.ndarray, floor: int) -> Iterator[tuple[int, int, int]]:
    """``(i, j, lcp)``: positions that become neighbours in a class, at a distance within their LCP, by decreasing LCP."""
    edges = np.argsort(-common, kind="stable")[: int((common >= floor).sum())]
    root: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    places = order.tolist()
    for edge, lcp in zip(edges.tolist(), common[edges].tolist()):
        large, small = find(edge), find(edge + 1)
        more, fewer = held.pop(large, None) or [places[large]], held.pop(small, None) or [places[small]]
        if len(more) < len(fewer):
            large, small, more, fewer = small, large, fewer, more
        for p in fewer:
            at = bisect(more, p)
            if at and p - more[at - 1] <= lcp:
                yield more[at - 1], p, lcp
            if at < len(more) and more[at] - p <= lcp:
                yield p, more[at], lcp
        if 8 * len(fewer) > len(more):
            more = sorted(more + fewer)  # two ordered stretches: one merge
        else:
            for p in fewer:
                insort(more, p)
        root[small] = large
        held[large] = more


def find_runs(ids: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for i, j, lcp in seeds(*suffix_order(ids), shared(least, power)):
        period = j - i
        if lcp + period >= max(least, power * period) and (not i or ids[i - 1] != ids[j - 1]):
            found[i, lcp + period] = min(period, found.get((i, lcp + period), period))
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def shared(least: int, power: int) -> int:
    """Words that the two first periods' suffixes of any run have in common at least."""
    return max(1, -(-least * (power - 1) // power))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeating(ids: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Of texts that begin at ``starts`` (and end where the next begins), those in which a window of ids may occur twice.

    Windows are compared by 64-bit hashes, which hide no repetition.
    """
    odd, of = np.uint64(0x9E3779B97F4A7C15), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = (ids.astype(np.uint64) + np.uint64(1)) * odd
    h ^= h >> np.uint64(29)
    full, done, out, factor = h, 0, np.zeros(len(h), np.uint64), np.array([0xD6E8FEB86659FD93], np.uint64)
    width = 1
    while done < window:  # binary digits of the window's length
        if window & width:
            moved = np.zeros(len(h), np.uint64)
            moved[: max(0, len(h) - done)] = full[done:]
            out = out * factor + moved
            done += width
        twice = np.zeros(len(h), np.uint64)
        twice[: max(0, len(h) - width)] = full[width:]
        full, factor, width = full * factor + twice, factor * factor, 2 * width
    inside = np.arange(len(h)) + window <= starts[1:][of]
    keys = (out ^ (of.astype(np.uint64) * odd))[inside]
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return np.unique(of[inside][order[again]])


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a period planted from a place on, in the documents that the query's contract names; a null id names none."""
    if doc_id is None or not words or (h := crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER, key: str = "doc_id", text: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Add ``runs`` (array of ``start, length, period`` in words, by start, then period) and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``collapsed`` has those that no run contains after its first
    period, joined by one space. ``change`` may replace the words of a row, given its ``key``. Null, empty and
    blank texts have no runs and an empty ``collapsed``; rows that repeat are judged each. Other columns
    pass through; those named like an added one are replaced. An empty table stays empty.
    """
    frame = docs.drop("runs", "collapsed")
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, rows=4096):
            words = [(t or b"").split() for t in b.column(text).cast(pa.binary()).to_pylist()]
            if change:
                words = [change(k, w) for k, w in zip(b.column(key).to_pylist(), words)]
            number, lengths = _Ids(), np.array([len(w) for w in words])
            ids = np.fromiter((n for w in words for n in map(number.__getitem__, w)), np.int64, int(lengths.sum()))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            runs: list[list[tuple[int, int, int]]] = [[]] * len(words)
            for d in repeating(ids, starts, shared(least, power)).tolist():
                runs[d] = find_runs(ids[starts[d] : starts[d + 1]], least, power)
                gone = np.zeros(len(words[d]) + 1, np.int64)
                for start, length, period in runs[d]:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                words[d] = [words[d][i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            collapsed = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
            listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], _RUNS)
            yield pa.RecordBatch.from_arrays([*b.columns, listed, collapsed], [*names, "runs", "collapsed"])

    return frame.mapInArrow(run, with_fields(frame.schema, _ADDED))


def summary(found: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the number of runs, the one of most periods (ties: first start, then period), and digests."""
    runs = F.col("runs")
    first = F.get(
        F.array_sort(
            runs,
            lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).otherwise(1))
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.signum(a["period"] - b["period"]).cast("int")),
        ),
        F.lit(0),
    )
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), first.alias("best"), F.when(F.size(runs) > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "collapsed")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", *best, milli, F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
