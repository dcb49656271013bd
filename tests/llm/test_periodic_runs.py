"""Runs equal those of a search over every period, on made-up words and over a whole table."""

import hashlib
import random
import zlib
from fractions import Fraction

import cases
import compare
import numpy as np

from tidewell.llm import catalog, periodic_runs as pr

SF = f"{compare.DATA}/sf0.001"


def every_period(ids, least=24, power=3):
    """All runs, by comparing the words with themselves shifted by each period, smallest first."""
    found = {}
    for q in range(1, len(ids) // power + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(least, power * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_up(rng):
    words = []
    while len(words) < rng.randint(0, 70):
        unit = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.randint(1, 7))]
        words += (unit * rng.randint(1, 8))[: rng.randint(1, 50)]
    return np.array(words, np.int64)


def test_runs_against_every_period():
    rng, seen = random.Random(5), 0
    for _ in range(3000):
        ids = made_up(rng)
        for least, power in ((24, 3), (rng.randint(2, 9), rng.randint(2, 4))):
            want = every_period(ids, least, power)
            assert pr.find_runs(ids, least, power) == want, (ids.tolist(), least, power)
            seen += len(want)
            if want:
                assert pr.repeating(ids, np.array([0, len(ids)]), pr.shared(least, power)).tolist() == [0]
    assert seen > 2000


def test_suffix_order_and_prefixes():
    rng = random.Random(6)
    for _ in range(300):
        ids = made_up(rng)
        order, common = pr.suffix_order(ids)
        assert sorted(order.tolist()) == list(range(len(ids)))
        suffixes = [ids[i:].tolist() for i in order.tolist()]
        for a, b, n in zip(suffixes, suffixes[1:], common.tolist()):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1]


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = every_period(np.array([names[w] for w in words], np.int64))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(listed.encode()), digest(b" ".join(kept)))


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = catalog.op12_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert rows == {d.doc_id: slow_row(d.doc_id, d.text) for d in docs}
    assert sum(r[1] > 0 for r in rows.values()) >= len(docs) // 20


def test_collapsed_text_keeps_one_period(spark):
    once = [f"w{i}" for i in range(9)]
    rows = [(1, " ".join(["before", *once * 4, "w0", "after"])), (2, " \t".join(once * 2)), (3, "ab " * 40 + "c")]
    got = {r.doc_id: r for r in pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].collapsed == " ".join(["before", *once, "after"]) and [tuple(r) for r in got[1].runs] == [(1, 37, 9)]
    assert got[2].runs == [] and got[2].collapsed == " ".join(once * 2)
    assert got[3].collapsed == "ab c" and [tuple(r) for r in got[3].runs] == [(0, 40, 1)]


def test_ties_take_the_first_start_then_the_period(spark):
    rows = [(1, [(40, 30, 10), (0, 30, 10), (0, 60, 20), (90, 27, 9)])]
    found = spark.createDataFrame([(i, r, "") for i, r in rows], "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    best = pr.summary(found).first()
    assert (best.start, best.length, best.period, best.exponent_milli) == (0, 30, 10, 3000)


def test_edges(spark):
    table = cases.edges(spark).withColumnRenamed("score", "runs")
    got = pr.periodic_runs(table)
    assert got.columns == ["doc_id", "text", "runs", "collapsed"] and got.count() == len(cases.EDGES)
    by = {r.doc_id: r for r in got.collect()}
    assert [tuple(r) for r in by[6].runs] == [(0, 30_000, 1)] and by[6].collapsed == "word"
    assert by[2].runs == by[3].runs == by[4].runs == [] and by[2].collapsed == by[4].collapsed == ""
    assert pr.periodic_runs(cases.empty(spark)).count() == 0
    none = spark.createDataFrame([(None, "x " * 30), (None, None)], "doc_id long, text string")
    assert sorted(r.n_runs for r in pr.summary(pr.periodic_runs(none, change=pr.planted)).collect()) == [0, 1]
