"""Linkage of small literal items, and connected components."""

import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidewell.operators import common, linkage
from tidewell.operators.components import connected_components, star_forest

FIELDS = "item_ord long, source_id string, guid string, url string, title string"


def run(spark, rows, priorities=()):
    items = spark.createDataFrame([(i, *r, f"t{i}") for i, r in enumerate(rows)], FIELDS)
    return linkage.link(items, spark.createDataFrame(list(priorities), "source_id string, priority int"))


def kept(linked):
    return [r.item_ord for r in linked.retained.orderBy("first_ord").collect()]


def test_priority_wins_and_class_keeps_its_place(spark):
    linked = run(spark, [("low", "", "https://x.example/b"), ("other", "", "https://x.example/c"), ("high", "", "http://www.x.example/b/?utm_source=z")], [("high", 10), ("low", 0)])
    assert kept(linked) == [2, 1]
    report = {r.source_id: (r.losers, r.winners) for r in linked.report.collect()}
    assert report == {"low": (1, 0), "high": (0, 1)}
    assert linkage.summary(linked.report).first().line == "Deduplication: 1 duplicate(s) removed - removed: low (-1) | absorbed by: high (+1)"


def test_ties_go_to_the_first_and_guid_is_scoped(spark):
    assert kept(run(spark, [("a", "1", "https://x.example/1"), ("a", "1", "https://x.example/2"), ("b", "1", ""), ("a", "", ""), ("a", "", ""), ("b", None, None), ("a", "2", "https://[bad"), ("a", "3", "https://x.example/3")])) == [0, 2, 3, 4, 5, 6, 7]


def test_chains_in_any_order(spark):
    chain = [("s", "g0", "https://x.example/0"), ("s", "g1", "https://x.example/0"), ("s", "g1", "https://x.example/1")]
    rows = [(f"{n}{r[0]}", r[1], r[2].replace("x.", f"x{n}.")) for n, order in enumerate(itertools.permutations(chain)) for r in order]
    linked = run(spark, rows)
    assert len(kept(linked)) == 6
    assert linkage.total_losers(linked.report).first()[0] == 12


def test_no_items(spark):
    linked = run(spark, [])
    assert kept(linked) == [] and linked.report.count() == 0
    assert linkage.summary(linked.report).first().line == "Deduplication: no duplicates."


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5), (None, 3)]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    assert got == {a: find(a) for a in list(up)}


def test_stars_of_some_edges():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 30, 300):
        a, b = rng.integers(-50, 50, n), rng.integers(-50, 50, n)
        u, v = star_forest(a, b)
        assert set(u.tolist()) | set(v.tolist()) == set(a.tolist()) | set(b.tolist()) and len(set(u.tolist())) == len(u)
        assert not (set(u[u != v].tolist()) & set(v.tolist())) and (u >= v).all()
        up = dict(zip(u.tolist(), v.tolist()))
        assert all(up.get(x, x) == up.get(y, y) for x, y in zip(a.tolist(), b.tolist()))
        assert len(set(map(lambda x: up.get(x, x), a.tolist()))) <= len({*a.tolist(), *b.tolist()})


def test_contraction_saves_rounds(spark):
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seen = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # so that single edges can be contracted, which changes nothing
    for at_once in (1, 1 << 20):
        seen[at_once] = []
        got = connected_components(chain.repartition(4, F.xxhash64("src")), rounds=seen[at_once], contract_rows=at_once)
        assert {r.node: r.component for r in got.collect()} == {i: 0 for i in range(3001)}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 2 * len(seen[1 << 20]) <= len(seen[1]) and 2 * sum(seen[1 << 20]) < sum(seen[1])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).select(F.count("*")).first()[0] == 0


def test_item_numbers_keep_the_order_of_any_source(spark):
    places = [(s, e) for s in (-(1 << 31), -1, 0, 7, 8_388_607, 8_388_608, 10_000_000, (1 << 31) - 1) for e in (0, 1, 5, (1 << 32) - 1)]
    rows = spark.createDataFrame(places, "source_ord int, entry_ord long").repartition(3)
    got = rows.select("*", common.item_ord(F.col("source_ord"), F.col("entry_ord")).alias("n")).orderBy("n").collect()
    assert [(r.source_ord, r.entry_ord) for r in got] == sorted(places) and len({r.n for r in got}) == len(places)
    for source, entry, bits in ((0, 1 << 32, 32), (0, -1, 32), (1 << 23, 0, 40)):
        with pytest.raises(Exception, match="out of range"):
            spark.range(1).select(common.item_ord(F.lit(source), F.lit(entry), bits)).collect()


def test_dense_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("_v")).repartition(5)
    got = common.numbered(rows, "k")
    assert got.columns == ["k", "_v", "place"]
    assert [r.place for r in got.orderBy("k").collect()] == list(range(1000))
    assert common.numbered(rows.limit(0), "k").count() == 0


def test_classes_keep_registry_order_beyond_eight_million_sources(spark):
    rows = [(20_000_000, 0, "z", "https://x.example/a"), (3, 5, "y", "https://x.example/b"), (9_000_000, 1, "x", "https://x.example/a"), (9_000_000, 0, "x", "https://x.example/c")]
    items = spark.createDataFrame(rows, "source_ord int, entry_ord long, source_id string, url string").withColumn("guid", F.lit(""))
    items = items.withColumn("item_ord", common.item_ord(F.col("source_ord"), F.col("entry_ord")))
    linked = linkage.link(items, spark.createDataFrame([], "source_id string, priority int"))
    got = linkage.in_order(linked.retained).orderBy("place").collect()
    assert [(r.source_id, r.url[-1]) for r in got] == [("y", "b"), ("x", "c"), ("x", "a")]
