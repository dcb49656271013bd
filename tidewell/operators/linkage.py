"""Record linkage of items: identity keys, transitive classes, one winner per class, and its reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import common
from tidewell.operators.components import connected_components
from tidewell.session import materialize


def identity_keys(items: DataFrame) -> DataFrame:
    """``item_ord, key``: the normalised URL and the source-scoped guid of each item, as far as it has them."""
    read = items.select("item_ord", "source_id", urls.normalise(F.col("url")).alias("url"), F.coalesce("guid", F.lit("")).alias("guid"))
    keys = F.array_compact(F.array(
        F.when(F.col("url") != "", F.concat(F.lit("url:"), "url")),
        F.when(F.col("guid") != "", F.concat(F.lit("guid:"), F.coalesce("source_id", F.lit("")), F.lit(":"), "guid")),
    ))
    return read.select("item_ord", F.explode(keys).alias("key"))


def classes(items: DataFrame) -> DataFrame:
    """``item_ord, component``: the smallest ``item_ord`` of the item's class.

    Items that share a key are linked to the key's first item (an aggregation, so a key that
    many items share is summed before the shuffle), and classes are connected components.
    Only ordinals and keys take part.
    """
    keys, _ = materialize(identity_keys(items), "keys")
    hubs = keys.groupBy("key").agg(F.min("item_ord").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = keys.join(hubs, "key").where("item_ord <> hub").select(F.col("item_ord").alias("src"), F.col("hub").alias("dst"))
    labels = connected_components(edges).withColumnRenamed("node", "item_ord")
    return items.select("item_ord").join(labels, "item_ord", "left").select("item_ord", F.coalesce("component", "item_ord").alias("component"))


def last_priorities(registry: DataFrame) -> DataFrame:
    """``source_id, priority``: of sources declared twice, the last declaration counts."""
    return registry.groupBy(F.col("id").alias("source_id")).agg(F.max_by("priority", "source_ord").alias("priority"))


class Linked(NamedTuple):
    """Class of every item, the retained items, and losers and winners per source."""

    members: DataFrame  # item_ord, component, source_id, winner_ord, winner_source, size
    retained: DataFrame  # items with first_ord
    report: DataFrame  # source_id, losers, winners


def _better() -> Column:
    return F.struct(F.coalesce("priority", F.lit(0)), -F.col("item_ord"))


def link(items: DataFrame, priorities: DataFrame) -> Linked:
    """Keep one item per class: the highest source priority, then the earliest position.

    ``items`` needs unique ``item_ord``; ``priorities`` is ``source_id, priority`` (absent: 0).
    ``first_ord`` of a retained item is the place of its class, by which output is ordered.
    """
    slim = items.select("item_ord", "source_id").join(classes(items), "item_ord").join(priorities, "source_id", "left")
    winners = slim.groupBy("component").agg(F.max_by(F.struct("item_ord", "source_id"), _better()).alias("w"), F.count(F.lit(1)).alias("size"))
    won = winners.select("component", F.col("w.item_ord").alias("winner_ord"), F.col("w.source_id").alias("winner_source"), "size")
    members, _ = materialize(slim.join(won, "component").select("item_ord", "component", "source_id", "winner_ord", "winner_source", "size"), "members")
    kept = members.where("item_ord = winner_ord").select("item_ord", F.col("component").alias("first_ord"))
    retained = items.join(kept, "item_ord")
    lost = members.where("item_ord <> winner_ord").groupBy("source_id").agg(F.count(F.lit(1)).alias("losers"))
    gained = members.where("item_ord = winner_ord and size > 1").groupBy("source_id").agg(F.count(F.lit(1)).alias("winners"))
    report = lost.join(gained, "source_id", "full").select("source_id", F.coalesce("losers", F.lit(0)).alias("losers"), F.coalesce("winners", F.lit(0)).alias("winners"))
    return Linked(members, retained, report)


def in_order(retained: DataFrame) -> DataFrame:
    """Retained items with their ``place``, from 0: classes in the order in which their first items appeared."""
    return common.numbered(retained, "first_ord")


def total_losers(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("losers"), F.lit(0)).alias("total_losers"))


def summary(report: DataFrame) -> DataFrame:
    """One line: losers and winners per source, most first. Rows are sources, so one row's text stays small."""
    def ranked(count: str, sign: str) -> Column:
        entries = F.sort_array(F.collect_list(F.when(F.col(count) > 0, F.struct((-F.col(count)).alias("n"), "source_id"))))
        return F.array_join(F.transform(entries, lambda e: F.concat(e["source_id"], F.lit(f" ({sign}"), (-e["n"]).cast("string"), F.lit(")"))), ", ")

    line = report.agg(F.coalesce(F.sum("losers"), F.lit(0)).alias("total"), ranked("losers", "-").alias("lost"), ranked("winners", "+").alias("won"))
    text = F.concat(F.lit("Deduplication: "), F.col("total").cast("string"), F.lit(" duplicate(s) removed - removed: "), "lost", F.lit(" | absorbed by: "), "won")
    return line.select(F.when(F.col("total") == 0, "Deduplication: no duplicates.").otherwise(text).alias("line"))
