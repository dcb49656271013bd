"""The source registry: loading, defaults, and data-quality rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("id", "type", "url", "lang", "section")
OPTIONAL = ("priority", "root_path", "mapping", "url_template", "selector", "base_url")
TYPES = ("rss", "json", "scrape")
SECTIONS = ("learn", "moving", "work")


class Loaded(NamedTuple):
    registry: DataFrame
    rejects: DataFrame


def load(entries: DataFrame) -> Loaded:
    """Split declared entries into a typed registry and rejects.

    ``entries`` is ``source_ord int, entry map<string,string>``; a nested ``mapping`` is a JSON
    object. An entry that lacks a required key, has an unknown one, or whose priority is no
    whole number goes to ``rejects`` with its reason. A null entry is rejected; no entry at all
    gives an empty registry.
    """
    keys = F.map_keys(F.coalesce("entry", F.create_map().cast("map<string,string>")))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    unknown = F.array_except(keys, F.array(*map(F.lit, REQUIRED + OPTIONAL)))
    priority = F.try_element_at("entry", F.lit("priority"))
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing key: "), F.array_join(missing, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown key: "), F.array_join(F.array_sort(unknown), ", ")))
        .when(priority.isNotNull() & priority.try_cast("int").isNull(), "priority is not a number")
    )
    checked = entries.select("source_ord", "entry", reason.alias("reason"))
    return Loaded(with_defaults(checked.where("reason is null")), checked.where("reason is not null"))


def with_defaults(entries: DataFrame) -> DataFrame:
    """Typed source rows; what is not declared gets its default (priority 0, empty text, empty mapping)."""

    def text(name: str):
        return F.coalesce(F.try_element_at("entry", F.lit(name)), F.lit("")).alias(name)

    priority = F.coalesce(F.try_element_at("entry", F.lit("priority")).try_cast("int"), F.lit(0))
    mapping = F.coalesce(F.from_json(F.try_element_at("entry", F.lit("mapping")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return entries.select(
        "source_ord", *[text(n) for n in ("id", "type", "url", "lang", "section")], priority.alias("priority"),
        text("root_path"), mapping.alias("mapping"), text("url_template"), text("selector"), text("base_url"),
    )


def check(registry: DataFrame) -> DataFrame:
    """``source_id, rule`` of every violated data-quality rule."""
    def has(name: str):
        return F.col(name) != ""

    rules = F.array_compact(F.array(
        F.when(~F.col("type").isin(*TYPES), "type without connector"),
        F.when(~F.col("section").isin(*SECTIONS), "unknown section"),
        F.when((F.col("type") == "json") & (F.coalesce(F.try_element_at("mapping", F.lit("guid")), F.lit("")) == ""), "json without mapped guid"),
        F.when((F.col("type") == "scrape") & ~(has("selector") & has("base_url")), "scrape without selector or base_url"),
        F.when(F.col("priority") == 0, "priority not set"),
    ))
    broken = registry.select(F.col("id").alias("source_id"), F.explode(rules).alias("rule"))
    twice = registry.groupBy("id").count().where("count > 1").select(F.col("id").alias("source_id"), F.lit("id declared twice").alias("rule"))
    return broken.unionByName(twice)
