"""The driver's tables seen as items, sources and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import common

#: Start of a run, and first publication, of the views below.
RUN_TS, FIRST_TS = "2024-06-01 00:00:00", "2024-05-25 00:00:00"


def run_ts() -> Column:
    return F.lit(RUN_TS).cast("timestamp")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _ordinal(source: Column) -> Column:
    return F.regexp_replace(source, "[^0-9]", "").cast("int")


def item_url() -> Column:
    tail = F.element_at(F.array(F.lit("/?utm_source=feed"), F.lit("#top"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    return F.concat(F.lit("https://www."), "lang", F.lit(".example/"), F.md5("text"), tail)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an item of its source."""
    published = F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_TS).cast("timestamp")) + F.col("doc_id") * 60)
    source_ord = _ordinal(F.col("source"))
    return documents(spark, sf_dir).select(
        F.col("source").alias("source_id"),
        F.floor(F.col("doc_id") / 40).cast("string").alias("guid"),
        F.left("text", F.lit(40)).alias("title"),
        published.alias("published_at"),
        "lang",
        F.lit("moving").alias("section"),
        item_url().alias("url"),
        F.col("text").alias("content"),
        source_ord.alias("source_ord"),
        F.col("doc_id").alias("entry_ord"),
        common.item_ord(source_ord, F.col("doc_id"), 40).alias("item_ord"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of the items, and one of an unknown type, one silent and one failed."""
    source_ord = _ordinal(F.col("source"))
    known = documents(spark, sf_dir).select("source").distinct().select(
        source_ord.alias("source_ord"), F.col("source").alias("id"),
        F.element_at(F.array(F.lit("rss"), F.lit("json"), F.lit("scrape")), source_ord % 3 + 1).alias("type"),
        (source_ord % 3 * 5).alias("priority"), F.lit("").alias("reason"),
    )
    more = spark.createDataFrame(
        [(1000, "odd", "gopher", 0, "unknown source type 'gopher'"), (1001, "quiet", "rss", 0, ""), (1002, "broken", "json", 0, "payload missing")],
        "source_ord int, id string, type string, priority int, reason string",
    )
    return known.unionByName(more)


#: The same views in DuckDB.
ITEMS_SQL = """
items AS (SELECT source AS source_id, (doc_id // 40)::VARCHAR AS guid, left(text, 40) AS title,
    TIMESTAMP '2024-05-25 00:00:00' + to_minutes(doc_id) AS published_at, lang,
    'https://www.' || lang || '.example/' || md5(text) || CASE doc_id % 3 WHEN 0 THEN '/?utm_source=feed' WHEN 1 THEN '#top' ELSE '' END AS url,
    lang || '.example/' || md5(text) AS norm, text AS content,
    regexp_replace(source, '[^0-9]', '', 'g')::INT AS source_ord, doc_id AS entry_ord,
    (regexp_replace(source, '[^0-9]', '', 'g')::BIGINT << 40) + doc_id AS item_ord FROM documents),
registry AS (SELECT DISTINCT source_ord, source_id AS id, CASE source_ord % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'json' ELSE 'scrape' END AS type,
    source_ord % 3 * 5 AS priority, '' AS reason FROM items
    UNION ALL VALUES (1000, 'odd', 'gopher', 0, 'unknown source type ''gopher'''), (1001, 'quiet', 'rss', 0, ''), (1002, 'broken', 'json', 0, 'payload missing'))
"""
#: Classes by smallest reachable item (over keys), winners and members.
CLASSES_SQL = ITEMS_SQL + """,
keys AS (SELECT item_ord, 'url:' || norm AS key FROM items UNION ALL SELECT item_ord, 'guid:' || source_id || ':' || guid FROM items),
hubs AS (SELECT item_ord, min(item_ord) OVER (PARTITION BY key) AS hub FROM keys),
links AS (SELECT DISTINCT item_ord AS a, hub AS b FROM hubs WHERE item_ord <> hub UNION SELECT DISTINCT hub, item_ord FROM hubs WHERE item_ord <> hub),
reach AS (SELECT item_ord AS node, item_ord AS label FROM items UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node AND r.label < l.b),
classes AS (SELECT node AS item_ord, min(label) AS component FROM reach GROUP BY node),
ranked AS (SELECT i.item_ord, c.component, i.source_id,
    row_number() OVER (PARTITION BY c.component ORDER BY coalesce(r.priority, 0) DESC, i.item_ord) AS place, count(*) OVER (PARTITION BY c.component) AS size
    FROM items i JOIN classes c USING (item_ord) LEFT JOIN registry r ON r.id = i.source_id),
lost AS (SELECT source_id, count(*) AS losers FROM ranked WHERE place > 1 GROUP BY 1),
won AS (SELECT source_id, count(*) AS winners FROM ranked WHERE place = 1 AND size > 1 GROUP BY 1)
"""
