"""Landed payloads, their dispatch to connectors, and failures per source."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.operators import common, feed_items, html_items, json_items
from tidewell.session import materialize

#: A connector maps payloads joined to their sources, and the run's instant, to entries, rejected ones with ``reject``.
CONNECTORS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "rss": feed_items.judged,
    "json": json_items.judged,
    "scrape": html_items.judged,
}
#: Name under which pages are crawled.
AGENT = "tidewell"
REJECT = "source_id string, source_ord int, entry_ord bigint, reason string"


#: Marks at the start of a document and the encodings they stand for (fixed values), longest first.
_MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"<\x00?\x00", "utf-16-le"), (b"\x00<\x00?", "utf-16-be"))
#: Where XML and HTML declare one.
_DECLARED = re.compile(rb"""^\s*<\?xml\b[^>]*?\bencoding\s*=\s*["']([A-Za-z0-9._:-]+)["']|<meta\b[^>]*?\bcharset\s*=\s*["']?([A-Za-z0-9._:-]+)""", re.I)
_HEAD_BYTES = 2048


def _text_of(content: bytes) -> str:
    encoding = next((e for mark, e in _MARKS if content.startswith(mark)), None)
    if not encoding:
        found = _DECLARED.search(content[:_HEAD_BYTES])
        encoding = (found[1] or found[2]).decode() if found else "utf-8"
    try:
        return content.decode(encoding, "replace")
    except LookupError:  # an unknown name
        return content.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of whole documents: by byte-order mark, else as XML or HTML declares, else UTF-8; bytes that do not fit become U+FFFD."""
    return content.map(lambda x: None if x is None else _text_of(bytes(x)))


def scan(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Whole documents from files: ``path, payload``. Files without bytes have no row."""
    return spark.read.format("binaryFile").load(paths).select("path", decoded("content").alias("payload"))


def scan_table(landed: DataFrame) -> DataFrame:
    """Whole documents from a table of landed files (``path, content``, as Spark's reader of binary files has them): ``path, payload``.

    A file costs a few processes and renames where it is written, so many sources are landed as rows, few as files.
    """
    return landed.where(F.length("content") > 0).select("path", decoded("content").alias("payload"))


def of_registry(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Each source with the payload landed for its ``url`` (null where none is)."""
    def plain(path: Column) -> Column:
        return F.regexp_replace(path, "^file:/+", "/")

    landed = files.select(plain(F.col("path")).alias("_path"), "payload")
    return registry.join(landed, plain(F.col("url")) == F.col("_path"), "left").drop("_path")


def failure(type_: Column, payload: Column) -> Column:
    """Why a source as a whole yields nothing, as far as shows without parsing; empty otherwise."""
    return (
        F.when(~type_.isin(*CONNECTORS), F.concat(F.lit("unknown source type '"), type_, F.lit("'")))
        .when(payload.isNull() & (type_ != "rss"), common.short_reason(F.lit("FileNotFoundError"), F.lit("payload missing")))
        .otherwise("")
    )


def collect(sources: DataFrame, run_ts: Column, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items of all sources, rejected entries, and sources with their failure ``reason``.

    ``sources`` are registry rows with ``payload``. A source that fails, or an entry that is
    rejected, never takes others with it. With ``robots`` (``host, body``), a page whose host forbids
    it yields nothing, without being a failure. Every payload is parsed once: entries, and
    the failures that parsing finds, are written as a table and then split. Items carry ``source_ord, entry_ord, item_ord``.
    """
    judged = sources.withColumn("reason", failure(F.col("type"), F.col("payload")))
    open_pages = judged if robots is None else html_items.crawl_permission(judged, robots, AGENT).where("allowed or type <> 'scrape'").drop("allowed")
    columns = ["source_id", "source_ord", "entry_ord", "guid", "title", "published_at", "lang", "section", "url", "content", "reject"]
    parts = []
    for kind, connector in CONNECTORS.items():
        entries = connector(open_pages.where((F.col("type") == kind) & (F.col("reason") == "")), run_ts)
        entries = entries if "failure" in entries.columns else entries.withColumn("failure", F.lit(None).cast("string"))
        parts.append(entries.withColumn("entry_ord", F.col("entry_ord").cast("bigint")).select(*columns, "failure"))
    entries, _ = materialize(reduce(DataFrame.unionByName, parts), "entries")
    failed = entries.where("failure is not null").select("source_ord", "failure")
    judged = judged.drop("payload").join(failed, "source_ord", "left")
    return *common.split(entries), judged.withColumn("reason", F.coalesce("failure", "reason")).drop("failure")
