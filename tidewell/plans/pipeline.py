"""The whole run: sources with payloads to retained items and reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators import linkage, report
from tidewell.session import materialize
from tidewell.sources import payloads


class Run(NamedTuple):
    items: DataFrame
    source_report: DataFrame
    dedup_report: DataFrame
    quarantine: DataFrame


def run(sources: DataFrame | None, run_ts: Column, spark: SparkSession | None = None, robots: DataFrame | None = None) -> Run:
    """Collect, link and report. ``sources`` are registry rows with ``payload``; None (no configuration) gives empty results.

    ``robots`` (``host, body``) holds landed crawl rules; without it every page is allowed.

    Retained items carry ``first_ord``, by which they are ordered.
    """
    if sources is None:
        empty = [spark.createDataFrame([], s) for s in (schemas.ORDERED_ITEM, schemas.SOURCE_REPORT, schemas.DEDUP_REPORT)]
        return Run(*empty, spark.createDataFrame([], payloads.REJECT))
    items, rejects, judged = payloads.collect(sources, run_ts, robots)
    judged, _ = materialize(judged, "judged")  # failures are found by parsing payloads
    linked = linkage.link(items, linkage.last_priorities(judged))
    return Run(linked.retained, report.source_report(judged, items, linked.retained, run_ts), linked.report, rejects)


def contract(items: DataFrame) -> DataFrame:
    """``item_ord, problem`` of items that break the canonical row: a null field. Instants are UTC by type."""
    names = [f.name for f in schemas.ITEM.fields]
    problems = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.concat(F.lit(n), F.lit(" is null"))) for n in names]))
    return items.select("item_ord", F.explode(problems).alias("problem"))
