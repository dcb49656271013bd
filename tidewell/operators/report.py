"""What each source produced: counts, states, ranking, report lines and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An item published this near to the start of the run has an approximate date.
APPROXIMATE_MICROS = 90_000_000
STATES = ("failed", "silent", "absorbed", "ok")


def is_approximate(published_at: Column, run_ts: Column) -> Column:
    return F.abs(F.unix_micros(published_at) - F.unix_micros(run_ts)) <= APPROXIMATE_MICROS


def approximate_dates(items: DataFrame, run_ts: Column) -> DataFrame:
    return items.groupBy("source_id").agg(F.count_if(is_approximate(F.col("published_at"), run_ts)).alias("n_approximate"))


def state(reason: Column, collected: Column, retained: Column) -> Column:
    return F.when(reason != "", "failed").when(collected == 0, "silent").when(retained == 0, "absorbed").otherwise("ok")


def source_report(registry: DataFrame, collected: DataFrame, retained: DataFrame, run_ts: Column) -> DataFrame:
    """One row per declared source. ``registry`` is ``source_ord, id, type, reason``.

    Each declaration has a row. Of an id declared twice, each declaration counts what it collected;
    the retained items of the id, which linkage knows by id alone, stand in both rows.
    """
    counts = collected.groupBy("source_ord").agg(F.count(F.lit(1)).alias("n_collected"), F.count_if(is_approximate(F.col("published_at"), run_ts)).alias("n_approximate"))
    kept = retained.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_retained"))
    rows = registry.select("source_ord", F.col("id").alias("source_id"), "type", F.coalesce("reason", F.lit("")).alias("reason"))
    rows = rows.join(counts, "source_ord", "left").join(kept, "source_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_collected", "n_retained", "n_approximate")}
    return rows.select("source_ord", "source_id", "type", *[v.alias(k) for k, v in n.items()], "reason", state(F.col("reason"), n["n_collected"], n["n_retained"]).alias("state"))


def in_state(report: DataFrame, wanted: str) -> DataFrame:
    return report.where(F.col("state") == wanted)


def ranking() -> list[Column]:
    """Most retained first, then most collected, then registry order."""
    return [F.desc("n_retained"), F.desc("n_collected"), F.asc("source_ord")]


def _status() -> Column:
    """Text of a state; the wording of report lines is fixed."""
    def count(column: str) -> Column:
        return F.col(column).cast("string")

    ok = F.concat(
        count("n_retained"), F.lit(" item(s)"),
        F.when(F.col("n_retained") != F.col("n_collected"), F.concat(F.lit(" ("), count("n_collected"), F.lit(" collected)"))).otherwise(""),
        F.when(F.col("n_approximate") > 0, F.concat(F.lit(" ("), count("n_approximate"), F.lit(" without a usable date)"))).otherwise(""),
    )
    return (
        F.when(F.col("state") == "failed", F.concat(F.lit("FAILED - "), "reason"))
        .when(F.col("state") == "silent", "SILENT - no item, no error")
        .when(F.col("state") == "absorbed", F.concat(F.lit("ABSORBED - "), count("n_collected"), F.lit(" collected, 0 retained")))
        .otherwise(ok)
    )


def totals(report: DataFrame) -> DataFrame:
    """One row ``sources, collected, retained``: declarations, and items. Retained items of an id declared twice count once."""
    by_id = report.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_collected").alias("c"), F.max("n_retained").alias("r"))
    return by_id.agg(*[F.coalesce(F.sum(a), F.lit(0)).cast("bigint").alias(b) for a, b in (("n", "sources"), ("c", "collected"), ("r", "retained"))])


def report_lines(report: DataFrame, summary: DataFrame) -> DataFrame:
    """``part, n_retained, n_collected, source_ord, line``; in the order of part and ranking they read as a report."""
    none = [F.lit(0).cast("bigint").alias("n_retained"), F.lit(0).cast("bigint").alias("n_collected"), F.lit(0).alias("source_ord")]
    total = totals(report).withColumnsRenamed({"retained": "r", "collected": "c"})
    head = F.format_string("Collection: %d item(s) from %d source(s)", "r", "sources")
    more = F.when(F.col("c") > F.col("r"), F.concat(head, F.format_string(" - %d collected, %d duplicate(s) removed", F.col("c"), F.col("c") - F.col("r")))).otherwise(head)
    header = total.select(F.lit(0).alias("part"), *none, F.when(F.col("sources") == 0, "No source configured.").otherwise(more).alias("line"))
    body = report.select(F.lit(1).alias("part"), "n_retained", "n_collected", "source_ord", F.concat(F.format_string("  %-22s [%-6s] ", "source_id", "type"), _status()).alias("line"))
    foot = summary.where(~F.col("line").startswith("Deduplication: no")).select(F.lit(2).alias("part"), *none, F.concat(F.lit("  "), "line").alias("line"))
    return header.unionByName(body).unionByName(foot)


def alerts(report: DataFrame) -> DataFrame:
    """``source_id, alert, n``: silent sources, absorbed ones, and those none of whose items has a date."""
    kinds = F.array_compact(F.array(
        F.when(F.col("state") == "silent", F.struct(F.lit("silent").alias("alert"), F.lit(0).cast("bigint").alias("n"))),
        F.when(F.col("state") == "absorbed", F.struct(F.lit("absorbed").alias("alert"), F.col("n_collected").alias("n"))),
        F.when((F.col("n_approximate") == F.col("n_collected")) & (F.col("n_collected") > 0), F.struct(F.lit("undated").alias("alert"), F.col("n_collected").alias("n"))),
    ))
    return report.select("source_id", F.explode(kinds).alias("a")).select("source_id", "a.alert", "a.n")


def conservation(report: DataFrame, losers: DataFrame) -> DataFrame:
    """One row: retained plus losers make up what was collected."""
    nothing = F.lit(0).cast("bigint")
    sides = totals(report).select("collected", "retained", nothing.alias("losers")).unionByName(losers.select(nothing.alias("collected"), nothing.alias("retained"), "losers"))
    sums = sides.agg(*[F.coalesce(F.sum(c), nothing).alias(c) for c in ("collected", "retained", "losers")])
    return sums.withColumn("holds", F.col("retained") + F.col("losers") == F.col("collected"))
