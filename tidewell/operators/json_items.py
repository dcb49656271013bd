"""JSON payloads to items, by the paths that a source declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates, urls
from tidewell.operators import common


def path(dotted: Column) -> Column:
    """A path through objects for the variant functions; null for empty ones and for names with quotes or brackets."""
    steps = F.transform(F.split(dotted, "[.]"), lambda x: F.concat(F.lit("['"), x, F.lit("']")))
    return F.when((dotted != "") & ~F.rlike(dotted, F.lit(r"['\"\[\]]")), F.concat(F.lit("$"), F.array_join(steps, "")))


def at(value: Column, dotted: Column) -> Column:
    """The variant at a dotted path; null where something on the way is missing, null or no object."""
    return F.try_variant_get(value, path(dotted), "variant")


def root(whole: Column, root_path: Column) -> Column:
    """What stands at ``root_path`` (empty: the whole) of a parsed payload, as a variant."""
    return F.when(F.coalesce(root_path, F.lit("")) == "", whole).otherwise(at(whole, root_path))


def field(entry: Column, mapping: Column, name: str) -> Column:
    """A mapped field; null if the mapping lacks it."""
    return at(entry, F.try_element_at(mapping, F.lit(name)))


def kind(value: Column) -> Column:
    """``string, number, boolean, object, array, void`` of a variant; null is void."""
    s = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (s == "VOID"), "void")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, F.lit("$"), "string")


def truthy_text(value: Column) -> Column:
    """Text of a value; empty for null, zero, false and empty ones."""
    s = as_text(value)
    number = F.try_variant_get(value, F.lit("$"), "double")
    empty = (kind(value) == "void") | ((kind(value) == "number") & (number == 0)) | ((kind(value) == "boolean") & (s == "false")) | s.isin("[]", "{}") & kind(value).isin("array", "object")
    return F.when(empty, "").otherwise(F.coalesce(s, F.lit("")))


def instant(value: Column, run_ts: Column) -> Column:
    """Publication time: a number is an epoch, text is ISO 8601; what cannot be read is ``run_ts``."""
    number = F.try_variant_get(value, F.lit("$"), "double")
    return F.coalesce(F.when(kind(value) == "number", dates.epoch(number)).when(kind(value) == "string", dates.iso(as_text(value))), run_ts)


def template_url(template: Column, guid: Column) -> Column:
    return F.replace(F.replace(F.replace(template, F.lit("{guid}"), urls.percent_encode(guid)), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def bad_template(template: Column) -> Column:
    """A template that names anything but ``guid``."""
    return F.rlike(F.regexp_replace(template, r"\{guid\}|\{\{|\}\}", ""), F.lit("[{}]"))


def _listed(sources: DataFrame) -> DataFrame:
    """Sources with their ``list``, and ``failure`` where the payload is no JSON. A payload is parsed here, once."""
    parsed = sources.select(*common.SOURCE_COLUMNS, F.try_parse_json("payload").alias("whole"))
    failure = F.when(F.col("whole").isNull(), common.short_reason(F.lit("JSONDecodeError"), F.lit("payload is not JSON")))
    return parsed.select(*common.SOURCE_COLUMNS, root(F.col("whole"), F.col("root_path")).alias("list"), failure.alias("failure"))


def _exploded(listed: DataFrame) -> DataFrame:
    """One row per entry of a list, in order, and one without ``entry_ord`` for a source whose payload failed.

    A list is walked, not copied into an array. Entries of an object, which have a key, are none; other values have no entries.
    """
    walked = listed.lateralJoin(listed.sparkSession.tvf.variant_explode_outer(F.col("list").outer())).where("(pos is not null and key is null) or failure is not null")
    rows = walked.select(*common.SOURCE_COLUMNS, "failure", F.col("pos").alias("entry_ord"), F.col("value").alias("entry"))
    return rows.withColumnRenamed("id", "source_id").withColumn("source_url", F.col("url")).drop("url")


def entries(sources: DataFrame) -> DataFrame:
    """Payload lists to one row per entry, in order."""
    return _exploded(_listed(sources)).where("failure is null").drop("failure")


def project(rows: DataFrame, run_ts: Column) -> DataFrame:
    """Item columns of each entry, and why it is rejected."""
    def get(name: str) -> Column:
        return field(F.col("entry"), F.col("mapping"), name)

    values = rows.select("*", get("guid").alias("_guid"), get("title").alias("_title"), get("published_at").alias("_published"), get("content").alias("_content"), get("url").alias("_url"))
    guid, template = as_text(F.col("_guid")), common.text(F.col("url_template"))
    reject = (
        F.when((kind(F.col("_guid")) == "void") | (guid == ""), "no usable identifier")
        .when(kind(F.col("_guid")).isin("object", "array"), F.concat(F.lit("identifier is an "), kind(F.col("_guid"))))
        .when(bad_template(template), "invalid URL template")
    )
    return values.select(
        "source_id", "source_ord", "entry_ord", guid.alias("guid"), truthy_text(F.col("_title")).alias("title"),
        instant(F.col("_published"), run_ts).alias("published_at"), "lang", "section",
        F.when(template != "", template_url(template, guid)).otherwise(truthy_text(F.col("_url"))).alias("url"),
        truthy_text(F.col("_content")).alias("content"), reject.alias("reject"), *(["failure"] if "failure" in rows.columns else []),
    )


def judged(sources: DataFrame, run_ts: Column) -> DataFrame:
    """Every entry of the lists, accepted or with its ``reject``; and one row with its ``failure`` for each payload that is no JSON."""
    return project(_exploded(_listed(sources)), run_ts)


def items(sources: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    return common.split(judged(sources, run_ts))
