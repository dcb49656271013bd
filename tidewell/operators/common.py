"""What the connectors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.session import materialize

#: Columns of a source that its entries carry.
SOURCE_COLUMNS = ("source_ord", "id", "url", "lang", "section", "mapping", "root_path", "url_template", "selector", "base_url")


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


#: Bits of an item's number that hold its entry's; a payload, being one text, has fewer entries.
ENTRY_BITS = 32


def item_ord(source_ord: Column, entry_ord: Column, entry_bits: int = ENTRY_BITS) -> Column:
    """Place in registry order, then entry order, as one number. Every int fits as ``source_ord``.

    With other ``entry_bits`` the rest is the source's. Numbers that do not fit raise an error, for they would change the order.
    """
    source, entry = source_ord.cast("bigint"), entry_ord.cast("bigint")
    most = 1 << (63 - entry_bits)
    fits = entry.between(0, (1 << entry_bits) - 1) & source.between(-most, most - 1)
    return F.when(fits, F.shiftleft(source, entry_bits) + entry).when(source.isNotNull() & entry.isNotNull(), F.raise_error(F.lit("source_ord or entry_ord is out of range")))


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Add each row's dense place, from 0, in the order of columns that tell all rows apart.

    Rows are range partitioned and sorted once; the sizes of the partitions, one number each, say where each one begins.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ordered, _ = materialize(ordered, "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = ordered.select("*", part).join(F.broadcast(starts), "_part")
    return placed.select(*rows.columns, (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def short_reason(kind: Column, message: Column) -> Column:
    """First line of a failure's message, cut to 110 characters, after its kind."""
    line = F.trim(F.substring_index(message, "\n", 1))
    return F.concat(kind, F.lit(": "), F.when(F.length(line) > 110, F.concat(F.left(line, F.lit(107)), F.lit("..."))).otherwise(line))


def as_items(entries: DataFrame) -> DataFrame:
    """Project accepted entries to ordered items."""
    return entries.withColumn("item_ord", item_ord(F.col("source_ord"), F.col("entry_ord"))).select(*[F.col(f.name).cast(f.dataType) for f in schemas.ORDERED_ITEM.fields])


def split(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (no ``reject``) and rejected entries; rows that only say that a source failed are neither."""
    entries = entries.where("entry_ord is not null")
    bad = entries.where("reject is not null").select("source_id", "source_ord", F.col("entry_ord").cast("bigint").alias("entry_ord"), F.col("reject").alias("reason"))
    return as_items(entries.where("reject is null")), bad
