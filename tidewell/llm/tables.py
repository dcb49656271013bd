"""Input tables, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a training corpus table holds.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Java and Python form of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has at most ``rows`` rows and, beyond one row, ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(text).to_pylist()]


def with_fields(schema: StructType, added: str) -> StructType:
    """A copy of ``schema`` with the fields of a DDL string after it."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])


def bounded_sample(df: DataFrame, key: str, limit: int, salt: int = 0) -> DataFrame:
    """At most ``limit`` rows, those whose hashed key is smallest; the same rows however the table is split.

    A threshold on the hash leaves about a quarter more than ``limit`` rows to sort, so what
    tasks send on does not grow with the number of tasks.
    """
    hashed = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 40))
    n = df.count()
    if n > limit:
        df = df.where(hashed < int((1 << 40) * min(1.0, (1.25 * limit + 100) / n)))
    return df.orderBy(hashed, key).limit(limit)


#: A key of more than one in so many of all rows is hot; so at most as many keys are.
HOT = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, by: list[str], sized: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` with ``groups``, which has one row per ``key`` and its number ``n`` of rows.

    Hot keys are salted: their rows are dealt by a hash of the columns ``by``, their group is
    repeated per salt. With ``total`` rows in all, at most ``HOT`` keys are hot, so what says
    which ones is broadcast, and at most twice as many rows are added. ``sized`` may give keys and
    numbers from a table that is cheaper to read.
    """
    least = max(1, total // HOT)
    width = F.greatest(F.ceil(F.col("n") / least), F.lit(1)).cast("int")
    hot = (groups if sized is None else sized).where(F.col("n") > least).select(key, width.alias("_width"))
    salted = rows.join(F.broadcast(hot), key, "left")
    salted = salted.withColumn("_salt", F.when(F.col("_width").isNotNull(), F.pmod(F.xxhash64(*by), F.col("_width"))).otherwise(0).cast("int")).drop("_width")
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > least, width).otherwise(1) - 1)))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")


#: Rows (24 bytes each) that say what is dropped and are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def without(docs: DataFrame, version: Column, dropped: DataFrame, twins: DataFrame) -> DataFrame:
    """``docs`` without the rows in ``dropped``; of the rows in ``twins``, one each stays.

    Both name rows by ``doc_id`` (null equals null) and ``version``, a 64-bit hash of the text, so
    rows that share an id and differ in text are told apart. Twins are rows of which there
    are several; which one stays is not defined where their other columns differ.
    """
    keyed = docs.withColumn("_version", version)

    def same(named: DataFrame):
        return keyed["doc_id"].eqNullSafe(named["doc_id"]) & (keyed["_version"] == named["version"])

    few = dropped.count() <= BROADCAST_ROWS
    keyed = keyed.join(F.broadcast(dropped) if few else dropped, same(dropped), "left_anti")
    if twins.take(1):
        once = keyed.join(twins, same(twins), "left_semi").dropDuplicates(["doc_id", "_version"])
        keyed = keyed.join(twins, same(twins), "left_anti").unionByName(once)
    return keyed.select(*docs.columns)
