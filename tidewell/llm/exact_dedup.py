"""Exact deduplication as a stateful stream over content digests.

Arrivals are a slim log ``(row digest, stable id, content locator)``: texts never enter the
stream. A streaming aggregation keyed by digest keeps, in RocksDB and without a watermark (so
without expiry), the smallest document id, the row that brought the digest first (its delivery, id
and the locator of its content) and the number of rows. Spark sums per task before the shuffle,
so a digest that a third of all rows share costs one row per task.

Documents come in numbered deliveries, each one micro-batch. A delivery's hits, that is its rows
whose digest occurs more than once, are compared in full with the text of the row that brought
the digest first. That row never changes, so rows that equal it equal each other, whichever delivery
they came in; of earlier deliveries only the files are read that the locators of hits name. Rows
that differ (a digest collision) are grouped again by their whole text.

Production feeds call :func:`absorb` for every delivery, with a lasting folder: the state outlives
the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.tables import SPACE, join_groups, without
from tidewell.session import drop_path, materialize, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Set while a stream starts: disk-backed state with one memory bound for all stores of an executor.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}
#: The arrival log; ``delivery`` is its folder's number.
LOG = "doc_id long, text_sha256 string, locator string, digest string, delivery int"
#: Groups of copies, of about 150 bytes each, that are broadcast at most when hits are compared.
BROADCAST_GROUPS = 50_000


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def arrivals(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """The arrival log of documents ``doc_id, text, at``: ``doc_id, digest, locator`` (where the content lies) and ``text_sha256``."""
    hashed = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), F.col("at").alias("locator"))
    return hashed.withColumn("digest", F.left("text_sha256", F.lit(digest_chars)))


def ingest(log: DataFrame, state_dir: str, index_dir: str, trigger: dict | None = None, check: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run the stateful stream over the streaming arrival log until it has consumed what is there.

    Appends to ``index_dir``, for each micro-batch, the state of every digest it touched:
    ``digest, keep_id, delivery, first_id, locator, n, batch`` (the first arrival's delivery, id and
    locator), and then calls ``check`` with those that occurred more than once and the batch's
    number. Exactly-once: a replayed batch overwrites its own folder and is checked again. Settings
    of the state store are changed in the log's session while the stream runs, and put back.
    """
    spark = log.sparkSession
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    state = log.groupBy("digest").agg(F.min(least).alias("least"), F.min(F.struct("delivery", "doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("n"))
    changed = state.select("digest", F.col("least.doc_id").alias("keep_id"), "first.delivery", F.col("first.doc_id").alias("first_id"), "first.locator", "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{index_dir}/batch={number}")
        if check:
            check(spark.read.schema(batch.schema).parquet(f"{index_dir}/batch={number}").where("n > 1"), number)

    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        query = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state_dir).trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def absorb(fresh: DataFrame, contents: Callable[[list[str]], DataFrame], folder: str, delivery: int, digest_chars: int = 64) -> None:
    """Take one delivery of documents ``doc_id, text, at`` into the lasting tables and state of ``folder``.

    ``at`` is a file's locator; ``contents`` returns the documents, with the same columns, of the files
    whose locators it is given. It is asked only for files of earlier deliveries that hold the first
    text of a digest of this delivery. Their names come to the driver, as those of any table's files do.

    Deliveries are numbered upwards. One that failed is given again, under its number and before the
    next one: a log that was written whole is kept, the stream goes on where it stood, and nothing counts
    twice. Leaves ``arrivals`` (:func:`arrivals`), ``digests`` (:func:`digest_index`), ``collided``
    (digests under which texts differ) and ``state``.
    """
    spark, written = fresh.sparkSession, f"{folder}/arrivals/delivery={delivery}"
    if not _whole(spark, written):
        arrivals(fresh, digest_chars).write.mode("overwrite").parquet(written)

    def check(touched: DataFrame, number: int) -> None:
        differing(fresh, touched, contents, delivery, digest_chars).write.mode("overwrite").parquet(f"{folder}/collided/batch={number}")

    ingest(spark.readStream.schema(LOG).parquet(f"{folder}/arrivals"), f"{folder}/state", f"{folder}/digests", check=check)


def _whole(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def digest_index(spark: SparkSession, index_dir: str) -> DataFrame:
    """The last state of every digest: ``digest, keep_id, locator, n``."""
    written = spark.read.schema("digest string, keep_id long, n long, batch long").parquet(index_dir)
    return written.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "n")).alias("s")).select("digest", "s.keep_id", "s.n")


def by_file(docs: DataFrame) -> tuple[Callable[[list[str]], DataFrame], list[str]]:
    """A reader of ``doc_id, text, at`` by files, and all files of ``docs`` that hold rows, in order of their names.

    Spark prunes the scan to the files asked for. What is not read from files is written to the shared folder first.
    """
    slim = docs.select("doc_id", "text")
    try:
        placed = slim.withColumn("at", slim.metadataColumn("_metadata")["file_path"])
    except AnalysisException:
        slim, _ = materialize(slim, "contents")
        placed = slim.withColumn("at", slim.metadataColumn("_metadata")["file_path"])
    return lambda files: placed.where(F.col("at").isin(files)), sorted(r[0] for r in placed.select("at").distinct().collect())


def exact_dedup(docs: DataFrame, digest_chars: int = 64, files_per_batch: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after :func:`normalised`; of equal texts the smallest
    ``doc_id`` stays. Null and empty texts are equal to each other. A row that repeats with
    the same ``doc_id`` and text counts in ``group_size``, and every such row says ``kept``.
    A null ``doc_id`` comes after all others: such rows stay only where their text has no named
    row. Other columns are ignored. An empty table gives an empty result.
    ``digest_chars`` shortens the state's key (hex digits of SHA-256); a short key costs
    comparisons and never merges texts that differ. ``files_per_batch`` cuts the table into deliveries of
    so many files, of which each reads its own rows and the files that :func:`absorb` names; without it the whole
    table is one delivery.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "exact")
    if files_per_batch:
        contents, files = by_file(docs)
        parts = [contents(files[i : i + files_per_batch]) for i in range(0, len(files), files_per_batch)] or [contents([])]
    else:
        whole = docs.select("doc_id", "text", F.input_file_name().alias("at"))
        parts, contents = [whole], lambda files: whole
    for number, part in enumerate(parts):
        absorb(part, contents, folder, number, digest_chars)
    docs, log = docs.select("doc_id", "text"), spark.read.schema(LOG).parquet(f"{folder}/arrivals").drop("delivery")
    groups, _ = materialize(digest_index(spark, f"{folder}/digests").where("n > 1"), "groups")
    for used in ("state", "digests"):
        drop_path(spark, f"{folder}/{used}")

    collided = spark.read.schema("digest string, batch long").parquet(f"{folder}/collided").select("digest").distinct()
    any_collided, rows = bool(collided.take(1)), log.drop("locator")
    if any_collided:
        rows, groups = rows.join(collided, "digest", "left_anti"), groups.join(collided, "digest", "left_anti")
    found = join_groups(rows, groups.select("digest", "keep_id", "n"), "digest", log.count(), ["doc_id"]).select("doc_id", "keep_id", "n", "text_sha256")
    if any_collided:
        body = normalised(F.col("text"))
        those = docs.select("doc_id", body.alias("body"), F.left(F.sha2(body, 256), F.lit(digest_chars)).alias("digest")).join(collided, "digest", "left_semi")
        own = those.groupBy("body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        found = found.unionByName(join_groups(those, own, "body", log.count(), ["doc_id"]).select("doc_id", "keep_id", "n", F.sha2("body", 256).alias("text_sha256")))
    keep = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def differing(fresh: DataFrame, groups: DataFrame, contents: Callable[[list[str]], DataFrame], delivery: int, digest_chars: int = 64) -> DataFrame:
    """The digests (``digest``) of ``groups`` under which whole texts of ``fresh`` differ from each other or from the first one.

    ``groups`` is what :func:`ingest` writes. Texts of a group in ``fresh``, and the text that the group's
    locator names where it lies in a file of an earlier delivery, are compared in full: they are equal
    where the least and the greatest are. A first text that is not found counts as different. Tasks compare before the shuffle, so of a hot digest each
    sends one row. Only texts of hits are shuffled where the groups are few enough to be broadcast
    (checked by count); beyond that texts join by digest, hot digests salted.
    """
    size = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    total, body = size[1] or 0, normalised(F.col("text"))
    named = [r[0] for r in groups.where(F.col("delivery") < delivery).select("locator").distinct().collect()]

    def hits(docs: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", "at", body.alias("body")).withColumn("digest", F.left(F.sha2("body", 256), F.lit(digest_chars)))
        if size[0] <= BROADCAST_GROUPS:
            return rows.join(F.broadcast(groups), "digest")
        return join_groups(rows, groups, "digest", total, ["doc_id", "at"]).where("n is not null")

    found = hits(fresh).select("digest", "body", (F.col("delivery") < delivery).alias("awaited"), F.lit(False).alias("came"))
    if named:
        first = hits(contents(named)).where("doc_id <=> first_id and at = locator")
        found = found.unionByName(first.select("digest", "body", F.lit(True).alias("awaited"), F.lit(True).alias("came")))
    compared = found.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"), F.max("awaited").alias("awaited"), F.max("came").alias("came"))
    return compared.where("least <> most or (awaited and not came)").select("digest")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less copies: of equal texts one row stays, that of the smallest ``doc_id``.

    Rows without an id stay only where their text has no named row, and then one of them. Of rows
    that repeat with id and text one stays. An empty table stays empty.
    """
    found, _ = materialize(exact_dedup(docs).select("doc_id", F.xxhash64("text_sha256").alias("version"), "kept"), "verdicts")
    twins = found.where("kept").groupBy("doc_id", "version").count().where("count > 1").drop("count")
    return without(docs, F.xxhash64(F.sha2(normalised(F.col("text")), 256)), found.where("not kept").select("doc_id", "version").distinct(), twins)
