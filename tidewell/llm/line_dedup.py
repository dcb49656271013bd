"""Line deduplication by winnowing over line hashes, in SQL functions.

Lines are compared with white space collapsed; blank lines do not count. ``GRAM`` = 2 successive
lines make a gram, keyed by both line hashes. Of each ``WINDOW`` successive grams the one with
the smallest hash (the rightmost of ties) is a fingerprint, so documents that share
``GRAM + WINDOW - 1`` lines share a fingerprint inside the shared run; a line of ``LONG_WORDS``
words is a fingerprint of its own.

A fingerprint joins the first place of its gram (smallest document, then position). That is
an aggregation with map-side combine and one row per distinct gram, never pairs of places, so
a passage that a third of all documents hold stays linear; places join first places with hot grams salted.
A join gives a diagonal: two documents and the difference of places. Along it the match is extended both
ways: grams that follow one another in both documents are a run (their positions less their number agree), and a
run that holds a fingerprint is deleted at the later place. Rows stay one per matched place, however long texts are.

Runs shorter than the guaranteed length, and the parts of a run that occurred earlier in other
places than its fingerprints' first ones, need not lie on such a diagonal. So an exact check
follows: the other grams are deleted where their own gram has an earlier place. In the end a line is deleted
exactly if it is long, or in a gram, and that occurred at an earlier place. For this all grams, not only
fingerprints, must meet the first place of their own (README gives figures).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.tables import SPACE, join_groups, whole_text
from tidewell.session import materialize

#: Lines of a gram, grams of a window, and words of a line that is a fingerprint alone.
GRAM, WINDOW, LONG_WORDS = 2, 3, 50


def _lines(text: Column) -> Column:
    """Lines that are not blank: ``array<struct<at, h, check, long>>`` (two hashes of 64 and 32 bits)."""
    def line(body: Column, at: Column) -> Column:
        words = F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1
        return F.struct(at.alias("at"), F.xxhash64(body).alias("h"), F.crc32(body).alias("check"), (words >= LONG_WORDS).alias("long"), (body != "").alias("some"))

    bodies = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, f"{SPACE}+", " ")))
    return F.filter(F.transform(bodies, line), lambda x: x["some"])


def _places(lines: Column) -> Column:
    """All grams and long lines: ``array<struct<i, at, last_at, a, b, lone, picked>>``; ``picked`` are the fingerprints."""
    def gram(i: Column) -> Column:
        one, two = F.get(lines, i), F.get(lines, i + 1)
        order = F.struct(F.xxhash64(one["h"], two["h"]).alias("w"), (-i).alias("back"))
        return F.struct(i.alias("i"), one["at"].alias("at"), two["at"].alias("last_at"), one["h"].alias("a"), two["h"].alias("b"), order.alias("order"))

    def chosen(grams: Column) -> Column:
        last = F.greatest(F.size(grams) - WINDOW, F.lit(0))
        least = F.transform(F.sequence(F.lit(0), last), lambda s: F.array_min(F.transform(F.slice(grams, s + 1, F.lit(WINDOW)), lambda g: g["order"])))

        def picks(minima: Column) -> Column:
            def is_picked(g: Column, i: Column) -> Column:
                windows = F.sequence(F.least(F.greatest(i - WINDOW + 1, F.lit(0)), last), F.least(i, last))
                return F.exists(windows, lambda s: F.get(minima, s) == g["order"])

            return F.transform(grams, lambda g, i: F.struct(g["i"], g["at"], g["last_at"], g["a"], g["b"], F.lit(False).alias("lone"), is_picked(g, i).alias("picked")))

        return F.element_at(F.transform(F.array(least), picks), 1)

    grams = F.element_at(F.transform(F.array(F.transform(F.sequence(F.lit(0), F.size(lines) - GRAM), gram)), chosen), 1)
    none = F.array().cast("array<struct<i:int,at:int,last_at:int,a:bigint,b:bigint,lone:boolean,picked:boolean>>")
    alone = F.filter(F.transform(lines, lambda x, i: F.when(x["long"], F.struct(i.alias("i"), x["at"].alias("at"), x["at"].alias("last_at"), x["h"].alias("a"), x["check"].alias("b"), F.lit(True).alias("lone"), F.lit(True).alias("picked")))), lambda x: x.isNotNull())
    return F.concat(F.when(F.size(lines) >= GRAM, grams).otherwise(none), alone)


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per distinct ``doc_id, version`` (hash of the text): its number of lines, and what is deleted.

    Returns ``(doc_id, version, n_lines)`` and ``(doc_id, version, deleted, n_extended)``; ``deleted`` are
    positions among all lines, ascending, ``n_extended`` of them in runs that hold a fingerprint, and
    rows without deletions are absent there. Rows with
    a null ``doc_id`` neither lose lines nor count as an earlier place.
    """
    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64(whole_text()).alias("version"), _lines(whole_text()).alias("lines"))
    lines, _ = materialize(keyed, "lines")
    lines = lines.dropDuplicates(["doc_id", "version"])
    places = lines.select("doc_id", "version", F.explode(_places(F.col("lines"))).alias("p"))
    places, _ = materialize(places.select("doc_id", "version", "p.i", "p.at", "p.last_at", F.struct("p.a", "p.b", "p.lone").alias("gram"), "p.picked"), "places")
    first = places.groupBy("gram").agg(F.min(F.struct("doc_id", "version", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first, _ = materialize(first, "firsts")
    joined = join_groups(places, first, "gram", places.count(), ["doc_id", "version", "i"]).where("first is not null")
    later = joined.where("not (doc_id = first.doc_id and version = first.version and i = first.i)")
    later = later.select("doc_id", "version", "i", "at", "last_at", "picked", F.col("first.doc_id").alias("first_id"), F.col("first.version").alias("first_version"), (F.col("first.i") - F.col("i")).alias("shift"), F.col("gram.lone").alias("lone"))

    diagonal = ["doc_id", "version", "first_id", "first_version", "shift", "lone"]
    run = F.col("i") - F.row_number().over(W.partitionBy(*diagonal).orderBy("i"))
    in_runs = later.withColumn("run", run).withColumn("extended", F.max("picked").over(W.partitionBy(*diagonal, "run")))
    gone = in_runs.select("doc_id", "version", F.explode(F.array("at", "last_at")).alias("at"), "extended")
    gone = gone.groupBy("doc_id", "version", "at").agg(F.max("extended").alias("extended"))
    deleted = gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("at")).alias("deleted"), F.count_if("extended").alias("n_extended"))
    return lines.select("doc_id", "version", F.size("lines").alias("n_lines")), deleted


def line_dedup(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with repeated runs deleted from ``text``, and ``deleted`` (line positions).

    Null and empty texts stay as they are, with none deleted; a text all of whose lines are
    deleted becomes empty. Repeated rows (same ``doc_id`` and text) are one place, so they do
    not delete each other. A column named ``deleted`` is replaced. An empty table stays empty.
    """
    _, deleted = repeated_lines(docs)
    keyed = docs.drop("deleted").withColumn("_version", F.xxhash64(whole_text()))
    joined = keyed.join(deleted.drop("n_extended").withColumnRenamed("version", "_version"), ["doc_id", "_version"], "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted"))
    kept = F.element_at(F.transform(F.array(lines), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")), 1)
    out = joined.withColumn("text", F.when(F.col("deleted").isNull(), F.col("text")).otherwise(kept))
    return out.withColumn("deleted", F.coalesce("deleted", F.array().cast("array<int>"))).select(*[c for c in docs.columns if c != "deleted"], "deleted")


#: The goal: a line goes if it is long, or one of two successive lines, and that has an earlier place.
ORACLE_SQL = rf"""
WITH raw AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
body AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS b FROM raw),
ln AS (SELECT doc_id, pos, b, lead(b) OVER w AS next_b, lead(pos) OVER w AS next_pos FROM body WHERE b <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
seen AS (SELECT doc_id, pos, next_pos AS last_pos, b || chr(10) || next_b AS what FROM ln WHERE next_b IS NOT NULL
         UNION ALL SELECT doc_id, pos, pos, b FROM ln WHERE length(b) - length(replace(b, ' ', '')) + 1 >= {LONG_WORDS}),
again AS (SELECT doc_id, pos, last_pos FROM seen QUALIFY row_number() OVER (PARTITION BY what ORDER BY doc_id, pos) > 1),
gone AS (SELECT doc_id, pos FROM again UNION SELECT doc_id, last_pos FROM again),
kept AS (SELECT r.doc_id, string_agg(line, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL) AS t, count(g.pos) AS n_deleted, string_agg(g.pos::VARCHAR, ',' ORDER BY g.pos) AS deleted
         FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY r.doc_id)
SELECT doc_id, n_deleted::BIGINT AS n_deleted, coalesce(deleted, '') AS deleted, sha256(coalesce(t, '')) AS kept_sha256 FROM kept
"""
