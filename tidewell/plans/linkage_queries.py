"""Linkage and report queries over documents seen as items, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import linkage, report
from tidewell.plans import views
from tidewell.plans.views import CLASSES_SQL, ITEMS_SQL


def _linked(spark: SparkSession, sf_dir: str) -> linkage.Linked:
    return linkage.link(views.items(spark, sf_dir), linkage.last_priorities(views.registry(spark, sf_dir)))


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, linkage.Linked]:
    linked = _linked(spark, sf_dir)
    kept = linked.members.where("item_ord = winner_ord").select("source_id")
    return report.source_report(views.registry(spark, sf_dir), views.items(spark, sf_dir), kept, views.run_ts()), linked


def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pages(spark, sf_dir).select("page_id", urls.normalise(F.col("url")).alias("url_key"))


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.identity_keys(views.items(spark, sf_dir))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.classes(views.items(spark, sf_dir))


def retained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _linked(spark, sf_dir).retained
    return kept.select("first_ord", "item_ord", "source_id", "guid", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "lang", "url", F.md5("content").alias("content_md5"))


def dedup_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).report.where("losers > 0").select("source_id", "losers")


def dedup_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).report.where("winners > 0").select("source_id", "winners")


def dedup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.total_losers(_linked(spark, sf_dir).report)


def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.summary(_linked(spark, sf_dir).report)


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)[0].select("source_ord", "source_id", "n_collected", "n_retained")


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)[0].select("source_id", "type", "reason", "state")


def state_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir)[0]
    parts = [report.in_state(rows, s).select(F.lit(s).alias("list"), "source_id") for s in ("failed", "silent", "absorbed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def approx_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("entry_ord") % 7 == 0, views.run_ts()).otherwise(F.col("published_at"))
    return report.approximate_dates(views.items(spark, sf_dir).withColumn("published_at", late), views.run_ts())


def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = views.registry(spark, sf_dir)
    again = registry.where("source_ord < 3").withColumn("source_ord", F.col("source_ord") + 2000).withColumn("priority", F.lit(7))
    return linkage.last_priorities(registry.unionByName(again))


def report_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in report order. The ranked table has one row per declared source, a dimension that one task sorts."""
    rows = _report(spark, sf_dir)[0]
    return rows.select("source_id", F.row_number().over(W.orderBy(*report.ranking())).cast("bigint").alias("rank"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, linked = _report(spark, sf_dir)
    return report.report_lines(rows, linkage.summary(linked.report))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.alerts(_report(spark, sf_dir)[0])


def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, linked = _report(spark, sf_dir)
    return report.conservation(rows, linked.report)


def _twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, linkage.Linked]:
    """Every source declared twice: items of odd places come from the second declaration."""
    linked, known = _linked(spark, sf_dir), views.registry(spark, sf_dir)
    items = views.items(spark, sf_dir).withColumn("source_ord", F.col("source_ord") + (F.col("entry_ord") % 2 * 5000).cast("int"))
    both = known.unionByName(known.withColumn("source_ord", F.col("source_ord") + 5000))
    return report.source_report(both, items, linked.members.where("item_ord = winner_ord").select("source_id"), views.run_ts()), linked


def twice_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir)[0].select("source_ord", "source_id", "n_collected", "n_retained", "n_approximate", "state")


def twice_declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, linked = _twice(spark, sf_dir)
    return report.conservation(rows, linked.report)


def twice_declared_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, linked = _twice(spark, sf_dir)
    return report.report_lines(rows, linkage.summary(linked.report)).where("part = 0").select("line")


_SUMMARY = """
SELECT CASE WHEN coalesce((SELECT sum(losers) FROM lost), 0) = 0 THEN 'Deduplication: no duplicates.' ELSE
  'Deduplication: ' || (SELECT sum(losers) FROM lost)::VARCHAR || ' duplicate(s) removed - removed: '
  || (SELECT string_agg(source_id || ' (-' || losers || ')', ', ' ORDER BY losers DESC, source_id) FROM lost) || ' | absorbed by: '
  || (SELECT string_agg(source_id || ' (+' || winners || ')', ', ' ORDER BY winners DESC, source_id) FROM won) END AS line
"""
_REPORT = CLASSES_SQL + """,
rep AS (SELECT r.source_ord, r.id AS source_id, r.type, r.reason, coalesce(c.n, 0) AS n_collected, coalesce(k.n, 0) AS n_retained, coalesce(c.late, 0) AS n_approximate,
  CASE WHEN r.reason <> '' THEN 'failed' WHEN coalesce(c.n, 0) = 0 THEN 'silent' WHEN coalesce(k.n, 0) = 0 THEN 'absorbed' ELSE 'ok' END AS state
  FROM registry r LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (abs(epoch_us(published_at) - epoch_us(TIMESTAMP '2024-06-01')) <= 90000000) AS late FROM items GROUP BY 1) c ON c.source_id = r.id
  LEFT JOIN (SELECT source_id, count(*) AS n FROM ranked WHERE place = 1 GROUP BY 1) k ON k.source_id = r.id)
"""
_TWICE = CLASSES_SQL + """,
decl AS (SELECT * FROM registry UNION ALL SELECT source_ord + 5000, id, type, priority, reason FROM registry),
found AS (SELECT source_ord + 5000 * (entry_ord % 2) AS source_ord, count(*) AS n, count(*) FILTER (abs(epoch_us(published_at) - epoch_us(TIMESTAMP '2024-06-01')) <= 90000000) AS late FROM items GROUP BY 1),
kept AS (SELECT source_id, count(*) AS n FROM ranked WHERE place = 1 GROUP BY 1)
"""
SQL = {
    "twice_declared": f"""WITH RECURSIVE {_TWICE} SELECT b.source_ord, b.id AS source_id, coalesce(f.n, 0) AS n_collected, coalesce(k.n, 0) AS n_retained, coalesce(f.late, 0) AS n_approximate,
  CASE WHEN b.reason <> '' THEN 'failed' WHEN coalesce(f.n, 0) = 0 THEN 'silent' WHEN coalesce(k.n, 0) = 0 THEN 'absorbed' ELSE 'ok' END AS state
  FROM decl b LEFT JOIN found f USING (source_ord) LEFT JOIN kept k ON k.source_id = b.id""",
    "twice_declared_totals": f"""WITH RECURSIVE {_TWICE}, n AS (SELECT (SELECT count(*) FROM items) AS collected, (SELECT count(*) FROM ranked WHERE place = 1) AS retained, (SELECT coalesce(sum(losers), 0)::BIGINT FROM lost) AS losers)
  SELECT collected, retained, losers, retained + losers = collected AS holds FROM n""",
    "twice_declared_header": f"""WITH RECURSIVE {_TWICE}, n AS (SELECT (SELECT count(*) FROM items) AS collected, (SELECT count(*) FROM ranked WHERE place = 1) AS retained, (SELECT count(*) FROM decl) AS sources)
  SELECT 'Collection: ' || retained || ' item(s) from ' || sources || ' source(s)' || CASE WHEN collected > retained THEN ' - ' || collected || ' collected, ' || (collected - retained) || ' duplicate(s) removed' ELSE '' END AS line FROM n""",
    "identity_keys": f"WITH {ITEMS_SQL} SELECT item_ord, 'url:' || norm AS key FROM items UNION ALL SELECT item_ord, 'guid:' || source_id || ':' || guid FROM items",
    "components": f"WITH RECURSIVE {CLASSES_SQL} SELECT item_ord, component FROM classes",
    "retained_items": f"WITH RECURSIVE {CLASSES_SQL} SELECT component AS first_ord, item_ord, i.source_id, guid, title, published_at, lang, url, md5(content) AS content_md5 FROM ranked JOIN items i USING (item_ord) WHERE place = 1",
    "dedup_losers": f"WITH RECURSIVE {CLASSES_SQL} SELECT * FROM lost",
    "dedup_winners": f"WITH RECURSIVE {CLASSES_SQL} SELECT * FROM won",
    "dedup_total": f"WITH RECURSIVE {CLASSES_SQL} SELECT coalesce(sum(losers), 0)::BIGINT AS total_losers FROM lost",
    "dedup_summary": f"WITH RECURSIVE {CLASSES_SQL} {_SUMMARY}",
    "source_counts": f"WITH RECURSIVE {_REPORT} SELECT source_ord, source_id, n_collected, n_retained FROM rep",
    "source_states": f"WITH RECURSIVE {_REPORT} SELECT source_id, type, reason, state FROM rep",
    "state_filters": f"WITH RECURSIVE {_REPORT} SELECT state AS list, source_id FROM rep WHERE state <> 'ok'",
    "approx_dates": f"WITH {ITEMS_SQL} SELECT source_id, count(*) FILTER (entry_ord % 7 = 0 OR abs(epoch_us(published_at) - epoch_us(TIMESTAMP '2024-06-01')) <= 90000000) AS n_approximate FROM items GROUP BY 1",
    "priority_lookup": f"WITH {ITEMS_SQL} SELECT id AS source_id, CASE WHEN source_ord < 3 THEN 7 ELSE priority END::INT AS priority FROM registry",
    "report_rank": f"WITH RECURSIVE {_REPORT} SELECT source_id, row_number() OVER (ORDER BY n_retained DESC, n_collected DESC, source_ord) AS rank FROM rep",
    "report_lines": f"""WITH RECURSIVE {_REPORT}
SELECT 0 AS part, 0::BIGINT AS n_retained, 0::BIGINT AS n_collected, 0 AS source_ord, 'Collection: ' || sum(n_retained)::BIGINT || ' item(s) from ' || count(*) || ' source(s)'
  || CASE WHEN sum(n_collected) > sum(n_retained) THEN ' - ' || sum(n_collected)::BIGINT || ' collected, ' || (sum(n_collected) - sum(n_retained))::BIGINT || ' duplicate(s) removed' ELSE '' END AS line FROM rep
UNION ALL SELECT 1, n_retained, n_collected, source_ord, '  ' || rpad(source_id, greatest(22, length(source_id))::INT, ' ') || ' [' || rpad(type, greatest(6, length(type))::INT, ' ') || '] ' || CASE state
  WHEN 'failed' THEN 'FAILED - ' || reason WHEN 'silent' THEN 'SILENT - no item, no error' WHEN 'absorbed' THEN 'ABSORBED - ' || n_collected || ' collected, 0 retained'
  ELSE n_retained || ' item(s)' || CASE WHEN n_retained <> n_collected THEN ' (' || n_collected || ' collected)' ELSE '' END || CASE WHEN n_approximate > 0 THEN ' (' || n_approximate || ' without a usable date)' ELSE '' END END FROM rep
UNION ALL SELECT 2, 0, 0, 0, '  ' || line FROM ({_SUMMARY}) WHERE line NOT LIKE 'Deduplication: no%'""",
    "alerts": f"""WITH RECURSIVE {_REPORT} SELECT source_id, 'silent' AS alert, 0::BIGINT AS n FROM rep WHERE state = 'silent'
UNION ALL SELECT source_id, 'absorbed', n_collected FROM rep WHERE state = 'absorbed'
UNION ALL SELECT source_id, 'undated', n_collected FROM rep WHERE n_approximate = n_collected AND n_collected > 0""",
    "conservation": f"""WITH RECURSIVE {_REPORT} SELECT (SELECT sum(n_collected) FROM rep)::BIGINT AS collected, (SELECT sum(n_retained) FROM rep)::BIGINT AS retained,
  (SELECT coalesce(sum(losers), 0) FROM lost)::BIGINT AS losers, (SELECT sum(n_retained) FROM rep) + (SELECT coalesce(sum(losers), 0) FROM lost) = (SELECT sum(n_collected) FROM rep) AS holds""",
    "url_normalise": r"""
WITH parts AS (SELECT page_id, regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', ['scheme', 'place', 'path', 'query']) AS p FROM pages),
host AS (SELECT page_id, p.scheme AS scheme, regexp_replace(lower(regexp_replace(p.place, '^.*@', '')), '^(www\.)+', '') AS h, p.path AS path, p.query AS query FROM parts),
q AS (SELECT page_id, url_decode(replace(split_part(x, '=', 1), '+', ' ')) AS k, url_decode(replace(CASE WHEN contains(x, '=') THEN x[instr(x, '=') + 1:] ELSE '' END, '+', ' ')) AS v
  FROM (SELECT page_id, unnest(string_split(query, '&')) AS x FROM host) WHERE x <> ''),
kept AS (SELECT page_id, string_agg(url_encode(k) || '=' || url_encode(v), '&' ORDER BY k, v) AS t FROM q
  WHERE lower(k) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','utm_name','utm_reader','utm_brand','utm_social','fbclid','gclid','dclid','msclkid','twclid','igshid','mc_cid','mc_eid','_hsenc','_hsmi','vero_id','yclid') GROUP BY 1)
SELECT h.page_id, regexp_replace(regexp_replace(h, CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE ':$' END, '') || regexp_replace(url_decode(path), '/+$', ''), '^$', '') || coalesce('?' || t, '') AS url_key
FROM host h LEFT JOIN kept USING (page_id)""",
}
QUERIES = {name: globals()[name] for name in SQL}
