"""Planning and bulk rewrites of work tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtrace.operators import ranges as G
from imgtrace.operators import setdiff as X
from imgtrace.registry.base import query, ts_text
from imgtrace.registry.derived_sql import ts_text as sql_ts
from imgtrace.registry.derived_sql import with_
from imgtrace.registry.reports import GAPS
from imgtrace.registry.sources import posts
from imgtrace.sources import derived as D

# Gaps are three ids long, so slices of two give two ranges per gap.
_PLANNED = """
  SELECT source_site, scope_key, 'backfill' AS direction, greatest(u - 1, gap_from) AS lower_id, u AS upper_id
  FROM (SELECT *, unnest(range(gap_to, gap_from - 1, -2)) AS u FROM g)"""


@query("g1_plan_gap_ranges", with_("crawl_ranges", g=GAPS, planned=_PLANNED) + """
SELECT lower_id, upper_id, 'failed' AS status, 0 AS attempts FROM planned p WHERE NOT EXISTS (
  SELECT 1 FROM crawl_ranges r WHERE r.lower_id = p.lower_id AND r.upper_id = p.upper_id)""")
def plan_gap_ranges(spark, sf):
    r = D.crawl_ranges(spark, sf)
    return G.plan_gap_ranges(G.coverage_gaps(r, limit=None), r, 2).select(
        "lower_id", "upper_id", "status", "attempts")


@query("g1_plan_gap_ranges_again", with_("crawl_ranges") + "SELECT count(*) * 0 AS created FROM crawl_ranges")
def plan_gap_ranges_again(spark, sf):
    """A second plan over the first one's result creates nothing."""
    r = D.crawl_ranges(spark, sf)
    gaps = G.coverage_gaps(r, limit=None)
    keys = r.select(*G.RANGE_KEY)
    first = G.plan_gap_ranges(gaps, keys, 2)
    again = G.plan_gap_ranges(gaps, keys.unionByName(first.select(*G.RANGE_KEY)), 2)
    return again.agg(F.count("*").alias("created"))


@query("g1_planned_is_leasable", with_("crawl_ranges", g=GAPS, planned=_PLANNED) + """
SELECT (SELECT max(id) FROM crawl_ranges) + row_number() OVER (ORDER BY lower_id, upper_id) AS id, lower_id, upper_id
FROM planned p WHERE NOT EXISTS (
  SELECT 1 FROM crawl_ranges r WHERE r.lower_id = p.lower_id AND r.upper_id = p.upper_id)""")
def planned_is_leasable(spark, sf):
    """Every planned range is in the backlog at once, under an id of its own."""
    r = D.crawl_ranges(spark, sf)
    planned = G.plan_gap_ranges(G.coverage_gaps(r, limit=None), r, 2, D.ORDERS_NOW)
    return G.reusable_ranges(planned, D.ORDERS_NOW, 0).select("id", "lower_id", "upper_id")


@query("g2_plan_backfill", with_("states") + """
SELECT greatest(u - 9, 100) AS lower_id, u AS upper_id
FROM (SELECT unnest(range(backfill_before_id - 1, 99, -10)) AS u FROM states)""")
def plan_backfill(spark, sf):
    return G.plan_backfill(D.crawl_states(spark, sf), 100, 10).select("lower_id", "upper_id")


@query("g3_split_at_floor", with_("crawl_ranges", floor="""
  SELECT (max(o_orderkey) // 2) * 10 + 5 AS f FROM orders""") + """
SELECT CASE WHEN lower_id < f AND upper_id >= f AND status IN ('failed', 'running') THEN f ELSE lower_id END AS lower_id,
  upper_id, status, attempts FROM crawl_ranges, floor
UNION ALL SELECT lower_id, f - 1, 'failed', 0 FROM crawl_ranges r, floor
WHERE lower_id < f AND upper_id >= f AND status IN ('failed', 'running')""")
def split_at_floor(spark, sf):
    floor = D.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] // 2 * 10 + 5
    return G.split_at_floor(D.crawl_ranges(spark, sf), floor).select(
        "lower_id", "upper_id", "status", "attempts")


_COLS = ("id", "status", "attempts")


def _shown(df):
    blank = lambda c, fn=F.col: F.coalesce(fn(c), F.lit("")).alias(c)
    return df.select(*_COLS, blank("node_id"), blank("last_error"), blank("ready_at", ts_text),
                     blank("leased_at", ts_text), "touched")


def _sql(table: str, where: str, **sets: str) -> str:
    cols = {"status": "status", "attempts": "attempts", "node_id": "coalesce(node_id, '')",
            "last_error": "coalesce(last_error, '')", "ready_at": sql_ts("ready_at"),
            "leased_at": sql_ts("leased_at")}
    out = [f"CASE WHEN {where} THEN {sets[c]} ELSE {e} END AS {c}" if c in sets else f"{e} AS {c}"
           for c, e in cols.items()]
    return with_(table) + f"SELECT id, {', '.join(out)}, coalesce({where}, FALSE) AS touched FROM {table}"


_NOW = f"'{D.ORDERS_NOW}'"


@query("g4_reset_exhausted", _sql("crawl_ranges", "status = 'failed' AND attempts >= 5", attempts="0",
                                  last_error="''", node_id="''"))
def reset_exhausted(spark, sf):
    return _shown(G.reset_exhausted(D.crawl_ranges(spark, sf)))


@query("g4_reset_range", _sql("crawl_ranges", "id = 77", status="'failed'", attempts="0", last_error="''",
                              node_id="''"))
def reset_range(spark, sf):
    return _shown(G.reset_range(D.crawl_ranges(spark, sf), 77))


@query("g4_retry_failed_ranges", _sql("crawl_ranges", "status = 'failed'", attempts="0", ready_at=_NOW,
                                      last_error="''", node_id="''", leased_at="''"))
def retry_failed_ranges(spark, sf):
    return _shown(G.retry_failed_ranges(D.crawl_ranges(spark, sf), D.ORDERS_NOW))


@query("g4_retry_pending_queue", _sql(
    "retries", "status IN ('pending', 'dead')", status="'pending'",
    attempts="CASE WHEN status = 'dead' OR attempts >= 5 THEN 0 ELSE attempts END", ready_at=_NOW,
    last_error="''", node_id="''", leased_at="''"))
def retry_pending_queue(spark, sf):
    return _shown(G.retry_pending_queue(D.crawl_post_retries(spark, sf), D.ORDERS_NOW))


@query("g4_reset_retry_queue", _sql("retries", "status = 'dead' OR attempts >= 5", status="'pending'",
                                    attempts="0", ready_at=_NOW, last_error="''", node_id="''"))
def reset_retry_queue(spark, sf):
    return _shown(G.reset_retry_queue(D.crawl_post_retries(spark, sf), D.ORDERS_NOW))


@query("g4_affected", with_("crawl_ranges") + """
SELECT count(*) FILTER (status = 'failed' AND attempts >= 5) AS affected FROM crawl_ranges""")
def affected(spark, sf):
    return G.touched(G.reset_exhausted(D.crawl_ranges(spark, sf)))


_DEAD = f"""node_id NOT IN (SELECT node_id FROM nodes WHERE status = 'online'
  AND heartbeat_at > TIMESTAMP '{D.EVENTS_NOW}' - INTERVAL 2400 SECOND)"""


def _holders(spark, sf, work):
    return X.dead_node_leases(work, D.nodes(spark, sf), D.EVENTS_NOW, 2400)


@query("g5_reclaim_ranges", with_("crawl_ranges", "nodes") + f"""
SELECT id, CASE WHEN dead THEN 'failed' ELSE status END AS status, CASE WHEN dead THEN '' ELSE coalesce(node_id, '') END AS node_id,
  CASE WHEN dead THEN '노드 임대 회수' ELSE coalesce(last_error, '') END AS last_error, dead AS touched
FROM (SELECT *, status = 'running' AND node_id IS NOT NULL AND {_DEAD} AS dead FROM crawl_ranges)""")
def reclaim_ranges(spark, sf):
    r = D.crawl_ranges(spark, sf)
    return _shown(G.reclaim_ranges(r, _holders(spark, sf, r))).select(
        "id", "status", "node_id", "last_error", "touched")


@query("g5_reclaim_retries", with_("retries", "nodes") + f"""
SELECT id, CASE WHEN dead THEN 'pending' ELSE status END AS status, CASE WHEN dead THEN '' ELSE coalesce(node_id, '') END AS node_id,
  CASE WHEN dead THEN '' ELSE {sql_ts('leased_at')} END AS leased_at, dead AS touched
FROM (SELECT *, status = 'running' AND node_id IS NOT NULL AND {_DEAD} AS dead FROM retries)""")
def reclaim_retries(spark, sf):
    r = D.crawl_post_retries(spark, sf)
    return _shown(G.reclaim_retries(r, _holders(spark, sf, r))).select(
        "id", "status", "node_id", "leased_at", "touched")


@query("g6_work_delta", with_("checked_posts", "done_vectors") + """
SELECT id AS post_id, download_url FROM checked_posts WHERE skip_reason = '' AND id NOT IN (
  SELECT image_id FROM done_vectors GROUP BY 1 HAVING count(*) = 2)""")
def work_delta(spark, sf):
    done = X.fully_indexed(D.done_images(spark, sf), D.done_vectors(spark, sf), ["copy64", "sem32"])
    return X.work_delta(posts(spark, sf), done).select("post_id", "download_url")
