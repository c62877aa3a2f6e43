"""Aggregations, windows and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtrace.operators import capacity as C
from imgtrace.operators import evaluate as E
from imgtrace.operators import fleet as L
from imgtrace.operators import merge as M
from imgtrace.operators import ranges as G
from imgtrace.operators import setdiff as X
from imgtrace.plans import evaluation, reports
from imgtrace.registry.base import i64, query, r6
from imgtrace.registry.derived_sql import cosine, dot, hamming_hex, with_
from imgtrace.registry.search import PAIRS, all_vectors
from imgtrace.registry.sources import posts
from imgtrace.session import materialize
from imgtrace.sources import derived as D

WINDOW = 6 * 3600

_STATS = """
SELECT source_site, scope_key, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'failed' AND attempts >= 5) AS exhausted,
  sum(saved_count)::BIGINT AS saved,
  coalesce(sum(upper_id - lower_id + 1) FILTER (status = 'failed'), 0)::BIGINT AS missing_ids,
  count(*) FILTER (status IN ('failed', 'running')) = 0 AS complete
FROM crawl_ranges GROUP BY 1, 2"""


@query("d1_range_stats", with_("crawl_ranges") + _STATS)
def range_stats(spark, sf):
    return G.range_stats(D.crawl_ranges(spark, sf))


_SUMMARY = """
SELECT r.*, retry_pending, retry_dead, high_watermark_id AS high_watermark, backfill_before_id AS backfill_before
FROM (SELECT source_site, scope_key, count(*) FILTER (status = 'completed') AS ranges_completed,
        count(*) FILTER (status = 'running') AS ranges_running, count(*) FILTER (status = 'failed') AS ranges_failed,
        count(*) FILTER (status = 'empty') AS ranges_empty FROM crawl_ranges GROUP BY 1, 2) r,
  (SELECT count(*) FILTER (status = 'pending') AS retry_pending, count(*) FILTER (status = 'dead') AS retry_dead
   FROM retries) q, states"""


def _summary(spark, sf):
    return reports.crawl_summary(D.crawl_ranges(spark, sf), D.crawl_post_retries(spark, sf),
                                 D.crawl_states(spark, sf))


@query("d2_crawl_summary", with_("crawl_ranges", "retries", "states", s=_SUMMARY) + """
SELECT s.* EXCLUDE (source_site, scope_key), source_site, scope_key FROM s""")
def crawl_summary(spark, sf):
    return _summary(spark, sf)


@query("d3_vectors_by_model", with_("image_vectors") + """
SELECT model_id, count(*) AS vectors FROM image_vectors GROUP BY model_id""")
def vectors_by_model(spark, sf):
    return reports.vectors_by_model(D.image_vectors(spark, sf))


FLEET = f"""
  SELECT node_id, greatest(max_by(downloaded, observed_at) - min_by(downloaded, observed_at), 0) AS downloaded,
    greatest(max_by(embedded, observed_at) - min_by(embedded, observed_at), 0) AS embedded,
    greatest(max_by(saved, observed_at) - min_by(saved, observed_at), 0) AS saved,
    greatest(max_by(failed, observed_at) - min_by(failed, observed_at), 0) AS failed,
    coalesce(greatest(max_by(saved, observed_at) - min_by(saved, observed_at), 0)
      / nullif((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 1e6, 0), 0) AS per_second,
    coalesce(max_by(struct_pack(c := cpu_pct), observed_at).c, 0) AS cpu_pct, max_by(mem_mb, observed_at) AS mem_mb
  FROM node_metrics WHERE observed_at > TIMESTAMP '{D.EVENTS_NOW}' - INTERVAL {WINDOW} SECOND GROUP BY node_id"""
_FLEET_COLS = """node_id, downloaded, embedded, saved, failed, round(per_second, 6) AS per_second,
  round(CAST(cpu_pct AS DOUBLE), 4) AS cpu_pct, round(CAST(mem_mb AS DOUBLE), 4) AS mem_mb"""


def _fleet(spark, sf):
    return L.fleet_summary(D.node_metrics(spark, sf), D.EVENTS_NOW, WINDOW)


def _fleet_cols():
    return [*L.COUNTERS, r6("per_second").alias("per_second"),
            *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("cpu_pct", "mem_mb")]]


@query("d4_fleet_summary", with_("node_metrics", fleet=FLEET) + f"SELECT {_FLEET_COLS} FROM fleet")
def fleet_summary(spark, sf):
    return _fleet(spark, sf).select("node_id", *_fleet_cols())


@query("d4_fleet_total", with_("node_metrics", fleet=FLEET) + """
SELECT round(sum(per_second), 6) AS total_per_second, count(*) AS nodes FROM fleet""")
def fleet_total(spark, sf):
    return L.fleet_total(_fleet(spark, sf)).withColumn("total_per_second", r6("total_per_second"))


_VIEW = f"""
  SELECT n.node_id, role, CASE WHEN status = 'online'
      AND heartbeat_at > TIMESTAMP '{D.EVENTS_NOW}' - INTERVAL 2400 SECOND THEN 'online' ELSE 'offline' END AS effective_status,
    (epoch_us(TIMESTAMP '{D.EVENTS_NOW}') - epoch_us(heartbeat_at)) / 1e6 AS last_seen_sec,
    coalesce(f.saved, 0) AS saved, coalesce(per_second, 0) AS per_second
  FROM nodes n LEFT JOIN fleet f USING (node_id)"""


def _view(spark, sf):
    return L.node_view(D.nodes(spark, sf), _fleet(spark, sf), D.EVENTS_NOW, 2400)


@query("d5_node_view", with_("node_metrics", "nodes", fleet=FLEET, v=_VIEW) + """
SELECT node_id, role, effective_status, round(last_seen_sec, 4) AS last_seen_sec, saved,
  round(per_second, 6) AS per_second FROM v""")
def node_view(spark, sf):
    return _view(spark, sf).select(
        "node_id", "role", "effective_status", F.round("last_seen_sec", 4).alias("last_seen_sec"), "saved",
        r6("per_second").alias("per_second"))


@query("d5_node_counts", with_("node_metrics", "nodes", fleet=FLEET, v=_VIEW) + """
SELECT count(*) FILTER (effective_status = 'online') AS online_nodes, count(*) AS total_nodes FROM v""")
def node_counts(spark, sf):
    return L.node_counts(_view(spark, sf))


_STALE = f"""(SELECT count(*) FROM crawl_ranges WHERE status = 'running'
  AND leased_at < TIMESTAMP '{D.ORDERS_NOW}' - INTERVAL 30 MINUTE)"""


@query("d6_stale_running", with_("crawl_ranges") + f"SELECT {_STALE} AS stale_running")
def stale_running(spark, sf):
    return G.stale_running(D.crawl_ranges(spark, sf), D.ORDERS_NOW).select("stale_running")


@query("d6_stale_two_scopes", with_("crawl_ranges", two=D.TWO_SCOPES_SQL) + f"""
SELECT source_site, scope_key, count(*) FILTER (status = 'running'
  AND leased_at < TIMESTAMP '{D.ORDERS_NOW}' - INTERVAL 30 MINUTE) AS stale_running FROM two GROUP BY 1, 2""")
def stale_two(spark, sf):
    return G.stale_running(D.two_scopes(spark, sf), D.ORDERS_NOW)


@query("d7_progress", with_("crawl_ranges", "retries", "states", s=_SUMMARY, t=_STATS) + """
SELECT s.source_site, s.scope_key,
  round(greatest(0, least(high_watermark - backfill_before, high_watermark)) / high_watermark * 100, 6) AS coverage_pct,
  round((high_watermark - backfill_before) / high_watermark * 100, 6) AS swept_pct,
  greatest(0, total - ranges_completed - ranges_running - ranges_empty - ranges_failed) AS remaining_ranges,
  CASE WHEN ranges_running > 0 THEN '진행 중' ELSE '대기' END AS phase
FROM s JOIN t USING (source_site, scope_key)""")
def progress(spark, sf):
    p = reports.progress(_summary(spark, sf), G.range_stats(D.crawl_ranges(spark, sf)))
    return p.withColumn("coverage_pct", r6("coverage_pct")).withColumn("swept_pct", r6("swept_pct"))


GAPS = """
  SELECT source_site, scope_key, upper_id + 1 AS gap_from, prev_lower - 1 AS gap_to, prev_lower - upper_id - 1 AS gap_size
  FROM (SELECT *, lag(lower_id) OVER (PARTITION BY source_site, scope_key ORDER BY upper_id DESC, lower_id DESC)
          AS prev_lower FROM crawl_ranges) WHERE prev_lower > upper_id + 1"""


@query("d8_jobs_report", with_("crawl_ranges", "retries", "states", s=_SUMMARY, t=_STATS, g=GAPS, worst="""
  SELECT * FROM crawl_ranges WHERE status = 'failed' AND attempts >= 5 ORDER BY upper_id DESC LIMIT 50""") + f"""
SELECT t.source_site, total, completed, exhausted, saved, missing_ids, retry_pending, retry_dead, high_watermark,
  backfill_before, {_STALE} AS stale_running,
  (SELECT string_agg(lower_id || '-' || upper_id || ':' || attempts || ':' || last_error, ' ' ORDER BY upper_id DESC)
   FROM worst) AS failed_ranges,
  (SELECT string_agg(gap_from || '-' || gap_to, ' ' ORDER BY gap_from DESC)
   FROM (SELECT * FROM g ORDER BY gap_from DESC LIMIT 20)) AS gaps
FROM t JOIN s USING (source_site, scope_key)""")
def jobs_report(spark, sf):
    r = reports.jobs_report(D.crawl_ranges(spark, sf), D.crawl_post_retries(spark, sf),
                            D.crawl_states(spark, sf), D.ORDERS_NOW)
    text = lambda c, fn: F.array_join(F.transform(c, fn), " ").alias(c)
    s = lambda c: c.cast("string")
    return r.select(
        "source_site", "total", "completed", "exhausted", "saved", "missing_ids", "retry_pending",
        "retry_dead", "high_watermark", "backfill_before", "stale_running",
        text("failed_ranges", lambda x: F.concat(
            s(x.lower), F.lit("-"), s(x.upper), F.lit(":"), s(x.attempts), F.lit(":"), x.error)),
        text("gaps", lambda x: F.concat(s(x.gap_from), F.lit("-"), s(x.gap_to))))


_RANKS = """
  SELECT p.query_id, any_value(p.degradation) AS degradation,
    count(*) FILTER (p.score >= o.score AND p.image_id <> p.answer_id) AS rank
  FROM pairs p JOIN (SELECT query_id, score FROM pairs WHERE image_id = answer_id) o USING (query_id) GROUP BY 1"""


@query("d9_retrieval_eval", with_("degraded", pairs=f"""
  SELECT q.query_id, q.answer_id, q.degradation, e.vec_id + 1 AS image_id,
    CAST({dot('q.vector', 'e.embedding')} AS FLOAT) AS score FROM degraded q, embeddings e""", ranks=_RANKS) + """
SELECT coalesce(degradation, '전체') AS degradation, count(*) AS queries,
  round(avg(CASE WHEN rank < 1 THEN 100.0::DOUBLE ELSE 0 END), 6) AS top1_pct,
  round(avg(CASE WHEN rank < 5 THEN 100.0::DOUBLE ELSE 0 END), 6) AS top5_pct
FROM ranks GROUP BY ROLLUP (degradation)""")
def retrieval_eval(spark, sf):
    q = D.degraded(spark, sf)
    ranks = evaluation.vector_ranks(q, all_vectors(spark, sf), D.vector_size("copy64")).join(
        q.select("query_id", "degradation"), "query_id")
    return E.retrieval_eval(ranks).select(
        "degradation", "queries", r6("top1_pct").alias("top1_pct"), r6("top5_pct").alias("top5_pct"))


# --- score separation -----------------------------------------------------
# A query is real when its picture is in the gallery (label not 7), else fake.

SCORES = f"""
  SELECT 'vector' AS method, CASE WHEN label = 7 THEN 'fake' ELSE 'real' END AS kind, score FROM (
    SELECT q.query_id, q.label, max(CAST({dot('q.vector', 'e.embedding')} AS FLOAT))::DOUBLE AS score
    FROM queries q, embeddings e WHERE e.label <> 7 GROUP BY 1, 2)
  UNION ALL
  SELECT 'phash', CASE WHEN label = 7 THEN 'fake' ELSE 'real' END, score FROM (
    SELECT q.query_id, q.label, CAST(-min({hamming_hex('q.phash', 'g.phash')}) AS DOUBLE) AS score
    FROM queries q, gallery g WHERE g.label <> 7 GROUP BY 1, 2)
  UNION ALL
  SELECT 'vector+phash', CASE WHEN label = 7 THEN 'fake' ELSE 'real' END, score FROM (
    SELECT query_id, label, CAST(-min(distance) AS DOUBLE) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM (
        SELECT q.query_id, q.label, g.image_id, {cosine('q.vector', 'g.embedding')} AS score,
          {hamming_hex('q.phash', 'g.phash')} AS distance FROM queries q, gallery g WHERE g.label <> 7))
    WHERE rank <= 20 GROUP BY 1, 2)"""
_SCORED = with_("gallery", "queries", scores=SCORES)


def scores(spark, sf):
    kind = F.when(F.col("label") == 7, "fake").otherwise("real")
    found = evaluation.threshold_scores(
        D.queries(spark, sf).withColumn("kind", kind),
        all_vectors(spark, sf).where(F.col("label") != 7), 20, D.vector_size("copy64"))
    # The figures read the scores several times; the scans behind them run once.
    return materialize(found, "scores")


REPORT_SQL = """
SELECT method, round(quantile_cont(score, 0.5) FILTER (kind = 'real'), 5) AS real_median,
  round(quantile_cont(score, 0.01) FILTER (kind = 'real'), 5) AS real_q01,
  round(quantile_cont(score, 0.5) FILTER (kind = 'fake'), 5) AS fake_median,
  round(quantile_cont(score, 0.99) FILTER (kind = 'fake'), 5) AS fake_q99,
  round(avg(score) FILTER (kind = 'real'), 5) AS real_mean, round(avg(score) FILTER (kind = 'fake'), 5) AS fake_mean,
  round(avg(score) FILTER (kind = 'real') - avg(score) FILTER (kind = 'fake'), 5) AS mean_gap
FROM scores GROUP BY method"""


def round5(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 5))
    return df


@query("d10_score_report", _SCORED + REPORT_SQL)
def score_report(spark, sf):
    r = E.score_report(scores(spark, sf))
    return round5(r, *[c for c in r.columns if c != "method"])


@query("d11_overlap", _SCORED + """
SELECT method, round(avg(CASE WHEN score <= top THEN 1.0::DOUBLE ELSE 0 END), 6) AS overlap
FROM scores JOIN (SELECT method, max(score) AS top FROM scores WHERE kind = 'fake' GROUP BY 1) USING (method)
WHERE kind = 'real' GROUP BY method""")
def overlap(spark, sf):
    return E.overlap(scores(spark, sf)).withColumn("overlap", r6("overlap"))


@query("d12_separation", _SCORED + """
SELECT method, target, round(any_value(cut), 5) AS cut,
  round(avg(CASE WHEN score >= cut THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall
FROM scores JOIN (
  SELECT method, 0.99::DOUBLE AS target, quantile_cont(score, 0.99) AS cut FROM scores WHERE kind = 'fake' GROUP BY 1
  UNION ALL SELECT method, 0.999, quantile_cont(score, 0.999) FROM scores WHERE kind = 'fake' GROUP BY 1
  UNION ALL SELECT method, 1.0, max(score) FROM scores WHERE kind = 'fake' GROUP BY 1) c USING (method)
WHERE kind = 'real' GROUP BY method, target""")
def separation(spark, sf):
    return E.separation(scores(spark, sf)).withColumn("cut", F.round("cut", 5)).withColumn(
        "recall", r6("recall"))


@query("d13_at_hash_threshold", _SCORED + """
SELECT method, round(avg(CASE WHEN score >= -5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind = 'real'), 6) AS recall,
  round(avg(CASE WHEN score >= -5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind = 'fake'), 6) AS leak
FROM scores GROUP BY method HAVING max(score) FILTER (kind = 'real') <= 0""")
def at_hash_threshold(spark, sf):
    t = E.at_hash_threshold(scores(spark, sf))
    return t.withColumn("recall", r6("recall")).withColumn("leak", r6("leak"))


@query("d14_batch_report", with_("checked_posts", "done_images", "done_vectors", done="""
  SELECT image_id FROM done_vectors GROUP BY 1 HAVING count(*) = 2""") + """
SELECT count(*) AS total, count(*) FILTER (st = 'skipped') AS skipped, count(*) FILTER (st = 'existing') AS existing,
  count(*) FILTER (st = 'saved') AS saved, count(*) FILTER (st = 'failed') AS failed
FROM (SELECT CASE WHEN skip_reason <> '' THEN 'skipped' WHEN d.image_id IS NOT NULL THEN 'existing'
             WHEN score = 13 THEN 'failed' ELSE 'saved' END AS st
      FROM checked_posts p LEFT JOIN done d ON d.image_id = p.id)""")
def batch_report(spark, sf):
    p = posts(spark, sf)
    done = X.fully_indexed(D.done_images(spark, sf), D.done_vectors(spark, sf), ["copy64", "sem32"])
    failed = p.where(F.col("score") == 13).select("post_id")
    return X.batch_report(X.post_status(p, done, failed))


@query("d15_size_profile", """
SELECT count(*) AS n, round(avg(n_chars), 4) AS mean,
  (SELECT CAST(n_chars AS DOUBLE) FROM documents ORDER BY n_chars LIMIT 1
   OFFSET (SELECT count(*) // 2 FROM documents)) AS median, min(n_chars) AS min, max(n_chars) AS max,
  round(avg(n_chars) * 10000000, 0) AS bytes_at_10m FROM documents""")
def size_profile(spark, sf):
    p = C.size_profile(D.table(spark, sf, "documents"), "n_chars")
    return p.withColumn("mean", F.round("mean", 4)).withColumn("bytes_at_10m", F.round("bytes_at_10m", 0))


@query("d15_size_profile_outlier", """
WITH sizes AS (SELECT n_chars FROM documents UNION ALL SELECT 1000000000000)
SELECT count(*) AS n, (SELECT CAST(n_chars AS DOUBLE) FROM sizes ORDER BY n_chars LIMIT 1
   OFFSET (SELECT count(*) // 2 FROM sizes)) AS median, min(n_chars) AS min, max(n_chars) AS max FROM sizes""")
def size_profile_outlier(spark, sf):
    """One size far beyond all others moves no other value to another segment."""
    d = D.table(spark, sf, "documents").select("n_chars")
    far = d.select(F.max("n_chars")).select(F.lit(10**12).alias("n_chars"))
    return C.size_profile(d.unionByName(far), "n_chars").select("n", "median", "min", "max")


@query("d16_index_size", with_("models") + """
SELECT (SELECT count(*) FROM embeddings) AS images, 0::BIGINT AS flat_ram,
  sum((vector_size + 7) // 8 + 8)::BIGINT AS flat_disk, sum(vector_size // 8 + 238)::BIGINT AS graph_ram,
  (sum((vector_size + 7) // 8 + 8) * (SELECT count(*) FROM embeddings))::BIGINT AS flat_disk_total,
  (sum(vector_size // 8 + 238) * (SELECT count(*) FROM embeddings))::BIGINT AS graph_ram_total
FROM models WHERE active""")
def index_size(spark, sf):
    return C.index_size(D.models(spark).where("active"), D.gallery(spark, sf))


@query("d17_capacity", with_("models") + """
SELECT node, CASE WHEN budget > 167772160 THEN CAST(floor((budget - 167772160) * 0.8::DOUBLE / per) AS BIGINT) ELSE 0 END
  AS capacity
FROM (SELECT n_nationkey AS node, sum(c_custkey)::BIGINT * 300000 // (n_nationkey + 1) // 100 AS budget,
        (SELECT sum(vector_size // 8 + 238) FROM models)::BIGINT AS per
      FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)""")
def capacity(spark, sf):
    """Memory budgets differ per nation's customers, so both sides of the base share occur."""
    c = D.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum("c_custkey").alias("s"))
    per = D.models(spark).select(C.ram_per_image("graph")).scalar()
    budget = F.floor(F.floor(F.col("s") * 300000 / (F.col("c_nationkey") + 1)) / 100)
    return c.select(F.col("c_nationkey").alias("node"), C.image_capacity(budget, per).alias("capacity"))


@query("d17_reembed_room", with_("models") + """
SELECT (SELECT count(*) FROM embeddings) AS images, sum(vector_size // 8 + 238)::BIGINT AS per_image,
  (400 * sum(vector_size // 8 + 238))::BIGINT AS budget,
  (sum(vector_size // 8 + 238) * (SELECT count(*) FROM embeddings))::BIGINT AS need,
  (SELECT count(*) FROM embeddings) <= 400 AS fits FROM models""")
def reembed_room(spark, sf):
    return C.reembed_room(D.models(spark), D.gallery(spark, sf), 400)


@query("d18_probe_summary", with_("download_log", k="""
  SELECT *, CASE WHEN http_code IS NOT NULL THEN 'HTTP ' || http_code WHEN error LIKE '%reset%' THEN '연결 끊김'
    WHEN error LIKE '%deadline%' THEN '시간 초과' WHEN error LIKE '%no such host%' THEN '이름 조회 실패'
    WHEN error IS NOT NULL THEN '기타' END AS kind FROM download_log""", s="""
  SELECT step, count(*) FILTER (kind IS NULL) AS ok, count(*) FILTER (kind IS NOT NULL) AS failed,
    (coalesce(sum(bytes) FILTER (kind IS NULL), 0))::BIGINT AS bytes,
    max(epoch_us(started_at) / 1e6 + seconds) - min(epoch_us(started_at) / 1e6) AS elapsed FROM k GROUP BY step""") + """
SELECT CAST(step AS INTEGER) AS step, ok, failed, round(ok / elapsed, 6) AS per_second,
  round(bytes / 1048576.0::DOUBLE / elapsed, 6) AS mb_per_second, CAST(floor(bytes / greatest(ok, 1)) AS BIGINT) AS mean_bytes,
  coalesce((SELECT string_agg(kind || ' ' || n, ', ' ORDER BY kind || ' ' || n) FROM (
    SELECT step, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL) f WHERE f.step = s.step), '-') AS failures
FROM s""")
def probe_summary(spark, sf):
    ts = D.table(spark, sf, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("started_at"))
    p = L.probe_summary(D.download_log(spark, sf).join(ts, "attempt_id"))
    return p.withColumn("per_second", r6("per_second")).withColumn("mb_per_second", r6("mb_per_second"))


@query("d19_index_audit", with_("models", "image_vectors") + """
SELECT m.model_id, count(v.image_id) AS vectors, count(v.indexed_at) AS points,
  count(v.image_id) - count(v.indexed_at) AS pending
FROM models m LEFT JOIN image_vectors v USING (model_id) WHERE active GROUP BY 1""")
def index_audit(spark, sf):
    v = D.image_vectors(spark, sf)
    return C.index_audit(D.models(spark), v, v.where(F.col("indexed_at").isNotNull()))


# --- windows --------------------------------------------------------------

@query("e1_coverage_gaps", with_("crawl_ranges", g=GAPS) + "SELECT gap_from, gap_to, gap_size FROM g")
def coverage_gaps(spark, sf):
    return G.coverage_gaps(D.crawl_ranges(spark, sf), limit=None, width=10_000).select(
        "gap_from", "gap_to", "gap_size")


@query("e1_gaps_two_scopes", with_("crawl_ranges", two=D.TWO_SCOPES_SQL, g=GAPS.replace("FROM crawl_ranges", "FROM two")) + """
SELECT scope_key, gap_from, gap_to FROM (
  SELECT *, row_number() OVER (PARTITION BY source_site, scope_key ORDER BY gap_from DESC) AS r FROM g) WHERE r <= 20""")
def gaps_two(spark, sf):
    return G.coverage_gaps(D.two_scopes(spark, sf)).select("scope_key", "gap_from", "gap_to")


@query("d8_jobs_two_scopes", with_("crawl_ranges", two=D.TWO_SCOPES_SQL, g=GAPS.replace("FROM crawl_ranges", "FROM two")) + f"""
SELECT t.scope_key, count(*) AS total, count(*) FILTER (status = 'running'
    AND leased_at < TIMESTAMP '{D.ORDERS_NOW}' - INTERVAL 30 MINUTE) AS stale_running,
  least(20, (SELECT count(*) FROM g WHERE g.scope_key = t.scope_key)) AS gaps,
  least(50, count(*) FILTER (status = 'failed' AND attempts >= 5)) AS failed_ranges
FROM two t GROUP BY t.scope_key""")
def jobs_two(spark, sf):
    r = reports.jobs_report(D.two_scopes(spark, sf), D.crawl_post_retries(spark, sf), D.crawl_states(spark, sf), D.ORDERS_NOW)
    return r.select("scope_key", "total", "stale_running", i64(F.size("gaps")).alias("gaps"),
                    i64(F.size("failed_ranges")).alias("failed_ranges"))


@query("e1_coverage_gaps_top20", with_("crawl_ranges", g=GAPS) + """
SELECT gap_from, gap_to, gap_size FROM g ORDER BY gap_from DESC LIMIT 20""")
def coverage_gaps_top(spark, sf):
    return G.coverage_gaps(D.crawl_ranges(spark, sf)).select("gap_from", "gap_to", "gap_size")


@query("e1_coverage_gaps_strict", with_("crawl_ranges", nested="""
  SELECT upper_id, CASE WHEN attempts = 6 THEN greatest(lower_id - 40, 1) ELSE lower_id END AS lower_id FROM crawl_ranges""") + """
SELECT upper_id + 1 AS gap_from, reach - 1 AS gap_to, reach - upper_id - 1 AS gap_size FROM (
  SELECT *, min(lower_id) OVER (ORDER BY upper_id DESC, lower_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS reach FROM nested) WHERE reach > upper_id + 1""")
def coverage_gaps_strict(spark, sf):
    nested = D.crawl_ranges(spark, sf).withColumn("lower_id", F.when(
        F.col("attempts") == 6, F.greatest(F.col("lower_id") - 40, F.lit(1))).otherwise(F.col("lower_id")))
    return G.coverage_gaps(nested, limit=None, strict=True, width=10_000).select(
        "gap_from", "gap_to", "gap_size")


@query("e2_best_paths", with_("probe_log", latest="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, host, mode ORDER BY seq DESC) AS rn FROM probe_log)
  WHERE rn = 1""") + f"""
SELECT node_id, host, mode, coalesce(latency_ms, -1) AS latency_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id, host ORDER BY latency_ms NULLS LAST, mode) AS best FROM latest
  WHERE ok AND checked_at > TIMESTAMP '{D.EVENTS_NOW}' - INTERVAL 43200 SECOND) WHERE best = 1""")
def best_paths(spark, sf):
    probes = M.record_probes(D.probe_log(spark, sf), "seq")
    return L.best_paths(probes, D.EVENTS_NOW, 43200).select(
        "node_id", "host", "mode", F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms"))


@query("e5_first_last_per_node", with_("node_metrics") + """
SELECT node_id, min_by(saved, observed_at) AS first_saved, max_by(saved, observed_at) AS last_saved,
  round(CAST(max_by(mem_mb, observed_at) AS DOUBLE), 2) AS last_mem FROM node_metrics GROUP BY 1""")
def first_last(spark, sf):
    return L.first_last_per_node(D.node_metrics(spark, sf)).select(
        "node_id", F.col("first.saved").alias("first_saved"), F.col("last.saved").alias("last_saved"),
        F.round(F.col("last.mem_mb").cast("double"), 2).alias("last_mem"))


@query("e6_active_model_per_kind", with_("models", "image_vectors") + """
SELECT kind, m.model_id, m.model_id = 'copy64' AS is_primary, count(*) AS vectors
FROM models m JOIN image_vectors v USING (model_id) WHERE active GROUP BY 1, 2, 3""")
def active_model(spark, sf):
    v = D.image_vectors(spark, sf).groupBy("model_id").agg(F.count("*").alias("vectors"))
    return M.active_model_per_kind(D.models(spark)).join(v, "model_id").select(
        "kind", "model_id", "is_primary", "vectors")
