"""The derived inputs of `sources.derived`, written as SQL common table expressions."""

from __future__ import annotations


def word(v: str, first: int) -> str:
    """32 sign bits of dims first..first+31 as a BIGINT."""
    return (f"CAST(list_sum([CASE WHEN {v}[i] > 0 THEN 1::BIGINT << (i - {first}) ELSE 0 END "
            f"for i in range({first}, {first + 32})]) AS BIGINT)")


def sign_hash(v: str) -> str:
    return f"printf('%08x%08x', {word(v, 33)}, {word(v, 1)})"


def shifted(step: str) -> str:
    return (f"[CAST(CAST(embedding[i + 1] AS DOUBLE) + CAST({step} AS DOUBLE) * ((i * 7 + vec_id) % 5 - 2) "
            f"AS FLOAT) for i in range(0, 64)]")


def hexword(h: str, first: int) -> str:
    return f"CAST('0x' || substr({h}, {first}, 8) AS BIGINT)"


def hamming_hex(a: str, b: str) -> str:
    """Distance of two 16-digit hashes."""
    return (f"CAST(bit_count(xor({hexword(a, 1)}, {hexword(b, 1)})) + "
            f"bit_count(xor({hexword(a, 9)}, {hexword(b, 9)})) AS INTEGER)")


def dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def cosine(a: str, b: str) -> str:
    return f"CAST({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) AS FLOAT)"


CTES = {
    "gallery": f"""
  SELECT vec_id + 1 AS image_id, 'site' || (label % 3) AS source_site, vec_id * 7 + 1 AS source_post_id,
    CASE WHEN label = 4 THEN '' ELSE 'https://origin.example/' || vec_id END AS source_url,
    'https://site' || (label % 3) || '.example/posts/' || (vec_id * 7 + 1) AS canonical_url,
    'ftp://cdn.example/' || vec_id AS preview_url,
    CASE WHEN label < 2 THEN 'g' WHEN label < 4 THEN ' Sensitive ' WHEN label < 6 THEN 'q'
         WHEN label < 8 THEN 'odd' WHEN label < 9 THEN '' END AS rating,
    CAST(vec_id % 50 AS INTEGER) AS score,
    {sign_hash('embedding')} AS phash,
    CASE WHEN label = 1 THEN '' WHEN label = 7 THEN NULL
         ELSE printf('%s/%02x/%02x/%d.jpg', 'site' || (label % 3), (vec_id * 7 + 1) & 255,
                     ((vec_id * 7 + 1) >> 8) & 255, vec_id * 7 + 1) END AS thumb_path,
    ['t' || i for i in range(1, vec_id % 16 + 1)] AS tags,
    list_slice(['artist' || label, 'guest'], 1, label % 3) AS artist_tags,
    label, embedding
  FROM embeddings""",
    "image_vectors": """
  SELECT vec_id + 1 AS image_id, 'copy64' AS model_id, embedding AS vector,
         CASE WHEN label <> 3 THEN TIMESTAMP '2024-01-01 00:00:00' END AS indexed_at
  FROM embeddings WHERE label <> 7
  UNION ALL
  SELECT vec_id + 1, 'sem32', embedding[1:32],
         CASE WHEN label <> 3 THEN TIMESTAMP '2024-01-01 00:00:00' END
  FROM embeddings WHERE label NOT IN (2, 5, 8)""",
    "models": """
  SELECT * FROM (VALUES ('copy64', 'copy', 64, TRUE), ('sem32', 'semantic', 32, TRUE),
                        ('old64', 'copy', 64, FALSE)) t(model_id, kind, vector_size, active)""",
    "queries": f"""
  SELECT *, {sign_hash('vector')} AS phash FROM (
    SELECT vec_id AS query_id, vec_id + 1 AS answer_id, label, {shifted('0.02')} AS vector FROM embeddings)""",
    "degraded": f"""
  SELECT *, {sign_hash('vector')} AS phash FROM (
    SELECT vec_id * 8 + no AS query_id, vec_id + 1 AS answer_id, kind AS degradation, label,
           {shifted('step')} AS vector
    FROM embeddings, (VALUES (0, 'half', 0.01), (1, 'jpeg40', 0.02), (2, 'crop', 0.03), (3, 'bar', 0.04),
                             (4, 'border', 0.06)) k(no, kind, step))""",
    "crawl_ranges": """
  SELECT o_orderkey + 1 AS id, 'site0' AS source_site, 'default' AS scope_key, 'backfill' AS direction,
    o_orderkey * 10 + 1 AS lower_id,
    o_orderkey * 10 + CASE WHEN o_orderpriority LIKE '1%' THEN 7 ELSE 10 END AS upper_id,
    CASE WHEN o_orderstatus = 'F' THEN 'completed'
         WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'failed'
         WHEN o_orderpriority LIKE '3%' THEN 'running' WHEN o_orderpriority LIKE '4%' THEN 'empty'
         ELSE 'completed' END AS status,
    CAST(o_custkey % 7 AS INTEGER) AS attempts,
    CASE WHEN o_orderstatus <> 'F' AND o_orderpriority LIKE '3%' THEN 'node' || (o_custkey % 12) END AS node_id,
    o_orderdate AS leased_at, o_orderdate AS ready_at,
    CASE WHEN o_orderstatus = 'F' OR o_orderpriority LIKE '5%' THEN o_custkey % 11 ELSE 0 END AS saved_count,
    CASE WHEN o_orderstatus <> 'F' AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')
         THEN 'HTTP ' || (o_custkey % 3 + 428) END AS last_error
  FROM orders""",
    "retries": """
  SELECT o_orderkey + 1 AS id, 'site0' AS source_site, 'default' AS scope_key, o_orderkey AS source_post_id,
    CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'running'
         WHEN o_custkey % 2 = 0 THEN 'dead' ELSE 'succeeded' END AS status,
    CAST(o_custkey % 7 AS INTEGER) AS attempts,
    CASE WHEN o_orderstatus = 'O' THEN 'node' || (o_custkey % 12) END AS node_id,
    o_orderdate AS ready_at, o_orderdate AS leased_at,
    CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'gone' END AS last_error
  FROM orders""",
    "states": """
  SELECT 'site0' AS source_site, 'default' AS scope_key, max(o_orderkey) * 10 + 10 AS high_watermark_id,
         (max(o_orderkey) * 10 + 10) // 4 AS backfill_before_id FROM orders""",
    "node_metrics": """
  SELECT 'node' || (user_id % 10) AS node_id, ts AS observed_at,
    CASE WHEN event_type <> 'view' THEN CAST(value AS FLOAT) END AS cpu_pct,
    CAST(user_id * 10 AS FLOAT) AS mem_mb, event_id * 3 AS downloaded, event_id * 2 AS embedded,
    event_id * 2 - event_id // 50 AS saved, event_id // 50 AS failed
  FROM events""",
    "nodes": """
  SELECT node_id, CASE WHEN node_id = 'node0' THEN 'center' ELSE 'worker' END AS role,
         CASE WHEN node_id = 'node3' THEN 'offline' ELSE 'online' END AS status, heartbeat_at
  FROM (SELECT 'node' || (user_id % 10) AS node_id, max(ts) AS heartbeat_at FROM events GROUP BY 1)""",
    "probe_log": """
  SELECT 'node' || (user_id % 10) AS node_id, event_type AS host,
    CASE user_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'split' WHEN 2 THEN 'tunnel' ELSE 'proxy' END AS mode,
    value > 20 AS ok,
    CASE WHEN event_type <> 'click' THEN CAST(floor(value * 10) AS INTEGER) END AS latency_ms,
    ts AS checked_at, event_id AS seq
  FROM events""",
    "download_log": """
  SELECT event_id AS attempt_id, ts AS started_at,
    CASE WHEN user_id % 6 = 0 THEN 1 ELSE 2 << CAST(user_id % 6 AS INTEGER) END AS step,
    CAST(floor(value * 4096) AS BIGINT) AS bytes, value AS seconds,
    CASE WHEN event_type = 'error' THEN CASE WHEN value > 60 THEN 503 ELSE 429 END END AS http_code,
    CASE WHEN event_type = 'error' THEN 'status'
         WHEN event_type = 'click' AND value > 90 THEN 'dial tcp: connection reset by peer'
         WHEN event_type = 'click' AND value > 80 THEN 'context deadline exceeded'
         WHEN event_type = 'click' AND value > 70 THEN 'lookup cdn: no such host'
         WHEN event_type = 'click' AND value > 60 THEN 'broken' END AS error
  FROM events""",
    "feed": """
  SELECT d.doc_id + 1 AS id, md5(text) AS md5,
    CASE WHEN lang = 'en' THEN '' WHEN lang = 'fr' THEN 'https://cdn/' || (d.doc_id + 1) || '.mp4'
         ELSE 'https://cdn/' || (d.doc_id + 1) || '.JPG?x=1#f' END AS large_file_url,
    'https://cdn/' || (d.doc_id + 1) || CASE WHEN source LIKE '%1' THEN '.webm' ELSE '.png' END AS file_url,
    'https://cdn/' || (d.doc_id + 1) || CASE WHEN source LIKE '%1' THEN '.gif' ELSE '.jpeg' END
      AS preview_file_url,
    '  https://origin/' || (d.doc_id + 1) || ' ' AS source_url, substr(lang, 1, 1) AS rating,
    CAST(n_chars % 100 AS INTEGER) AS score, CAST(n_chars % 4000 + 1 AS INTEGER) AS width,
    CAST(n_chars % 3000 + 1 AS INTEGER) AS height, n_chars AS file_size, 'png' AS file_ext,
    CASE WHEN lang = 'de' THEN '' ELSE ' ' || lang || '  ' || source || ' ' END AS tag_string,
    source, lang, coalesce(toxic, 0) = 1 AS is_deleted, source LIKE '%7' AS is_banned
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "posts": """
  SELECT *, trim(source_url) AS clean_source,
    CASE WHEN lang = 'de' THEN [source, lang, 'shared'] ELSE [lang, source] END AS tags,
    'https://site0.example/posts/' || id AS canonical_url,
    CASE WHEN lang IN ('es', 'de') THEN large_file_url WHEN file_url LIKE '%.png' THEN file_url ELSE '' END
      AS download_url
  FROM feed""",
    "checked_posts": """
  SELECT *, CASE WHEN is_deleted THEN '삭제된 게시물' WHEN is_banned THEN '차단된 게시물'
                 WHEN download_url = '' THEN '지원하는 이미지 URL 없음' ELSE '' END AS skip_reason
  FROM posts""",
    "done_images": """
  SELECT doc_id + 1 AS image_id, 'site0' AS source_site, doc_id + 1 AS source_post_id
  FROM documents WHERE lang <> 'en'""",
    "done_vectors": """
  SELECT doc_id + 1 AS image_id, 'copy64' AS model_id FROM documents WHERE lang IN ('es', 'fr')
  UNION ALL SELECT doc_id + 1, 'sem32' FROM documents WHERE lang = 'es'""",
}

NEEDS = {"posts": ["feed"], "checked_posts": ["feed", "posts"]}


def with_(*names: str, **extra: str) -> str:
    """WITH clause holding the named inputs, what they need, and extra expressions."""
    order: list[str] = []
    for n in names:
        for need in [*NEEDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts_text(c: str) -> str:
    return TS.format(c)
