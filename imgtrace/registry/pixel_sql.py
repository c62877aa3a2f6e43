"""The pixel jobs as SQL over lists of numbers, for one grey picture size.

A picture table has one row per pixel row: (image_id, y, px DOUBLE[]).
"""

from __future__ import annotations

WIDTH, HEIGHT = 136, 40
HASH_WIDTH, HASH_HEIGHT = 128, 38


def _ramp(n_out: int) -> str:
    return (f"SELECT i, [greatest(0, 1 - abs(i * (7.0::DOUBLE / {n_out - 1}) - k)) for k in range(0, 8)] AS w "
            f"FROM range(0, {n_out}) t(i)")


PICTURES = {
    "ramp_y": _ramp(HEIGHT),
    "ramp_x": _ramp(WIDTH),
    "mixed": """
  SELECT vec_id + 1 AS image_id, i AS y,
    [list_sum([w[r + 1] * CAST(embedding[r * 8 + c + 1] AS DOUBLE) for r in range(0, 8)]) for c in range(0, 8)] AS g
  FROM embeddings, ramp_y""",
    "pic": """
  SELECT image_id, y, list(greatest(0, least(255, round_even(128 + 300 * list_dot_product(g, w), 0))) ORDER BY i) AS px
  FROM mixed, ramp_x GROUP BY image_id, y""",
}


def _weights(n_in: int, n_out: int) -> str:
    s = n_in / n_out
    f = max(s, 1.0)
    t = f"((x - c + 0.5) / {f!r}::DOUBLE)"
    sinc = lambda v: f"CASE WHEN {v} = 0 THEN 1 ELSE sin(pi() * {v}) / (pi() * {v}) END"
    raw = (f"[CASE WHEN abs({t}) < 3 AND x >= floor(c - {3 * f!r}::DOUBLE + 0.5) AND x < floor(c + {3 * f!r}::DOUBLE + 0.5) "
           f"THEN ({sinc(t)}) * ({sinc(f'({t} / 3)')}) ELSE 0 END for x in range(0, {n_in})]")
    return (f"SELECT o, [round_even(v / list_sum(raw) * 4194304, 0) for v in raw] AS w FROM ("
            f"SELECT o, {raw} AS raw FROM (SELECT o, (o + 0.5) * {s!r}::DOUBLE AS c FROM range(0, {n_out}) t(o)))")


_FIXED = "greatest(0, least(255, floor(({} + 2097152) / 4194304)))"


def resized(name: str, src: str, w_in: int, h_in: int, w_out: int, h_out: int) -> dict[str, str]:
    """CTEs that shrink picture table `src` into `name`: columns first, then rows."""
    out = {}
    across = src
    if w_in != w_out:
        out[f"{name}_wx"] = _weights(w_in, w_out)
        across = f"{name}_x"
        out[across] = (f"SELECT image_id, y, list({_FIXED.format('list_dot_product(px, w)')} ORDER BY o) AS px "
                       f"FROM {src}, {name}_wx GROUP BY image_id, y")
    out[f"{name}_wy"] = _weights(h_in, h_out)
    out[f"{name}_cols"] = (f"SELECT image_id, x, list(px[x + 1] ORDER BY y) AS col "
                           f"FROM {across}, range(0, {w_out}) t(x) GROUP BY image_id, x")
    out[name] = (f"SELECT image_id, o AS y, list({_FIXED.format('list_dot_product(col, w)')} ORDER BY x) AS px "
                 f"FROM {name}_cols, {name}_wy GROUP BY image_id, o")
    return out


def hex_md5(src: str, each: str = "repeat(printf('%02X', CAST(p AS INTEGER)), 3)") -> str:
    """Per picture: md5 of the hex text of its bytes, each value written by `each`."""
    return (f"SELECT image_id, md5(string_agg(array_to_string([{each} for p in px], ''), '' ORDER BY y)) AS md5 "
            f"FROM {src} GROUP BY image_id")


GREY_BYTE = "printf('%02X', CAST(p AS INTEGER))"
HASHED = {**PICTURES, **resized("hashed", "pic", WIDTH, HEIGHT, HASH_WIDTH, HASH_HEIGHT)}


def _dct(n: int) -> str:
    """First n rows of the orthonormal 32-point DCT-II."""
    return (f"SELECT u, [cos(pi() * (2 * k + 1) * u / 64) * CASE WHEN u = 0 THEN sqrt(1.0 / 32) ELSE 0.25 END "
            f"for k in range(0, 32)] AS d FROM range(0, {n}) t(u)")


def coefficients(src: str, n: int) -> dict[str, str]:
    """coef(image_id, u, v, c): the n x n lowest frequencies of a 32x32 picture."""
    return {
        "dct": _dct(n),
        "half_dct": f"SELECT image_id, y, u AS v, list_dot_product(px, d) AS a FROM {src}, dct",
        "coef": "SELECT image_id, u, v, sum(d[y + 1] * a ORDER BY y) AS c FROM half_dct, dct GROUP BY image_id, u, v",
    }


PACK = ("printf('%08x%08x', CAST(list_sum([CASE WHEN b[i] THEN 1::BIGINT << (32 - i) ELSE 0 END for i in range(1, 33)]) AS BIGINT), "
        "CAST(list_sum([CASE WHEN b[i] THEN 1::BIGINT << (64 - i) ELSE 0 END for i in range(33, 65)]) AS BIGINT))")

PHASH = {**HASHED, **resized("small", "hashed", HASH_WIDTH, HASH_HEIGHT, 32, 32), **coefficients("small", 8)}
PHASH_SQL = f"""
SELECT image_id, {PACK} AS phash FROM (
  SELECT image_id, [x > list_aggregate(cs[2:], 'median') for x in cs] AS b
  FROM (SELECT image_id, list(c ORDER BY u, v) AS cs FROM coef GROUP BY image_id))"""

DHASH = {**HASHED, **resized("small", "hashed", HASH_WIDTH, HASH_HEIGHT, 9, 8)}
DHASH_SQL = f"""
SELECT image_id, {PACK} AS dhash FROM (
  SELECT image_id, flatten(list([px[i + 1] > px[i] for i in range(1, 9)] ORDER BY y)) AS b FROM small GROUP BY image_id)"""

EMBED = {**PICTURES, **resized("small", "pic", WIDTH, HEIGHT, 32, 32), **coefficients("small", 12)}
EMBED_SQL = """
SELECT image_id, model_id, any_value(size)::INTEGER AS n, round(sum(c * rn) / sqrt(sum(c * c)), 3) AS weighted
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY u + v, u, v) - 1 AS rn FROM coef) k
JOIN (VALUES ('copy64', 64), ('sem32', 32)) m(model_id, size) ON rn BETWEEN 1 AND size GROUP BY image_id, model_id"""

_DX, _DY, _PAD, _BAR = WIDTH // 10, HEIGHT // 10, HEIGHT * 8 // 100, HEIGHT * 88 // 100
_RGB = "array_to_string([repeat(printf('%02X', CAST(p AS INTEGER)), 3) for p in px], '')"
_EDGE = "repeat('161212', {})"
DEGRADE = {**PICTURES, **resized("half", "pic", WIDTH, HEIGHT, WIDTH // 2, HEIGHT // 2), "damaged": f"""
  SELECT image_id, 'half' AS degradation, {WIDTH // 2} AS width, {HEIGHT // 2} AS height, y, {_RGB} AS line FROM half
  UNION ALL
  SELECT image_id, 'crop', {WIDTH - 2 * _DX}, {HEIGHT - 2 * _DY}, y, {_RGB}
  FROM (SELECT image_id, y, px[{_DX + 1}:{WIDTH - _DX}] AS px FROM pic WHERE y >= {_DY} AND y < {HEIGHT - _DY})
  UNION ALL
  SELECT image_id, 'bar', {WIDTH}, {HEIGHT}, y, CASE WHEN y >= {_BAR} THEN repeat('141414', {WIDTH}) ELSE {_RGB} END FROM pic
  UNION ALL
  SELECT image_id, 'border', {WIDTH + 2 * _PAD}, {HEIGHT + 2 * _PAD}, y + {_PAD},
    {_EDGE.format(_PAD)} || {_RGB} || {_EDGE.format(_PAD)} FROM pic
  UNION ALL
  SELECT vec_id + 1, 'border', {WIDTH + 2 * _PAD}, {HEIGHT + 2 * _PAD}, y, {_EDGE.format(WIDTH + 2 * _PAD)}
  FROM embeddings, range(0, {HEIGHT + 2 * _PAD}) t(y) WHERE y < {_PAD} OR y >= {HEIGHT + _PAD}"""}
DEGRADE_SQL = """
SELECT image_id, degradation, width, height, md5(string_agg(line, '' ORDER BY y)) AS pixels_md5
FROM damaged GROUP BY ALL"""
