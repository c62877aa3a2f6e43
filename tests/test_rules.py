"""Literal expectations for the column rules."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from imgtrace.functions import hashes as H
from imgtrace.functions import posts as P
from imgtrace.functions import rules as R
from imgtrace.functions import vectors as V


def column(spark, rows, schema, expr):
    def floats(x):
        return [float(v) for v in x] if isinstance(x, list) and "array<float>" in schema else x

    rows = [tuple(floats(x) for x in r) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r[0] for r in df.orderBy("_i").select(expr).collect()]


def test_hamming_hex(spark):
    rows = [("f0" * 8, "f0" * 8), ("0" * 16, "0" * 15 + "1"), ("0" * 16, "0" * 15 + "f"),
            ("0" * 16, "f" * 16), ("ABCDEF0123456789", "abcdef0123456789"), ("0" * 32, "f" * 32),
            ("f0", "0f"), ("", "f0"), ("f0", ""), ("", ""), ("f0f0", "f0f0f0f0"),
            ("zz" * 8, "zz" * 8), ("f0f", "0f0"), (None, "f0")]
    got = column(spark, rows, "a string, b string", H.hamming_hex(F.col("a"), F.col("b")))
    assert got == [0, 1, 4, 64, 0, 128, 8] + [None] * 7


def test_threshold(spark):
    got = column(spark, [("0" * 16,), ("0" * 32,), ("f0",), ("",)], "h string",
                 F.array(H.hash_bits(F.col("h")), H.same_image_threshold(F.col("h"))))
    assert got == [[64, 5], [128, 10], [8, 1], [0, 1]]
    d = column(spark, [("8f373714acfcf4d0", "8f373714acfcf4d2")], "a string, b string",
               H.hamming_hex(F.col("a"), F.col("b")))
    assert d[0] <= 5


def test_encode_sign(spark):
    v = [1.0, -1, 0, 2, -0.5, 3, -3, 0.1, 5]
    want = sum(1 << i for i, x in enumerate(v) if x > 0)
    rows = [(v,), ([1.0] * 12,), ([float("nan"), 1.0],), ([1.0] * 64,), ([1.0] * 65,)]
    got = column(spark, rows, "v array<float>", V.encode_sign(F.col("v")))
    assert got == [[want], [0x0FFF], [2], [-1], [-1, 1]]


def test_wire_round_trip(spark):
    vals = [1.0, -2.5, 0.0, 3.4e38, -3.4e38, 1e-38, 0.1]
    df = spark.createDataFrame([(vals,), ([1.0],)], "v array<float>")
    back = df.withColumn("w", V.encode_wire(F.col("v"))).withColumn(
        "d", V.decode_wire(F.col("w"), F.size("v"))).collect()
    assert all(r.v == r.d["values"] and r.d.reject is None for r in back)
    import base64
    assert base64.b64decode(back[1].w) == struct.pack("<f", 1.0) == bytes.fromhex("0000803f")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_wire_rejects_odd_lengths(spark, n):
    import base64
    text = base64.b64encode(b"x" * n).decode()
    got = column(spark, [(text,)], "w string", V.decode_wire(F.col("w"), F.lit(0)))
    assert got[0].reject == "length" and got[0]["values"] is None


def test_normalize(spark):
    inf, nan = float("inf"), float("nan")
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([inf, 1.0],), ([nan, 1.0],), ([1e-30, 1e-30],)]
    got = column(spark, rows, "v array<float>", V.normalize(F.col("v")))
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0, 0] and got[2] == [inf, 1]
    assert math.isnan(got[3][0]) and got[3][1] == 1
    assert got[4] == pytest.approx([2**-0.5] * 2)


def test_cosine(spark):
    rows = [([1.0, 2, 3], [1.0, 2, 3]), ([1.0, 2, 3], [2.0, 4, 6]), ([1.0, 0], [0.0, 1]),
            ([1.0, 0], [-1.0, 0]), ([0.0, 0], [1.0, 1])]
    got = column(spark, rows, "a array<float>, b array<float>", V.cosine(F.col("a"), F.col("b")))
    assert got == pytest.approx([1, 1, 0, -1, 0])
    with pytest.raises(Exception, match="sizes differ"):
        column(spark, [([1.0], [1.0, 2.0])], "a array<float>, b array<float>",
               V.cosine(F.col("a"), F.col("b")))


def test_first_non_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = [([1.0, 2],), ([1.0, nan],), ([-inf, nan],), ([0.0, 1.0, inf],), ([],)]
    got = column(spark, rows, "v array<float>", V.first_non_finite(F.col("v")))
    assert got == [None, 1, 0, 2, None]


def test_download_url(spark):
    ok = "https://x/a.jpg"
    rows = [("https://x/l.png", ok, ""), ("", ok, ""), ("", "", ok), ("https://x/a.GIF", "", ""),
            ("https://x/a.mp4", "https://x/b.webm", "https://x/c.zip"), ("https://x/a.jpg.exe", "", ""),
            ("https://x/A.JPEG?v=1#f", "", ""), ("https://x/noext", "", ""), (None, None, None),
            ("https://x/a.webp#frag.exe", "", ""), ("https://x/a?file=b.jpg", "", "")]
    got = column(spark, rows, "l string, f string, p string",
                 P.download_url(F.col("l"), F.col("f"), F.col("p")))
    assert got == ["https://x/l.png", ok, ok, "", "", "", "https://x/A.JPEG?v=1#f", "", "",
                   "https://x/a.webp#frag.exe", ""]


def test_skip_reason(spark):
    rows = [(False, False, "u"), (True, True, ""), (False, True, ""), (False, False, ""), (None, None, "u")]
    got = column(spark, rows, "d boolean, b boolean, u string",
                 P.skip_reason(F.col("d"), F.col("b"), F.col("u")))
    assert got == ["", P.SKIP_DELETED, P.SKIP_BANNED, P.SKIP_NO_URL, ""]


def test_tags(spark):
    got = column(spark, [("  a  b\tc\n",), ("",), (None,)], "s string", P.split_tags(F.col("s")))
    assert got == [["a", "b", "c"], [], []]
    merged = P.merged_tags(*[F.col(c) for c in "abcdef"])
    rows = [("x y", "art", "", "", "", ""), ("", "art", "ch", "co art", "g ch", "m")]
    assert column(spark, rows, ", ".join(f"{c} string" for c in "abcdef"), merged) == [
        ["x", "y"], ["art", "ch", "co", "g", "m"]]


def test_labels(spark):
    rows = [("g",), (" Sensitive ",), ("Q",), ("EXPLICIT",), ("",), (None,), ("odd",)]
    got = column(spark, rows, "r string", P.rating_label(F.col("r")))
    assert got == ["General", "Sensitive", "Questionable", "Explicit", "Unrated", "Unrated", "odd"]
    got = column(spark, [(["a", "b"],), ([],)], "t array<string>",
                 P.post_label(F.lit("s"), F.lit(7), F.col("t")))
    assert got == ["s #7 · a, b", "s #7"]
    got = column(spark, [([str(i) for i in range(14)],), (["x"],), ([],)], "t array<string>",
                 P.visible_tags(F.col("t")))
    assert got[0].endswith("11 and 2 more") and got[1:] == ["x", ""]


def test_thumb_path(spark):
    rows = [("Site", 0x1234), ("a/../b", 1), ("--", 256), ("", 2), ("日本", 3)]
    got = column(spark, rows, "s string, p long", P.thumb_path(F.col("s"), F.col("p")))
    assert got == ["site/34/12/4660.jpg", "a----b/01/00/1.jpg", "unknown/00/01/256.jpg",
                   "unknown/02/00/2.jpg", "unknown/03/00/3.jpg"]


def test_backoff(spark):
    rows = [(n,) for n in (0, 1, 2, 3, 4, 5, 6, 99)]
    assert column(spark, rows, "n int", R.range_backoff_minutes(F.col("n"))) == [1, 1, 2, 4, 8, 16, 30, 30]
    assert column(spark, rows, "n int", R.post_delay_minutes(F.col("n"))) == [2, 2, 4, 8, 16, 32, 64, 64]


def test_range_size_for(spark):
    rows = [(0.0,), (-1.0,), (0.001,), (0.5,), (100.0,)]
    assert column(spark, rows, "r double", R.range_size_for(F.col("r"), 1000)) == [1000, 1000, 100, 1800, 4000]


def test_estimate(spark):
    rows = [(100, 0.0), (0, 1.0), (3600, 1.0), (10, 1.0), (90, 1.0), (7380, 1.0)]
    got = column(spark, rows, "n long, r double", R.estimate_duration(F.col("n"), F.col("r")))
    assert got == [R.UNKNOWN_DURATION, R.UNKNOWN_DURATION, "1h0m0s", "0s", "2m0s", "2h3m0s"]


def test_distance_name(spark):
    rows = [("",), ("Cosine",), ("DOT",), ("l2",), ("manhattan",)]
    assert column(spark, rows, "d string", R.distance_name(F.col("d"), "flat")) == [
        "cosine", "cosine", "dot", None, None]
    assert column(spark, rows, "d string", R.distance_name(F.col("d"), "graph")) == [
        "cosine", "cosine", "dot", "euclid", "cosine"]


def test_failure_and_probe(spark):
    rows = [(429, "x"), (None, "context deadline exceeded"), (None, "i/o timeout"),
            (None, "read: connection reset by peer"), (None, "no such host"), (None, "?"), (None, None)]
    got = column(spark, rows, "c int, m string", R.failure_kind(F.col("c"), F.col("m")))
    assert got == ["HTTP 429", R.FAILURE_TIMEOUT, R.FAILURE_TIMEOUT, R.FAILURE_RESET, R.FAILURE_DNS,
                   R.FAILURE_OTHER, R.FAILURE_OTHER]
    rows = [(True, 200), (False, 0), (False, None), (False, 403), (False, 200)]
    got = column(spark, rows, "b boolean, s int", R.probe_verdict(F.col("b"), F.col("s")))
    assert got == [R.PROBE_BLOCKED, R.PROBE_FAILED, R.PROBE_FAILED, R.PROBE_REACHED + " 403", R.PROBE_OK]
    rows = [(1 << 20, 2.0), (65535, 1.0), (1 << 20, 0.0)]
    assert column(spark, rows, "n long, s double", R.throughput_mbps(F.col("n"), F.col("s"))) == [0.5, 0, 0]
