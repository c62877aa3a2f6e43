"""The banded hash join against every pair, its plans, and what a common hash costs."""

import random

import pytest

from imgtrace.operators import hashjoin as J
from imgtrace.operators import knn
from imgtrace.operators import search as S


def hex_of(word):
    return f"{word & (2**64 - 1):016x}"


def near(rnd, word, bits):
    for b in rnd.sample(range(64), bits):
        word ^= 1 << b
    return word


def words(seed=5, n=60):
    """Random words, each with others at 0 to 9 bits, runs of ones and zeros, and words that aren't hashes."""
    rnd = random.Random(seed)
    out = [0, 2**64 - 1, 2**63, 1, 2**63 - 1]
    for _ in range(n):
        w = rnd.getrandbits(64)
        out += [w, *(near(rnd, w, b) for b in range(rnd.randint(0, 9)))]
    return [hex_of(w) for w in out]


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def frame(spark, hashes, id_column, first=0):
    odd = [None, "", "zz" * 8, "ff", "ff" * 16]
    rows = [(first + i, h) for i, h in enumerate([*hashes, *odd])]
    return spark.createDataFrame(rows, f"{id_column} long, phash string"), {i: h for i, h in rows if h in set(hashes)}


@pytest.mark.parametrize("bits", [0, 1, 2, 5, 8, 13, 20])
@pytest.mark.parametrize("size", [1, 1000, 10**6, 10**9])
def test_bands_find_every_pair(bits, size):
    rnd = random.Random(bits + size)
    p = J.plan(bits, size)
    assert sum(b.width for b in p) == 64 and [b.low for b in p] == [sum(x.width for x in p[:j]) for j in range(len(p))]
    assert sum(b.radius + 1 for b in p) == bits + 1 or bits == 0
    part = lambda w, b: (w >> b.low) & ((1 << b.width) - 1)
    for _ in range(300):
        w = rnd.getrandbits(64)
        v = near(rnd, w, bits)
        assert any((part(w, b) ^ part(v, b)).bit_count() <= b.radius for b in p)
    assert all(len(set(b.changes())) == b.keys for b in p)


def test_plans_follow_the_size():
    few, many = J.plan(5, 1000), J.plan(5, 10**9)
    assert len(few) > len(many) and max(b.width for b in many) > max(b.width for b in few)
    with pytest.raises(ValueError):
        J.plan(64, 10)


@pytest.mark.parametrize("m", [None, 1, 2, 3, 6])
def test_matches_equal_all_pairs(spark, m, monkeypatch):
    if m:
        monkeypatch.setattr(J, "plan", lambda bits, _: J.bands(3 if m == 1 else 5, m))
    bits = 3 if m == 1 else 5
    if m == 1:
        monkeypatch.setattr(J, "plan", lambda *_: [J.Band(0, 64, 2)])
        bits = 2
    g, stored = frame(spark, words() + words()[:40], "image_id", 10)
    q, asked = frame(spark, words()[5:150], "query_id", 7000)
    want = {(i, k, distance(a, b)) for i, a in asked.items() for k, b in stored.items() if distance(a, b) <= bits}
    got = J.matching_pictures(q, g, bits).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    best = {}
    for i, k, d in want:
        best.setdefault(i, []).append((d, k))
    assert {tuple(r) for r in J.hash_matches(q, g, bits).collect()} == {(i, len(v), min(v)[1], min(v)[0]) for i, v in best.items()}


def test_same_pictures_and_search(spark):
    g, stored = frame(spark, words() + words()[:40], "image_id", 10)
    q, _ = frame(spark, words(5)[3:60] + words(6)[:30], "query_id")
    for r in J.same_pictures(g).collect():
        others = sorted((distance(stored[r["image_id"]], h), i) for i, h in stored.items() if i != r["image_id"])
        close = [x for x in others if x[0] <= 5]
        assert (r["links"], r["distance"], r["nearest"]) == (len(close), *(close[0] if close else (None, None)))
    assert J.same_pictures(g).count() == len(stored)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "image_id", "distance").collect())
    assert rows(J.hash_search_near(q, g)) == rows(S.hash_search(q, g))
    none = spark.createDataFrame([], "image_id long, phash string")
    assert J.hash_search_near(q, none).count() == 0 and J.same_pictures(none).count() == 0


def test_a_common_hash_is_one_row(spark):
    """Two thousand pictures of one hash and two thousand queries of it: one pair of words, no pair of pictures."""
    common = hex_of(12345)
    hashes = [common] * 2000 + words()[5:25]
    g, stored = frame(spark, hashes, "image_id")
    q, _ = frame(spark, [common] * 2000, "query_id")
    pairs = J.near_words(J.distinct_words(q, "query_id"), J.distinct_words(g, "image_id"), 5)
    assert pairs.count() == len({h for h in stored.values() if distance(h, common) <= 5})
    out = J.hash_matches(q, g)
    assert out.count() == 2000 and {(r["matches"], r["image_id"], r["distance"]) for r in out.collect()} == {(2000, 0, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString() and "Cross" not in plan


def within(asked, stored, bits, others):
    """(word, matches, nearest distance, its least id) by every pair; stored: word -> ids."""
    out = set()
    for w in asked:
        near = [((w ^ v).bit_count(), min(ids), len(ids)) for v, ids in stored.items() if not (others and v == w)]
        near = [x for x in near if x[0] <= bits]
        if near:
            out.add((w, sum(x[2] for x in near), *min(near)[:2]))
    return out


@pytest.mark.parametrize("max_shipped", [8192, 0])
@pytest.mark.parametrize("others", [True, False])
@pytest.mark.parametrize("bits", [0, 5, 20, 63])
def test_words_within_equal_all_pairs(spark, bits, others, max_shipped, monkeypatch):
    monkeypatch.setattr(knn, "_TILE", 500)
    g, stored = frame(spark, words() + words()[:40] + words(8), "image_id", -30)
    q, asked = frame(spark, words()[5:150] + words(9)[:20], "query_id")
    by_word = {}
    for i, h in stored.items():
        by_word.setdefault(int(h, 16), []).append(i)
    left, right = J.distinct_words(q, "query_id"), J.distinct_words(g, "image_id")
    got = {(r["word"] & (2**64 - 1), r["matches"], r["b"]["distance"], r["b"]["least"])
           for r in knn.words_within(left, right, bits, others, max_shipped).collect()}
    assert got == within({int(h, 16) for h in asked.values()}, by_word, bits, others)


def test_pictures_at_many_bits_are_compared_not_joined(spark, monkeypatch):
    """Bands at twenty bits make rows with the square of the table; at five bits they are kept."""
    bands = J.near_words
    monkeypatch.setattr(J, "near_words", lambda *_: pytest.fail("bands at twenty bits"))
    g, stored = frame(spark, words() + words()[:40], "image_id", 10)
    for r in J.same_pictures(g, 20).collect():
        close = sorted((distance(stored[r["image_id"]], h), i) for i, h in stored.items() if i != r["image_id"])
        close = [x for x in close if x[0] <= 20]
        assert (r["links"], r["distance"], r["nearest"]) == (len(close), *(close[0] if close else (None, None)))
    for size in (10**4, 10**6, 10**8):
        assert J.COMPARED * J.rows_per_word(J.plan(20, size), size) > size
    assert all(J.COMPARED * J.rows_per_word(J.plan(5, size), size) < size for size in (10**5, 10**7))
    monkeypatch.setattr(J, "near_words", bands)
    monkeypatch.setattr(J, "COMPARED", 0)
    by_bands = sorted(map(repr, J.same_pictures(g, 20).collect()))
    monkeypatch.setattr(J, "COMPARED", 100)
    assert by_bands == sorted(map(repr, J.same_pictures(g, 20).collect()))


def test_a_null_id_stays_the_nearest(spark):
    right = spark.createDataFrame([(7, 1, None), (6, 1, 9), (5, 1, 2)], "word long, n long, least long")
    got = {r["word"]: (r["matches"], r["b"]["distance"], r["b"]["least"]) for r in knn.words_within(right, right, 1, True).collect()}
    assert got == {7: (2, 1, 2), 6: (1, 1, None), 5: (1, 1, None)}
