"""Scans against numpy brute force, both ways of bringing queries and gallery together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtrace.operators import knn
from imgtrace.operators import search as S
from imgtrace.plans import evaluation


def frames(spark, q, g, kind):
    mk = lambda m, name: spark.createDataFrame(
        [(int(i), [x.item() for x in r]) for i, r in enumerate(m, 1)], f"{name} long, code array<{kind}>")
    return mk(q, "query_id"), mk(g, "image_id")


def brute(key, k):
    ids = np.arange(1, key.shape[1] + 1)
    return [[(int(ids[i])) for i in np.lexsort((ids, row))[:k]] for row in key]


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.image_id)
    return [out[i] for i in sorted(out)]


@pytest.mark.parametrize("n", [1, 5, 39, 40, 41, 1000])
@pytest.mark.parametrize("k", [1, 10, 40])
@pytest.mark.parametrize("max_shipped", [1000, 2])
def test_codes(spark, n, k, max_shipped):
    rng = np.random.default_rng(31)
    # Few distinct values make many ties.
    q = rng.integers(0, 8, size=(7, 2)).astype(np.int64)
    g = rng.integers(0, 8, size=(n, 2)).astype(np.int64)
    dq, dg = frames(spark, q, g, "long")
    key = np.bitwise_count(q[:, None, :] ^ g[None, :, :]).sum(axis=2)
    got = knn.nearest_codes(dq, dg, k, max_shipped=max_shipped)
    assert result(got) == brute(key, k)


def test_kernel_prunes_exactly():
    rng = np.random.default_rng(5)
    for metric in knn.METRICS:
        make = (lambda n: rng.integers(-2**63, 2**63 - 1, size=(n, 3))) if metric == "hamming" else (
            lambda n: np.round(rng.standard_normal((n, 6)), 1).astype(np.float32))
        q = make(23)
        state = knn._TopK(metric, 9, np.arange(23), q)
        parts, ids = [make(n) for n in (3, 4, 700, 1, 900, 50)], []
        at = 0
        for p in parts:
            mine = np.arange(at, at + len(p))[::-1]
            ids.append(mine)
            state.feed(mine, p)
            at += len(p)
        got = np.concatenate([b.column(1).to_numpy() for b in state.rows()]).reshape(23, 9)
        g, ids = np.concatenate(parts), np.concatenate(ids)
        key = knn._keys(metric, knn._prepare(metric, q), knn._prepare(metric, g))
        for r in range(23):
            assert (ids[np.lexsort((ids, key[r]))[:9]] == got[r]).all()


def odd_vectors(rng, n):
    """Clusters, copies, zeros, lengths from 1e-30 to 1e30, single huge and tiny components, NaN and infinities."""
    m = rng.standard_normal((6, 8))[rng.integers(0, 6, n)] + 0.05 * rng.standard_normal((n, 8))
    m[: n // 3] = m[rng.integers(0, 5, n // 3)]
    m[n // 3 : n // 2] *= 10.0 ** rng.integers(-30, 30, (n // 2 - n // 3, 1))
    at = rng.permutation(n)
    m[at[: n // 20]] = 0
    for place, x in zip(at[-7:], (np.nan, np.inf, -np.inf, 1e200, 1e-200, -1e30, 1e38)):
        m[place, 3] = x
    return m


@pytest.mark.parametrize("kind", [np.float64, np.float32])
@pytest.mark.parametrize("make", [knn._TopK, knn._TopKAndDot])
@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_float32_bound_loses_nothing(make, metric, kind):
    rng = np.random.default_rng(8)
    q, g = odd_vectors(rng, 90).astype(kind), odd_vectors(rng, 5000).astype(kind)
    ids = rng.permutation(5000)
    state = make(metric, 4, np.arange(90), q)
    for s in (0, 30, 1500, 2600):
        e = {0: 30, 30: 1500, 1500: 2600, 2600: 5000}[s]
        state.feed(ids[s:e], g[s:e])
    for x, batch in zip(state.lists, state.rows()):
        key = knn._keys(x.metric, knn._prepare(x.metric, q), knn._prepare(x.metric, g))
        got = batch.column(1).to_numpy().reshape(90, x.k)
        # products of copies may differ in the last bit of a double, so keys are compared, and ids where keys are exact
        want = np.lexsort((np.broadcast_to(ids, key.shape), key), axis=1)[:, : x.k]
        place = np.argsort(ids)[got]
        np.testing.assert_allclose(np.take_along_axis(key, place, 1), np.take_along_axis(key, want, 1), rtol=1e-6)
        assert (got == ids[want]).mean() > 0.99 and all(len(set(r)) == x.k for r in got.tolist())


def test_few_pairs_are_computed_in_double(monkeypatch):
    rng = np.random.default_rng(9)
    cells, keys = [], knn._keys
    monkeypatch.setattr(knn, "_keys", lambda m, q, g: cells.append(len(q[0]) * len(g[0])) or keys(m, q, g))
    state = knn._TopK("cosine", 5, np.arange(100), rng.standard_normal((100, 32)))
    for s in range(0, 20_000, 5000):
        state.feed(np.arange(s, s + 5000), rng.standard_normal((5000, 32)))
    assert sum(cells) < 100 * 20_000 / 10


@pytest.mark.parametrize("max_shipped", [1000, 2])
def test_threshold_scores_scan_the_vectors_once(spark, max_shipped, monkeypatch):
    rng = np.random.default_rng(3)
    mk = lambda n, name: spark.createDataFrame(
        [(i, [x.item() for x in r], f"{h:016x}", "real" if i % 3 else "fake") for i, (r, h) in enumerate(
            zip(rng.standard_normal((n, 8)) * rng.uniform(0.2, 3, (n, 1)), rng.integers(0, 2**62, n)), 1)],
        f"{name} long, vector array<float>, phash string, kind string").cache()
    q, g = mk(30, "query_id"), mk(400, "image_id").drop("kind")
    apart = {r.query_id: [r.score] for r in knn.nearest_vectors(q, g, 1, metric="dot").collect()}
    for r in S.two_step_scores(q, g, 20).collect():
        apart[r.query_id].append(r.score)
    monkeypatch.setattr(knn, "ship", lambda *a, ship=knn.ship, **k: ship(*a[:2], max_shipped, **{
        x: y for x, y in k.items() if x != "max_shipped"}))
    found = evaluation.threshold_scores(q, g, 20)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    rows = found.where("method != 'phash'").orderBy("query_id", "method").collect()
    assert [(r.query_id, r.score) for r in rows] == [(i, x) for i in sorted(apart) for x in apart[i]]
    assert found.where("method = 'phash'").count() == 30


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("max_shipped", [1000, 2])
def test_vectors(spark, metric, max_shipped):
    rng = np.random.default_rng(1)
    q = rng.standard_normal((9, 16)).astype(np.float32)
    g = rng.standard_normal((300, 16)).astype(np.float32)
    dq, dg = frames(spark, q, g, "float")
    got = knn.nearest_vectors(dq, dg, 6, metric=metric, vector="code", max_shipped=max_shipped)
    a, b = q.astype(float), g.astype(float)
    score = {"dot": -(a @ b.T), "cosine": -(a @ b.T) / np.linalg.norm(a, axis=1)[:, None]
             / np.linalg.norm(b, axis=1), "euclid": np.linalg.norm(a[:, None] - b, axis=2)}[metric]
    assert result(got) == brute(score.astype(np.float32), 6)


@pytest.mark.parametrize("max_shipped", [1000, 2])
def test_answer_rank_counts_ties_against_the_answer(spark, max_shipped):
    g = np.array([[1.0, 0], [1.0, 0], [0.5, 0], [0.0, 1]], dtype=np.float32)
    q = spark.createDataFrame(
        [(1, 1, [1.0, 0.0], 1.0), (2, 3, [1.0, 0.0], 0.5), (3, 4, [0.0, 1.0], 1.0)],
        "query_id long, answer_id long, code array<float>, own double")
    _, dg = frames(spark, g, g, "float")
    got = knn.answer_rank(q, dg, "dot", "code", "own", max_shipped=max_shipped)
    assert {r.query_id: r["rank"] for r in got.collect()} == {1: 1, 2: 2, 3: 0}


def ranks_of(metric, q, answer, own, gid, g, cuts):
    """Ranks by the reducer, and by every pair's key."""
    state = knn._Ahead(metric, 0, np.arange(len(q)), q, (answer, own))
    for s, e in zip(cuts, cuts[1:]):
        state.feed(gid[s:e], g[s:e])
    got, = state.rows()
    key = knn._keys(metric, knn._prepare(metric, q), knn._prepare(metric, g))
    mine = own.astype(np.uint16) if metric == "hamming" else (own if metric == "euclid" else -own).astype(np.float32)
    return got.column(1).to_numpy(), (
        (key <= mine[:, None]) & (gid[None, :] != answer[:, None])).sum(axis=1)


@pytest.mark.parametrize("kind", [np.float64, np.float32])
@pytest.mark.parametrize("per", [1, 5, 20])
@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_rank_counts_every_row_of_odd_vectors(metric, per, kind):
    rng = np.random.default_rng(per)
    g, gid = odd_vectors(rng, 3000).astype(kind), rng.permutation(3000)
    gid[::50] = gid[1::50]  # some ids have two rows
    at = rng.integers(0, 3000, 40).repeat(per)
    q = (g[at] + rng.normal(0, 0.1, (len(at), 8)) * (np.arange(len(at)) % per * 0.5)[:, None]).astype(kind)
    key = knn._keys(metric, knn._prepare(metric, q), knn._prepare(metric, g))[np.arange(len(at)), at]
    own = (key if metric == "euclid" else -key).astype(float)
    own[::17] = rng.normal(size=len(own[::17]))
    own[3], own[5] = np.nan, np.inf
    got, want = ranks_of(metric, q, gid[at], own, gid, g, [0, 30, 1500, 3000])
    assert (got == want).all() and want.any()


@pytest.mark.parametrize("words", [1, 3])
@pytest.mark.parametrize("per", [1, 5, 20])
def test_rank_counts_every_code(words, per):
    rng = np.random.default_rng(per)
    g, gid = rng.integers(-2**63, 2**63 - 1, (3000, words)), rng.permutation(3000)
    g[1000:2000] = g[:1000] ^ (1 << rng.integers(0, 60, (1000, words)))
    gid[::50] = gid[1::50]
    at = rng.integers(0, 3000, 60).repeat(per)
    q = g[at].copy()
    for i in range(len(at)):
        q[i, 0] ^= int(np.bitwise_or.reduce(1 << rng.integers(0, 62, i % per * 8, dtype=np.int64), initial=0))
    own = np.bitwise_count((q ^ g[at]).view(np.uint64)).sum(axis=1).astype(float)
    own[::11] = rng.integers(0, 66, len(own[::11]))
    got, want = ranks_of("hamming", q, gid[at], own, gid, g, [0, 30, 1500, 3000])
    assert (got == want).all() and want.any()


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_copies_that_tie_with_far_queries_are_compared_together(metric, monkeypatch):
    rng = np.random.default_rng(7)
    g, gid = rng.standard_normal((3000, 16)), rng.permutation(3000)
    g[::2] = g[0]
    at = np.arange(60).repeat(4)
    q = rng.standard_normal((len(at), 16))  # nothing like their answers: no centre rules rows out
    own = -knn._keys(metric, knn._prepare(metric, q), knn._prepare(metric, g))[np.arange(len(at)), at].astype(float)
    pairs, keys = [], knn._pair_keys
    monkeypatch.setattr(knn, "_pair_keys", lambda m, a, b, r, c: pairs.append(len(r)) or keys(m, a, b, r, c))
    got, want = ranks_of(metric, q, gid[at], own, gid, g, [0, 1500, 3000])
    assert (got == want).all() and sum(pairs) < len(q) * 10


@pytest.mark.parametrize("metric", ["dot", "hamming"])
def test_queries_of_one_answer_share_their_comparisons(metric, monkeypatch):
    rng = np.random.default_rng(2)
    g = rng.standard_normal((4000, 64))
    at = np.arange(300).repeat(5)
    q = g[at] + 0.1 * (np.arange(len(at)) % 5)[:, None] * rng.standard_normal((len(at), 64))
    own = np.einsum("ij,ij->i", q, g[at])
    if metric == "hamming":
        q, g = (np.packbits(m > 0, axis=1, bitorder="little").view("<i8") for m in (q, g))
        own = np.bitwise_count((q ^ g[at]).view(np.uint64))[:, 0].astype(float)
    cells, keys, product = [], knn._keys, knn._Tile._product
    monkeypatch.setattr(knn, "_keys", lambda m, a, b: cells.append(knn._rows(m, a, slice(None))[0].shape[-1 if m == "hamming" else 0]
                                                                   * b[0].shape[-1 if m == "hamming" else 0]) or keys(m, a, b))
    monkeypatch.setattr(knn._Tile, "_product", lambda t, n, u: cells.append(len(u) * len(t.gid)) or product(t, n, u))
    state = knn._Ahead(metric, 0, np.arange(len(q)), q, (at, own))
    state.feed(np.arange(4000), g)
    assert sum(cells) < len(q) * len(g) / 3


def test_rank_blocks_of_many_queries_stay_as_many():
    assert knn.block_count(3_076_920, 64, 200, knn._Ahead.numbers) == 32
    assert knn.block_count(12_000_000, 64, 200, knn._Ahead.numbers) == 92


def test_queries_of_one_answer_meet_in_one_block(spark):
    rng = np.random.default_rng(6)
    g = rng.standard_normal((200, 8)).astype(np.float32)
    _, gallery = frames(spark, g, g, "float")
    near = lambda i, n: (i * 8 + n, i + 1, [x.item() for x in g[i] * (1 + n)], float(g[i] @ g[i] * (1 + n)))
    q = spark.createDataFrame([near(i, n) for i in range(200) for n in range(5)],
                              "query_id long, answer_id long, code array<float>, own double")
    got = knn.answer_rank(q, gallery, "dot", "code", "own", max_shipped=2, width=8)
    want = ((g.astype(float) @ g.T.astype(float)).astype(np.float32) >= np.einsum(
        "ij,ij->i", g.astype(float), g.astype(float)).astype(np.float32)[:, None]).sum(axis=1) - 1
    assert {r.query_id: r["rank"] for r in got.collect()} == {i * 8 + n: want[i] for i in range(200) for n in range(5)}


def test_rows_of_another_size_are_dropped(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    g = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 0.0, 0.0]), (4, None)],
                              "image_id long, vector array<float>")
    assert result(knn.nearest_vectors(q, g, 5)) == [[1]]


def test_empty_sides(spark):
    q = spark.createDataFrame([(1, [1])], "query_id long, code array<long>")
    g = spark.createDataFrame([], "image_id long, code array<long>")
    assert knn.nearest_codes(q, g, 3).count() == 0
    assert knn.nearest_codes(q.limit(0), q.withColumnRenamed("query_id", "image_id"), 3).count() == 0


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, image_id long, score float, vector_rank int, phash string")


def test_rerank_brings_equal_hash_first(spark):
    qh = spark.createDataFrame([(1, "00000000000000ff")], "query_id long, phash string")
    hits = _hits(spark, [(1, 1, 0.99, 1, "ffffffffffffff00"), (1, 2, 0.95, 2, None),
                         (1, 3, 0.90, 3, "00000000000000ff"), (1, 4, 0.80, 4, "00000000000000fe")])
    got = S.rerank(hits, qh, 5).orderBy("hit_rank").collect()
    assert [(r.image_id, r.hash_distance, r.exact) for r in got] == [
        (3, 0, True), (4, 1, True), (1, 64, False), (2, -1, False)]
    assert S.exact_match(S.rerank(hits, qh, 5)).first().exact_match


def test_rerank_without_equal_hash_keeps_vector_order(spark):
    qh = spark.createDataFrame([(1, "")], "query_id long, phash string")
    hits = _hits(spark, [(1, 1, 0.9, 1, "00000000000000ff"), (1, 2, 0.9, 2, "00000000000000ff"),
                         (1, 3, 0.8, 3, "0000000000000000")])
    got = S.rerank(hits, qh, 2).orderBy("hit_rank").collect()
    assert [(r.image_id, r.exact) for r in got] == [(1, False), (2, False)]


def test_defaults():
    assert S.coarse_want(25) == 100 and S.coarse_want(3) == 40
    assert S.effective_candidates(5, 25) == 25 and S.effective_candidates(5, 3) == 20


def test_missing_original_vanishes(spark):
    c = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, image_id long")
    v = spark.createDataFrame([(1, "m", [1.0]), (2, "other", [1.0])],
                              "image_id long, model_id string, vector array<float>")
    assert [r.image_id for r in S.fetch_originals(c, v, "m").collect()] == [1]


def test_gallery_is_not_shuffled_for_shipped_queries(spark):
    q = spark.createDataFrame([(1, [1])], "query_id long, code array<long>")
    g = spark.range(1000).select(F.col("id").alias("image_id"), F.array("id").alias("code"))
    plan = knn.nearest_codes(q, g, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow")[1]
    assert "Exchange" not in below and plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("first", [[], [1.0], [1.0] * 9])
@pytest.mark.parametrize("max_shipped", [1000, 2])
def test_wrong_sized_first_gallery_row(spark, first, max_shipped):
    rows = [(0, first), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 1.0])]
    gallery = spark.createDataFrame(rows, "image_id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, [1.0, 0.1]) for i in range(3)], "query_id long, vector array<double>")
    assert knn.stored_width(gallery, "vector") == 2
    assert result(knn.nearest_vectors(queries, gallery, 3, max_shipped=max_shipped)) == [[1, 4, 2]] * 3
    assert {r.image_id for r in knn.wrong_sized(gallery, "vector", 2, "image_id").collect()} == {0, 3}


def test_shuffled_scan_hands_on_k_rows_a_query(spark):
    rng = np.random.default_rng(4)
    dq, dg = frames(spark, rng.integers(0, 99, size=(40, 1)), rng.integers(0, 99, size=(300, 1)), "long")
    got = knn._scan(knn._TopK, "hamming", 7, knn._as_queries(dq, "code"), knn._as_gallery(dg, "code"), None, 1)
    assert got.count() == 40 * 7


def test_blocks_stay_as_many_until_they_are_full():
    assert [knn.block_count(n, 64, 200) for n in (10_000, 100_000, 600_000)] == [32] * 3
    assert knn.block_count(3_000_000, 64, 200) == 92
    assert knn.block_count(3_000_000, 1, 200) == 46
