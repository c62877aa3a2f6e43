"""Scores, packing, search, mixing, pages, quality and the pipeline against plain versions."""

import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from common import components, dedup_lines, edge_docs, edge_rows, held_out, no_docs, shingles, words
from imgtrace.llm import brown, minhash, mixing, multi_index, packing, pages, quality
from imgtrace.llm.tables import materialize


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_sql(docs, sql, **renamed):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    return con.sql(sql).fetchall(), con.sql(sql).columns


def same_rows(got, sql_rows, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in got) == sorted(map(repr, sql_rows))


# --- Brown scores ---

@pytest.mark.parametrize("core", [1 << 18, 300])
def test_base_scores(spark, sf, core, monkeypatch):
    monkeypatch.setattr(brown, "CORE", core)
    out = brown.op1_brown_scores(spark, sf).collect()
    texts = dict(pairs(spark.read.parquet(f"{sf}/documents.parquet")))
    c, ends = Counter(), 0
    for d, t in texts.items():
        if not held_out(d, 5, 1):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    assert len(out) == len(texts)
    for r in out:
        w = words(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held_out(r["doc_id"], 5, 1), len(w) + 1, n)
        assert r["n_known"] == sum(c[x] > 0 for x in w) + 1
        assert math.isclose(r["base_score"], sum(log(c[x]) for x in w) + log(ends), rel_tol=1e-9)
    apart = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_scores_are_probabilities(spark):
    """Over all words after a given word, and one unknown a class, they sum to 1."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", "b a c c dddddd", "a", ""])], "doc_id long, text string")
    model = brown.learn(docs)
    for before in range(model.end + 1):
        assert math.isclose(sum(10 ** model.log_next[before]), 1.0, rel_tol=1e-9)
    for c in range(model.end + 1):
        sizes = [n for n, k in zip(model.n, model.classes) if k == c] + ([model.ends] if c == model.end else [])
        assert math.isclose(sum(10 ** model.emission_log(n, c) for n in [*sizes, 0]), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("core", [1 << 18, 40, 0])
def test_scores_by_a_plain_model(spark, sf, core, monkeypatch):
    """Whatever share of the words travels to the tasks: every word has the class its contexts gain most in, transitions are those
    of all tokens, and a text's score is the plain sum of logarithms."""
    monkeypatch.setattr(brown, "CORE", core)
    monkeypatch.setattr(brown, "PER_CLASS", 3)
    monkeypatch.setattr(brown, "PENDING", 500)
    monkeypatch.setattr(brown, "STEP", 300)
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).withColumn("held_out", F.col("doc_id") % 3 == 0).repartition(5)
    docs = docs.select("doc_id", "text", "held_out")
    docs = docs.unionByName(spark.createDataFrame([(-1, "a a a", True), (-2, None, False), (-3, "zq zqq zq", False), (-4, " zqx zqx", True)], docs.schema))
    model = brown.learn(docs.where("NOT held_out"))
    rows = docs.collect()
    train = [words(r["text"]) for r in rows if not r["held_out"]]
    count = Counter(w for t in train for w in t)
    table = model.words.toPandas().set_index("h")
    h = {w: int(brown.signed(brown.hash_words(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])))[0])
         for r in rows for w in words(r["text"])}
    assert len(table) == len(count) == len({h[w] for w in count}) and all(table["n"][h[w]] == n for w, n in count.items())
    classes = brown.class_count(len(count))
    assert model.end == classes and table["class"].between(0, classes - 1).all()
    own = {w: int(table["class"][h[w]]) for w in count}
    moves, end = np.zeros((classes + 1, classes + 1)), classes
    for t in train:
        c = [end, *[own[w] for w in t], end]
        np.add.at(moves, (c[:-1], c[1:]), 1)
    share = (moves.sum(0) + brown.HALF) / (moves.sum() + brown.HALF * (classes + 1))
    log_next = np.log10((moves + brown.PULL * share) / (moves.sum(1, keepdims=True) + brown.PULL))
    assert np.allclose(log_next, model.log_next)

    first = sorted(count, key=lambda w: (-count[w], h[w]))[:3 * classes]
    of = {w: own[w] for w in first}
    k = classes + 2
    n, seen = np.zeros((k, k)), {w: np.zeros((2, k)) for w in count}
    for t in train:
        c = [k - 1, *[of.get(w, k - 2) for w in t], k - 1]
        np.add.at(n, (c[:-1], c[1:]), 1)
        for i, w in enumerate(t):
            seen[w][0, c[i]] += 1
            seen[w][1, c[i + 2]] += 1
    for w in set(count) - set(first):
        got = brown.gains(n, *seen[w], 0.0)[:classes]
        assert math.isclose(got[own[w]], got.max(), rel_tol=1e-9, abs_tol=1e-7)

    once = Counter((min((len(w.encode()) - 1) // 4, 3), own[w]) for w, x in count.items() if x == 1)
    unseen = [max(range(classes), key=lambda c: once[s, c]) for s in range(4)]
    size = Counter(own.values())
    total = moves.sum(0)
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in brown.score(docs, model).collect():
        t, before, want = words(texts[r["doc_id"]]), end, 0.0
        for w in t:
            c = own.get(w, unseen[min((len(w.encode()) - 1) // 4, 3)])
            want += log_next[before, c] + math.log10((count[w] + 0.5) / (total[c] + 0.5 * (size[c] + 1)))
            before = c
        want += log_next[before, end] + math.log10((len(train) + 0.5) / (total[end] + 0.5 * 2))
        assert math.isclose(r["score"], want, rel_tol=1e-9)


def test_many_gains_are_gains():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 20, (9, 9)).astype(float)
    left, right = (rng.integers(0, 4, (50, 9)) * (rng.random((50, 9)) < 0.4) + np.eye(9)[rng.integers(0, 9, 50)] for _ in range(2))
    got = brown.many_gains(n, left, right, 7)
    want = np.array([brown.gains(n, a, b, 0.0)[:7] for a, b in zip(left, right)])
    assert np.allclose(got, want)


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 9, (30, 30)).astype(float)
    own = rng.integers(0, 5, 30)

    def likelihood(own):
        hot = np.eye(5)[own]
        n = hot.T @ b @ hot
        return brown.xlogx(n).sum() - brown.xlogx(n.sum(0)).sum() - brown.xlogx(n.sum(1)).sum()

    for w in range(30):
        hot = np.eye(5)[own]
        hot[w] = 0
        got = brown.gains(hot.T @ b @ hot, b[:, w] @ hot, b[w] @ hot, b[w, w])
        want = np.array([likelihood(np.where(np.arange(30) == w, d, own)) for d in range(5)])
        assert np.allclose(got - got[0], want - want[0])


def test_exchange_finds_classes():
    """Words of two kinds that only follow each other end in classes of one kind each."""
    rng = np.random.default_rng(0)
    b = np.zeros((42, 42))
    kind = rng.integers(0, 2, 40)
    for i in range(40):
        for j in range(40):
            b[i, j] = rng.integers(5, 20) * (kind[i] != kind[j])
    own, _ = brown.exchange(b, 40, 2)
    assert len(set(zip(own.tolist(), kind.tolist()))) == 2


def test_scores_on_edge_rows(spark):
    docs = edge_docs(spark)
    out = brown.score(docs, brown.learn(docs)).collect()
    assert len(out) == len(edge_rows()) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    twice = [(r["score"], r["n_tokens"]) for r in out if r["doc_id"] == 7]
    assert len(twice) == 2 and math.isclose(twice[0][0], twice[1][0])
    assert brown.score(no_docs(spark), brown.learn(no_docs(spark))).count() == 0
    assert brown.score(docs, brown.learn(no_docs(spark))).where("n_known > 0").count() == 0


# --- packing ---

def placed(counts, capacity):
    bins = {}
    for w, n in counts.items():
        runs = packing.plan(counts, capacity)[w]
        for i in range(n):
            r = runs[np.searchsorted(runs[:, 0], i, "right") - 1]
            bins.setdefault(int(r[1] + i - r[0]), []).append((int(r[2]), w))
    for held in bins.values():
        at = 0
        for offset, w in sorted(held):
            assert offset == at
            at += w
        assert at <= capacity
    return len(bins)


def fewest(items, capacity):
    """The least number of bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1:]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plans_are_packings():
    rnd = random.Random(5)
    for _ in range(150):
        capacity = rnd.choice([7, 20, 64, 1024])
        counts = Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(1, 120)))
        n = placed(counts, capacity)
        assert n >= -(-sum(w * k for w, k in counts.items()) // capacity)


def test_reduction_keeps_the_optimum():
    rnd = random.Random(6)
    fixed_some = 0
    for _ in range(150):
        capacity = rnd.choice([10, 17, 30])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        fixed, left = packing.reduce_by_dominance(Counter(items), capacity)
        fixed_some += bool(fixed)
        assert sum(t for _, t in fixed) + fewest(list(Counter(left).elements()), capacity) == fewest(items, capacity)
    assert fixed_some > 50


def check_packing(docs):
    from tokenizers import Tokenizer
    import public_tokenizers
    import zlib
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs).collect()
    want = Counter()
    for d, text in pairs(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in held.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in out)
    return len(held), -(-total // 1024)


def test_packing_round_trip(spark, sf):
    used, least = check_packing(spark.read.parquet(f"{sf}/documents.parquet"))
    assert used <= 1.02 * least + 1
    check_packing(edge_docs(spark))
    assert packing.pack_documents(no_docs(spark)).count() == 0


# --- search ---

def brute_search(ids, x, asked, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = u @ u[q]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def test_search_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = brute_search(ids, x, np.flatnonzero(ids % 50 == 0))
    got = {}
    for r in multi_index.op3_multi_index(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hits = [len({v for _, v in got[q]} & set(w)) / 5 for q, w in want.items()]
    assert np.mean(hits) >= 0.9


def test_search_on_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "VECTORS", 16)
    monkeypatch.setattr(multi_index, "QUERIES", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8)], "x") for i in range(120)]
    rows += [(200 + i, [1.0] * 8, None) for i in range(60)]  # one common vector
    rows += [(300, None, "x"), (301, [0.0] * 8, "x"), (302, [float("nan")] + [1.0] * 7, "x"), (303, [None] + [1.0] * 7, "x"),
             (304, [float("inf")] + [1.0] * 7, "x"), (305, [1.0] * 3, "x"), (None, [1.0] * 8, "x"), (306, [], "x"), (307, [1e-200] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    good = [r for r in rows if r[0] is not None and (r[0] < 300 or r[0] == 307)]
    ids = np.array([r[0] for r in good])
    x = np.array([r[1] if r[0] != 307 else [1.0] * 8 for r in good])
    want = brute_search(ids, x, np.flatnonzero(ids % 50 == 0))
    got = {}
    for r in multi_index.nearest(df, df.where("vec_id % 50 = 0"), share=1.0, centroids=4).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want
    assert multi_index.nearest(df.limit(0), df.limit(0)).count() == 0
    assert multi_index.nearest(df.where("vec_id = 50"), df.where("vec_id = 50")).count() == 0


@pytest.mark.parametrize("centroids", [1, 3])
def test_search_where_ids_repeat(spark, centroids):
    """Ids with a dozen rows, equal and different ones, near a query: its other neighbours stay."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=6)
    near = lambda d: [float(x) for x in base + rng.normal(size=6) * d]
    rows = [(50, [float(x) for x in base])] + [(1, near(0.01)) for _ in range(12)] + [(2, near(0.001))] * 40
    rows += [(10 + i, near(0.3)) for i in range(7)] + [(60 + i, [2.0 * float(x) for x in base]) for i in range(60)]
    rows = rows if centroids == 1 else rows[:60]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = {}
    for (d, _), s in zip(rows, (x * x[0]).sum(1)):
        if d != 50:
            score[d] = max(s, score.get(d, -2))
    want = [d for d, _ in sorted(score.items(), key=lambda z: (-round(z[1], 12), z[0]))][:5]
    got = multi_index.nearest(df, df.where("vec_id = 50"), share=1.0, centroids=centroids).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == want and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_cells_come_by_distance():
    rng = np.random.default_rng(4)
    a, b, sizes = rng.random(6), rng.random(5), np.ones(30, int)
    cells = multi_index.visit(a, b, sizes, 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)


# --- mixing ---

def test_mix_by_sql_and_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).withColumn("taken", F.col("copies") * F.col("size")).collect()
    rows, columns = by_sql(docs, mixing.SQL)
    assert same_rows(got, rows, columns)
    taken, target, most = Counter(), {}, Counter()
    for r in got:
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert math.isclose(sum(target.values()), 1.5 * sum(r["size"] for r in got), rel_tol=1e-9)
    assert all(abs(taken[s] - t) <= most[s] + 1 for s, t in target.items())


def test_mix_on_edge_rows(spark):
    docs = edge_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(edge_rows()) and all(r["copies"] in (0, 1, 2) for r in got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mixed_documents(no_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert [r["target"] for r in mixing.mix(blank).collect()] == [0.0, 0.0]


def test_numbers_of_ranges_change_no_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("source", F.lit(None).cast("string")))
    found, parts = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(repr, mixing.mix(docs.repartition(5)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()


def test_a_source_takes_the_nearest_of_64_offsets(spark):
    sizes = {s: [(i * 37 + len(s or "")) % 90 + (700 if i == 5 else 0) for i in range(n)] for s, n in (("a", 23), ("b", 40), (None, 31))}
    rows = [(i, " ".join(["w"] * z), s) for s, of in sizes.items() for i, z in enumerate(of)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    unit = 1 << mixing.UNIT_BITS
    for s, of in sizes.items():
        mine = [r for r in got if r["source"] == s]
        target, taken = mine[0]["target"], sum(r["copies"] * r["size"] for r in mine)
        step = int(target / mine[0]["source_size"] * unit)
        start = int(hashlib.md5(f"mix:{chr(0) if s is None else s}".encode()).hexdigest()[:5], 16)
        misses = []
        for i in range(64):
            at = (start + i * (unit // 64)) % unit
            misses.append(abs(sum((((n + 1) * step + at >> mixing.UNIT_BITS) - (n * step + at >> mixing.UNIT_BITS)) * z
                                  for n, z in enumerate(sorted(of))) - target))
        assert math.isclose(abs(taken - target), min(misses), abs_tol=1e-6)


def test_hot_source_of_equal_rows_is_parted_and_taken_to_its_target(spark):
    rows = [(None, "a b c", "hot")] * 6000 + [(i, "a b " * (i % 7), "cold") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs)
    assert got.rdd.glom().map(len).max() < 6000
    taken = {r["source"]: (r["taken"], r["target"], r["longest"]) for r in got.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest")).collect()}
    assert all(abs(t - want) <= longest for t, want, longest in taken.values())
    assert mixing.mixed_documents(docs).count() == got.agg(F.sum("copies")).first()[0]


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; line</h1></header><p>One<br>two   <i>three</i>four
<p class="advert">Buy<p>Five</p><!-- <p>no</p> --><script>var t="</p>";</script><aside>Related</aside><ul><li>a<li>b</ul>
<form>Name <input></form><section id="comments"><article class="comment"><p>First!</p></article></section></article></main>
<footer>&copy; x</footer></body></html>"""


def test_article_of_a_page():
    assert pages.candidates(PAGE) == (["Head & line", "One two threefour", "Five", "a", "b"], [True] * 5)
    assert pages.candidates("") == ([], [])
    assert pages.candidates("<p>open <b>never closed") == (["open never closed"], [False])
    assert pages.candidates("<article><div>Share this</div><p>x</p></article>") == (["Share this", "x"], [False, True])
    assert pages.candidates("a &lt; b &#233;&nbsp;c <!-- unclosed")[0] == ["a < b é c"]


def test_longest_common_subsequence():
    rnd = random.Random(7)
    for _ in range(300):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 9))] for _ in range(2))
        got = sorted(pages.common(a, b))
        want = max(n for n in range(len(a) + 1) for x in combinations(a, n) if is_inside(x, b))
        assert len(got) == want and is_inside([a[i] for i in got], b)


def is_inside(x, b):
    it = iter(b)
    return all(v in it for v in x)


def test_neighbours_take_the_template_away(spark):
    shell = "<div>Site name</div><p>{}</p><p>{}</p><div>All rights</div>"
    rows = [(i, f"http://h.example/a/{i}", shell.format(f"Story {i} one.", f"Story {i} two.")) for i in range(6)]
    rows += [(10, "http://h.example/b/1", None), (11, "http://h.example/b/2", ""), (12, None, "<p>No url</p>"),
             (13, "http://o.example/x", "<p>Alone here</p>"), (14, "http://c.example/1", shell.format("Same", "copy")),
             (15, "http://c.example/2", shell.format("Same", "copy")), (16, "http://h.example/a/9", PAGE), (None, "http://h.example/a/77", PAGE)]
    inside = "<article><div>Share this story</div><p>Quoted.</p><p>{}</p></article>"
    rows += [(20 + i, f"http://i.example/n/{i}", inside.format(f"Own {i}.")) for i in range(3)]
    rows += [rows[0]]
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k", F.lit("x")).withColumn("text", F.lit(1)))
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in out.collect())
    article = "Head & line\nOne two threefour\nFive\na\nb"
    want = [(i, f"Story {i} one.\nStory {i} two.") for i in [0, *range(6)]] + [
        (10, ""), (11, ""), (12, "No url"), (13, "Alone here"), (14, "Site name\nSame\ncopy\nAll rights"),
        *[(20 + i, f"Quoted.\nOwn {i}.") for i in range(3)],
        (15, "Site name\nSame\ncopy\nAll rights"), (16, article), (None, article)]
    assert got == Counter((i, t, len(t)) for i, t in want)
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nearest_page_of_a_large_directory(spark):
    # the partner of each page is its nearest; the last three pages are copies between two others
    rows = [(i, f"http://h.example/x/{i // 2:05d}{'ab'[i % 2]}", f"<div>Pair {i // 2}</div><p>Text {i}.</p>") for i in range(5000)]
    rows += [(9000 + i, f"http://c.example/{i}", f"<div>Site</div><p>{'Copy' if 0 < i < 5 else i}</p>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Text {i}." for i in range(5000)}, **{9000 + i: "Copy" if 0 < i < 5 else str(i) for i in range(6)}}


def test_pages_of_one_path_are_parted(spark):
    rows = [(i if i % 3 else None, None, f"<div>Site</div><p>Text {i}.</p>") for i in range(900)]
    rows = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k", F.xxhash64("page_id", "url", "html"))
    lines = materialize(pages.line_hashes(rows), "test-lines")
    sizes = [r["count"] for r in pages.in_ranges(lines).groupBy("part").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 450
    assert [r["shared"] for r in pages.shared_lines(lines).collect()] == [[0]] * 900


def test_neighbours_across_ranges(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(240):
        host, folder = f"h{i // 60}", f"/{rnd.randint(0, 2)}/"
        hashes = [7, 7, 7] if i // 60 == 2 and i % 60 else [rnd.randint(0, 2) for _ in range(rnd.randint(1, 3))]
        rows.append((1000 + i, i, host, f"{folder}{rnd.randint(0, 9)}", hashes, [0] if i % 7 == 0 else []))
    folder_of = lambda x: x[3][:3]
    rows.sort(key=lambda x: (x[2], folder_of(x), x[3], x[1]))
    want = {}
    for at, x in enumerate(rows):
        near = []
        for others in (rows[:at][::-1], rows[at + 1:]):
            y = next((y for y in others if y[2] == x[2] and y[4] != x[4]), None)
            near.append(y and (folder_of(y), y[3]))
            near.append(y)
        one, other = (near[1], near[3]) if pages.nearer((folder_of(x), x[3]), near[0], near[2]) else (near[3], near[1])
        if y := one or other:
            places = pages.common(x[4], y[4])
            if len(places) < len(x[4]) and (places := sorted(places.difference(x[5]))):
                want[x[0]] = places
    lines = spark.createDataFrame(rows, "k long, page_id long, host string, path string, hashes array<long>, sure array<int>").repartition(3)
    got = pages.shared_lines(materialize(lines.unionByName(lines.limit(9)), "test-lines")).collect()
    assert len(got) == len(want) and {r["k"]: r["shared"] for r in got} == want


# --- quality ---

def test_quality_by_sql_on_edge_rows(spark, tmp_path):
    docs = edge_docs(spark)
    docs.drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op9_quality_cascade(spark, str(tmp_path)).collect()
    rows, columns = by_sql(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).dropDuplicates(["doc_id"]), quality.SQL)
    ours = {repr(tuple(r[c] for c in columns[1:])) for r in got}
    assert {repr(tuple(r[1:])) for r in rows} <= ours and len(got) == len(edge_rows())


def test_order_changes_no_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = quality.estimate(docs.select("text"), quality.rules())
    assert {x[0] for x in found} == {r.name for r in quality.rules()} and all(0 <= x[2] <= 1 and x[1] > 0 for x in found)
    ordered = quality.in_order(quality.rules(), found)
    made = docs.withColumns(quality.features())
    ids = lambda rules: {r[0] for r in made.where(quality.cascade(rules).isNull()).select("doc_id").collect()}
    assert ids(ordered) == ids(ordered[::-1]) == {r[0] for r in quality.passing(docs).select("doc_id").collect()}
    assert quality.passing(no_docs(spark)).count() == 0


def test_each_quality_rule_rejects_its_kind(spark, tmp_path):
    clean = [" ".join(f"word{chr(97 + (i * j) % 26)}{chr(97 + (i + j) % 26)}" for j in range(8)) for i in range(12)]
    texts = {
        "clean": clean, "few_words": ["a few words"], "repeated_words": ["the same three words again"] * 20,
        "symbols": [x.replace(" ", " #*$ ") for x in clean], "word_length": [" ".join("abcdefgh"[i % 8] + "xyz"[i % 3: i % 3 + i % 2] for i in range(j, j + 20)) for j in range(0, 400, 20)],
        "bullets": ["\u2022 " + x for x in clean], "ellipses": [x + " \u2026" if i % 2 else x + "..." for i, x in enumerate(clean)],
        "letters": [" ".join(f"{i * 8 + j}.5" for j in range(8)) for i in range(12)],
        "one_word": [" ".join("so" if j % 4 else f"then{i}{j}" for j in range(8)) for i in range(12)],
        "few bullets": ["- " + x if i % 2 else x for i, x in enumerate(clean)], "other letters": [x.replace("word", "слово") for x in clean],
    }
    rows = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts.values())], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    which = {r.name: r for r in quality.rules()}
    made = rows.withColumns(quality.features())
    for i, name in enumerate(texts):
        hit = [n for n, r in which.items() if made.where(f"doc_id = {i}").where(r.rejects).count()]
        assert (name in hit) if name in which else not hit, (name, hit)
    got = quality.op9_quality_cascade(spark, str(tmp_path)).collect()
    want, columns = by_sql(rows.withColumns({"lang": F.lit("en"), "source": F.lit("s")}), quality.SQL)
    assert same_rows(got, want, columns)
    assert {list(texts)[r["doc_id"]] for r in got if r["kept"]} == {"clean", "few bullets", "other letters"}


# --- pipeline ---

def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "mix", "pack"]
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test-stage")
        outs.append(docs)
    first = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(o.columns == first.columns for o in outs[:-1])
    a = {r["doc_id"]: r["text"] for r in outs[0].collect()}
    assert {d for d, t in pairs(first) if any(c.isalpha() for c in t or "")} == set(a)
    b = dict(pairs(outs[1]))
    rows = list(a.items())
    assert b == {d: x[0] for (d, _), x in zip(rows, dedup_lines(rows))}
    comp = components({d: shingles(t, 5) for d, t in b.items()}, 80)
    assert set(dict(pairs(outs[2]))) == {d for d, c in comp.items() if c == d}
    taken = Counter(r["doc_id"] for r in outs[3].select("doc_id").collect())
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(outs[2]).collect() if r["copies"]}
    assert taken == Counter(want)
    assert Counter(r["doc_id"] for r in outs[4].where("piece = 0").collect()) == taken


def test_near_duplicate_stage_takes_five_words_and_80_percent(spark, sf):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    rows = []
    for i in range(60):
        base = [word() for _ in range(200)]
        added = base + [word() for _ in range(rnd.randint(30, 60))]  # 0.77 to 0.87 by either width
        edits = list(base)
        for at in rnd.sample(range(200), rnd.randint(2, 6)):  # below 0.8 by five words, above 0.85 by three in part
            edits[at] = word()
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(added)), (3 * i + 2, " ".join(edits))]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    for docs in (made, spark.read.parquet(f"{sf}/documents.parquet")):
        comp = components({d: shingles(t, 5) for d, t in pairs(docs)}, 80)
        assert Counter(d for d, _ in pairs(stage(spark, docs, sf))) == Counter(d for d, c in comp.items() if c == d)


def test_sketches_follow_the_similarity():
    a, b = minhash.Plan(85), minhash.Plan(80)
    assert (a.collections, a.hashes, len(a.tables), a.least_equal, a.most_differ) == (12, 24, 66, 11, 309)
    assert (b.collections, b.hashes, len(b.tables)) == (15, 30, 105) and b.least_equal / 30 < 0.8 and 307 < b.most_differ < 400


def test_pipeline_on_edge_rows(spark, tmp_path):
    edge_docs(spark).drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    no_docs(spark).drop("a.b").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
