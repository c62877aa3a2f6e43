"""Merkle manifest, embedding links and source divergence against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import LOWER, edge_docs, edge_rows, no_docs
from imgtrace.llm import divergence, merkle, pca_tiles

# --- Merkle manifest ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*map(one, (doc_id, source, lang, n_chars, text)))


def proofs(leaves):
    """(top, for each leaf the siblings before and after on its way up)."""
    ways = [[] for _ in leaves]
    level = [(x, [i]) for i, x in enumerate(leaves)]
    while len(level) > 1:
        up = []
        for lo in range(0, len(level), 8):
            run = level[lo:lo + 8]
            for s, (_, below) in enumerate(run):
                for i in below:
                    ways[i].append(("".join(d for d, _ in run[:s]), "".join(d for d, _ in run[s + 1:])))
            up.append((digest(*(d for d, _ in run)), [i for _, b in run for i in b]))
        level = up
    return level[0][0], ways


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops, ways, kept = [], {}, {}
    for lang in names:
        kept[lang] = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        top, ways[lang] = proofs([leaf_of(*r) for r in kept[lang]])
        tops.append(top)
    root, over = proofs(tops)
    out = []
    for k, lang in enumerate(names):
        for r, way in zip(kept[lang], ways[lang]):
            steps = way + over[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            seen = leaf_of(*r[:4], r[4].translate(LOWER) if hit and r[4] is not None else r[4])
            for before, after in steps:
                seen = digest(before, seen, after)
            out.append((r[0], leaf_of(*r), tops[k], root, digest(*(a + b for a, b in steps)), seen, seen == root))
    return sorted(map(repr, out))


def tampered():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0


def check_manifest(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.manifest(docs, tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_manifest(rows)


def test_manifest_on_edge_rows(spark):
    check_manifest(edge_docs(spark))
    assert merkle.manifest(no_docs(spark)).count() == 0


@pytest.mark.parametrize("rows, langs", [(1, 1), (8, 1), (9, 1), (600, 1), (300, 75)])
def test_manifest_of_trees(spark, rows, langs):
    made = [(i * 7 % rows - 3, f"s{i % 3}", f"l{i % langs}" if i % langs else None, None if i % 4 else i, f"Text {i}" * (i % 5)) for i in range(rows)]
    check_manifest(spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string").repartition(5))


def test_untouched_rows_verify_and_touched_ones_do_not(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = merkle.manifest(docs, F.col("doc_id") == 5).collect()
    assert [r["doc_id"] for r in out if not r["verified"]] == [5] and len(out) == docs.count()
    assert all(r["verified"] for r in merkle.manifest(docs).collect())


def test_manifest_of_repeated_rows_and_ids(spark):
    made = [(1, "s", "en", 1, "Same")] * 30 + [(1, "s", "en", 1, "Other"), (None, None, None, None, None), (None, "s", "en", 2, "Null id")] * 3
    check_manifest(spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string").repartition(4))


# --- embedding links ---

def plain_links(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector)."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], float) for k in (i, j))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(repr((d, n, least.get(find(i)), least.get(find(i)) == d)) for i, ((d, _), n) in enumerate(zip(rows, links)))


def check_links(spark, rows, tile=pca_tiles.TILE, kind="float"):
    t = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, node int, v string, links long, rep int").repartition(3)
    back = [(r[0], r[1]) for r in t.collect()]
    out = pca_tiles.near_duplicates(t, tile=tile)
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain_links(back)


def vectors(n, width, seed, flat=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * (1 if flat else np.linspace(3, 0.2, width))
    for i in range(n // 3, 2 * n // 3):  # chains of near copies, some just below the threshold
        x[i] = x[i - 1] + rng.normal(size=width) * np.linalg.norm(x[i - 1]) * rng.uniform(0.2, 0.55) / math.sqrt(width)
    x[2 * n // 3: 5 * n // 6] = x[0] + rng.normal(size=(5 * n // 6 - 2 * n // 3, width)) * 0.05
    return x


@pytest.mark.parametrize("tile, kind, flat", [(1 << 16, "float", False), (40, "double", True), (25, "float", True)])
def test_links_of_near_copies(spark, tile, kind, flat):
    x = vectors(400, 24, tile, flat)
    check_links(spark, [(int(i * 7 % 400), v.tolist(), *[None] * 4) for i, v in enumerate(x)], tile, kind)


def test_links_of_edge_rows(spark):
    v = vectors(60, 5, 1).tolist()
    odd = [None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0], [2.0], [-2.0], [1e-30] * 5, [1e30] * 5, [1.0] * 5, [1.0] * 6]
    made = v + odd + [v[3]] * 9 + [v[4]] * 3
    ids = [*range(len(v) + len(odd)), *([7] * 3), None, *range(-8, 0)]
    check_links(spark, [(d, x, *[None] * 4) for d, x in zip(ids, made, strict=True)])
    check_links(spark, [(None, [1.0, 2.0], *[None] * 4)] * 3 + [(None, None, *[None] * 4)])
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pca_tiles.near_duplicates(none).columns == ["vec_id", "n_links", "component_id", "kept"] and pca_tiles.near_duplicates(none).count() == 0


def test_bound_loses_no_pair_and_forest_joins():
    x = vectors(700, 40, 5)
    stops = [15, 25]
    axes = np.linalg.eigh(pca_tiles.units(x).T @ pca_tiles.units(x))[1][:, ::-1]
    a = pca_tiles.Side(x, axes, stops)
    got = {(i, j) for p, q in pca_tiles.linked_pairs(a, a, True, stops, 0.9) for i, j in zip(p.tolist(), q.tolist())}
    u = pca_tiles.units(x)
    want = np.triu(u @ u.T >= 0.9, 1)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(want)))) and len(got) > 1000
    f = pca_tiles.Forest(10)
    f.join(np.array([9, 3, 8]), np.array([8, 4, 3]))
    assert f.up.tolist() == [0, 1, 2, 3, 3, 5, 6, 7, 3, 3]


# --- source divergence ---

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least=30, listed=50):
    """rows: (lang, source, text)."""
    seen, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        w = TERM.findall((text or "").translate(LOWER))
        seen[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    for lang in seen:
        kept = [t for t, k in seen[lang].items() if k >= least]
        v = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        mine = {s: shares(c) for (x, s), c in n.items() if x == lang}
        whole = shares(sum((c for (x, _), c in n.items() if x == lang), Counter()))
        for s, p in mine.items():
            for part, items in (("pair", {o: sum(abs(p[t] - q[t]) for t in kept) for o, q in mine.items() if o != s}),
                                ("term", {t: p[t] - whole[t] for t in kept if n[lang, s][t] > 0 and p[t] > whole[t]})):
                ranked = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, f, r) for r, (i, f) in enumerate(ranked, 1) if part == "pair" or r <= listed]
    return sorted(map(repr, out))


def check_audit(docs, **more):
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    out = divergence.audit(docs, **{"least_docs" if k == "least" else k: v for k, v in more.items()})
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain_audit(rows, **more)


@pytest.mark.parametrize("sources, cut", [(256, 200_000), (2, 3)])
def test_audit_on_edge_rows_and_documents(spark, sf, sources, cut, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "SLICE", cut)
    docs = edge_docs(spark)
    check_audit(docs, least=1, listed=5)
    check_audit(docs)
    check_audit(spark.read.parquet(f"{sf}/documents.parquet").limit(150), least=10)
    assert divergence.audit(no_docs(spark)).count() == 0


def test_audit_of_short_and_long_terms(spark):
    rng = np.random.default_rng(2)
    letters = list("abAB") + ["é", "漢", "߿", "\U0001f600"]
    rows = []
    for i in range(300):
        terms = ["".join(rng.choice(letters, rng.integers(1, 4) if k % 3 else rng.integers(4, 30))) for k in range(rng.integers(0, 40))]
        terms += [letters[i % 8] * k for k in (7, 8, 9, 16, 17, 33, 70)] * (i % 3)
        rows.append((f"l{i % 2}", f"s{i % 9}", "".join(t + rng.choice([" ", "1", "_", "\n", "\x7f", "\x00"]) for t in terms)))
    rows += [("l0", "s0", "ab" * 100_000), ("l0", "s0", "ab" * 100_000), ("l1", None, "x" + "a b " * 50_000), ("alone", "s1", "word"), ("l1", "sä", None)]
    check_audit(spark.createDataFrame(rows, "lang string, source string, text string").repartition(4), least=2)


def test_runs_and_sums():
    data = np.frombuffer("bb a bb aa bb abcdefghijkl".encode() + bytes(24), np.uint8)
    starts, lengths, text = divergence.find_terms(data[:-24], np.array([0, 5, 5, 26]))
    assert (starts.tolist(), lengths.tolist(), text.tolist()) == ([0, 3, 5, 8, 11, 14], [2, 1, 2, 2, 2, 12], [0, 0, 2, 2, 2, 2])
    words = divergence.packed(data, starts, lengths, 2)
    w1, w2, group, n, docs = divergence.run_counts(words, np.zeros(6, np.uint64), text)
    raw = np.stack((w1, w2), 1).astype(">u8").tobytes()
    assert [raw[16 * i:16 * i + 16].strip(b"\0") for i in range(4)] == [b"a", b"aa", b"abcdefghijkl", b"bb"]
    assert (n.tolist(), docs.tolist()) == ([1, 1, 1, 3], [1, 1, 1, 2])
    held = divergence.Counts(2)
    assert not list(held.add([w1, w2, group, n, docs])) and not list(held.add([w1, w2, group, n, docs]))
    (whole,) = held.rest()
    assert whole[-2].tolist() == [2, 2, 2, 6] and whole[-1].tolist() == [2, 2, 2, 4]
    split = divergence.find_terms(np.frombuffer(b"abcd", np.uint8), np.array([0, 2, 2, 4]))
    assert [x.tolist() for x in split] == [[0, 2], [2, 2], [0, 2]]


def test_shares_are_exact_beyond_64_bits(spark):
    big = 7_000_000_000_000_000
    got = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big + 1), F.lit(10**9)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (big + 5) // (3 * big + 1 + 5 * 10**9)


def test_all_rows_of_the_edge_table_are_there(spark):
    assert merkle.manifest(edge_docs(spark)).count() == len(edge_rows())
