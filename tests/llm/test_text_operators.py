"""Line dedup, near-duplicates, string removal and language against plain versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import cut_repeats, components, dedup_lines, edge_docs, edge_rows, held_out, no_docs, shingles, words
from imgtrace.llm import language, line_dedup, minhash, suffix_dedup
from imgtrace.llm.words import find_words, hash_words


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def sample(spark, sf, n=160):
    return spark.read.parquet(f"{sf}/documents.parquet").limit(n)


def test_words_and_hashes():
    texts = ["", "a", " A  b\t", "Ça va\x0bÉté", "x" * 300]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    starts, lengths, per = find_words(data, offsets)
    found = [bytes(data[s:s + n]).decode() for s, n in zip(starts, lengths)]
    assert found == ["a", "A", "b", "Ça", "va", "Été", "x" * 300]
    assert per.tolist() == [0, 1, 2, 3, 1]
    h = hash_words(data, starts, lengths)
    assert h[0] == h[1] and len(set(h.tolist())) == 6


# --- line dedup ---

def test_lines_on_edge_rows(spark):
    docs = edge_docs(spark)
    out = line_dedup.drop_lines(docs)
    assert set(out.columns) == set(docs.columns)
    rows = pairs(docs)
    want = sorted(repr((d, *x)) for (d, _), x in zip(rows, dedup_lines(rows)))
    got = sorted(repr((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"])) for r in out.collect())
    assert got == want
    assert line_dedup.drop_lines(no_docs(spark)).count() == 0


def test_line_index_is_reversible(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    old, new = docs.where("doc_id % 3 != 0"), docs.where("doc_id % 3 = 0")
    counts = lambda index: sorted(map(tuple, index.counts.collect()))
    texts = lambda index: {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(old, index).collect()}
    first = line_dedup.build(old)
    both = line_dedup.insert(first, new)
    assert counts(both) == counts(line_dedup.build(docs))
    back = line_dedup.delete(both, new.select("doc_id"))
    assert counts(back) == counts(first) and texts(back) == texts(first)
    for index in (both, back):
        raw = {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()}
        hot = index.hot.collect()
        if hot:
            k1, k2 = (np.array([r[c] for r in hot]) for c in ("k1", "k2"))
            assert all(line_dedup.Cuckoo.load(raw[0]).has(k1, k2))


def test_large_filters_are_not_sent(spark, sf, monkeypatch):
    docs = sample(spark, sf)
    want = sorted(map(tuple, line_dedup.drop_lines(docs).select("doc_id", "text", "n_dropped").collect()))
    monkeypatch.setattr(line_dedup, "SENT_BYTES", -1)
    assert sorted(map(tuple, line_dedup.drop_lines(docs).select("doc_id", "text", "n_dropped").collect())) == want


def test_cuckoo_adds_and_removes():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    f = line_dedup.cuckoo_of(k1, k2)
    assert f.has(k1, k2).all()
    o1, o2 = rng.integers(-(1 << 62), 1 << 62, (2, 20000))
    assert f.has(o1, o2).mean() < 0.002
    f.remove(k1[:2500], k2[:2500])
    assert f.has(k1[2500:], k2[2500:]).all() and f.has(k1[:2500], k2[:2500]).mean() < 0.002


# --- near-duplicates ---

def rows_linked(rows, width=3, percent=85):
    """(doc_id, set size, component_id, kept or None where any one of the rows may be kept) of rows (doc_id, text)."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    full = [i for i, s in enumerate(sets) if s]
    for k, i in enumerate(full):
        for j in full[:k]:
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[i][0] == rows[j][0] or 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    members = {}
    for i in full:
        members.setdefault(find(i), []).append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        own = members[find(i)] if sets[i] else [i]
        c = min((rows[j][0] for j in own if rows[j][0] is not None), default=None)
        out.append((d, len(sets[i]), c, c == d if c is not None else (True if len(own) == 1 else None)))
    return out


def check_components(docs, **how):
    out = (minhash.near_duplicates(docs, **how) if how else minhash.near_duplicates(docs)).collect()
    want = rows_linked(pairs(docs), **how)
    assert sorted(repr(tuple(r)[:3]) for r in out) == sorted(repr(r[:3]) for r in want)
    sure = [r for r in want if r[3] is not None]
    assert Counter(r["doc_id"] for r in out if r["kept"] and r["component_id"] is not None) == Counter(r[0] for r in sure if r[3] and r[2] is not None)
    return out


def two_texts_under_one_id():
    """(doc_id, text) with ids and nulls that hold several texts, each with a near copy elsewhere."""
    text = lambda i, last: " ".join(f"w{i}x{k}" for k in range(60)) + last
    rows = []
    for i in range(10):
        rows += [(i, text(2 * i, "")), (i, text(2 * i + 1, "")), (100 + i, text(2 * i, " end")), (200 + i, text(2 * i + 1, " end"))]
    for i in range(20, 30):
        rows += [(None, text(i, "")), (None, text(i, " end"))]
    return rows + [(None, text(30, "")), (300, text(30, " end")), (None, text(31, "")), (None, ""), (5, "")]


@pytest.mark.parametrize("parts", [1, 4])
def test_components_of_ids_and_nulls_with_several_texts(spark, parts):
    docs = spark.createDataFrame(two_texts_under_one_id(), "doc_id long, text string").repartition(parts)
    out = check_components(docs)
    assert {r["component_id"] for r in out if r["doc_id"] in range(100, 210)} == set(range(10))
    pairs_without_id = [r for r in out if r["component_id"] is None]
    assert len(pairs_without_id) == 22 and sum(r["kept"] for r in pairs_without_id) == 12
    again = minhash.near_duplicates(docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert len(minhash.one_of_each(docs).collect()) == sum(r["kept"] for r in out)


def test_components_on_edge_rows(spark):
    docs = edge_docs(spark)
    out = check_components(docs)
    assert len(out) == len(edge_rows())
    assert minhash.near_duplicates(no_docs(spark)).count() == 0
    assert minhash.one_of_each(docs).columns == docs.columns


def test_components_on_documents(spark, sf):
    check_components(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.mark.parametrize("block", [1024, 8])
def test_components_of_a_group_of_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 14)):
            w[at] = f"new{rng.integers(1000)}"
        rows.append((int(i * 7 % 120), " ".join(w)))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (205, 203), (203, 204)]
    got = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 203: 203, 204: 203, 205: 203}


# --- repeated strings ---

def check_cut(docs):
    rows = pairs(docs)
    got = sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in suffix_dedup.cut(docs).collect())
    assert got == sorted(repr((d, *x)) for (d, _), x in zip(rows, cut_repeats(rows)))


@pytest.mark.parametrize("frequent, block, sent", [(2048, 1 << 20, 1 << 20), (3, 2000, 1 << 20), (3, 2000, -1)])
def test_cut_on_edge_rows_and_documents(spark, sf, frequent, block, sent, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "SENT", sent)
    check_cut(edge_docs(spark))
    check_cut(sample(spark, sf, 100))


@pytest.mark.parametrize("frequent, sent", [(2048, 1 << 20), (8, 1 << 20), (8, -1)])
def test_cut_of_one_passage_in_half_of_all_documents(spark, frequent, sent, monkeypatch):
    """Whole copies of the passage, copies with one letter changed, and two of them in one document."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "SENT", sent)
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))
    passage, rows = prose(90), []
    for i in range(80):
        middle = passage
        if i % 8 == 3:
            at = int(rng.integers(len(passage)))
            middle = passage[:at] + "X" + passage[at + 1:]
        rows.append((i * 37 % 80, prose(25) + " " + (middle if i % 2 else prose(10)) + prose(3) + (passage if i % 20 == 5 else "")))
    docs = spark.createDataFrame(rows + [(None, passage), (3, "short")], "doc_id long, text string")
    check_cut(docs.where("doc_id <> 3 or length(text) > 5").repartition(3))


def test_near_copies_of_a_passage_travel_in_pieces(spark, monkeypatch):
    """One letter of each copy is changed: hundreds of different stretches around frequent anchors, none of them suffix by suffix."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 64)
    one_by_one, whole = [], suffix_dedup.sorted_suffixes

    def counted(rows):
        one_by_one.append(rows.count())
        return whole(rows)

    monkeypatch.setattr(suffix_dedup, "sorted_suffixes", counted)
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefghij "), 700))
    rows = []
    for i in range(100):
        at = int(rng.integers(len(passage)))
        rows.append((i * 37 % 100, passage[:at] + "X" + passage[at + 1:]))
    check_cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert one_by_one == [0]


def test_pieces_of_a_stretch():
    """Every suffix is in one piece, and equal ones at the same place before the anchor are in one bucket, whatever their stretch."""
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, 160, np.uint8).tobytes()
    buckets: dict[tuple, set] = {}
    for first, past, place in ((0, 61, 60), (0, 1, 60), (7, 40, 60), (44, 46, 60), (60, 61, 60), (13, 31, 30)):
        pieces = suffix_dedup.cut_stretch(text[first:past + 99], past - first, place - first)
        assert [first + s for lo, hi, _ in sorted(pieces) for s in range(lo, hi)] == list(range(first, past))
        assert all(0 < hi - lo <= suffix_dedup.PIECE for lo, hi, _ in pieces)
        for lo, hi, k in pieces:
            for s in range(lo, hi):
                buckets.setdefault((place, first + s), set()).add(k)
    assert all(len(b) == 1 for b in buckets.values())


def test_cut_of_all_given_documents(spark, sf):
    check_cut(spark.read.parquet(f"{sf}/documents.parquet"))


def test_cut_of_nothing(spark):
    assert suffix_dedup.cut(no_docs(spark)).count() == 0


def test_difference_cover():
    assert (suffix_dedup.SHIFTS >= 0).all()
    text = np.frombuffer((b"abcde" * 90 + bytes(range(200)) * 2 + b"abcde" * 60), np.uint8)
    starts = np.arange(len(text) - 99)
    bucket = starts % 2
    order = np.lexsort((starts, bucket))
    got = suffix_dedup.repeats(text, starts[order], bucket[order])
    seen, want = set(), []
    for s, b in zip(starts[order], bucket[order]):
        w = (b, text[s:s + 100].tobytes())
        want.append(w in seen)
        seen.add(w)
    assert got.tolist() == want


# --- language ---

def plain_cells(text):
    """The numbered n-grams that a text contains, one by one."""
    def symbol(c):
        if ord(c) > 0xFFFF:
            return 2 + ord(c) % 254 if c.isalpha() else 0
        low = ord(c.lower()[0])
        return 2 + (low if low < 128 else low * 40503 >> 4) % 254 if c.isalpha() else int(c.isdigit())

    s = [symbol(c) for c in text]
    out = set()
    for k in (1, 2, 3):
        for i in range(len(s) - k + 1):
            code = 0
            for x in s[i:i + k]:
                code = code << 8 | x
            out.add((code + (k << 26)) * 2654435761 % 2**32 >> 18)
    return out


def test_language_equals_a_plain_kernel_ridge(spark, sf):
    """Kernels as set intersections, landmarks' span by an eigenbasis, each regression by least squares of its own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    sets = {r["doc_id"]: plain_cells(r["text"] or "") for r in rows}
    letters = {r["doc_id"]: any(c.isalpha() for c in r["text"] or "") for r in rows}
    learn = [r for r in rows if r["lang"] is not None and letters[r["doc_id"]] and not held_out(r["doc_id"], 3, 1)]
    bits = lambda d: np.packbits(np.isin(np.arange(language.CELLS), list(sets[d]))).tobytes()
    learn.sort(key=lambda r: (r["lang"], bits(r["doc_id"])))
    langs = sorted({r["lang"] for r in learn})
    assert max(Counter(r["lang"] for r in learn).values()) <= language.FIT_ROWS
    each, marks = min(language.LANDMARKS, language.MAX_LANDMARKS // len(langs)), []
    for x in langs:
        own = [r["doc_id"] for r in learn if r["lang"] == x]
        marks += own[::max(1, len(own) // each)][:each]
    kernel = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    basis = vector[:, value > 1e-6 * value[-1]] / np.sqrt(value[value > 1e-6 * value[-1]])
    span = lambda d: np.append(np.array([kernel(d, m) for m in marks]) @ basis, 1.0)
    z = np.array([span(r["doc_id"]) for r in learn])
    count = Counter(r["lang"] for r in learn)
    weight = np.array([(len(learn) / (len(langs) * count[r["lang"]])) ** 0.5 for r in learn])
    calm = np.sqrt(language.RIDGE * len(learn)) * np.eye(z.shape[1])
    models = [np.linalg.lstsq(np.vstack((z * weight[:, None], calm)), np.concatenate((
        np.array([1.0 if r["lang"] == x else -1.0 for r in learn]) * weight, np.zeros(len(calm)))), rcond=None)[0] for x in langs]
    for r in language.op7_language_id(spark, sf).collect():
        d = r["doc_id"]
        if not letters[d]:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        f = [span(d) @ m for m in models]
        assert abs(r["score"] - min(1, max(0, (max(f) + 1) / 2))) < 2e-3
        assert r["lang_pred"] == langs[int(np.argmax(f))] or sorted(f)[-1] - sorted(f)[-2] < 1e-2


def test_language_held_out(spark, sf):
    out = language.op7_language_id(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in out)
    apart = [r for r in out if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in apart) >= 0.98 * len(apart)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_on_edge_rows(spark, sf):
    docs = edge_docs(spark)
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    out = language.predict(docs, model)
    assert set(out.columns) == set(docs.columns)
    for r in out.collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert r["lang_pred"] in model[0]
    assert language.predict(docs, language.fit(no_docs(spark))).where("lang_pred != 'und'").count() == 0
    kept = language.recognised(docs)
    assert kept.columns == docs.columns
    assert language.recognised(no_docs(spark)).count() == 0
    assert language.predict(docs.withColumn("lang", F.lit(None).cast("string")), language.train(docs)).count() == len(edge_rows())
