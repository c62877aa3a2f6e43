"""Documents with every awkward case, and plain versions of what the operators compute."""

import hashlib
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns whose names operators might use for themselves.
CLASHING = ("size bigint, copies int, id string, key string, h double, n int, score string, target string, kept string, "
            "component_id string, n_lines string, n_dropped int, length int, piece int, k int, d int, sha int, lang_pred int, "
            "held_out string, spans int, hub int, n_tokens string, `a.b` int")
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
EXTRA = tuple([None] * len(CLASHING.split(",")))

LINE = "This is a long line that many of the documents share, 1234567890."
BODY = " ".join(f"word{i % 37} other{i % 11}" for i in range(120))


def edge_rows():
    texts = [
        (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "Two words"), (6, "ÀÉ ß 漢字 \U0001f600 émile naïve"),
        (7, BODY), (7, BODY), (8, BODY + " end"), (9, BODY.upper()), (None, BODY), (None, None), (10, "\n\n" + LINE + "\n"),
        (11, LINE + "\nx"), (12, LINE.upper() + "  \ny\r"), (13, "\t" + LINE), (14, LINE + "\n" + LINE), (15, LINE),
        (16, "<|endoftext|> special     text"), (17, "1234 5678 ### ***"), (18, "a" * 5000), (19, "tick " * 3000),
        (20, " ".join(f"w{i}" for i in range(30_000))), (21, BODY), (22, "\n".join([BODY, LINE, BODY])), (-5, "Negative id " + BODY),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        lang = None if i % 5 == 0 else ("en", "de")[i % 2]
        source = None if i % 4 == 0 else f"s{i % 3}"
        out.append((doc, text, lang, source, None, *EXTRA))
    return out


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def held_out(doc, parts, which):
    return doc is not None and zlib.crc32(str(doc).encode()) % parts == which


def shingles(text, width=3):
    w = words(text)
    if len(w) >= width:
        return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)] if w else [])


def components(sets, percent=85):
    """Smallest id reachable, by comparing every pair; sets: id -> shingles."""
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def dedup_lines(rows, min_docs=5, chars=40):
    """(text, lines, dropped) per row of (doc_id, text)."""
    low = -(1 << 63)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    n, last = {}, {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= chars:
                n[k] = n.get(k, 0) + 1
                last[k] = max(last.get(k, low), low if doc is None else doc)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if n.get(key(x), 0) < min_docs or last[key(x)] == (low if doc is None else doc)]
        out.append(("\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def cut_repeats(rows, length=100):
    """(bytes, removed, runs, sha256) per row of (doc_id, text), in any order."""
    places = {}
    data = [((-(1 << 63) if d is None else d), (t or "").encode()) for d, t in rows]
    for doc, b in data:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            places[w] = min(places.get(w, (doc, i)), (doc, i))
    out = []
    for doc, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if places[b[i:i + length]] < (doc, i):
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
