"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in order of their URL paths; a page and its nearest neighbour are
two fillings of one template. Their text lines are aligned by a longest common subsequence
of line hashes, and the lines both have are the template's: they go. Markup is heard too: what an
element or its class names as menu, footer, advert, form and so on goes, whether shared or not,
and paragraphs, headings, list items and the like inside an `article` (or `main`) element stay
even where a neighbour repeats them, since pages that quote or copy each other would otherwise
lose their text. The alignment decides what is left: lines of an article outside such blocks, and all
unmarked lines of pages without one. The given pages have no such lines (see README), so there markup alone decides.

Only line hashes travel: html is read twice and shuffled only for pages whose result depends on a
neighbour. All pages are put in order in ranges of about equal size, however large a host or a directory is,
and the last different page before a range and the first one after it are handed to it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace.session import shuffle_partitions

from .queries import query
from .tables import checked_broadcast, materialize, table, take_columns

# Element names of HTML and words of class names for parts that aren't the article.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math noframes object xmp".split())
APART = frozenset("nav footer aside form dialog menu search select button head header fieldset datalist audio video canvas".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies
disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo
promotion recommended related reply replies search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar
widget""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[a-z]+")


def names_apart(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in ROLES:
                return True
        elif NAMES.intersection(LETTERS.findall(CAMEL.sub(" ", value).lower())):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool, bool, bool]]:
    """(line, stands apart by its markup, is inside an article, inside main, in a block of prose) per block with text."""
    out: list[tuple[str, bool, bool, bool, bool]] = []
    open_: list[tuple[str, bool, str]] = []  # element, apart, "article", "main" or ""
    seen = False
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                apart = any(x[1] for x in open_)
                block = next((x[0] for x in reversed(open_) if x[0] in BLOCKS), "")
                out.append((line, apart, any(x[2] == "article" for x in open_), any(x[2] == "main" for x in open_), block in PROSE))

    while True:
        m = TAG.search(page, at)
        piece = page[at:m.start() if m else len(page)]
        if piece:
            text.append(entities.unescape(piece))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            text.append(" ")
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    flush() if any(x[1] or x[2] for x in open_[i:]) else None
                    del open_[i:]
                    break
                if open_[i][2] and name not in ("body", "html"):
                    break  # a stray end tag closes nothing around an article
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if block and open_ and open_[-1][0] == "p" or open_ and name in ("li", "dt", "dd", "td", "th", "tr", "option") and open_[-1][0] == name:
            open_.pop()
        elif block:  # a paragraph ends at the next block, whatever inline elements were left open in it
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == "p":
                    del open_[i:]
                    break
                if open_[i][0] in BLOCKS:
                    break
        inside = any(x[2] for x in open_)
        holder = name in ("article", "main")
        apart = name in APART and not (name == "header" and inside)
        if attributes and name not in ("html", "body") and (not holder or "comment" in attributes.lower()):
            apart |= names_apart(attributes)
        if holder and not apart and not seen:  # what holds the first article isn't apart, whatever its class says
            open_ = [(e, e in APART and e != "header", place) for e, _, place in open_]
            seen = True
        if apart and not block:
            flush()
        role = "main" if re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I) else ""
        open_.append((name, apart, name if name in ("article", "main") else role))
    flush()
    return out


def candidates(page: str) -> tuple[list[str], list[bool]]:
    """(lines that may be the article, which of them surely are)."""
    lines = [x for x in lines_of(page) if not x[1]]
    for place in (2, 3):
        inside = [x for x in lines if x[place]]
        if inside:
            return [x[0] for x in inside], [x[4] for x in inside]
    return [x[0] for x in lines], [False] * len(lines)


# --- differencing ----------------------------------------------------------------------------

def common(a: list[int], b: list[int]) -> set[int]:
    """Places in `a` of a longest common subsequence with `b`.

    Equal ends are cut off first; in between, the longest increasing run of matching places
    is kept (each place of `a` offers its places in `b` from the last to the first).
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            at = bisect_left(ends, j)
            link = (i, last[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[at], last[at] = j, link
    link = last[-1] if last else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def nearer(place: tuple[str, str], one: tuple[str, str] | None, other: tuple[str, str] | None) -> bool:
    """Whether `one` is at least as near to (folder, path) `place` as `other`: in its folder, then by the length of the common start."""
    def same(x):
        if x is None:
            return (False, -1)
        n = 0
        for p, q in zip(place[1], x[1], strict=False):
            if p != q:
                break
            n += 1
        return (x[0] == place[0], n)
    return same(one) >= same(other)


def line_hashes(pages: DataFrame) -> DataFrame:
    """(k, page_id, host, path, hashes, sure: places of lines that stay whether shared or not) of the pages with lines."""

    def run(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for k, page, url, doc in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                lines, sure = candidates(doc.as_py() or "")
                if lines:
                    host, path = split_url(url or "")
                    kept = [i for i, s in enumerate(sure) if s]
                    for c, v in zip(cols, (k, page, host, path, [line_hash(x) for x in lines], kept), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["k", "page_id", "host", "path", "hashes", "sure"])

    return pages.select("k", "page_id", "url", "html").mapInArrow(
        run, "k long, page_id long, host string, path string, hashes array<long>, sure array<int>")


def split_url(url: str) -> tuple[str, str]:
    """(host in small letters, path with query, without fragment)."""
    rest = url.split("#", 1)[0].partition("://")[2] or url
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


ORDER = ["host", "folder", "path", "page_id", "k"]


def in_ranges(lines: DataFrame) -> DataFrame:
    """`lines`, each once, with folder, `same` (digest of host and lines) and `part`, the range of the order by ORDER they are in.

    Ranges are of about equal size: page ids part pages of one path.
    """
    folder = F.regexp_replace(F.regexp_replace("path", r"\?.*$", ""), r"[^/]*/?$", "")
    lines = lines.dropDuplicates(["k"]).withColumns({"folder": folder, "same": F.xxhash64("host", "hashes")})
    cut = lines.repartitionByRange(shuffle_partitions(lines.sparkSession), *ORDER)
    return materialize(cut.withColumn("part", F.spark_partition_id()), "page-order")


def edges(cut: DataFrame) -> list[tuple[int, int]]:
    """(part, k): the last page before each range that differs from its first page, and the first after it that differs from its last."""
    row = F.struct(*ORDER, "same")
    ends = materialize(cut.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last")), "page-ends")
    inner = cut.join(F.broadcast(ends), "part").groupBy("part").agg(
        F.min(F.when(F.col("same") != F.col("first.same"), row)).alias("second"),
        F.max(F.when(F.col("same") != F.col("last.same"), row)).alias("other"))
    ranges = ends.join(inner, "part").orderBy("part").collect()
    out = []
    for i, r in enumerate(ranges):
        back = (x for e in reversed(ranges[:i]) for x in (e["last"], e["other"]))
        ahead = (x for e in ranges[i + 1:] for x in (e["first"], e["second"]))
        for end, found in ((r["first"], back), (r["last"], ahead)):
            x = next((x for x in found if x is not None and (x["host"] != end["host"] or x["same"] != end["same"])), None)
            if x is not None and x["host"] == end["host"]:
                out.append((r["part"], x["k"]))
    return out


def differences(rows):
    """(k, page_id, places) from rows (part, edge, k, page_id, host, folder, path, hashes, sure) in order, lists of hashes compared."""
    before, run, known = None, [], None

    def settle(after):
        found: dict[int, set[int]] = {}
        for _, edge, k, page, _, folder, path, own, sure in run:
            if edge:
                continue
            sides = [before, after]
            if not nearer((folder, path), *[x and (x[5], x[6]) for x in sides]):
                sides.reverse()
            other = sides[0] or sides[1]
            if other is None:
                continue
            if id(other) not in found:  # copies have the same neighbours
                found[id(other)] = common(own, other[7])
            places = found[id(other)]
            if len(places) < len(own):  # else the page is a part of the other: nothing of its own would be left
                if places := sorted(places.difference(sure)):
                    yield k, page, places

    for r in rows:
        place = (r[0], r[4])
        if run and (place != known or r[7] != run[0][7]):
            yield from settle(r if place == known else None)
            before = run[-1] if place == known else None
            run = []
        known = place
        run.append(r)
    if run:
        yield from settle(None)


def shared_lines(lines: DataFrame) -> DataFrame:
    """(k, page_id, shared: places of the unsure lines that the nearest page has too) where there are some.

    Neighbours are the last page before and the first page after in the order of host, directory and path
    that don't have the very same lines, which would tell nothing. One in the same directory is nearer than one
    in another, then the one with the longer common start. Without one in the host all lines stay.
    """
    spark = lines.sparkSession
    cut = in_ranges(lines)
    sent = spark.createDataFrame(edges(cut), "__to int, k long")
    over = cut.join(F.broadcast(sent), "k").withColumn("part", F.col("__to")).withColumn("edge", F.lit(True))
    names = ["part", "edge", "k", "page_id", "host", "folder", "path", "hashes", "sure"]
    both = cut.withColumn("edge", F.lit(False)).select(*names).unionByName(over.select(*names))
    both = both.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", *ORDER)

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = differences(rows)
        while some := list(islice(found, 1024)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)],
                ["k", "page_id", "shared"])

    return both.mapInArrow(run, "k long, page_id long, shared array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (a stored table).

    A null or empty html, or one without an article, gives an empty text. Null ids and urls are kept;
    pages without url are one host. Repeated rows get the same text.
    """
    rows = take_columns(pages, page_id="long", url="string", html="string").withColumn("k", F.xxhash64("page_id", "url", "html"))
    shared = materialize(shared_lines(materialize(line_hashes(rows), "page-lines")), "page-shared").drop("page_id")
    joined = rows.join(checked_broadcast(shared, 512), "k", "left")

    @F.pandas_udf("string")
    def text_of(html, gone):
        import pandas as pd

        out = []
        for page, places in zip(html, gone, strict=True):
            lines, _ = candidates(page or "")
            drop = set() if places is None else set(int(i) for i in places)
            out.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
        return pd.Series(out, dtype=object)

    return joined.select("page_id", "url", text_of("html", "shared").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("op5_page_differencing")
def op5_page_differencing(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages"))
