"""Merkle manifest of a table by sibling-shift self-joins.

A row's digest is a leaf. Leaves of one language, in order of doc_id, form a tree whose nodes have
`ARITY` children; the trees' tops form one more tree, whose top is the root of the table.

* Places: rows are dealt by range of (tree, doc_id, leaf) and numbered inside their partition; one row
  per (partition, tree) is added up across partitions, so no language meets in one task.
* A level: the node in slot s looks for the slot-zero node at its own index less s. These are equijoins on
  (tree, index) with one key in all of them, so a level's nodes are shuffled once; slot-zero rows then hold
  the digests of their run and emit the parent. Every level is an eighth of the one below.
* Proofs come down again: the row of a run takes the steps above it from the run of its parent, which is a join
  of an eighth of the rows, so that a leaf meets one row only. The fold is an aggregate over the steps.

Built-in functions only; each level is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query
from .tables import checked_broadcast, materialize, places, table, take_columns

ARITY = 8
#: Characters of a digest.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<before:string,after:string>>"


def entry(c: Column) -> Column:
    """A value as it enters a leaf: '-' if null, else its number of UTF-8 bytes, ':' and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**other: Column) -> Column:
    """Digest of a row; `other` stands in for columns of that name."""
    return F.sha2(F.concat(*[entry(other.get(c, F.col(c))) for c in FIELDS]), 256)


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, idx, digest, m, members) of the level above the nodes (tree, idx, digest, m: nodes of the tree's level).

    `members`: the digests of the children one after another.
    """
    slot = F.pmod("idx", F.lit(ARITY))
    out = nodes.where(slot == 0).select("tree", "idx", "m", F.col("digest").alias("d0"))
    for s in range(1, ARITY):
        sibling = nodes.where(slot == s).select("tree", (F.col("idx") - s).alias("idx"), F.col("digest").alias(f"d{s}"))
        out = out.join(sibling, ["tree", "idx"], "left")
    members = F.concat_ws("", *[f"d{s}" for s in range(ARITY)])
    out = out.select("tree", F.expr(f"idx div {ARITY}").alias("idx"), F.expr(f"(m + {ARITY - 1}) div {ARITY}").alias("m"),
                     members.alias("members"))
    return out.withColumn("digest", F.sha2("members", 256))


def levels(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above `nodes` (a stored table, of trees with up to `largest` nodes), and the tops (tree, digest)."""
    made, tops = [], nodes.where("m = 1").select("tree", "digest")
    while largest > 1:
        nodes = materialize(parents(nodes.where("m > 1").select("tree", "idx", "digest", "m")), "merkle-level")
        made.append(nodes)
        tops = tops.unionByName(nodes.where("m = 1").select("tree", "digest"))
        largest = -(-largest // ARITY)
    return made, tops


def step(slot: Column) -> Column:
    """What stands before and after the child in this slot of a run."""
    return F.struct(F.col("__members").substr(F.lit(1), slot * HEX).alias("before"),
                    F.col("__members").substr((slot + 1) * HEX + 1, F.lit(ARITY * HEX)).alias("after"))


def with_steps(nodes: DataFrame, above: list[DataFrame], tops: DataFrame) -> DataFrame:
    """`nodes` (tree, idx, m, ...) with `steps`: the siblings on their way up, run by run, then the steps of `tops` (tree, steps)."""
    alone = nodes.where("m = 1").join(tops, "tree")
    if not above:
        return alone
    runs = with_steps(above[0].select("tree", "idx", "m", "members"), above[1:], tops).select(
        "tree", F.col("idx").alias("__run"), F.col("members").alias("__members"), F.col("steps").alias("__up"))
    inner = nodes.where("m > 1").withColumn("__run", F.expr(f"idx div {ARITY}")).join(runs, ["tree", "__run"])
    steps = F.concat(F.array(step(F.pmod("idx", F.lit(ARITY)).cast("int"))), F.col("__up"))
    return alone.unionByName(inner.withColumn("steps", steps).drop("__run", "__members", "__up"))


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs`.

    `tampered` says of which rows (columns `FIELDS`) the text is lower-cased (A-Z) before it is verified; default: none.
    A null stays a null and is a leaf's '-'; a null lang is a tree of its own, before all others; null doc_ids come
    first in their tree. Rows that share a doc_id are leaves of their own, in order of their digests, so that repeated
    rows have neighbouring places and may have different proofs. An empty text differs from a null one. Texts of any
    length count whole. A lone leaf is its tree's top and has no siblings there. Of an empty table there are no rows.
    """
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = take_columns(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    lower = F.translate(F.col("text"), UPPER, LOWER)
    leaves = materialize(rows.select(
        "doc_id", "lang", leaf().alias("leaf"), F.when(hit, leaf(text=lower)).alias("changed"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt")), "merkle-leaves")
    trees = materialize(leaves.groupBy("lang").agg(F.count("*").alias("n")).withColumn("tree", F.lit(0).cast("long")), "merkle-trees")
    trees = materialize(places(trees, ["tree"], ["lang"]).select(
        F.col("lang").alias("__lang"), "n", F.col("idx").alias("tree"), F.col("m").alias("trees")), "merkle-trees")
    most = trees.agg(F.max("n").alias("n"), F.count("*").alias("trees")).first()

    of_tree = checked_broadcast(trees.select("__lang", "tree"), 64)
    keyed = leaves.join(of_tree, F.col("lang").eqNullSafe(F.col("__lang"))).drop("lang", "__lang")
    keyed = materialize(places(materialize(keyed, "merkle-keyed"), ["tree"], ["doc_id", "leaf", "salt"]).drop("salt"), "merkle-nodes")
    above, tops = levels(keyed.select("tree", "idx", "m", F.col("leaf").alias("digest")), most["n"] or 0)
    tops = materialize(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest",
                                   F.lit(most["trees"]).cast("long").alias("m")), "merkle-tops")
    over, root = levels(tops, most["trees"])
    root = root.first()
    end = tops.sparkSession.range(1).select(F.col("id").alias("tree"), F.array().cast(STEPS).alias("steps"))
    tops = with_steps(tops, over, end).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "steps")
    tops = checked_broadcast(materialize(tops, "merkle-subroots"), 4096)

    out = with_steps(keyed, above, tops.select("tree", "steps")).join(tops.select("tree", "subroot"), "tree")
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.select("doc_id", "leaf", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"),
                     F.sha2(proof, 256).alias("proof_sha256"),
                     folded(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# --- the query and its SQL -------------------------------------------------------------------

#: Levels that the SQL unrolls for a language and for the languages; a finished tree stays as it is.
SQL_LEVELS, SQL_TOP_LEVELS = 8, 3


def _sql() -> str:
    one = lambda c, s: f"coalesce(strlen({s})::varchar || ':' || {s}, '-')" if s else f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    head = " || ".join(one(c, None) for c in FIELDS[:-1])
    crc = ("list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::bigint), lambda acc, b: "
           "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, "
           "xor(acc, b)), 4294967295)")
    parts = [f"""leaves AS (
  SELECT doc_id, lang, sha256({head} || {one('text', None)}) AS leaf,
    sha256({head} || {one('', f"translate(text, '{UPPER}', '{LOWER}')")}) AS lowered,
    xor({crc}, 4294967295) % 3 = 0 AS hit
  FROM (SELECT *, doc_id::varchar AS s FROM documents)),
b0 AS (SELECT doc_id, coalesce(CASE WHEN hit THEN lowered END, leaf) AS seen, leaf, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS m, leaf AS digest
  FROM leaves)"""]

    def climb(name: str, first: str, tree: str, n: int) -> list[str]:
        out = [f"{name}0 AS (SELECT {tree} AS tree, idx, m, digest FROM {first})"]
        for k in range(n):
            out.append(f"""{name}{k + 1} AS (SELECT tree, idx // {ARITY} AS idx, (m + {ARITY - 1}) // {ARITY} AS m,
    CASE WHEN m = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY {name}{k}.idx)) END AS digest,
    list(digest ORDER BY {name}{k}.idx) AS kids
  FROM {name}{k} GROUP BY tree, idx // {ARITY}, m)""")
        return out

    parts += climb("u", "b0", "tree", SQL_LEVELS)
    parts.append(f"s AS (SELECT 0 AS t, tree AS idx, count(*) OVER () AS m, digest FROM u{SQL_LEVELS})")
    parts += climb("r", "s", "t", SQL_TOP_LEVELS)

    def walk(prev: str, name: str, n: int, tree: str, at: str) -> tuple[list[str], str]:
        out = []
        for k in range(n):
            slot = f"({at} // {ARITY ** k} % {ARITY})"
            pre, post = f"array_to_string(p.kids[1:{slot}], '')", f"array_to_string(p.kids[{slot} + 2:], '')"
            out.append(f"""{name}w{k} AS (SELECT w.* REPLACE (
    CASE WHEN c.m = 1 THEN folded ELSE sha256({pre} || folded || {post}) END AS folded, proof || {pre} || {post} AS proof)
  FROM {prev} w JOIN {name}{k} c ON c.tree = {tree} AND c.idx = {at} // {ARITY ** k}
  JOIN {name}{k + 1} p ON p.tree = {tree} AND p.idx = {at} // {ARITY ** (k + 1)})""")
            prev = f"{name}w{k}"
        return out, prev

    parts.append("w AS (SELECT doc_id, leaf, tree AS tr, idx AS at, seen AS folded, '' AS proof FROM b0)")
    more, last = walk("w", "u", SQL_LEVELS, "w.tr", "w.at")
    parts += more
    more, last = walk(last, "r", SQL_TOP_LEVELS, "0", "w.tr")
    parts += more
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, x.digest AS subroot, y.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = y.digest AS verified
FROM {last} JOIN u{SQL_LEVELS} x ON x.tree = tr CROSS JOIN r{SQL_TOP_LEVELS} y"""


@query("op11_merkle_manifest", _sql())
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    every_third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return manifest(table(spark, sf, "documents"), every_third)
