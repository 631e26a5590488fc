"""Merkle manifest of a data set: hash trees whose leaves are ranked by a trie of id digits.

Ranks need no global sort: rows are counted by the leading digits of their key, level by level, and a row's rank is
the rows of smaller prefixes plus its place among the few rows of its own prefix. The ranks, written in digits
of base FANOUT, are the keys of the tree's nodes: the parent's key is the node's without its last digit, so a
group of nodes with a common prefix (a block of BLOCK_DIGITS digits) is reduced at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skeinlab.llm import common

FANOUT_BITS = 1  # base 2: two nodes to a parent
BLOCK_DIGITS = 10  # digits of a block: 1,024 nodes are reduced in one row
CELL = 4096  # rows of a prefix that are ordered among themselves
DIGITS = 3  # hex digits from one level of counts to the next, 4,096 prefixes below a prefix
ID = 16  # hex digits of a doc_id
LEAF = 64  # and of a leaf
FIRST = ID - DIGITS  # the counts begin at all digits of the id but the last three


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(name: str, value: Column | None = None) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = (F.col(f"`{name}`") if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def key_of(doc_id: Column, leaf: Column, row: Column) -> Column:
    """A string that orders rows by doc_id (null last), then leaf, then row number, and is unique."""
    number = F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), ID, "0")
    return F.concat(F.coalesce(number, F.lit("G" * ID)), leaf, F.lpad(F.hex(row), ID, "0"))


def _offsets(cells: DataFrame, above: DataFrame | None, length: int) -> DataFrame:
    """cells with `before`, the rows of the tree in smaller cells, and `size`, all its rows; above: the cells of
    `length` digits, with both."""
    if above is None:
        inside = Window.partitionBy("tree")
        return cells.withColumn("before", F.sum("n").over(inside.orderBy("cell")) - F.col("n")).withColumn("size", F.sum("n").over(inside))
    inside = Window.partitionBy("tree", "up").orderBy("cell")
    placed = cells.withColumn("up", F.substring("cell", 1, length)).withColumn("before", F.sum("n").over(inside) - F.col("n"))
    known = above.select("tree", F.col("cell").alias("up"), F.col("before").alias("start"), "size")
    return placed.join(known, ["tree", "up"]).select("tree", "cell", "n", (F.col("start") + F.col("before")).alias("before"), "size")


def _counted(rows: DataFrame, length: int) -> DataFrame:
    return rows.groupBy("tree", F.substring("key", 1, length).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= common.SENT else df


def ranked(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """rows (tree, key, ...) with place, the 0-based rank of key in its tree, and size, the rows of the tree.

    Keys are unique and not null. Prefixes of `first` digits are counted and summed up to shorter ones; where
    a prefix holds more than CELL rows (ids that repeat), its rows alone are counted by longer ones, through the
    leaf to the row number, so no cell is larger, whatever the data."""
    counts = common.stored(_counted(rows, first), "cells")
    levels = {first: counts}
    lengths = [n for n in range(first - DIGITS, 0, -DIGITS)]
    for n in lengths:
        fewer = list(levels.values())[-1]
        levels[n] = fewer.groupBy("tree", F.substring("cell", 1, n).alias("cell")).agg(F.sum("n").alias("n"))
    now, above = None, 0
    for n in reversed(list(levels)):
        now, above = _offsets(levels[n], now, above), n
    now = common.stored(now, "cells")
    length, final = first, []
    rows = rows.withColumn("cell", F.substring("key", 1, first))
    while heavy := now.filter(F.col("n") > CELL).count():
        many = now.filter(F.col("n") > CELL)
        final.append(now.filter(F.col("n") <= CELL))
        longer = next(n for n in (ID, ID + DIGITS, ID + 2 * DIGITS, *range(ID + LEAF, 2 * ID + LEAF, DIGITS), 2 * ID + LEAF) if n > length)
        inside = _small(many.select("tree", "cell", F.lit(True).alias("in")), heavy)
        rows = rows.join(inside, ["tree", "cell"], "left").withColumn("cell", F.when(F.col("in"), F.substring("key", 1, longer)).otherwise(F.col("cell"))).drop("in")
        part = rows.filter(F.length("cell") == longer).groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("n"))
        now, length = common.stored(_offsets(part, many, length), "cells"), longer
    for more in final:
        now = now.unionByName(more)
    placed = rows.withColumn("turn", F.row_number().over(Window.partitionBy("tree", "cell").orderBy("key")))
    found = placed.join(now.select("tree", "cell", "before", "size"), ["tree", "cell"])
    return found.withColumn("place", F.col("before") + F.col("turn") - 1).drop("cell", "before", "turn")


def _height(size: Column) -> Column:
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _parents(nodes: Column) -> Column:
    some = F.sequence(F.lit(0), F.floor((F.size(nodes) + 1) / 2).cast("int") - 1)
    return F.transform(some, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _blocks(nodes: DataFrame, done: int, payload: list[str]) -> DataFrame:
    """One row for each block of nodes: its members in order and the levels above them inside the block."""
    member = F.struct("place", "node", *payload)
    grouped = nodes.groupBy("tree", "size", F.shiftright("place", BLOCK_DIGITS).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    steps = F.greatest(F.lit(0), F.least(F.lit(BLOCK_DIGITS), _height(F.col("size")) - done))
    turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    leaves = F.transform("members", lambda m: m["node"])
    levels = F.aggregate(turns, F.array(leaves), lambda acc, j: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
    return grouped.withColumn("levels", levels)


def _paths(blocks: DataFrame, payload: list[str]) -> DataFrame:
    """Each member with its siblings, from its own level to the top of the block and on along `above`, and with
    what else `above` holds."""
    each = blocks.select("tree", "levels", "above", F.posexplode("members").alias("o", "m"))
    steps = F.size("levels") - 1
    turns = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))

    def sibling(j: Column) -> Column:
        at = F.call_function("shiftright", F.col("o"), j)
        return F.struct((at % 2 == 1).alias("left"), F.get(F.get(F.col("levels"), j), at.bitwiseXOR(F.lit(1))).alias("node"))

    path = F.concat(F.transform(turns, sibling), F.col("above")["path"])
    member = [F.col("m")[c].alias(c) for c in ("place", "node", *payload)]
    return each.select("tree", *member, F.struct(path.alias("path"), F.col("above")["subroot"].alias("subroot"), F.col("above")["root"].alias("root")).alias("above"))


NO_PATH = "struct<path:array<struct<left:boolean,node:string>>,subroot:string,root:string>"


class Forest:
    """Hash trees over nodes (tree, place, size, node and the columns `payload`), in rounds of BLOCK_DIGITS levels."""

    def __init__(self, nodes: DataFrame, payload: list[str]):
        self.payload = payload
        largest = nodes.agg(F.max("size")).first()[0] or 1
        rounds = max(1, -(-(largest - 1).bit_length() // BLOCK_DIGITS))
        self.rounds = []
        for k in range(rounds):
            blocks = common.stored(_blocks(nodes, k * BLOCK_DIGITS, [] if k else payload), "blocks")
            self.rounds.append(blocks)
            nodes = blocks.select("tree", "size", F.col("block").alias("place"), F.get(F.element_at("levels", -1), F.lit(0)).alias("node"))
        self.roots = nodes.select("tree", F.col("node").alias("root"))

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """tree, place, node, the payload and above: a struct of path, the siblings (left, node or null) from the node
        to its root and on along that of above (tree, above), and of what else that holds."""
        found = None
        for k in reversed(range(len(self.rounds))):
            blocks = self.rounds[k]
            if found is not None:
                blocks = blocks.join(found.select("tree", F.col("place").alias("block"), "above"), ["tree", "block"])
            elif above is not None:  # one block to a tree here
                blocks = blocks.join(above, "tree")
            else:
                start = F.struct(F.array().cast("array<struct<left:boolean,node:string>>"), F.lit(None).cast("string"), F.lit(None).cast("string"))
                blocks = blocks.withColumn("above", start.cast(NO_PATH))
            found = _paths(blocks, [] if k else self.payload)
        return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(
        path,
        leaf,
        lambda now, x: F.when(x["node"].isNull(), F.sha2(now, 256)).when(x["left"], digest(x["node"], now)).otherwise(digest(now, x["node"])),
    )


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, changed (the leaf of the tampered row, null where it is not tampered) and key, stored."""
    parts = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    other = digest(*[framed(c, F.col("n_chars").cast("bigint") + 1 if c == "n_chars" else None) for c in parts])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("tree"),
        "doc_id",
        digest(*[framed(c) for c in parts]).alias("leaf"),
        F.when(tampered, other).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = common.stored(rows, "leaves")
    return rows.withColumn("key", key_of(F.col("doc_id"), F.col("leaf"), F.col("row"))).drop("row")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs (doc_id, source, lang,
    n_chars, text); further columns are not read.

    Trees are by lang, null and empty languages are trees of their own. Leaves ascend by doc_id, null last, then by
    leaf; repeated rows are leaves next to one another. A null doc_id or n_chars is never tampered. A tree
    of one leaf is that leaf, and a forest of one tree its subroot. Empty input: no rows. Texts are read once
    and never shuffled; a block holds 1,024 digests, and proofs are made where the block is."""
    ranks = ranked(leaves(docs)).withColumnRenamed("leaf", "node").drop("key")
    forest = Forest(ranks, ["doc_id", "changed"])
    tops = forest.roots.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node"), F.hex("tree").alias("key"))
    crown = Forest(ranked(common.stored(tops, "subroots")).drop("key"), ["of"])
    crowned = crown.paths().join(crown.roots, "tree")
    above = crowned.select(F.col("of").alias("tree"), F.struct(F.col("above")["path"].alias("path"), F.col("node").alias("subroot"), F.col("root").alias("root")).alias("above"))
    found = forest.paths(common.stored(above, "crown"))
    path = F.col("above")["path"]
    again = folded(F.coalesce("changed", "node"), path)
    rows = found.select(
        "doc_id",
        F.col("node").alias("leaf"),
        F.col("above")["subroot"].alias("subroot"),
        F.col("above")["root"].alias("root"),
        F.sha2(F.array_join(F.transform(path, lambda x: x["node"]), ""), 256).alias("proof_sha256"),
        again.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; see manifest for nulls, ties, repeated rows, empty tables and further columns."""
    return manifest(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS t, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS z,
         list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ord(c)::BIGINT)), lambda crc, b:
           list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS inv
  FROM documents),
e AS (
  SELECT doc_id, t, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
         sha256(a || coalesce(strlen((n_chars + (xor(inv, 4294967295) % 7 = 0)::BIGINT)::VARCHAR) || ':' || (n_chars + (xor(inv, 4294967295) % 7 = 0)::BIGINT), '-') || z) AS changed,
         row_number() OVER (PARTITION BY t ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY t) AS n
  FROM d),
nodes AS (
  SELECT t, 0 AS lvl, i, n, leaf AS h FROM e
  UNION ALL
  SELECT t, lvl + 1, i // 2, (n + 1) // 2, up FROM (
    SELECT t, lvl, i, n, sha256(h || coalesce(lead(h) OVER (PARTITION BY t ORDER BY i), '')) AS up FROM nodes WHERE n > 1)
  WHERE i % 2 = 0),
sub AS (SELECT t, lvl AS height, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, up FROM (
    SELECT lvl, i, n, sha256(h || coalesce(lead(h) OVER (ORDER BY i), '')) AS up FROM crown WHERE n > 1)
  WHERE i % 2 = 0),
steps AS (
  SELECT e.doc_id, e.t, x.lvl, x.i AS place, s.h AS sib
  FROM e JOIN nodes x ON x.t = e.t AND x.n > 1 AND x.i = e.i >> x.lvl
  LEFT JOIN nodes s ON s.t = x.t AND s.lvl = x.lvl AND s.i = xor(x.i, 1)
  UNION ALL
  SELECT e.doc_id, e.t, sub.height + x.lvl, x.i, s.h
  FROM e JOIN sub ON sub.t = e.t JOIN crown x ON x.n > 1 AND x.i = sub.i >> x.lvl
  LEFT JOIN crown s ON s.lvl = x.lvl AND s.i = xor(x.i, 1)),
proofs AS (SELECT doc_id, t, coalesce(string_agg(sib, '' ORDER BY lvl), '') AS proof, count(*) AS len FROM steps GROUP BY doc_id, t),
fold AS (
  SELECT doc_id, t, 0 AS lvl, changed AS now FROM e
  UNION ALL
  SELECT f.doc_id, f.t, f.lvl + 1, sha256(CASE WHEN s.sib IS NULL THEN f.now WHEN s.place % 2 = 1 THEN s.sib || f.now ELSE f.now || s.sib END)
  FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.t = f.t AND s.lvl = f.lvl)
SELECT e.doc_id, e.leaf, sub.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.now AS folded_root, f.now = r.h AS verified
FROM e JOIN sub ON sub.t = e.t JOIN crown r ON r.n = 1
LEFT JOIN proofs p ON p.doc_id = e.doc_id AND p.t = e.t
JOIN fold f ON f.doc_id = e.doc_id AND f.t = e.t AND f.lvl = coalesce(p.len, 0)
"""
