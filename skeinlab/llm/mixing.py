"""Mixing sources to target weights: exact quotas split down a tree of hypergeometric draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skeinlab.llm import common

WEIGHTS = (3, 1, 2)  # of the sources by code point, repeating
TOTAL = 1.5  # words of the mix per word of the input
REPEATS = 2  # the most passes over a source
BLOCK_ROWS = 5_000  # documents of a block of a source that holds the whole table: the number of blocks follows the size
SHARDS = 64  # the fewest, where their number follows the size of the mix
SHARD_WORDS = 4_000_000  # of a shard, about, where there are more
QUOTAS = 1 << 22  # the most numbers of the splitting tree's last level, shards x sources, beyond SHARDS shards
SENT_BLOCKS = 1 << 18  # the most rows of a plan that is sent to all tasks


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(doc_id: Column, seed: int = 0) -> Column:
    """A key that puts documents in a random order that reruns repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size): with weight and target.

    Sources by code point, null last, get the weights in turn. Water fills them by weight until each
    that would rise above repeats * size stands at that height: in order of height per weight, a source
    is full if its share of what the earlier full ones left is no less than its height. One row per
    source takes part in the unpartitioned windows here."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    after, whole = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("double")
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("left", F.lit(total) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("among", F.sum("weight").over(after))
        .withColumn("full", F.col("cap") * F.col("among") <= F.col("left") * F.col("weight"))
    )
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("left") / F.col("among")))).over(Window.partitionBy())
    return filled.withColumn("level", first["col2"]).select(
        "source", "source_size", "weight", F.round(F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")), 6).alias("target")
    )


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard the number of blocks of each source: halves of the shards share the blocks of a
    node evenly, and which sources they come from is a multivariate hypergeometric draw. Sums by source
    are exactly the quotas. Work and memory: shards x sources."""

    def split(blocks: np.ndarray, lo: int, hi: int) -> list[list[int]]:
        if hi - lo == 1:
            return [blocks.tolist()]
        mid = (lo + hi) // 2
        take = int(blocks.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(blocks, take, method="marginals") if take else 0 * blocks
        return split(left, lo, mid) + split(blocks - left, mid, hi)

    return split(np.asarray(quotas, dtype=np.int64), 0, max(1, shards))


def block_digits(rows: int) -> int:
    """Hexadecimal digits of the permutation key that name a block: about BLOCK_ROWS of `rows` rows share them."""
    digits = 1
    while rows > BLOCK_ROWS * 16**digits:
        digits += 1
    return digits


def sized(docs: DataFrame, seed: int, digits: int) -> DataFrame:
    """docs' columns in `row`, with mix_id, mix_source, size, key (the permutation) and block (its first digits)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(row, F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), words(F.col("text")).alias("size"))
    return base.withColumn("key", permuted(F.col("mix_id"), seed)).withColumn("block", F.substring("key", 1, digits))


def block_plan(base: DataFrame, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """plan_source, plan_block, source_size, target, owed: the words that each block of a source owes in each pass.
    base: sized rows."""
    blocks = base.groupBy(F.col("mix_source").alias("source"), "block").agg(F.sum("size").alias("block_words"))
    sources = source_targets(blocks.groupBy("source").agg(F.sum("block_words").alias("source_size")), total, repeats)
    earlier = Window.partitionBy(blocks["source"]).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.floor(F.col("target") + 0.5)
    owed = [F.least(F.greatest(goal - p * F.col("source_size") - F.col("words_before"), F.lit(0)), F.col("block_words")) for p in range(repeats)]
    rows = blocks.join(sources, blocks["source"].eqNullSafe(sources["source"])).select(
        blocks["source"].alias("plan_source"), F.col("block").alias("plan_block"), "block_words", "source_size", "target",
        F.coalesce(F.sum("block_words").over(earlier), F.lit(0)).alias("words_before"),
    )
    return rows.select("plan_source", "plan_block", "source_size", "target", F.array(*owed).alias("owed"))


def with_takes(base: DataFrame, plan: DataFrame) -> DataFrame:
    """sized rows with their block's plan and takes, the words taken in each pass. The rows are shuffled once."""
    inside = Window.partitionBy("mix_source", "block").orderBy("key", "mix_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    takes = F.transform("owed", lambda o: F.least(F.greatest(o - F.col("before"), F.lit(0)), F.col("size")))
    joined = base.join(plan, F.col("mix_source").eqNullSafe(F.col("plan_source")) & (F.col("block") == F.col("plan_block")))
    return joined.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("takes", takes)


def mix_plan(docs: DataFrame, total: float = TOTAL, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """One row per input row: its columns in `row`, size, source_size, target, and takes, the words
    taken in each pass (pass 1 first).

    A source is a permuted sequence of blocks, its documents dealt by a hash of doc_id, and is walked as
    often as its target needs; the last document of the walk is taken in part, so that the words taken
    are the rounded target. Documents without words take none. Equal rows share their ids' place.
    Null sources are one source. Empty input: no rows. The running sums are kept in two levels (blocks of
    a source, documents of a block), so no task holds a hot source."""
    base = sized(docs, seed, block_digits(docs.count()))
    found = with_takes(base, block_plan(base, total, repeats))
    return found.select("row", "mix_id", "mix_source", "block", "key", "size", "source_size", "target", "takes")


def dealt_blocks(plan: DataFrame, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    """(end_source, end_block, mix_pass, owes, mix_shard for each block and pass that owes words, number of shards).

    The blocks that each source owes are counted, the splitting tree deals the counts out to the shards, and
    each shard takes its own run of every source's permuted blocks: the runs' places are spelled out and joined
    to the blocks' ranks. Only (source, blocks, words) comes to the driver, and at least SHARDS numbers for each
    source; shards grow rather than that shards x sources passes QUOTAS."""
    drawn = plan.select("plan_source", "plan_block", F.posexplode("owed").alias("mix_pass", "owes")).filter("owes > 0")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("plan_source").orderBy("mix_pass", "plan_block")) - 1)
    counts = sorted((tuple(r) for r in drawn.groupBy("plan_source").agg(F.count(F.lit(1)), F.sum("owes")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    shards = shards or max(SHARDS, min(sum(w for *_, w in counts) // SHARD_WORDS + 1, QUOTAS // max(1, len(counts))))
    tree = np.asarray(splitting_tree([n for _, n, _ in counts], shards, seed), dtype=np.int64).reshape(shards, len(counts))
    ends = np.cumsum(tree, axis=0)
    runs = [(counts[i][0], int(ends[shard, i] - tree[shard, i]), int(ends[shard, i]), int(shard)) for shard, i in zip(*np.nonzero(tree), strict=True)]
    runs = plan.sparkSession.createDataFrame(runs, "end_source string, lo bigint, hi bigint, mix_shard int")
    places = runs.select("end_source", "mix_shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("place"))
    dealt = ranked.join(places, F.col("plan_source").eqNullSafe(F.col("end_source")) & (F.col("rank") == F.col("place")))
    return dealt.select("end_source", F.col("plan_block").alias("end_block"), "mix_pass", "owes", "mix_shard"), shards


def dealt_rows(base: DataFrame, plan: DataFrame, shards: int | None = SHARDS, seed: int = 0, whole: bool = False) -> DataFrame:
    """sized rows of the mix with nth (the place in the block), mix_pass, mix_words, mix_shard and mix_place: a
    partition for each shard, in it the rows by mix_place, a random order.

    whole: the last document of a source's walk is taken whole or not at all, whichever is nearer to the target.
    A block owes a pass to one shard, so its running sum is found in the shard, and rows are shuffled once
    (twice where the plan is too large to be sent to all)."""
    blocks, shards = dealt_blocks(plan, shards, seed)
    blocks = F.broadcast(blocks) if plan.count() <= SENT_BLOCKS else blocks
    rows = base.join(blocks, F.col("mix_source").eqNullSafe(F.col("end_source")) & (F.col("block") == F.col("end_block")))
    rows = rows.drop("end_source", "end_block").repartitionById(shards, F.col("mix_shard"))
    inside = Window.partitionBy("mix_shard", "mix_source", "block", "mix_pass").orderBy("key", "mix_id", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("before", before)
    words_taken = F.least(F.greatest(F.col("owes") - F.col("before"), F.lit(0)), F.col("size"))
    if whole:
        words_taken = F.when(2 * words_taken >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    rows = rows.withColumn("mix_words", words_taken).filter("mix_words > 0")
    place = F.md5(F.concat_ws(":", F.lit(seed + 1), "key", "mix_pass"))
    return rows.drop("owes", "before").withColumn("mix_place", place).sortWithinPartitions("mix_shard", "mix_place")


def drawn_rows(docs: DataFrame, shards: int | None, seed: int, whole: bool) -> DataFrame:
    """The dealt rows of docs. The plan (a row for each block) is stored."""
    base = sized(docs, seed, block_digits(docs.count()))
    return dealt_rows(base, common.stored(block_plan(base), "mix-plan"), shards, seed, whole)


MIX = ("mix_pass", "mix_words", "mix_shard", "mix_place", "mix_size")


def mix(docs: DataFrame, shards: int | None = SHARDS, seed: int = 0, whole: bool = False) -> DataFrame:
    """The mix itself: docs' columns, then mix_pass, mix_words (taken of this row), mix_shard, mix_place, mix_size.
    These replace columns of docs that have their names.

    Partition i is shard i, its rows in the order of mix_place. shards None: as many as the words of the mix
    ask for. A document of which only a part is taken keeps its first mix_words words, joined by single spaces
    in mixed_documents; with whole there is none (see dealt_rows). Nulls, ties and empty tables as in mix_plan."""
    rows = drawn_rows(docs, shards, seed, whole)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in MIX], *MIX[:-1], F.col("size").alias(MIX[-1]))


def mixed_documents(docs: DataFrame, seed: int = 0, whole: bool = False) -> DataFrame:
    """The mix with the columns of docs, whatever their names, shard by shard in random order: a row for each pass
    over a document; n_chars follows the text. whole: documents are never cut, and their rows are as in docs.

    Documents without words (null, empty and white texts) are in no mix. Null sources are one source; repeated
    rows are documents of their own. Empty input: no rows."""
    rows = drawn_rows(docs, None, seed, whole)
    if whole:
        return rows.select("row.*")
    found = F.regexp_extract_all(F.col("row")["text"], F.lit(r"([^\x20\x09-\x0D]+)"))
    part = F.array_join(F.slice(found, 1, F.col("mix_words").cast("int")), " ")
    rows = rows.withColumn("part", F.when(F.col("mix_words") == F.col("size"), F.col("row")["text"]).otherwise(part))
    new = {"text": F.col("part"), "n_chars": F.length("part").cast("long")}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def taken_of(docs: DataFrame, shards: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs: the words that the dealt mix holds of it.

    The mix is dealt to its shards and ordered, and is stored as references (source, block, nth) to documents,
    without texts; what is taken of a document is summed over the stored shards. The texts are read once, for
    their sizes. Nulls, ties and empty tables as in mix_plan."""
    digits = block_digits(docs.count())
    base = common.stored(sized(docs, seed, digits).drop("row"), "mix-sizes")
    plan = common.stored(block_plan(base), "mix-plan")
    dealt = dealt_rows(base, plan, shards, seed).select("mix_id", "mix_source", "block", "nth", "mix_pass", "mix_words", "mix_shard", "mix_place")
    sums = common.stored(dealt, "mix-shards").groupBy(F.col("mix_source").alias("s"), F.col("block").alias("b"), F.col("nth").alias("n")).agg(F.sum("mix_words").alias("taken"))
    rows = base.withColumn("nth", F.row_number().over(Window.partitionBy("mix_source", "block").orderBy("key", "mix_id", "size")))
    sources = plan.groupBy("plan_source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    found = rows.join(sources, F.col("mix_source").eqNullSafe(F.col("plan_source"))).join(sums, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("nth") == F.col("n")), "left")
    return found.select(F.col("mix_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, summed over the dealt mix (see taken_of)."""
    return taken_of(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         2.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among
  FROM w),
g AS (SELECT *, cap * among <= remains * weight AS is_full FROM f),
t AS (
  SELECT source, source_size, round(CASE WHEN is_full THEN cap ELSE weight *
         (SELECT arg_min(remains / among, cap / weight) FROM g WHERE NOT is_full) END, 6) AS target FROM g),
o AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(greatest(goal - before, 0), size) + least(greatest(goal - source_size - before, 0), size) AS BIGINT) AS taken
FROM o
"""
