"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skeinlab.llm import common


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), common.WHITE, "")


def content_hash(norm: Column) -> Column:
    return F.md5(norm)


def digests(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """doc_id, n_code (code points), h, text_sha256 and a number for each row, stored: texts are digested once."""
    norm = normalised(F.col("text"))
    rows = docs.select("doc_id", F.length(common.text_or_empty()).cast("long").alias("n_code"), hash_of(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256"))
    return common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def checked_groups(docs: DataFrame, rows: DataFrame, total: int, hash_of=content_hash) -> DataFrame:
    """h, text_sha256, group_size and the number of the row that stays (keep_row) with its doc_id (keep_id).

    Where a hash has two rows or more, their distinct texts are compared byte by byte (grouping on the bytes);
    if two of them agree in both digests, the job stops rather than merge them. These hashes are sent to all
    tasks up to SENT of them, so that other texts are not shuffled; beyond that all texts are grouped."""
    order = F.struct(F.col("n_code"), F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"), -F.col("row"))
    groups = common.stored(rows.groupBy("h", "text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best")), "groups")
    texts = docs.select(hash_of(normalised(F.col("text"))).alias("h"), normalised(F.col("text")).alias("norm"))
    repeated = groups.groupBy("h").agg(F.sum("group_size").alias("n")).filter("n > 1").select("h")
    if repeated.count() <= common.SENT:
        texts = texts.join(F.broadcast(repeated), "h", "left_semi")
    by_bytes = texts.groupBy("h", "norm").agg(F.lit(1).alias("one"))
    clashes = by_bytes.select("h", F.sha2("norm", 256).alias("text_sha256")).groupBy("h", "text_sha256").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    sure = F.when(F.col("texts").isNull(), F.col("group_size")).otherwise(F.raise_error(F.lit("two digests met for different bytes")))
    return groups.join(clashes, ["h", "text_sha256"], "left").select(
        "h", "text_sha256", sure.cast("long").alias("group_size"), F.bitwise_not(F.col("best")["col3"]).alias("keep_id"), (-F.col("best")["col4"]).alias("keep_row")
    )


def exact_groups(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_code.

    Rows with equal normalised texts form a group; the row with the most code points in its original
    text stays, then the smallest doc_id (null ids last). A hash that holds different bytes is split
    by a second digest; see checked_groups for the comparison. Of fully repeated rows one is kept. Null and
    empty texts, and texts of white space only, are equal. Only doc_id and text are read, so further columns
    of any name do no harm. Empty input: no rows.

    Sizes and keepers are partial aggregates; the text of a group crosses the shuffle once per task at most;
    rows of large groups stay where they are when the groups are joined to them."""
    rows = digests(docs, hash_of)
    total = rows.count()
    groups = checked_groups(docs, rows, total, hash_of)
    found = common.join_groups(rows, common.stored(groups, "checked"), ["h", "text_sha256"], "group_size", total)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_code")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups drops, all columns as they were, whatever their names.

    Nulls, empty texts and ties as in exact_groups; of fully repeated rows, and of such that differ in other
    columns only, the first by a hash of the row stays. Empty input: no rows. Rows are shuffled once."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    # The digests are unique per group, so that one row of each (digest, doc_id) is the whole answer.
    norm = normalised(F.col("text"))
    keyed = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.sha2(norm, 256).alias("digest"))
    kept = exact_groups(docs).filter("kept").select(F.col("keep_id").alias("k"), F.col("text_sha256").alias("s"), F.col("n_code").alias("c"))
    one = keyed.join(kept, (F.col("digest") == F.col("s")) & F.col("id").eqNullSafe(F.col("k")) & (F.length(F.coalesce(F.col("row")["text"], F.lit(""))) == F.col("c")))
    turn = F.row_number().over(Window.partitionBy("s", "k").orderBy(F.xxhash64("row")))
    return one.withColumn("turn", turn).filter("turn = 1").select("row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document; see exact_groups for nulls, empty texts,
    ties, repeated rows and empty tables. Further columns are not read."""
    docs = common.table(spark, sf_dir, "documents")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
r AS (
  SELECT doc_id, t,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(t) AS text_sha256 FROM r
"""
