"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A document is its multiset of five-word shingles: a term with the number of its occurrences as weight. Each of
SAMPLES draws gives every term r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of the term alone; with
t = floor(ln w / r + b) the term's draw is ln a = ln c - r (t - b + 1), and the draw of the document is the
(term, t) of the least ln a. Two documents meet in a draw with the probability of their generalised Jaccard
similarity, sum of min / sum of max of the weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skeinlab.llm import common

WORDS = 5
SAMPLES = 32
ROWS_EACH = 2_000  # documents of a range of ids
UNIT = 1.0 / (1 << 31)


def words(text: Column) -> Column:
    """The runs of [^\\x20\\x09-\\x0D] of a text."""
    return F.array_remove(F.split(F.translate(text, common.WHITE, " " * len(common.WHITE)), " "), "")


def shingles(words_name: str) -> Column:
    """Sorted hashes of the five-word runs of an array column; fewer words are one run, none a fixed term."""
    w = F.col(words_name)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
    return F.when(F.size(w) >= WORDS, F.sort_array(runs)).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))


def single(hashes: Column) -> Column:
    """Terms of weight 1."""
    return F.transform(hashes, lambda h: F.struct(h.alias("h"), F.lit(1).alias("w")))


def distinct(sorted_name: str) -> Column:
    return F.size(F.array_distinct(sorted_name)) == F.size(sorted_name)


def weighted(sorted_name: str) -> Column:
    """Array of (h, w): the distinct values of a sorted array and how often each occurs."""
    s = F.col(sorted_name)
    starts = F.filter(F.transform(s, lambda h, i: F.when((i == 0) | (F.get(s, i - 1) != h), i).otherwise(-1)), lambda i: i >= 0)
    ends = F.filter(F.transform(s, lambda h, i: F.when(F.get(s, i + 1) == h, -1).otherwise(i + 1)), lambda i: i >= 0)
    repeated = F.zip_with(starts, ends, lambda i, j: F.struct(F.get(s, i).alias("h"), (j - i).alias("w")))
    return F.when(distinct(sorted_name), single(s)).otherwise(repeated)


def draw(h: Column, log_w: Column, k: int) -> Column:
    """One draw of a term as a bigint: the order of ln a in the upper 32 bits, the digest of (term, t) below."""
    x, y, z = (F.xxhash64(h, F.lit(3 * k + i)) for i in range(3))
    upper = lambda v: (F.shiftrightunsigned(v, 33) + F.lit(0.5)) * F.lit(UNIT)
    lower = lambda v: (v.bitwiseAND(F.lit(0x7FFFFFFF)) + F.lit(0.5)) * F.lit(UNIT)
    # logarithms of products of two uniforms are the gammas; b is uniform by a third hash, independent of both
    r = -F.ln(upper(x) * lower(x))
    c = -F.ln(upper(y) * lower(y))
    b = upper(z)
    t = F.floor(log_w / r + b)
    order = F.ln(c) - r * (t - b + F.lit(1.0))
    # ln a lies within +-100; in steps of 1e-7 it fits 32 bits
    rank = F.floor((order + F.lit(100.0)) * F.lit(1e7)).cast("long")
    # h is a hash already; a step of t moves its digest by an odd number
    return F.shiftleft(rank, 32).bitwiseOR(h.bitwiseXOR(t * 40503).bitwiseAND(F.lit(0xFFFFFFFF)))


def signatures(rows: DataFrame, keys: list[str], arrays: list[str], prints: dict[str, list[str]], samples: int = SAMPLES) -> DataFrame:
    """rows' keys with the fingerprints `prints`: each of the terms (h, w) of several array columns together.

    Terms are exploded and the least draws taken as plain aggregates; rows that are already dealt out by
    one of the keys are not shuffled again. A fingerprint is the hexadecimal digests of its draws."""
    sides = [F.struct(F.lit(i).alias("side"), F.col(a).alias("terms")) for i, a in enumerate(arrays)]
    terms = rows.select(*keys, F.explode(F.array(*sides)).alias("s")).select(*keys, F.col("s.side").alias("side"), F.explode("s.terms").alias("term"))
    terms = terms.select(*keys, "side", F.col("term.h").alias("h"), F.ln(F.col("term.w").cast("double")).alias("log_w"))
    drawn = terms.groupBy(*keys, "side").agg(*[F.min(draw(F.col("h"), F.col("log_w"), k)).alias(f"d{k}") for k in range(samples)])
    own = {name: F.col("side").isin([arrays.index(a) for a in parts]) for name, parts in prints.items()}
    least = drawn.groupBy(*keys).agg(*[F.min(F.when(mine, F.col(f"d{k}"))).alias(f"{name}_{k}") for name, mine in own.items() for k in range(samples)])
    text = lambda name: F.concat(*[F.lpad(F.lower(F.hex(F.col(f"{name}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for k in range(samples)])
    return least.select(*keys, *[text(name).alias(name) for name in prints])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of the draws that two fingerprints have in common."""
    same = [F.when(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8), 1).otherwise(0) for k in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and the fingerprint of its whole text (null: empty), for each row. Repeated rows repeat."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(common.text_or_empty()).alias("words"))
    rows = rows.withColumn("sorted", shingles("words")).select("doc_id", "row", weighted("sorted").alias("text"))
    return signatures(rows, ["row", "doc_id"], ["text"], {"fingerprint": ["text"]}, samples).select("doc_id", "fingerprint")


def with_next(docs: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """range, ghost, place, doc_id, text, next_text: each document with the text of the next in descending
    doc_id order (null ids last; ties by a hash of the text), after the last the first.

    Ids are cut into ranges of about rows_each documents at approximate percentiles; the first document of
    each range also goes, as a ghost, to the end of the range before it. So each text is shuffled once."""
    low = F.lit(-(1 << 63))
    rows = docs.select("doc_id", common.text_or_empty().alias("text"), F.coalesce("doc_id", low).alias("id"))
    points = common.size_buckets(docs.select("doc_id"), "doc_id", rows_each)
    # ranges in descending order of id
    rows = rows.withColumn("range", F.lit(len(points)) - common.bucket_of(F.col("doc_id"), points))
    tops = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max("id").alias("top")).collect()}  # at most 10,000
    order = sorted(tops)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    spark = docs.sparkSession
    ends = spark.createDataFrame([(r, tops[r], before[r]) for r in order] or [(-1, 0, -1)], "top_range int, top bigint, before int")
    placed = rows.join(F.broadcast(ends), F.col("range") == F.col("top_range")).select(
        "doc_id", "text", "id", F.explode(F.when(F.col("id") == F.col("top"), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost")), F.struct(F.col("before").alias("range"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost"))))).alias("to")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.select("to.range", "to.ghost", "doc_id", "id", "text").repartition(n, "range")
    turn = Window.partitionBy("range").orderBy("ghost", F.desc("id"), F.xxhash64("text"))
    return placed.withColumn("place", F.row_number().over(turn)).withColumn("next_text", F.lead("text").over(turn))


def edited_prints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last third of the code points replaced by the head of the next document. A
    document without words has one fixed term, so that two such are alike; with one document, next is
    itself. Repeated rows are documents of their own. Empty input: no rows."""
    rows = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    texts = rows.select("range", "ghost", "place", "doc_id", n.cast("long").alias("n_chars"), F.coalesce(edited, F.lit("")).alias("edited_text"), "text")
    texts = texts.select("range", "ghost", "place", "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), words(F.col("text")).alias("w0"), words(F.col("edited_text")).alias("w1"))
    texts = texts.withColumns({"s0": shingles("w0"), "s1": shingles("w1")})
    keys = ["range", "ghost", "place", "doc_id", "n_chars", "edited_sha256"]
    # where no term repeats, those that both texts have are drawn once for both
    simple = distinct("s0") & distinct("s1")
    none = F.array().cast("array<struct<h:bigint,w:int>>")
    shared = F.when(F.col("simple"), single(F.array_intersect("s0", "s1"))).otherwise(none)
    plain = F.when(F.col("simple"), single(F.array_except("s0", "s1"))).otherwise(weighted("s0"))
    edit = F.when(F.col("simple"), single(F.array_except("s1", "s0"))).otherwise(weighted("s1"))
    arrays = texts.withColumn("simple", simple).select(*keys, shared.alias("shared"), plain.alias("plain"), edit.alias("edited"))
    prints = signatures(arrays, keys, ["shared", "plain", "edited"], {"plain_print": ["shared", "plain"], "edited_print": ["shared", "edited"]}, samples)
    turn = Window.partitionBy("range").orderBy("ghost", "place")
    return (
        prints.withColumn("next_print", F.lead("plain_print").over(turn))
        .filter("ghost = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            F.col("plain_print").alias("fingerprint"),
            F.col("edited_print").alias("edited_fingerprint"),
            likeness(F.col("plain_print"), F.col("edited_print"), samples).alias("near_edited"),
            likeness(F.col("plain_print"), F.col("next_print"), samples).alias("near_next"),
        )
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; see edited_prints for nulls, empty texts, ties,
    repeated rows and empty tables. Further columns are not read; the standard deviation of a likeness s is
    sqrt(s (1 - s) / 32), 0.09 at most."""
    return edited_prints(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
