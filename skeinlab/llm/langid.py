"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skeinlab.llm import common

BUCKETS = 1 << 16  # rows of the log-probability matrix
ORDERS = (1, 2, 3)
TRAIN_ROWS = 20_000  # expected size of the sample of labelled rows that the model is fitted on, shared out evenly to the languages
MAX_LANGUAGES = 512  # of a model; the matrix that is broadcast has 64 MiB for each 256 at most
CHUNK = 1 << 19  # characters scored at once
SMOOTHING = 0.5

_latin = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ɏ]").search


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_latin(text)) or any(map(str.isalpha, text)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of the lower-case text between two spaces, in stretches."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    overlap = max(ORDERS) - 1
    for at in range(0, max(1, len(chars) - overlap), CHUNK):
        yield from _buckets(chars[at : at + CHUNK + overlap], CHUNK)


def _buckets(chars: np.ndarray, starts: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        h = np.zeros(len(chars), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = (h[: len(chars) - n + 1] * np.uint32(0x01000193)) ^ (chars[n - 1 :] * np.uint32(0x9E3779B1))
            if n in ORDERS and len(h):
                x = h[:starts] ^ (h[:starts] >> np.uint32(15))
                x = x * np.uint32(0x85EBCA6B)
                yield (x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray] | None:
    """(languages, log probabilities as buckets x languages), or None without labelled text.

    The prior is even. The fit reads a sample by hash of id and text of about rows / languages labelled rows of each language
    outside the held-out part (all, where there are fewer, so that rare languages are learned too), counts grams in
    the tasks and sums the counts per language and bucket in Spark; the driver gets at most languages x buckets
    numbers. More than MAX_LANGUAGES languages are an error."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    seen = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not seen:
        return None
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"the model holds {MAX_LANGUAGES} languages")
    unit = 1 << 40
    parts = {lang: int(min(1.0, rows / len(seen) / n) * unit) + 1 for lang, n in seen.items()}
    share = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    sample = usable.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(unit)) < share[F.col("lang")])

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if has_letter(text):
                    mine = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    for x in gram_buckets(text):
                        mine += np.bincount(x, minlength=BUCKETS)
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "bucket", "n"])

    sums = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if not sums.num_rows:
        return None
    langs = sorted(set(sums.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    counts[sums.column("bucket").to_numpy(), [place[x] for x in sums.column("lang").to_pylist()]] += sums.column("n").to_numpy()
    return langs, (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)


def score(text: str, log_p: np.ndarray) -> np.ndarray:
    total = np.zeros(log_p.shape[1])
    for x in gram_buckets(text):
        # a long stretch repeats its buckets: rows times counts, else one row for each gram
        if len(x) > BUCKETS // 4:
            n = np.bincount(x, minlength=BUCKETS)
            at = np.flatnonzero(n)
            total += n[at].astype(np.float64) @ log_p[at]
        else:
            total += log_p[x].sum(axis=0, dtype=np.float64)
    return total


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, as_names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (or other names for them), the even-prior posterior of lang_pred.

    Null and empty texts, texts without a letter, and any text where there is no model: und, score 0.
    Ties go to the first language by name. Texts are scored whole, in stretches of bounded size; repeated
    rows repeat. The new columns replace any of their names. Empty input: no rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in as_names]

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                found, scores = [], []
                for text in b.column("text").to_pylist():
                    if shared.value is None or not has_letter(text):
                        found.append("und")
                        scores.append(0.0)
                        continue
                    langs, log_p = shared.value
                    total = score(text, log_p)
                    best = int(total.argmax())
                    found.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, *as_names])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{kinds}, `{as_names[0]}` string, `{as_names[1]}` double")


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on docs' labelled rows, then predict all of docs. Neither lang nor source nor doc_id is seen."""
    return predict(docs, fit(docs, rows))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text is null or has no letter; a missing lang is set to the prediction.

    All other columns stay as they were, whatever their names (lang_pred and score too). Where no labelled text
    teaches a model, lang stays as it is, null or not. Repeated rows repeat. Empty input: no rows."""
    model = fit(docs)
    if model is None:

        def lettered(batches):
            for b in batches:
                yield b.filter(pa.array([has_letter(t) for t in b.column("text").to_pylist()], pa.bool_()))

        return docs.mapInArrow(lettered, docs.schema)
    pred, score = "lang_pred", "score"
    while {pred, score} & set(docs.columns):
        pred, score = pred + "_", score + "_"
    found = predict(docs, model, (pred, score)).filter(F.col(pred) != "und")
    return found.select(*[F.coalesce("lang", pred).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; see predict for nulls, empty texts, ties and repeated
    rows. A null doc_id is not held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs)
    return predict(docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
