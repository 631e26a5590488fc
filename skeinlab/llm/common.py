"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WHITE = " \t\n\x0b\x0c\r"  # the characters of [\x20\x09-\x0D]
HOT = 1_000  # rows of a key that may meet in one task, where the table is small
BUCKET_BYTES = 32 << 20  # text of a bucket, up to MAX_BUCKETS buckets
MAX_BUCKETS = 100_000
SENT = 100_000  # the most keys that are sent to all tasks

_held: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """What this worker keeps between tasks under a name: one thing at a time, so that an operator's cache goes
    when the next operator's comes."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where it names none, a local session (tests) gets a temporary one and
    any other stops: a folder of one machine is no use to the others."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back; later reads can prune columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what was stored under a path of the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def in_parts(docs: DataFrame, part_bytes: int) -> tuple[DataFrame, Callable[[], None]]:
    """docs' doc_id and text with `part` (bigint), a number that rows of about part_bytes bytes of text together share,
    as a table in the shared folder, in buckets by part: grouping by part shuffles no text. A longer text is a
    part of its own. The second result drops the table."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def numbered(batches):
        now, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            parts = []
            for n in pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist():
                if size and size + n > part_bytes:
                    now, size = now + 1, 0
                size += n
                parts.append(now)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), b.column("doc_id"), b.column("text")], names=["part", "doc_id", "text"])

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1))
    return bucketed(docs.select("doc_id", "text").mapInArrow(numbered, f"part bigint, doc_id {kind}, text string"), "part", buckets, "parts")


def bucketed(rows: DataFrame, column: str, buckets: int, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """rows as a table in buckets by a column in the shared folder: what groups or joins by the column shuffles none of
    them. The second result drops the table."""
    spark = rows.sparkSession
    name, path = f"{name}_{uuid.uuid4().hex}", scratch(spark, name)
    rows.write.format("parquet").bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE {name}")
        remove(spark, path)

    return spark.table(name), drop


class Scratch:
    """Tables in the shared folder that a job drops again when it has read them."""

    def __init__(self):
        self.held: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, or all."""
        for df, path in [x for x in self.held if not tables or any(x[0] is t for t in tables)]:
            remove(df.sparkSession, path)
            self.held = [x for x in self.held if x[1] != path]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined to groups, which hold one row for each key and in `size` the number of rows that have it.

    Keys of more than max(HOT, total / SENT) rows are sent to all tasks, and their rows stay where they are:
    fewer than SENT keys can be so large, whatever the data. The others meet in the shuffle, at most that
    many rows of a key. total: at least the number of rows. Keys are not null."""
    limit = max(HOT, total // SENT)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_buckets(df: DataFrame, column: str, rows_each: int) -> list[int]:
    """Ascending split points of a bigint column, so that each range has about rows_each rows.

    At most 10,000 points come to the driver, whatever the input."""
    n = df.agg(F.count(column)).first()[0]
    parts = min(10_000, n // max(1, rows_each) + 1)
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    points = df.agg(F.percentile_approx(column, shares, 10 * parts)).first()[0]
    return sorted(set(points))


def bucket_of(column: Column, points: list[int]) -> Column:
    """Number of points that are <= the value: ascending ranges; null goes to range 0.

    A balanced tree of comparisons, so that a row takes log2(points) steps of generated code."""

    def step(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(points[mid]), step(mid + 1, hi)).otherwise(step(lo, mid))

    return step(0, len(points)).cast("int")
