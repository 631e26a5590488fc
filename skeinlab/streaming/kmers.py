"""K-mer counts of a growing set of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skeinlab.operators.kmers import crc_counts
from skeinlab.schemas import READS


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Reads that arrive as Parquet files in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def count_stream(reads: DataFrame, out: str, checkpoint: str, k: int = 21, dim: int = 16384, step: int = 4) -> StreamingQuery:
    """Counts (sample, mate, bin, n) so far, kept as state, one row for each bin (samples x mates x dim at most).
    Each batch's changed rows are appended to `out` with the batch's number; latest_counts() reads them."""

    def append(rows: DataFrame, batch: int) -> None:
        rows.selectExpr("*", f"{batch} AS batch").write.mode("append").parquet(out)

    counts = crc_counts(reads, k, dim, step)
    return counts.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last count of each bin; counts only grow, so a batch that was written twice changes nothing."""
    return spark.read.parquet(out).groupBy("sample", "mate", "bin").agg({"n": "max"}).withColumnRenamed("max(n)", "n")
