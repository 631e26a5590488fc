"""Small input tables: distance matrices, feature matrices, pools, run info."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def auto_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV with a header: commas unless tabs outnumber them in the first line. All columns are text."""
    head = spark.read.text(path).limit(1).first()
    line = head[0] if head else ""
    return spark.read.csv(path, sep="," if line.count(",") >= line.count("\t") else "\t", header=True)


def _long(wide: DataFrame, id_column: str | None, name: str, value: str) -> DataFrame:
    names = wide.columns
    key = id_column if id_column in names else names[0]
    others = [c for c in names if c != key]
    return wide.select(F.col(f"`{key}`").cast("string").alias("sample"), *[F.col(f"`{c}`").cast("string") for c in others]).unpivot("sample", [f"`{c}`" for c in others], name, value)


def distance_matrix(spark: SparkSession, path: str, coerce: bool = True) -> DataFrame:
    """(a, b, d), a < b, of a square CSV whose header and first column name the same samples; other tables are an
    error. With coerce what is no number is null; the diagonal is taken as 0. Cells are taken from the upper
    triangle by name."""
    wide = auto_table(spark, path)
    cells = _long(wide, None, "b", "d")
    rows = {r[0] for r in wide.select(F.col(f"`{wide.columns[0]}`").cast("string")).collect()}
    if rows != set(wide.columns[1:]) or len(rows) != len(wide.columns) - 1:
        raise ValueError("the distance matrix is not square, or its rows and columns differ")
    d = F.expr("try_cast(d AS double)") if coerce else F.col("d").cast("double")
    return cells.filter(F.col("sample") < F.col("b")).select(F.col("sample").alias("a"), "b", d.alias("d"))


def feature_matrix(spark: SparkSession, path: str, id_column: str = "sample_id") -> DataFrame:
    """(sample, bin, n) without zeros of a CSV, TSV or local .npz (X or matrix, ids or samples; no pickles)."""
    if not path.lower().endswith(".npz"):
        cells = _long(auto_table(spark, path), id_column, "bin", "n")
        return cells.select("sample", "bin", F.col("n").cast("double").alias("n")).filter("n <> 0")
    with np.load(path, allow_pickle=False) as data:
        x, ids = (next((data[k] for k in names if k in data.files), None) for names in (("X", "matrix"), ("ids", "samples")))
    if x is None or ids is None:
        raise ValueError("an .npz needs X (or matrix) and ids (or samples)")
    row, column = np.nonzero(x)
    cells = [(str(ids[i]), str(j), float(x[i, j])) for i, j in zip(row.tolist(), column.tolist(), strict=True)]
    return spark.createDataFrame(cells, "sample string, bin string, n double")


def pools_file(spark: SparkSession, path: str) -> list[str]:
    """The ids of a text file, one a line; blank lines and those that start with # are passed over."""
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")  # all white space, as ids come from pasted tables
    return [r[0] for r in spark.read.text(path).select(line.alias("id")).filter((F.col("id") != "") & ~F.col("id").startswith("#")).collect()]


def run_info(spark: SparkSession, path: str) -> DataFrame:
    """A run-info CSV; a column Run is required."""
    table = spark.read.csv(path, header=True)
    if "Run" not in table.columns:
        raise ValueError("run info has no column Run")
    return table.filter("Run IS NOT NULL")


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
