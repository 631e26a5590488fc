"""Writers of result tables. What the reference keeps as sheets of a workbook is one Parquet data set each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from skeinlab.operators.distance import to_square


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table as Parquet below the folder; paths by name."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header; arrays are joined by commas."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, sep=sep, header=True)


def write_distance_matrix(dist: DataFrame, samples: list[str], path: str, sep: str = "\t", digits: int = 8) -> None:
    """The square matrix with fixed decimals, one file."""
    square = to_square(dist, samples)
    write_csv(square.select("sample", *[F.format_string(f"%.{digits}f", F.col(f"`{s}`")).alias(s) for s in samples]).coalesce(1), path, sep)


def write_newick(tree: DataFrame, path: str) -> None:
    tree.select("newick").coalesce(1).write.mode("overwrite").text(path)


def write_npz(counts: DataFrame, path: str, dim: int) -> None:
    """Counts (sample, bin, n) as a dense local .npz (X, ids), for exchange with other tools; at most 2**28 cells."""
    rows = counts.groupBy("sample").agg(F.collect_list(F.struct("bin", "n")).alias("cells")).orderBy("sample")
    n = rows.count()
    if n * dim > 1 << 28:
        raise ValueError(f"{n} x {dim} cells are too many for a local file")
    x, ids = np.zeros((n, dim), dtype=np.uint32), []
    for i, r in enumerate(rows.toLocalIterator()):
        ids.append(r["sample"])
        for c in r["cells"]:
            x[i, c["bin"]] = c["n"]
    np.savez_compressed(path, X=x, ids=np.array(ids))
