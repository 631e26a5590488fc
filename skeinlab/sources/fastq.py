"""FASTQ files as reads: a Spark data source that reads byte ranges, and the discovery of files and their mates.

A plain file is cut into ranges of bytes, one to a task. A record belongs to the range that its first line starts
in, and the task reads on past the end of its range for the rest of a cut record, so that no row is shuffled. Which
line of a record a range begins with follows from the lines of the ranges before it: where a file has more than one
range, these are counted first (in parallel, a row for each range). A read of the first N of each file is one
task to a file, which stops at the Nth."""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# How each reader treats a record whose key part is empty, what it does with bytes that are no UTF-8, whether a
# limit of 0 means all, and whether .GZ in any case is packed. The names are those of the callers.
VARIANTS = {
    "preprocess": ("qual", "stop", "replace", False, False),
    "calibrate": ("seq", "stop", "ignore", False, True),
    "qc": ("seq", "skip", "replace", False, True),
    "matrix": ("seq", "skip", "ignore", True, True),
}
RECORD = "path string, read_idx bigint, seq string, qual string"
CHUNK = 1 << 22  # bytes read at once
BATCH = 4096  # records of a batch
_end = re.compile(rb"\r\n|\n|\r")


def opened(path: str) -> BinaryIO:
    """A seekable file of any store that Arrow reads by its URI; plain paths and file: are local."""
    if path.startswith("file:") or "://" not in path:
        return open(re.sub(r"^file:/*", "/", path), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def packed(path: str, variant: str) -> bool:
    return (path.lower() if VARIANTS[variant][4] else path).endswith(".gz")


def line_start(f: BinaryIO, at: int) -> int:
    """The first place from `at` on where a line starts, or the file's end."""
    if at <= 0:
        return 0
    f.seek(at - 1)
    place, data = at - 1, f.read(CHUNK)
    while data:
        if m := _end.search(data):
            if m[0] != b"\r" or m.end() < len(data):
                return place + m.end()
            return place + m.end() + (f.read(1) == b"\n")
        place, data = place + len(data), f.read(CHUNK)
    return place


def lines_of(f: BinaryIO, size: int | None = None) -> Iterator[list[bytes]]:
    """The next lines, chunk by chunk, of `size` bytes (None: to the end). Lines end at \\n, \\r\\n or \\r."""
    held = b""
    while data := f.read(CHUNK if size is None else min(CHUNK, size)):
        size = None if size is None else size - len(data)
        data = held + data
        if b"\r" in data:
            cut, data = (b"\r", data[:-1]) if data.endswith(b"\r") else (b"", data)  # its \n may be in the next chunk
            data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        else:
            cut = b""
        *lines, held = data.split(b"\n")
        held += cut
        if lines:
            yield lines
    if held:
        yield [held.removesuffix(b"\r")]


@dataclass
class Range(InputPartition):
    """Bytes lo to hi of a file (hi None: all); line and kept: lines, and records that are not empty, before it;
    stop: the record at which the file's reader stops."""

    path: str
    lo: int = 0
    hi: int | None = None
    line: int = 0
    kept: int = 0
    stop: int | None = None


class FastqReader(DataSourceReader):
    def __init__(self, ranges: list[Range], variant: str, limit: int | None):
        self.ranges, self.variant, self.limit = ranges, variant, limit

    def partitions(self) -> list[Range]:
        return self.ranges

    def _lines(self, part: Range) -> Iterator[list[bytes]]:
        """Lines from the part's first record on: those that start in it, then those after it."""
        with opened(part.path) as raw:
            if part.hi is None:
                with gzip.open(raw) if packed(part.path, self.variant) else raw as f:
                    yield from lines_of(f)
                return
            begin, end = line_start(raw, part.lo), line_start(raw, part.hi)
            raw.seek(begin)
            skip = -part.line % 4
            total = part.line
            for lines in lines_of(raw, end - begin):
                total += len(lines)
                if skip:
                    lines, skip = lines[skip:], max(0, skip - len(lines))
                yield lines
            missing = -total % 4
            if missing and not skip:  # the last record goes on behind the range
                for lines in lines_of(raw):
                    yield lines[:missing]
                    missing -= len(lines)
                    if missing <= 0:
                        return

    def records(self, part: Range) -> Iterator[tuple[int, str, str]]:
        """(read_idx, seq, qual) of a part, as the variant's reader gives them."""
        key, empty, errors, *_ = VARIANTS[self.variant]
        record, kept, held = -(-part.line // 4), part.kept, []
        text = lambda x: x.decode("utf-8", errors).strip()
        for last, lines in _with_last(self._lines(part)):
            lines = held + lines
            whole = len(lines) if last else len(lines) // 4 * 4
            held = lines[whole:]
            for i in range(0, whole, 4):
                if record == part.stop:
                    return
                seq = text(lines[i + 1]) if i + 1 < whole else ""
                qual = text(lines[i + 3]) if i + 3 < whole else ""
                if seq if key == "seq" else qual:
                    yield (record if empty == "stop" else kept), seq, qual
                    kept += 1
                    if self.limit is not None and kept >= self.limit:
                        return
                elif empty == "stop":
                    return
                record += 1

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str, str]] = []
        for row in self.records(part):
            rows.append(row)
            if len(rows) == BATCH:
                yield self._batch(part.path, rows)
                rows = []
        if rows:
            yield self._batch(part.path, rows)

    @staticmethod
    def _batch(path: str, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        number, seq, qual = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(number, pa.int64()), pa.array(seq, pa.string()), pa.array(qual, pa.string())], names=["path", "read_idx", "seq", "qual"])


def _with_last(chunks: Iterator[list[bytes]]) -> Iterator[tuple[bool, list[bytes]]]:
    """The chunks, then an empty one that is marked as the last."""
    for x in chunks:
        yield False, x
    yield True, []


class FastqSource(DataSource):
    """Format `fastq`. Options: path, or ranges (JSON, a list of Range fields); variant; max_reads."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> FastqReader:
        variant = self.options.get("variant", "preprocess")
        most = self.options.get("max_reads", self.options.get("maxreads"))
        ranges = self.options.get("ranges")
        found = [Range(*x) for x in json.loads(ranges)] if ranges else [Range(self.options["path"])]
        return FastqReader(found, variant, limit_of(variant, None if most in (None, "") else int(most)))


def limit_of(variant: str, max_reads: int | None) -> int | None:
    """What a reader makes of its limit: None is all; 0 is one read, but all in the matrix variant."""
    return None if max_reads is None or (VARIANTS[variant][3] and max_reads == 0) else max(1, max_reads)


def counted_ranges(spark: SparkSession, ranges: list[tuple[str, int, int]], variant: str) -> list[Range]:
    """The ranges (path, lo, hi) of files that have several, each with the lines and records before it.

    A task counts the lines of its range, and those of them that are blank by their place modulo 4, so that it need
    not know where its records begin; the driver gets nine numbers a range."""
    key, empty, errors, *_ = VARIANTS[variant]

    def count(batches):
        for b in batches:
            for path, lo, hi in zip(*(b.column(c).to_pylist() for c in ("path", "lo", "hi")), strict=True):
                n, blank, first = 0, [0] * 4, [-1] * 4
                with opened(path) as f:
                    begin, end = line_start(f, lo), line_start(f, hi)
                    f.seek(begin)
                    for lines in lines_of(f, end - begin):
                        for i, x in enumerate(lines, n):
                            if not x.strip() or (not x.isascii() and not x.decode("utf-8", errors).strip()):
                                blank[i % 4] += 1
                                first[i % 4] = i if first[i % 4] < 0 else first[i % 4]
                        n += len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([lo]), pa.array([hi]), pa.array([n]), pa.array([blank]), pa.array([first])], names=["path", "lo", "hi", "n", "blank", "first"])

    table = spark.createDataFrame(ranges, "path string, lo bigint, hi bigint").repartition(len(ranges))
    counts = table.mapInArrow(count, "path string, lo bigint, hi bigint, n bigint, blank array<bigint>, first array<bigint>").collect()
    place = 1 if key == "seq" else 3
    counts = sorted(counts)
    out: list[Range] = []
    stops: dict[str, int] = {}
    line = blanks = 0
    for i, r in enumerate(counts):
        if i == 0 or r.path != counts[i - 1].path:
            line = blanks = 0
        record = -(-line // 4)
        # the key line of a record that is cut at the start lies in this range or a later one, among the first four lines
        cut, j, before = 4 * (record - 1) + place, i, line
        late = 0
        while cut >= line and j < len(counts) and counts[j].path == r.path:
            if cut < before + counts[j].n:
                late = int(counts[j].first[cut - before] == cut - before)
                break
            before, j = before + counts[j].n, j + 1
        out.append(Range(r.path, r.lo, r.hi, line, record - blanks - late))
        at = (place - line) % 4
        if empty == "stop" and r.first[at] >= 0:
            stops.setdefault(r.path, (line + r.first[at]) // 4)
        blanks += r.blank[at]
        line += r.n
    for x in out:
        x.stop = stops.get(x.path)
    return [x for x in out if x.stop is None or -(-x.line // 4) < x.stop]


def read_fastq(spark: SparkSession, paths: list[str] | str, variant: str = "preprocess", max_reads: int | None = None) -> DataFrame:
    """path, read_idx, seq, qual of the records that a variant's reader gives, the first max_reads of each file
    (None: all; 0 gives one read, but all in the matrix variant). Header and plus lines are not looked at; seq and
    qual are stripped of white space; a record cut off by the end of the file has empty parts.

    Paths are files, folders or globs, listed by Spark; contents are read through Arrow's file systems. With a limit,
    and for packed files, a file is one task, else one for each spark.sql.files.maxPartitionBytes."""
    limit = limit_of(variant, max_reads)
    listed = spark.read.format("binaryFile").load(paths).select("path", "length").collect()  # a row for each file
    each = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    whole, cut = [], []
    for r in sorted(listed):
        if limit is not None or packed(r.path, variant) or r.length <= each:
            whole.append(Range(r.path))
        else:
            cut += [(r.path, lo, min(lo + each, r.length)) for lo in range(0, r.length, each)]
    ranges = whole + (counted_ranges(spark, cut, variant) if cut else [])
    if not ranges:
        return spark.createDataFrame([], RECORD)
    spark.dataSource.register(FastqSource)
    reader = spark.read.format("fastq").option("variant", variant).option("ranges", json.dumps([[x.path, x.lo, x.hi, x.line, x.kept, x.stop] for x in ranges]))
    return (reader if max_reads is None else reader.option("max_reads", max_reads)).load()


def sample_of(path_column) -> F.col:
    """Sample id of a file name: without .gz, .fastq or .fq in any case, and one of [._-][12] at the end."""
    name = F.element_at(F.split(path_column, "/"), -1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), r"(?i)\.(fastq|fq)$", ""), r"[._-][12]$", "")


def files(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """path, name, length of the FASTQ files of a folder (by a glob of names, if given); contents are not read."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = (source.option("pathGlobFilter", pattern) if pattern else source).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), "length").filter(F.lower("name").rlike(r"\.(fastq|fq)(\.gz)?$"))


def find_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest (sample, r1, r2, r1_bytes, r2_bytes, total_bytes) of <sample>_1.fastq[.gz] and their mates; .gz is
    preferred. No file, or one without mate, is an error."""
    rows = files(spark, folder).select("*", F.regexp_extract("name", r"^(.*)_([12])\.fastq(\.gz)?$", 1).alias("sample"), F.regexp_extract("name", r"^(.*)_([12])\.fastq(\.gz)?$", 2).alias("mate")).filter("mate <> ''")
    best = lambda m: F.max(F.when(F.col("mate") == m, F.struct(F.col("name").endswith(".gz").alias("gz"), "path", "length")))
    pairs = rows.groupBy("sample").agg(best("1").alias("a"), best("2").alias("b")).filter("a IS NOT NULL")
    if pairs.isEmpty():
        raise FileNotFoundError(f"no *_1.fastq(.gz) in {folder}")
    if lone := pairs.filter("b IS NULL").select("sample").take(5):
        raise FileNotFoundError(f"no mate 2 for {', '.join(r[0] for r in lone)}")
    size = [F.col("a.length"), F.col("b.length")]
    return pairs.select("sample", F.col("a.path").alias("r1"), F.col("b.path").alias("r2"), size[0].alias("r1_bytes"), size[1].alias("r2_bytes"), (size[0] + size[1]).alias("total_bytes"))


def discover_runs(spark: SparkSession, folder: str) -> DataFrame:
    """sample, mate, path of files named by a run accession and mate, in any case; mates may lack, .gz is preferred."""
    pattern = r"^(?i)(SRR\d+)_([12])\.fastq(\.gz)?$"
    rows = files(spark, folder).select("path", "name", F.upper(F.regexp_extract("name", pattern, 1)).alias("sample"), F.regexp_extract("name", pattern, 2).alias("mate")).filter("mate <> ''")
    return rows.groupBy("sample", F.col("mate").cast("int").alias("mate")).agg(F.max_by("path", F.struct(F.lower("name").endswith(".gz"), "path")).alias("path"))


def paired_reads(spark: SparkSession, manifest: DataFrame, max_reads: int | None = None, variant: str = "preprocess") -> DataFrame:
    """sample, mate, read_idx, seq, qual of a manifest's files. The manifest (a row for each sample) is collected,
    as the reader needs its paths."""
    rows = manifest.select("sample", "r1", "r2").collect()
    names = spark.createDataFrame([(p, r.sample, m) for r in rows for m, p in ((1, r.r1), (2, r.r2))], "p string, sample string, mate int")
    reads = read_fastq(spark, [p for r in rows for p in (r.r1, r.r2)], variant, max_reads)
    plain = lambda c: F.regexp_replace(F.col(c), r"^file:/+", "/")
    return reads.join(names, plain("path") == plain("p")).select("sample", "mate", "read_idx", "seq", "qual")
