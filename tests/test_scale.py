"""Reads, k-mer counts and read QC: one pass over the texts, tasks that pass on sums only, the same results."""

import zlib
from collections import Counter

import pyarrow as pa
import pytest

from skeinlab.functions import sequence as S
from skeinlab.operators import kmers, qc
from skeinlab.plans import views as V

COLUMNS = "sample string, mate int, seq string, qual string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with one long text, letters beyond ASCII, empty and null texts, null sources and a null id."""
    path = tmp_path_factory.mktemp("docs")
    long = "The quick brown Fox. Jumps over\tthe lazy dog! " * 2000
    rows = [(1, long, "a"), (2, "Été İK Ab.c 123", "a"), (3, "", "a"), (4, None, "a"), (5, "abc", None), (None, "zZ.", "b"), (7, "12 34", "b"), (8, "x" * 100, "b"), (9, "y" * 101, "b")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_reads_are_cut_in_one_pass(spark, folder):
    path, rows = folder
    want = []
    for i, text, source in rows:
        s = "".join(V.BASES[V.LETTERS.index(c.lower())] for c in text or "" if c.isascii() and c.lower() in V.LETTERS)
        if source:
            want += [(source, None if i is None else 1 + i % 2, i, j // 100, s[j : j + 100]) for j in range(0, len(s), 100)]
    found = V.reads_with_quality(spark, path)
    got = found.collect()
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    assert all([ord(c) - 33 for c in r.qual] == [(7 * ord(c) + i) % 41 for i, c in enumerate(r.seq)] for r in got)
    assert {tuple(r) for r in V.reads(spark, path).collect()} == set(want)
    assert "Generate" not in plan(V.reads(spark, path)) and plan(found).count("MapInArrow") == 1


def test_hints_read_once(spark, folder):
    """report_hints took four passes over the reads."""
    assert plan(qc.hints(V.reads(spark, folder[0]))).count("MapInArrow") == 1
    rows = [("s", 1, "AC" + S.ADAPTERS[0], ""), ("s", 1, "ACGG", ""), ("s", 1, "T" + "G" * 12, ""), ("s", 1, None, ""), (None, 1, "A", ""), ("t", 1, "A", "")]
    got = {r.sample: r for r in qc.hints(spark.createDataFrame(rows, COLUMNS), 2).collect()}
    assert set(got) == {"s", "t"}
    assert (got["s"].top_prefix_pct, got["s"].top_adapter_pct, got["s"].poly_g_pct, got["s"].unique_lengths) == (50.0, 25.0, 25.0, 4)
    assert (got["t"].unique_lengths, got["t"].lengths_vary, got["t"].adapters_left, got["t"].prefix_dominates) == (1, False, False, True)


def test_end_kmers_take_the_ends_of_reads(spark, folder):
    """F16: end_kmers put whole reads in upper case, twice, made an array of each, and missed ends after a letter that
    becomes two."""
    made = plan(qc.end_kmers(V.reads(spark, folder[0]), 4))
    assert "Generate" not in made and made.count("MapInArrow") == 1
    texts = ["acgTN", "ßacgt", "acgtß", "aßß", "ACG", "ACGTACGA", "ACGTTTGA", "", "ŉACGT\U0001f600", None]
    rows = [("s" if i % 3 else None, 1, x, "") for i, x in enumerate(texts)]
    for k in (1, 3, 4, 6):
        want, total = Counter(), Counter()
        for sample, _, seq, _ in rows:
            if seq is not None and len(seq) >= k:
                want.update([(sample, 5, seq.upper()[:k]), (sample, 3, seq.upper()[-k:])])
                total[sample] += 1
        got = qc.end_kmers(spark.createDataFrame(rows, COLUMNS), k, 100).collect()
        assert {r[:3]: (r.n, r.pct) for r in got} == {x: (n, pytest.approx(100 * n / total[x[0]])) for x, n in want.items()}


def test_kmers_are_counted_in_the_tasks(spark):
    """F3, F4, F6, F8, F11 to F15, F17: a row for each k-mer went through the plan, or one for each bin of a batch."""
    texts = ["ACGTNACGTTGCA", "acg", "", "AC", "Éa\u20acGTNCAß\U0001f600GT", "NNNNN", "ACGTACGT"]
    rows = [("s" if i % 2 else "t", 1 + i % 2, x, "") for i, x in enumerate(texts)] + [("s", None, "ACGTA", ""), (None, 1, "ACGTA", ""), ("s", 1, None, "")]
    reads = spark.createDataFrame(rows, COLUMNS)
    for k, step, dim in ((3, 1, 64), (3, 4, 1000), (5, 2, 7)):
        want, whole = Counter(), Counter()
        for sample, mate, seq, _ in rows:
            s = (seq or "").upper()
            for w in (s[i : i + k] for i in range(0, len(s) - k + 1, step)):
                want[sample, mate, zlib.crc32(w.encode()) % dim] += "N" not in w
                whole[sample, zlib.crc32(w.encode()) % dim] += "N" not in s
        got = kmers.crc_counts(reads, k, dim, step)
        assert {r[:3]: r.n for r in got.collect()} == dict(+want) and "Generate" not in plan(got)
        assert {r[:2]: r.n for r in kmers.crc_counts(reads, k, dim, step, "read", ("sample",)).collect()} == dict(+whole)
    many = spark.range(30000).selectExpr("'s' AS sample", "substring(repeat('ACGTTGCATG', 5), CAST(1 + id % 10 AS INT), 40) AS seq").coalesce(1)
    sent = kmers.hashed_counts(many, 5, 64)
    found = Counter(b for i in range(10) for b in S.hashed_bins(("ACGTTGCATG" * 5)[i : i + 40].encode(), 5, 64).tolist())
    assert {r.bin: r.n for r in sent.collect()} == {b: 3000 * n for b, n in found.items()}


def test_held_counts_are_bounded(spark, monkeypatch):
    """Keys beyond CELLS are passed on batch by batch and come to the same sums."""
    reads = spark.createDataFrame([(f"s{i % 7}", "ACGTTGCAAC" * 3) for i in range(70)], "sample string, seq string")
    want = {tuple(r) for r in kmers.hashed_counts(reads, 4, 128).collect()}
    monkeypatch.setattr(kmers, "CELLS", 300)
    rows = kmers._counted(reads, ("sample",), 128, lambda t: S.hashed_bins(b"\n".join(t), 4, 128).astype(np.int64))
    assert {tuple(r) for r in rows.collect()} == want


def test_sums_leave_a_task_not_a_batch(spark):
    """F2, F7, F9, F10: sums left every batch, and a batch's scores were held whole."""
    rows = [(f"s{i % 3}", 1 + i % 2, "ACGTN"[: 1 + i % 5] * 9, "!I~5 \t?éx" * 5) for i in range(400)] + [("s0", 1, None, "II"), ("s1", 2, "AC", None), ("t", 1, "", "")]
    reads = spark.createDataFrame(rows, COLUMNS)
    n, total, lengths = Counter(), Counter(), Counter()
    for sample, mate, seq, qual in rows:
        q = [(ord(c) - 33) % 256 for c in qual or "" if ord(c) < 128][: len(seq or "")]
        for i, x in enumerate(q):
            n[sample, mate, i] += 1
            total[sample, mate, i] += x
        lengths[sample, mate] += len(seq or "")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = qc.qc_positions(reads)
        assert {r[:3]: (r.n, r.mean_q) for r in found.collect()} == {k: (n[k], pytest.approx(total[k] / n[k])) for k in n}
        got = {r[:2]: r for r in qc.qc_reads(reads).collect()}
        assert {k: r.bases_used for k, r in got.items()} == dict(lengths) and sum(r.reads_used for r in got.values()) == len(rows)
        for k, r in got.items():
            counted = [p for p in n if p[:2] == k]
            assert (r.mean_phred is None and not counted) or r.mean_phred == pytest.approx(sum(total[p] for p in counted) / sum(n[p] for p in counted))
        sent = reads.coalesce(1)
        keys = len({r[:2] for r in rows})
        for df, most in ((qc.qc_reads(sent), keys), (qc.qc_positions(sent), len(n)), (kmers.crc_counts(sent, 3, 16, 1), 16 * keys)):
            assert 0 < partial_rows(df) <= most
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def partial_rows(df) -> int:
    """Rows that the tasks pass to the plan's last aggregate."""
    node = df._jdf.queryExecution().analyzed()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    session = df.sparkSession
    return session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, node).count()


def test_pieces_hold_few_bases(monkeypatch):
    monkeypatch.setattr(qc, "BASES", 100)
    size = [30] * 10 + [0] * 5 + [1000, 1, 250, 99]
    batch = pa.RecordBatch.from_pydict({"len": pa.array(size, pa.int64())})
    pieces = [p.column("len").to_pylist() for p in qc._pieces([batch, batch.slice(0, 0)])]
    assert sum(pieces, []) == size and all(sum(p) - max(p) <= 100 for p in pieces)


def test_sweep_stores_what_its_cells_read(spark, monkeypatch):
    """run_sweep sorted and stored all reads for cells that hold 200 of a sample at most."""
    from skeinlab.operators import graph
    from skeinlab.plans import graph_queries, pipelines

    kept = []
    monkeypatch.setattr(graph, "cut", lambda df: kept.append(df) or df)
    monkeypatch.setattr(pipelines, "sweep", lambda *a, **b: {"run_metrics_raw": None})
    graph_queries.run_sweep(spark, "/root/testdata/sf0.01")
    whole = V.reads(spark, "/root/testdata/sf0.01").groupBy("sample").count().collect()
    got = kept[0].groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in got} == {r["sample"]: min(r["count"], 200) for r in whole}
