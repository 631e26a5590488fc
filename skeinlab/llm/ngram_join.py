"""N-gram Jaccard join: chosen paths find candidate groups, exact counting inside them finds the links.

Documents are sets of hashed shingles of five lower-case words. In each run a node of the path tree picks,
by its own hash, one or two of a document's 64 sampled shingles (1 / 0.8 on average), and documents that
share the picked shingle go to the same child. Small children, and all at the last depth, are searched by
brute force on the samples, in blocks. Runs repeat until a pair at the threshold is missed with a chance of
1 - RECALL. What is joined to a candidate group is then compared exactly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skeinlab.llm import common
from skeinlab.llm.components import components

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5  # the threshold 0.8 as a fraction, for exact comparison
THRESHOLD = NUMERATOR / DENOMINATOR
SAMPLES = 64  # sampled shingles of a document
DEPTH = 4  # of the path tree
SMALL = 512  # the largest bucket that is not split further
BLOCK = 1024  # documents of a block in the brute-force searches
RECALL = 0.999
SIGMAS = 4  # how far below the threshold the estimate of a candidate may lie
WORD_CACHE = 100_000  # words that a worker remembers, about 20 MB
LONGEST = 64  # characters of a word that is remembered

_seeds = np.random.default_rng(20_240_501)
_MUL = _seeds.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeds.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pair_missed(runs: int, depth: int = DEPTH) -> float:
    """Chance that a pair at the threshold is never together in a bucket of the last level, or fails the screen.

    All runs share the samples: given that k of them agree, runs are independent, each with its own chance to keep
    the pair together level by level (one pick, and a second with chance 1 / THRESHOLD - 1); k is binomial."""
    two = 1 / THRESHOLD - 1
    least = likely_least()
    total = 0.0
    for k in range(SAMPLES + 1):
        miss = 0.0
        for _ in range(depth):
            lost = 1 - k / SAMPLES * (1 - miss)
            miss = (1 - two) * lost + two * lost * lost
        total += math.comb(SAMPLES, k) * THRESHOLD**k * (1 - THRESHOLD) ** (SAMPLES - k) * (miss**runs if k >= least else 1.0)
    return total


def runs_needed(recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold is found with chance `recall`, whatever the depth of its leaf."""
    runs = 1
    while pair_missed(runs) > 1 - recall:
        runs += 1
    return runs


def likely_least() -> int:
    """Samples that a candidate pair must share: SIGMAS standard deviations below the threshold."""
    return math.floor(SAMPLES * (THRESHOLD - SIGMAS * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SAMPLES)))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class WordHashes(dict):
    """64-bit hashes by word. Words met early are the frequent ones: when it is full, the later half goes."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST:
            if len(self) >= WORD_CACHE:
                for late in list(self)[WORD_CACHE // 2 :]:
                    del self[late]
            self[word] = h
        return h


def shingles(words: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; fewer words are one shingle."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = common.worker_cache("word hashes", WordHashes)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def samples(shingle: np.ndarray) -> np.ndarray:
    """For each of 64 hash functions the least value over the set, as 32 bits."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingle), 4096):
        np.minimum(least, (shingle[at : at + 4096, None] * _MUL + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _hash(a: np.ndarray, b) -> np.ndarray:
    x = (a.astype(np.uint64) ^ (np.atleast_1d(b).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def children(nodes: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of the children that rows with these nodes and samples go to."""
    rows = np.arange(len(nodes))
    at, out = [], []
    for c in range(2):
        pick = _hash(nodes, c)
        go = rows if c == 0 else rows[(_hash(nodes, 7) % np.uint64(1000)) < np.uint64(round(1000 * (1 / THRESHOLD - 1)))]
        i = (pick % np.uint64(SAMPLES)).astype(np.int64)[go]
        at.append(go)
        out.append(_hash(_hash(nodes[go], i + 16), sample[go, i]))
    return np.concatenate(at), np.concatenate(out)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (a 64-bit hash of the words in order), n_shingles, sample of every row, stored."""

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                node, n, sample = [], [], []
                for text in b.column("text").to_pylist():
                    words = words_of(text)
                    s = shingles(words)
                    node.append(xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63))
                    n.append(len(s))
                    sample.append(samples(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sample, pa.binary())], names=["doc_id", "text_key", "node", "n_shingles", "sample"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return common.stored(rows.mapInArrow(run, "doc_id bigint, text_key bigint, node bigint, n_shingles bigint, sample binary"), "shingled")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), SAMPLES)


def path_buckets(texts: DataFrame, runs: int) -> DataFrame:
    """(bucket, n, node): the leaves of the path trees that hold two texts or more."""

    def first(batches):
        roots = _hash(np.arange(runs, dtype=np.uint64), 3)
        for b in batches:
            node, sample = b.column("node").to_numpy(), _matrix(b.column("sample"))
            for root in roots:
                at, child = children(np.full(len(node), root), sample)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[at])], names=["bucket", "node"])

    def deeper(batches):
        for b in batches:
            node = b.column("node").to_numpy()
            at, child = children(b.column("bucket").to_numpy().view(np.uint64), _matrix(b.column("sample")))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[at])], names=["bucket", "node"])

    kind, leaves = "bucket bigint, node bigint", []
    level = texts.select("node", "sample").mapInArrow(first, kind)
    for depth in range(1, DEPTH + 1):
        level = common.stored(level, "paths")
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = common.stored(common.join_groups(level, sizes, ["bucket"], "n", level.count()).select("bucket", "n", "node"), "sized")
        leaves.append(sized if depth == DEPTH else sized.filter(F.col("n") <= SMALL))
        wide = sized.filter(F.col("n") > SMALL)
        if depth == DEPTH or wide.isEmpty():
            break
        level = wide.join(texts.select("node", "sample"), "node").select("bucket", "node", "sample").mapInArrow(deeper, kind)
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def in_blocks(rows: DataFrame, group: str, payload: str) -> DataFrame:
    """rows (group, n, node, payload) dealt out so that each pair of a group's members meets exactly once:
    members fall into ceil(n / BLOCK) blocks by hash and a row goes to its block's pairs. A key holds two
    blocks, whatever the group's size. Columns: key, whole (one block alone), side, node, payload."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), parts)
    return (
        rows.withColumn("mine", mine.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(
            F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
            (F.col("mine") == F.col("other")).alias("whole"),
            (F.col("mine") > F.col("other")).alias("side"),
            "node",
            F.col(payload).alias("payload"),
        )
    )


def by_key(blocks: DataFrame, kernel: Callable, kind: str) -> DataFrame:
    """kernel(whole, side, node, payloads) -> iterable of column lists, for the rows of each key."""
    names = [x.split()[0] for x in kind.split(", ")]

    def groups(batches) -> Iterator[tuple]:
        held: list[tuple] = []
        now = None
        for b in batches:
            key = b.column("key").to_numpy()
            if not len(key):
                continue
            rest = b.column("whole").to_numpy(zero_copy_only=False), b.column("side").to_numpy(zero_copy_only=False), b.column("node").to_numpy(), b.column("payload").to_pylist()
            starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(starts, starts[1:], strict=False):
                if held and key[i] != now:
                    yield join(held)
                    held = []
                now = key[i]
                held.append(tuple(x[i:j] for x in rest))
        if held:
            yield join(held)

    def join(held: list[tuple]) -> tuple:
        if len(held) == 1:
            return held[0]
        whole, side, node, payload = zip(*held, strict=True)
        return np.concatenate(whole), np.concatenate(side), np.concatenate(node), [x for p in payload for x in p]

    def run(batches):
        out: list[list] = []
        for whole, side, node, payload in groups(batches):
            one = np.unique(node, return_index=True)[1]  # repeated rows count once
            if len(one) > 1:
                out += kernel(bool(whole[0]), side[one], node[one], [payload[i] for i in one])
            if len(out) > 4096:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    def pack(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(x[c], dtype=np.int64) for x in out])) for c in range(len(names))], names=names)

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, kind)


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs in the boolean matrix (left x right members)."""
    edges, free = [], np.ones(linked.shape[1], dtype=bool)
    seen = np.zeros(linked.shape[0], dtype=bool)
    columns = linked.T
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen[start]:
            continue
        seen[start] = True
        root, queue = left[start], [start]
        while queue:
            new = np.flatnonzero(linked[queue.pop()] & free)
            free[new] = False
            edges += [(root, right[j]) for j in new]
            for j in new:
                more = np.flatnonzero(columns[j] & ~seen)
                seen[more] = True
                edges += [(root, left[i]) for i in more]
                queue += more.tolist()
    return edges


def _likely(whole: bool, side: np.ndarray, node: np.ndarray, payload: list[bytes]) -> list[list]:
    """Forest of the pairs whose samples agree often enough."""
    least = likely_least()
    sample = np.frombuffer(b"".join(payload), dtype=np.uint32).reshape(len(payload), SAMPLES)
    a, b = (slice(None), slice(None)) if whole else (~side, side)
    left, right = np.ascontiguousarray(sample[a].T), np.ascontiguousarray(sample[b].T)
    if not left.shape[1] or not right.shape[1]:
        return []
    same = np.zeros((left.shape[1], right.shape[1]), dtype=np.uint8)
    for x, y in zip(left, right, strict=True):
        same += x[:, None] == y[None, :]
    linked = same >= least
    if whole:
        np.fill_diagonal(linked, False)
    edges = forest(linked, node[a], node[b])
    return [list(zip(*edges, strict=True))] if edges else []


def _exact(whole: bool, side: np.ndarray, node: np.ndarray, payload: list[bytes]) -> list[list]:
    """(a, b, n): for each node its number of links here as (a, a, n), and a forest of links as (a, b, 0)."""
    sets = [np.frombuffer(p, dtype=np.uint64) for p in payload]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = shared[place]
    row, column = row[keep], rank[place[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = (np.arange(len(sets)), np.arange(len(sets))) if whole else (np.flatnonzero(~side), np.flatnonzero(side))
    if not len(a) or not len(b):
        return []
    both = np.zeros((len(a), len(b)), dtype=np.int64)
    width = max(256, (1 << 22) // len(sets))
    for at in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[row[i:j], column[i:j] - at] = 1
        both += (x[a] @ x[b].T).astype(np.int64)
    linked = (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (size[a][:, None] + size[b][None, :])
    if whole:
        np.fill_diagonal(linked, False)
    out = []
    for members, links in ((a, linked.sum(axis=1)),) if whole else ((a, linked.sum(axis=1)), (b, linked.sum(axis=0))):
        some = links > 0
        if some.any():
            out.append([node[members[some]], node[members[some]], links[some]])
    edges = forest(linked, node[a], node[b])
    if edges:
        x, y = zip(*edges, strict=True)
        out.append([x, y, [0] * len(x)])
    return out


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_id, n_links.

    copy_id: least doc_id with the same words in the same order (case and white space apart). n_links:
    number of different such texts with a Jaccard similarity of 0.8 or more. class_id: least doc_id of
    the connected component of those links. Null, empty and white texts have no words: they are copies of
    each other and have no links; a text of one to four words is one shingle. Repeated rows repeat; a
    doc_id with several texts belongs to each text's class. Only doc_id and text are read.

    Null doc_ids come last: an id is null where no row of the class or of the copies has one. Samples are 256
    bytes a document; copies are one node, so they are never paired. Buckets and groups of any size are searched
    in blocks; what leaves a task is counts and spanning forests, not pairs. Empty input: no rows."""
    known = prepared(docs)
    total = known.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("rep")  # the row that stands for a text
    texts = common.stored(known.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.max("sample").alias("sample")), "texts")
    sampled = texts.filter("sample IS NOT NULL")
    leaves = path_buckets(sampled, runs_needed())
    searched = leaves.join(sampled.select("node", "sample"), "node")
    likely = by_key(in_blocks(searched, "bucket", "sample"), _likely, "a bigint, b bigint").distinct()
    groups = components(likely)
    sized = groups.join(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").join(texts.select("node", "rep"), "node")
    found = common.stored(by_key(in_blocks(_sets(docs, sized), "label", "payload"), _exact, "a bigint, b bigint, n bigint"), "links")
    links = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    classes = components(found.filter("a <> b").select("a", "b"))
    named = texts.select("node", "rep", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    answers = named.join(least, "label").select("node", "copies", "label", F.col("least")["doc_id"].alias("class_id"), F.col("rep")["doc_id"].alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = common.join_groups(known.select("doc_id", "text_key", "node"), common.stored(answers, "answers"), ["node"], "copies", total)
    return rows.select("doc_id", "class_id", "copy_id", "n_links", "label", "text_key")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, n, node, payload): the shingles of one document for each wanted node."""

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                keep, payload = [], []
                for i, (text, node) in enumerate(zip(b.column("text").to_pylist(), b.column("node").to_pylist(), strict=True)):
                    words = words_of(text)
                    if xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63) == node:
                        keep.append(i)
                        payload.append(shingles(words).tobytes())
                rows = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("n"), rows.column("node"), pa.array(payload, pa.binary())], names=["label", "n", "node", "payload"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    one = F.col("doc_id").eqNullSafe(F.col("rep")["doc_id"]) & (F.col("text_key") == F.col("rep")["text_key"])
    return texts.join(wanted, one).select("label", "n", "node", "text").mapInArrow(run, "label bigint, n bigint, node bigint, payload binary")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the row with the class's id, of such rows the first by hash.

    All columns stay as they were, whatever their names. Nulls, empty texts, repeated rows and ties as in
    near_classes (texts without words are one class); of rows that agree in doc_id and text the first by a hash
    of the row stays. Empty input: no rows."""
    first = near_classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("tk"))
    kept = keyed.join(first, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("tk") == F.col("text_key")))
    turn = F.row_number().over(Window.partitionBy("id", "tk").orderBy(F.xxhash64("row")))
    return kept.withColumn("turn", turn).filter("turn = 1").select("row.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, copy_id, n_links of every document; see near_classes for nulls, empty texts, ties, repeated
    rows and empty tables. Further columns are not read."""
    return near_classes(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "copy_id", "n_links")
