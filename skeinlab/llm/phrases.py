"""Substring dedup by repeated-phrase automata.

A window is a run of WINDOW words. The table is cut into parts of bounded size, stored in buckets by part, so
that no later pass shuffles a text. Three passes over the parts: (1) every window is named by the least hash of
its GRAM-word grams, and grams that are named at two places or more recur; (2) windows named by recurring
grams are counted, and those with two starts or more are confirmed; (3) the confirmed passages of a part are compiled
into Aho-Corasick automata (shards of bounded vocabulary), through which all documents of the part stream: each
hit of a phrase locates windows, which are checked against the confirmed ones, and their words go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skeinlab.llm import common

WINDOW = 35
GRAM = 16  # words of a gram: less than half of a window
PART_BYTES = 8 << 20  # text of a part; one longer document is a part of its own
SHARD_WORDS = 500_000  # words of the passages of one automaton
DIGITS = 5  # of 4 bits, in which the automaton is given a word: at most 2^20 distinct ones, more than SHARD_WORDS
BLOCK = 1 << 20  # bytes or words that are hashed at once

_white = np.zeros(256, dtype=bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_base = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))]) for b in (_base, pow(_base, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of x, whose ends ascend; equal stretches have equal hashes."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = int(ends[stop - 1])
        up, down = _powers.to(hi - lo + 1)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x[lo:hi].astype(np.uint64) * up[: hi - lo])])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = stop
    return mixed(out)


def slide(best, x: np.ndarray, width: int) -> np.ndarray:
    """best (np.minimum, np.maximum) over each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    more = width - span
    return best(x[:-more], x[more:]) if more else x


class Part:
    """Words and windows of some texts. firsts[i] is the number of words before text i."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, window: int = WINDOW, gram: int = GRAM):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        self.texts = pc.fill_null(texts, "").cast(pa.large_binary())
        self.window, self.gram = window, gram
        n = len(self.texts)
        at = np.frombuffer(self.texts.buffers()[1], np.int64)[self.texts.offset : self.texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = self.texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        word = ~_white[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[at] = True
        gap = np.concatenate([[True], ~word, [True]])
        starts = np.flatnonzero(word & (gap[:-2] | edge[:-1]))
        ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
        self.firsts = np.searchsorted(starts, at)
        self.words = runs(raw + np.uint8(1), starts, ends)
        self.count = np.diff(self.firsts)
        self.n = max(0, len(self.words) - window + 1)  # starts of windows, the invalid ones too
        inside = np.repeat(self.firsts[1:], self.count)[: self.n] - np.arange(self.n)
        self.valid = inside >= window  # the window ends in its own text

    def _grams(self, size: int) -> np.ndarray:
        starts = np.arange(max(0, len(self.words) - size + 1))
        return runs(self.words, starts, starts + size)

    def windows(self) -> np.ndarray:
        return self._grams(self.window)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """The name of each window, and the names at each of the places where the gram that names some window starts."""
        if not self.n:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        grams, width = self._grams(self.gram), self.window - self.gram + 1
        least = slide(np.minimum, grams, width)
        edge = np.zeros(width - 1, dtype=np.uint64)
        reach = slide(np.maximum, np.concatenate([edge, np.where(self.valid, least, np.uint64(0)), edge]), width)
        return least, grams[reach == grams]


def _counted(part: int, keys: list[np.ndarray], names: list[str]) -> pa.Table:
    """Distinct rows of keys with their counts."""
    rows = np.rec.fromarrays(keys)
    one, n = np.unique(rows, return_counts=True)
    columns = [pa.array(one[c].astype(np.int64)) for c in one.dtype.names]
    return pa.Table.from_arrays([pa.array(np.full(len(one), part)), *columns, pa.array(n)], names=["part", *names, "n"])


def _part(table: pa.Table) -> int:
    return table.column("part")[0].as_py()


def _among(x: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes x that are among some, an ascending array, and their numbers in it. A table of the first
    22 bits leaves few for the search."""
    first = np.zeros(1 << 22, dtype=bool)
    first[some >> np.uint64(42)] = True
    maybe = np.flatnonzero(first[x >> np.uint64(42)])
    at = np.searchsorted(some, x[maybe])
    sure = np.flatnonzero(some[np.minimum(at, len(some) - 1)] == x[maybe]) if len(some) else maybe
    return maybe[sure], at[sure]


def _within(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)
    out[_among(x, some)[0]] = True
    return out


def _known(column: pa.ChunkedArray) -> np.ndarray:
    return np.sort(column.to_numpy().astype(np.int64).view(np.uint64))


def named_grams(docs: pa.Table) -> pa.Table:
    return _counted(_part(docs), [Part(docs.column("text")).names()[1]], ["name"])


def named_windows(docs: pa.Table, recurring: pa.Table) -> pa.Table:
    """The windows whose names recur, with the number of their starts in this part."""
    if not docs.num_rows or not recurring.num_rows:
        return pa.table({"part": pa.array([], pa.int64()), "name": pa.array([], pa.int64()), "hash": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    part = Part(docs.column("text"))
    name, hashes = part.names()[0], part.windows()
    use = part.valid & _within(name, _known(recurring.column("name")))
    return _counted(_part(docs), [name[use], hashes[use]], ["name", "hash"])


def passages(hashes: np.ndarray, confirmed: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Stretches of words made of the first starts of all confirmed windows that follow one another."""
    at = np.flatnonzero(confirmed)
    firsts = np.sort(at[np.unique(hashes[at], return_index=True)[1]])
    breaks = np.flatnonzero(np.diff(firsts) != 1) + 1
    for run in np.split(firsts, breaks):
        if len(run):
            yield int(run[0]), int(run[-1]) + window


def shards(found: Iterator[tuple[int, int]], most: int, window: int) -> Iterator[list[tuple[int, int]]]:
    """The passages in lists of `most` words together; a longer passage is cut, with window - 1 words in both pieces."""
    held, size = [], 0
    for lo, hi in found:
        for a in range(lo, hi - window + 1, most - window + 1):
            b = min(hi, a + most)
            if held and size + b - a > most:
                yield held
                held, size = [], 0
            held.append((a, b))
            size += b - a
    if held:
        yield held


def located(words: np.ndarray, found: list[tuple[int, int]], window: int) -> np.ndarray:
    """Starts of the windows that hold a phrase of the passages, by an automaton over the words.

    Phrases are the whole blocks of (window + 1) / 2 words that follow one another in a passage: each window of it
    holds one. A word of the passages is its number in DIGITS digits, each with an alphabet of its own, so that nodes
    have few children and phrases match whole words only; any other word is one sign that no phrase has."""
    import ahocorasick

    size = (window + 1) // 2
    where, code = _among(words, np.unique(np.concatenate([words[a:b] for a, b in found])))
    width = np.ones(len(words) + 1, dtype=np.int64)
    width[where + 1] = DIGITS
    width[0] = 0
    places = np.cumsum(width)
    signs = np.zeros(places[-1], dtype=np.uint8)
    for k in range(DIGITS):
        signs[places[where] + k] = ((code >> 4 * k) & 15) + 16 * k + 1
    line = signs.tobytes().decode("latin-1")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for a, b in found:
        for at in range(a, b - size + 1, size):
            automaton.add_word(line[places[at] : places[at + size]])
    automaton.make_automaton()
    ends = np.fromiter((end for end, _ in automaton.iter(line)), dtype=np.int64)
    return covered(np.searchsorted(places, ends + 1) - size - (window - size), window - size + 1, len(words))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a stretch of this length from one of the starts."""
    step = np.zeros(n + length + 1, dtype=np.int64)
    np.add.at(step, np.maximum(starts, 0), 1)
    np.add.at(step, np.minimum(starts + length, n + length), -1)
    return np.cumsum(step)[:n] > 0


def without_repeats(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
    """doc_id, n_words, n_removed and kept_sha256 of the texts of a part."""
    if not docs.num_rows:
        return docs.select(["doc_id"]).append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("kept_sha256", pa.array([], pa.string()))
    part = Part(docs.column("text"))
    gone = np.zeros(len(part.words), dtype=bool)
    if confirmed.num_rows and part.n:
        hashes = part.windows()
        sure = part.valid & _within(hashes, _known(confirmed.column("hash")))
        hit = np.zeros(len(part.words), dtype=bool)
        for some in shards(passages(hashes, sure, part.window), SHARD_WORDS, part.window):
            hit |= located(part.words, some, part.window)
        gone = covered(np.flatnonzero(hit[: part.n] & sure), part.window, len(part.words))
    removed = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), part.firsts[:-1]) * (part.count > 0)
    digests = []
    for text, first, n, m in zip(part.texts.to_pylist(), part.firsts.tolist(), part.count.tolist(), removed.tolist(), strict=False):
        words = text.split() if m < n else []
        if m and words:
            words = compress(words, ~gone[first : first + n])
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(part.count.astype(np.int64)), "n_removed": pa.array(removed), "kept_sha256": pa.array(digests)})


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text): the words that some window of
    WINDOW words covers whose words also start elsewhere in the table go.

    Null, empty and white texts have no words; texts of fewer words than a window keep all. Repeated rows are
    documents of their own and lose all that they share; null and equal ids do no harm, further columns are
    not read. Empty input: no rows. Windows are equal when their 64-bit hashes and the 64-bit hashes of the grams that
    name them are. Texts are not shuffled; of windows only those whose name recurs are, once for each part that
    has them, and a very frequent one has a row for each part at most."""
    table, drop = common.in_parts(docs, PART_BYTES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    grams = table.select("part", "text").groupBy("part").applyInArrow(named_grams, "part bigint, name bigint, n bigint")
    recurring = grams.withColumn("all", F.sum("n").over(Window.partitionBy("name"))).filter("all > 1").select("part", "name")
    scratch = common.Scratch()
    recurring = scratch.stored(recurring, "recurring")
    found = table.select("part", "text").groupBy("part").cogroup(recurring.groupBy("part")).applyInArrow(named_windows, "part bigint, name bigint, hash bigint, n bigint")
    confirmed = found.withColumn("all", F.sum("n").over(Window.partitionBy("name", "hash"))).filter("all > 1").select("part", "hash")
    confirmed = scratch.stored(confirmed, "confirmed")
    out = table.groupBy("part").cogroup(confirmed.groupBy("part")).applyInArrow(without_repeats, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
    out = common.stored(out, "kept")
    scratch.drop()
    drop()
    return out


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat in runs of 35 removed from all documents; see repeats_removed for nulls, ties, repeated
    rows, empty tables and further columns."""
    return repeats_removed(common.table(spark, sf_dir, "documents"))
