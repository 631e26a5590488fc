"""Cross-tokenizer alignment: which tokens of two tokenizers cover common bytes of a text.

Texts are cut into units where both tokenizers must cut, so that equal units have equal tokens wherever they
stand; units are the documents of the alignment, each aligned once and weighted by its occurrences. The alignment
is relational: posexplode of the tokens, windowed cumulative lengths, a join of the two sides on (unit, end), running
counts of the common ends as group ids. Each stretch between neighbouring ends lies in one token of either
side, whose places are the running counts of the side's ends; a join on the unit turns places into ids (links).
Documents are put together from the rows of their units."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skeinlab.llm import common

PART_BYTES = 32 << 20  # text of a part, within which units are counted and documents put together
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"  # letters in every version of Unicode's tables
SIGNS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
NOT_BEFORE = "\\s\u180e\u200b\u2060\ufeff\u2581"  # after these a space isn't certain to begin a token

_held: dict[tuple, object] = {}


def _token_bytes(vocab: dict[str, int], symbols: dict[str, int]) -> dict[int, bytes]:
    return {i: bytes([symbols[c] for c in t]) if all(c in symbols for c in t) else t.encode() for t, i in vocab.items()}


class Tokenizers:
    """The two tokenizers of a worker with the bytes of their entries, and the cuts that both must make."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding(), self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        symbols = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.a_bytes = _token_bytes(self.a.get_vocab(with_added_tokens=True), symbols)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)}
        self.units = self._cutter([p for i, p in enumerate(pieces) if not self.b.is_byte(i)]).findall

    @staticmethod
    def _cutter(pieces: list[str]) -> re.Pattern:
        """Units of a text that begins with a space. A's words never hold a letter before another sign, nor end
        within a sign or letter and a space or line end; for B a cut is certain where no piece holds the pair."""
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(x[1] == "\u2581" != x[0] for x in pairs):
            raise ValueError("pieces that go on over a space have no certain cuts")
        letter = re.compile(f"[{LATIN}]").match
        joined = {x[1] for x in pairs if letter(x[0])}
        signs = "".join(re.escape(c) for c in SIGNS if c not in joined)
        line = any("\n" in x for x in pairs)
        after = f"(?<=[{LATIN}{signs}])"
        cuts = [f"(?<=[^{NOT_BEFORE}])(?= [^ ])", f"(?<=[{LATIN}])(?=[{signs}])"]
        short = [f" ?[{LATIN}]+(?=[{signs}]| [^ ]|\\Z)", f" ?[{signs}]+(?= [^ ]|\\Z)"]
        if not line:
            cuts += [f"(?<=[{LATIN}{signs}]\n)(?=[{LATIN}{signs}])", f"{after}(?=\n)"]
            short = [f" ?[{LATIN}]+(?=[{signs}\n]| [^ ]|\\Z)", f" ?[{signs}]+(?=\n| [^ ]|\\Z)", f"{after}\n(?=[{LATIN}{signs}])"]
        return re.compile("|".join([*short, f"[\\s\\S]+?(?=\\Z|{'|'.join(cuts)})"]))

    def lead(self, unit: str) -> str:
        """What stands before a unit that begins without a space, beyond a certain cut."""
        if unit[0] == " ":
            return ""
        return "\n" if re.match(f"[{LATIN}]", unit) else "a"

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        leads = [self.lead(u) for u in units]
        a = [e.ids for e in self.a.encode_batch([x + u for x, u in zip(leads, units, strict=True)], add_special_tokens=False)]
        b = self.b.encode([x + u if x else u[1:] for x, u in zip(leads, units, strict=True)], num_threads=1)
        skip = {"": 0, "a": 1, "\n": 2}  # B writes the space that it adds before a line end as a piece of its own
        return [ids[1:] if x else ids for ids, x in zip(a, leads, strict=True)], [ids[skip[x] :] for ids, x in zip(b, leads, strict=True)]


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _held:
        _held[a_path, b_path] = Tokenizers(a_path, b_path)
    return _held[a_path, b_path]


UNIT = "unit string, n bigint, a array<int>, a_len array<int>, b array<int>, b_len array<int>, ok boolean"


def _tokenised(counted: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """unit, n, the ids and byte lengths of its tokens, and whether both sides give its bytes."""

    def run(batches):
        t = tokenizers(*paths)
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                units = batch.column("unit").to_pylist()
                columns, ok = [], np.ones(len(units), dtype=bool)
                for ids, known in zip(t.tokens(units), (t.a_bytes, t.b_bytes), strict=True):
                    parts = [[known[i] for i in x] for x in ids]
                    ok &= [b"".join(p) == u.encode() for p, u in zip(parts, units, strict=True)]
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([[*map(len, p)] for p in parts], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("n"), *columns, pa.array(ok)], names=["unit", "n", "a", "a_len", "b", "b_len", "ok"])

    return counted.mapInArrow(run, UNIT)


def _aligned(units: DataFrame) -> DataFrame:
    """u, unit, n, n_a, n_b, n_groups, links (array of (a, b), one for each pair of tokens with common bytes) and groups
    (text) of each unit (u, unit, n, a, a_len, b, b_len)."""
    by_unit = units.repartition("u")
    ends = {}
    for side in ("a", "b"):
        tokens = by_unit.select("u", F.posexplode(f"{side}_len").alias("pos", "length"))
        to = F.sum("length").over(Window.partitionBy("u").orderBy("pos"))
        ends[side] = tokens.select("u", to.alias("end"), F.lit(1).alias(side))
    cut = ends["a"].join(ends["b"], ["u", "end"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    before = Window.partitionBy("u").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    stretches = cut.select("u", "end", (a * b == 1).alias("last"), count(a).alias("at_a"), count(b).alias("at_b"), count(a * b).alias("group"))
    each = F.sort_array(F.collect_list(F.struct("end", "group", "at_a", "at_b", "last")))
    found = stretches.groupBy("u").agg(each.alias("stretches")).join(by_unit.select("u", "unit", "n", "a", "b"), "u")
    cuts = F.filter("stretches", lambda s: s["last"])

    def ids(side: str):
        first = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get(F.col("cuts"), i - 1)[f"at_{side}"] + 2)
        return lambda s, i: F.array_join(F.slice(F.col(side), first(i), s[f"at_{side}"] + 2 - first(i)), ",")

    text = F.array_join(F.transform("cuts", lambda s, i: F.concat(ids("a")(s, i), F.lit("|"), ids("b")(s, i))), ";")
    links = F.transform("stretches", lambda s: F.struct(F.get("a", s["at_a"]).alias("a"), F.get("b", s["at_b"]).alias("b")))
    return found.withColumn("cuts", cuts).select(
        "u", "unit", "n", F.size("a").alias("n_a"), F.size("b").alias("n_b"), (F.element_at("stretches", -1)["group"] + 1).alias("n_groups"), links.alias("links"), text.alias("groups")
    )


def _scored(aligned: DataFrame, scratch: common.Scratch) -> DataFrame:
    """u, n_best and count_sum of each unit, from the weighted counts of all pairs."""
    links = aligned.select("u", "n", F.explode("links").alias("link")).select("u", "n", "link.a", "link.b")
    counts = scratch.stored(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    pairs = counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    scores = links.select("u", "a", "b").join(pairs, ["a", "b"]).groupBy("u")
    return scores.agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text).

    Null and empty texts, and texts that the joined bytes of either side differ from, have no tokens: zeros
    and an empty digest, and their would-be links count nowhere. Ties for the highest count of a b id are all
    best. Repeated rows are documents of their own; null and equal ids do no harm, further columns are not read.
    Empty input: no rows. Texts are stored in buckets by part and never shuffled; what is shuffled are the distinct
    units of each part, once, then those of the table. A text without certain cuts is one unit, aligned like any."""
    spark, paths = docs.sparkSession, (a_path, b_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    table, drop = common.in_parts(docs, PART_BYTES)

    def cut(text: str | None) -> list[str]:
        return tokenizers(*paths).units(" " + text) if text else []

    def counts(part: int, counter: Counter) -> pa.Table:
        return pa.table({"part": pa.array([part] * len(counter), pa.int64()), "unit": pa.array([*counter], pa.string()), "n": pa.array([*counter.values()], pa.int64())})

    def count(rows: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for text in rows.column("text").to_pylist():
            seen.update(cut(text))
        return counts(rows.column("part")[0].as_py(), seen)

    def count_bad(rows: pa.Table, bad: pa.Table) -> pa.Table:
        """Less what count has of documents with a bad unit."""
        seen: Counter = Counter()
        without = set(bad.column("unit").to_pylist())
        for text in rows.column("text").to_pylist() if without else []:
            if not without.isdisjoint(units := cut(text)):
                seen.subtract(units)
        return counts(rows.column("part")[0].as_py() if rows.num_rows else 0, seen)

    scratch = common.Scratch()
    counted = table.select("part", "text").groupBy("part").applyInArrow(count, "part bigint, unit string, n bigint")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted, drop_counted = common.bucketed(counted.repartition(buckets, "unit"), "unit", buckets, "counted")
    units = _tokenised(counted.groupBy("unit").agg(F.sum("n").alias("n")), paths).withColumn("u", F.monotonically_increasing_id())
    units = scratch.stored(units, "units")
    bad = scratch.stored(units.filter("not ok").select("unit"), "bad")
    good = units.filter("ok")
    if not bad.isEmpty():
        theirs = counted.join(bad, "unit", "left_semi").select("part", "unit")
        less = table.select("part", "text").groupBy("part").cogroup(theirs.groupBy("part")).applyInArrow(count_bad, "part bigint, unit string, n bigint")
        less = less.groupBy("unit").agg(F.sum("n").alias("less"))
        good = good.join(less, "unit", "left").withColumn("n", F.col("n") + F.coalesce("less", F.lit(0)))
    aligned = scratch.stored(_aligned(good.select("u", "unit", "n", "a", "a_len", "b", "b_len")), "aligned")
    scratch.drop(units)
    rows = aligned.select("u", "unit", "n_a", "n_b", "n_groups", F.size("links").alias("n_links"), "groups").join(_scored(aligned, scratch), "u")
    none = [F.lit(-1).cast("bigint").alias(c) for c in NUMBERS]
    found = rows.select("unit", *NUMBERS, "groups").unionByName(bad.select("unit", *none, F.lit(None).cast("string").alias("groups")))
    found = scratch.stored(found, "found")
    scratch.drop(*(x for x, _ in scratch.held if x is not found))
    theirs = counted.select("part", "unit").join(found, "unit")

    def together(docs: pa.Table, units: pa.Table) -> pa.Table:
        place = {u: i for i, u in enumerate(units.column("unit").to_pylist())}
        numbers = np.stack([units.column(c).to_numpy() for c in NUMBERS], axis=1) if place else np.zeros((0, len(NUMBERS)), np.int64)
        groups = [None if g is None else g.encode() for g in units.column("groups").to_pylist()]
        sums, digests = [], []
        for text in docs.column("text").to_pylist():
            at = [place[u] for u in cut(text)]
            mine = numbers[at]
            if not at or mine.min() < 0:
                sums.append([0] * len(NUMBERS))
                digests.append("")
            else:
                sums.append(mine.sum(axis=0).tolist())
                digests.append(hashlib.sha256(b";".join([groups[i] for i in at])).hexdigest())
        columns = zip(*sums, strict=True) if sums else [[] for _ in NUMBERS]
        return pa.table({"doc_id": docs.column("doc_id")} | {c: pa.array(x, pa.int64()) for c, x in zip(NUMBERS, columns, strict=True)} | {"groups_sha256": pa.array(digests, pa.string())})

    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in NUMBERS)}, groups_sha256 string"
    out = common.stored(table.groupBy("part").cogroup(theirs.groupBy("part")).applyInArrow(together, schema), "alignment")
    scratch.drop()
    drop_counted()
    drop()
    return out


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all documents under the byte-level and the piece tokenizer; see align for nulls, ties,
    repeated rows, empty tables and further columns."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
