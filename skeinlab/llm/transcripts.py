"""Chat formatting: a hidden Markov model recovers the roles of raw transcripts, then turns are rendered.

The states are (role, begins a turn) for each role; a line is observed as its speaker marker, length, ending and
first character. Viterbi finds the best states of a conversation. The parts are sorted into ranges of bounded size;
where a conversation goes on from range to range, the best scores between any two states over its parts in a range
(max-plus matrices) are chained, so that no task holds a long conversation's lines."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skeinlab.llm import common

RANGE = 20_000  # parts of a range, about
CHUNK = 256  # parts of a piece of a conversation that the fit samples
TRAIN_ROWS = 20_000  # expected number of labelled parts that the model is fitted on
MAX_ROLES = 16
SMOOTHING = 0.5

# Marker words of each usual role, in the styles that transcripts use.
MARKERS = {"user": ("user", "human", "q", "question", "prompt"), "assistant": ("assistant", "ai", "bot", "a", "answer", "response"), "system": ("system", "context", "instruction", "instructions")}
_marker = re.compile(r"\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?([A-Za-z]+)(?:\*\*:|\]:?|\|?>|:)\s*")
_kinds = {w: i + 1 for i, words in enumerate(MARKERS.values()) for w in words}
SIZES = (len(MARKERS) + 1, 5, 4, 3)  # values of each feature of a line


def observed(line: str) -> tuple[int, int, int, int]:
    m = _marker.match(line)
    kind = _kinds.get(m[1].lower(), 0) if m else 0
    body = line.strip()
    n = len(body)
    size = 0 if n == 0 else 1 if n < 40 else 2 if n < 120 else 3 if n < 400 else 4
    end = 0 if not body else 1 if body[-1] in ".!" else 2 if body[-1] == "?" else 3
    first = 0 if not body else 1 if body[0].isupper() else 2
    return kind, size, end, first


def stripped(line: str) -> str:
    """The line without a known speaker marker."""
    m = _marker.match(line)
    return line[m.end() :] if m and m[1].lower() in _kinds else line


class Model:
    """roles, and log probabilities: start (states), step (states x states), emit (per feature, value x states)."""

    def __init__(self, roles: list[str], start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.roles, self.start, self.step, self.emit = roles, start, step, emit

    def scores(self, lines: list[str]) -> np.ndarray:
        seen = np.array([observed(x) for x in lines])
        return sum(e[seen[:, k]] for k, e in enumerate(self.emit))

    def matrix(self, lines: list[str], first: bool) -> np.ndarray:
        """Best score from the state before these lines (any row, where they are the first) to each last state."""
        best = None
        for e in self.scores(lines):
            if best is None:
                best = (np.tile(self.start, (len(self.start), 1)) if first else self.step) + e
            else:
                best = (best[:, :, None] + self.step[None]).max(axis=1) + e
        return best

    def viterbi(self, lines: list[str], before: int | None, last: int | None) -> list[int]:
        """Best states of the lines after state `before` (None: they are the first), ending in `last` (None: any)."""
        back, v = [], None
        for e in self.scores(lines):
            if v is None:
                v = (self.start if before is None else self.step[before]) + e
            else:
                through = v[:, None] + self.step
                back.append(through.argmax(axis=0))
                v = through.max(axis=0) + e
        out = [int(v.argmax()) if last is None else last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string")) % 4 == 2, F.lit(False))


def fit(parts: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Counts of a sample of labelled parts outside the held-out ones, in pieces of CHUNK parts of a conversation.

    About `rows` parts are read, those without conv_id or part aside; of parts that repeat one counts. Pieces that
    begin a conversation (part 0) count for the start, steps are counted inside a piece, in the order of Spark's
    sort; what comes to the driver is one sum for each pair of states and each (state, feature, value). No labelled
    parts give an even model of the usual roles; more than MAX_ROLES roles are an error."""
    usable = parts.filter(F.col("role").isNotNull() & F.col("conv_id").isNotNull() & F.col("part").isNotNull() & ~held_out(F.col("conv_id")))
    n = usable.count()
    unit = 1 << 40
    share = int(min(1.0, rows / max(1, n)) * unit) + 1
    piece = F.floor(F.col("part") / CHUNK).alias("piece")
    sample = usable.select("conv_id", piece, "part", "role", "raw").filter(F.pmod(F.xxhash64("conv_id", "piece", F.lit(31)), F.lit(unit)) < share)
    sample = sample.groupBy("conv_id", "piece", "part").agg(F.min(F.struct("role", "raw")).alias("one")).select("conv_id", "piece", "part", "one.*")
    roles = sorted(r[0] for r in sample.select("role").distinct().limit(MAX_ROLES + 1).collect()) or sorted(MARKERS)
    if len(roles) > MAX_ROLES:
        raise ValueError(f"more than {MAX_ROLES} roles")
    place = {r: i for i, r in enumerate(roles)}
    states = 2 * len(roles)

    def count(batches):
        start, step = np.zeros(states), np.zeros((states, states))
        emit = [np.zeros((k, states)) for k in SIZES]
        now, state = None, None
        for b in batches:
            for conv, piece, part, role, raw in zip(*[b.column(c).to_pylist() for c in ("conv_id", "piece", "part", "role", "raw")], strict=True):
                for i, line in enumerate((raw or "").split("\n")):
                    new = 2 * place[role] + (i == 0)
                    if (conv, piece) == now:
                        step[state, new] += 1
                    elif part == 0:
                        start[new] += 1
                    now, state = (conv, piece), new
                    for e, value in zip(emit, observed(line), strict=True):
                        e[value, new] += 1
        flat = np.concatenate([start, step.ravel(), *[e.ravel() for e in emit]])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    ordered = sample.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "part")
    sums = ordered.mapInArrow(count, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.full(states + states * states + sum(SIZES) * states, SMOOTHING)
    flat[sums.column("at").to_numpy()] += sums.column("n").to_numpy()
    start, step, rest = flat[:states], flat[states : states + states * states].reshape(states, states), flat[states + states * states :]
    emit, at = [], 0
    for k in SIZES:
        e = rest[at : at + k * states].reshape(k, states)
        emit.append(np.log(e / e.sum(axis=0)))
        at += k * states
    start = np.where(np.arange(states) % 2, start, 1e-9)  # a conversation begins with a turn
    return Model(roles, np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), emit)


ORDERED = "conv_id bigint, part bigint, raw string, range int, place bigint"


def in_ranges(parts: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, part, raw, range, place) and the number of ranges: all parts in the order of conversation (null
    first), part (null as 0), a hash of raw and a row number, cut into ranges of about RANGE rows by Spark's range
    partitioning; place is the order in a range. Equal rows can fall into several ranges, so a range is bounded
    however often a row repeats. Stored, as the cuts are made from a sample."""
    rows = parts.select("conv_id", F.coalesce("part", F.lit(0)).cast("bigint").alias("part"), "raw", F.xxhash64("raw").alias("h"), F.monotonically_increasing_id().alias("row"))
    n = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts.count() // RANGE + 1)
    keys = ["conv_id", "part", "h", "row"]

    def numbered(batches):
        where, at = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), b.column("raw"), pa.array([where] * k, pa.int32()), pa.array(range(at, at + k), pa.int64())], names=["conv_id", "part", "raw", "range", "place"])
            at += k

    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv_id", "part", "raw")
    return common.stored(dealt.mapInArrow(numbered, ORDERED), "parts"), n


def _runs(batches):
    """(range, conv_id, whether it is the range's first run, rows (part, raw)) of sorted batches, and at the end of a
    range its number alone: a run is what a range holds of a conversation."""
    now, held, first = None, [], True
    for b in batches:
        for place, conv, part, raw in zip(*[b.column(c).to_pylist() for c in ("range", "conv_id", "part", "raw")], strict=True):
            if held and (place, conv) != now:
                yield (*now, first, place != now[0], held)
                held, first = [], place != now[0]
            now = place, conv
            held.append((part, raw))
    if held:
        yield (*now, first, True, held)


def chained(dealt: DataFrame, model: Model) -> DataFrame:
    """(range, conv_id, before, last, ends): for the runs at the edges of the ranges, two of each at most, the state
    that comes before them (null: they begin the conversation), the state they end in on the best path (null: free)
    and whether the conversation ends with them.

    A run's matrix has (2 x roles)^2 numbers; one task chains the matrices of a conversation, at most one for each
    range that it goes through."""

    def matrices(batches):
        for place, conv, first, last, rows in _runs(batches):
            if first or last:
                lines = [x for _, raw in rows for x in (raw or "").split("\n")]
                both = np.concatenate([model.matrix(lines, True)[0], model.matrix(lines, False).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([conv], pa.int64()), pa.array([both], pa.list_(pa.float64()))], names=["range", "conv_id", "m"])

    def solved(conv, held):
        size = len(model.start)
        v, back = held[0][1][:size], []
        for _, m in held[1:]:
            through = v[:, None] + m[size:].reshape(size, size)
            back.append(through.argmax(axis=0))
            v = through.max(axis=0)
        last = [int(v.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        n = len(held)
        columns = [pa.array([x for x, _ in held], pa.int32()), pa.array([conv] * n, pa.int64()), pa.array([None, *last[:-1]], pa.int32()), pa.array(last, pa.int32()), pa.array([i == n - 1 for i in range(n)])]
        return pa.RecordBatch.from_arrays(columns, names=["range", "conv_id", "before", "last", "ends"])

    def chain(batches):
        now, held = None, []
        for b in batches:
            for conv, place, m in zip(b.column("conv_id").to_pylist(), b.column("range").to_pylist(), b.column("m").to_pylist(), strict=True):
                if held and conv != now:
                    yield solved(now, held)
                    held = []
                now = conv
                held.append((place, np.array(m)))
        if held:
            yield solved(now, held)

    scored = dealt.mapInArrow(matrices, "range int, conv_id bigint, m array<double>")
    return scored.repartition("conv_id").sortWithinPartitions("conv_id", "range").mapInArrow(chain, "range int, conv_id bigint, before int, last int, ends boolean")


def parse(parts: DataFrame, model: Model) -> DataFrame:
    """parts (conv_id bigint, part bigint, raw string) with role_pred, n_begun and rendered, one row each.

    role_pred is the role of the part's first line, n_begun how many turns begin in it, rendered its share of
    the canonical form: <|role|> before each turn, on a line of its own, <|end|> after it (where the next begins, and
    at the conversation's end), markers removed. Parts in order make up the conversation. Null and empty parts are
    one empty line; a null part counts as part 0; null conv_ids are one conversation; ties in part go by a hash of
    raw; repeated rows repeat. Other columns are not read. Empty input: no rows.

    A range is one key of the shuffle and streams through its task run by run; a task keeps the lines of one run."""
    stored, n = in_ranges(parts)
    dealt = stored.repartitionById(n, F.col("range")).sortWithinPartitions("range", "place")
    edges = common.stored(chained(dealt, model), "chains")
    # two rows of a range at most: the rows of a range go with it
    ends = edges.groupBy("range").agg(F.collect_list(F.struct("conv_id", "before", "last", "ends")).alias("edges")).withColumnRenamed("range", "r")
    joined = stored.filter("place = 0").select("range").join(ends, F.col("range") == F.col("r")).select("range", F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("part"), F.lit(None).cast("string").alias("raw"), "edges")
    rows = stored.withColumn("edges", F.lit(None).cast(joined.schema["edges"].dataType)).select(*joined.columns).unionByName(joined)

    def known_first(batches):
        """The edges come as the first row of a range."""
        known: dict = {}
        for b in batches:
            keep = []
            for i, (at, place, conv) in enumerate(zip(b.column("place").to_pylist(), b.column("range").to_pylist(), b.column("edges").to_pylist(), strict=True)):
                if at == -1:
                    for x in conv:
                        known[place, x["conv_id"]] = (x["before"], x["last"], x["ends"])
                else:
                    keep.append(i)
            yield known, b.take(pa.array(keep, pa.int64()))

    def run(batches):
        known: dict = {}

        def only_rows():
            for found, b in known_first(batches):
                known.update(found)
                yield b

        for place, conv, _, _, rows in _runs(only_rows()):
            before, last, ends = known.get((place, conv), (None, None, True))
            lines = [(raw or "").split("\n") for _, raw in rows]
            states = model.viterbi([x for part in lines for x in part], before, last)
            at, roles, begun, text = 0, [], [], []
            opened = before is not None
            for k, part in enumerate(lines):
                mine = states[at : at + len(part)]
                at += len(part)
                roles.append(model.roles[mine[0] // 2])
                begun.append(sum(s % 2 for s in mine))
                out = []
                for s, line in zip(mine, part, strict=True):
                    if s % 2:
                        out += ["<|end|>"] * opened + [f"<|{model.roles[s // 2]}|>"]
                        opened = True
                        line = stripped(line)
                    out.append(line)
                text.append("\n".join(out + ["<|end|>"] * (ends and k == len(lines) - 1)))
            columns = [pa.array([conv] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(roles, pa.string()), pa.array(begun, pa.int32()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "role_pred", "n_begun", "rendered"])

    ordered = rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", "place")
    return ordered.mapInArrow(run, "conv_id bigint, part bigint, role_pred string, n_begun int, rendered string")


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, part, raw, role): the conversations table as raw transcripts. A conversation has one of four
    marker styles; by a hash of (conv_id, turn) one turn in eight lost its marker."""
    name = F.initcap(F.col("role"))
    style = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(4))
    human = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise(name)
    letter = F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise("Context")
    mark = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), human, F.lit(":\n"))).when(style == 2, F.concat(F.lit("["), F.lower(name), F.lit("] "))).otherwise(F.concat(letter, F.lit(": ")))
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    raw = F.concat(F.when(lost | mark.isNull(), "").otherwise(mark), common.text_or_empty())
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("part"), raw.alias("raw"), "role")


def op6_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, held_out, role_pred, n_begun and rendered_sha256 of every turn of conversations, made a raw
    transcript first. Nulls, ties, repeated rows and empty tables as in parse."""
    parts = transcripts(common.table(spark, sf_dir, "conversations"))
    found = parse(parts.drop("role"), fit(parts))
    return found.select("conv_id", F.col("part").alias("turn"), held_out(F.col("conv_id")).alias("held_out"), "role_pred", "n_begun", F.sha2("rendered", 256).alias("rendered_sha256"))
