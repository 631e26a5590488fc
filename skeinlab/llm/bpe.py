"""BPE encoding by forced boundaries, and decoding, for a tokenizer file with word-end symbols.

A pair of neighbouring symbols that occurs inside no vocabulary token can never be merged across, nor can
any token span it: it is a certain cut. Words are cut there, the fragments are encoded on their own, and the
ids concatenated."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skeinlab.llm import common

CACHE = 600_000  # values of units that a worker remembers, 150 MB at most; a full cache drops its later half
LONGEST = 64  # characters of a unit that is remembered


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ForcedBoundaryBPE:
    """Encoder and decoder of one tokenizer file; equal to its library for every text.

    Texts of characters up to U+017F take a short way: NFC leaves them alone and lower case goes
    character by character. All others are normalised and split by the library's own components."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.path = path
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t.encode() for t, i in self.vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(printable, map(chr, printable), strict=True))
        hidden = [b for b in range(256) if b not in shown]
        self.symbol = [shown.get(b) or chr(256 + hidden.index(b)) for b in range(256)]
        self.inside = {pair for token in self.vocab for pair in self._pairs(self._symbols(token))}
        # Letters, digits and the rest by Unicode category, for the short way only.
        import unicodedata

        kinds = {c: unicodedata.category(chr(c))[0] for c in range(0x180)}
        chars = lambda kind: "".join(re.escape(chr(c)) for c, k in kinds.items() if k == kind)
        letters, numbers, space = chars("L"), chars("N"), "\\t-\\r \\x85\\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self.odd = re.compile("[^\\t-\\r -~\\xa1-\\u012f\\u0131-\\u017f]").search
        none = len(self.rank)
        self.none, self.cut = none, none + 1
        self.kind = {p: self.rank.get(p, none) for p in self.inside | self.rank.keys()}
        self.library = None

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return [*token]

    @staticmethod
    def _pairs(symbols: list[str]) -> Iterator[tuple[str, str]]:
        return zip(symbols, symbols[1:], strict=False)

    def _fragment(self, symbols: list[str], ranks: list[int]) -> list[str]:
        """The merges of one fragment, lowest rank first, then leftmost; ranks: of its neighbours."""
        if len(symbols) > 200:
            return self._long(symbols)
        rank, none = self.rank.get, self.none
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            symbols[i] = merged = symbols[i] + symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], merged), none)
            if i < len(ranks):
                ranks[i] = rank((merged, symbols[i + 1]), none)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The same with a heap, for long fragments: n log n steps."""
        import heapq

        part: list[str | None] = list(symbols)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := self.rank.get(p := (part[x], part[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, p))
        return [p for p in part if p is not None]

    def _byte_word(self, word: str) -> list[int]:
        """Ids of a word that is written in the symbols of bytes: cut where a pair is in no token."""
        symbols = list(word)
        symbols[-1] += self.suffix
        kind, cut, vocab = self.kind.get, self.cut, self.vocab
        ranks = [kind(p, cut) for p in zip(symbols, symbols[1:], strict=False)]
        if not ranks or max(ranks) < cut:
            return [vocab[s] for s in self._fragment(symbols, ranks) if s in vocab]
        ids, start = [], 0
        for end in [i + 1 for i, r in enumerate(ranks) if r == cut] + [len(symbols)]:
            ids += [vocab[s] for s in self._fragment(symbols[start:end], ranks[start : end - 1]) if s in vocab]
            start = end
        return ids

    def units(self, text: str) -> list[str]:
        """The words of a text; one in the symbols of bytes has \\0 before it, an added token \\1."""
        if "<" in text and self.cut_added and len(parts := self.cut_added.split(text)) > 1:
            return [u for p in parts for u in (["\1" + p] if p in self.added else self.units(p))]
        if self.odd(text):
            return ["\0" + w for w in self._by_components(text)]
        return self.words(text.lower())

    def ids(self, unit: str, encode: Callable[[str], list[int]] | None = None) -> list[int]:
        """Ids of a unit; encode: of a word in the symbols of bytes."""
        encode = encode or self._byte_word
        if unit[0] == "\0":
            return encode(unit[1:])
        if unit[0] == "\1":
            return [self.added[unit[1:]]]
        return encode(unit if unit.isascii() else "".join([self.symbol[b] for b in unit.encode()]))

    def library_ids(self, unit: str) -> list[int]:
        """The same by the library's own merges, without forced cuts."""
        tokenize = self.loaded_library().model.tokenize
        return self.ids(unit, lambda word: [t.id for t in tokenize(word)])

    def loaded_library(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def _by_components(self, text: str) -> list[str]:
        library = self.loaded_library()
        return [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]

    def encode(self, text: str | None) -> list[int]:
        return [i for u in self.units(text or "") for i in self.ids(u)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the file names no decoder; special tokens stay."""
        return b" ".join(self.text_of[i] for i in ids if i in self.text_of).decode()


_loaded: dict[str, ForcedBoundaryBPE] = {}


def loaded(path: str) -> ForcedBoundaryBPE:
    """The encoder of this worker; its caches live on between tasks."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs' doc_id with ids (array<int>) and decoded text. Null and empty texts: no ids, empty text.

    Rows are independent, so there is no shuffle and memory is one batch of documents and the caches."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = loaded(path)
        for b in text_batches(batches, 64):
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")


class _Known(dict):
    """Values by unit; what is missing is made on the way."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        return self.make(unit)


class Memo:
    """What a worker remembers of units: of(ids) as bytes, one dictionary for each `of`."""

    def __init__(self, bpe: ForcedBoundaryBPE, ids_of: Callable[[str], list[int]], *of: Callable[[list[int]], bytes]):
        self.bpe, self.ids_of, self.of, self.most = bpe, ids_of, of, CACHE // len(of)
        self.known = [_Known(partial(self._make, i)) for i in range(len(of))]

    def _make(self, which: int, unit: str) -> bytes:
        if len(self.known[0]) >= self.most:  # units met early are the frequent ones; they stay
            for late in list(self.known[0])[self.most // 2 :]:
                for d in self.known:
                    d.pop(late, None)
        ids = self.ids_of(unit)
        if len(unit) > LONGEST:
            return self.of[which](ids)
        for of, d in zip(self.of, self.known, strict=True):
            d[unit] = of(ids)
        return self.known[which][unit]

    def joined(self, units: list[str], sep: bytes = b"") -> list[bytes]:
        return [sep.join(map(d.__getitem__, units)) for d in self.known]


def remembered(path: str, name: str, *of: Callable[[list[int]], bytes], by_library: bool = False) -> Memo:
    """This worker's memo of that name; it lives on until another operator runs in the worker."""
    bpe = loaded(path)
    return common.worker_cache(f"{name} of {path}", lambda: Memo(bpe, bpe.library_ids if by_library else bpe.ids, *of))


def digest_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and the columns `keep`), n_tokens, ids_sha256 and decoded_sha256: encode and decode of every
    whole text, of which only digests leave the worker. Null, empty and token-free texts: 0 tokens and the
    digests of the empty string. Repeated rows give repeated rows; extra columns are not read."""
    path = path or vocabulary_path()
    names = ["doc_id", *keep]

    def run(batches):
        bpe = loaded(path)
        text_of = bpe.text_of
        memo = remembered(path, "digest", lambda ids: b" ".join([b"%d" % i for i in ids]), lambda ids: b" ".join([text_of[i] for i in ids]))
        for b in text_batches(batches):
            n, ids_hash, text_hash = [], [], []
            for text in b.column("text").to_pylist():
                ids, back = memo.joined(bpe.units(text or ""), b" ")
                n.append(ids.count(b" ") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; see digest_documents for nulls, empty and
    repeated rows and further columns. An empty table gives no rows; a text of any length is encoded whole."""
    return digest_documents(common.table(spark, sf_dir, "documents"))
