"""Alignment, Merkle manifest and phrases against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlab.llm import align, common, html_text, langid, merkle, phrases, token_store

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("part", "unit", "n", "u", "place", "tree", "key", "cell", "range", "hash", "name", "row")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})


# Alignment


def tokenizer_paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_by_hand(rows):
    """Whole texts through both libraries, links by two pointers."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = align.Tokenizers(*tokenizer_paths())  # for the bytes of entries only
    a_lib = Tokenizer.from_file(tokenizer_paths()[0])
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_paths()[1])
    docs, count = [], Counter()
    for d, text in rows:
        ids = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        parts = [[known[i] for i in x] for known, x in zip((t.a_bytes, t.b_bytes), ids)]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            docs.append((d, None))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        links, i, j = [], 0, 0
        while i < len(ids[0]) and j < len(ids[1]):
            links.append((ids[0][i], ids[1][j]))
            e, f = ends[0][i], ends[1][j]
            i, j = i + (e <= f), j + (f <= e)
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            sides = []
            for k in (0, 1):
                to = ends[k].index(cut) + 1
                sides.append(",".join(map(str, ids[k][at[k] : to])))
                at[k] = to
            groups.append("|".join(sides))
        count.update(links)
        docs.append((d, (len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return ordered(
        (d, 0, 0, 0, 0, 0, 0, "") if r is None else (d, *r[:3], len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for d, r in docs
    )


def test_alignment_against_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(align, "PART_BYTES", 3000)
    rng = random.Random(3)
    bits = ["a", "b", " ", " ", "\n", "\t", ",", "'s", "'", "1", "23", "▁", "é", "漢", " ", " ", "\x85", "<s>", "<|endoftext|>", "\x00", "🙂", "ſ", "́", "the", "ing", ".", "\r", "  ", "\n\n", "ß", "Ж", "\x1c", "​", "<0x41>"]
    rows = [(1, None), (2, ""), (None, " "), (3, "  a"), (4, "a  "), (5, "word \n"), (5, "word\n"), (6, "x" * 3000), (7, "漢字" * 300), (7, "漢字" * 300)]
    rows += [(100 + i, "".join(rng.choices(bits, k=rng.randint(1, 12)))) for i in range(1500)]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert ordered(align.align(docs, *tokenizer_paths()).collect()) == aligned_by_hand(rows)
    assert align.align(spark.createDataFrame([], DOCS), *tokenizer_paths()).collect() == []


def test_units_join_to_the_text_and_cut_where_pieces_never_go_on():
    t = align.tokenizers(*tokenizer_paths())
    text = " don't stop, 12.5km\nNext line\n\nlast  one"
    assert "".join(t.units(text)) == text
    assert t.units(" the cat, sat\nDown") == [" the", " cat", ",", " sat", "\n", "Down"]
    with pytest.raises(ValueError, match="certain cuts"):
        t._cutter(["a▁b"])


# Merkle manifest


def manifest_by_hand(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, text, lang, source, n):
        return h(*map(part, (d, source, lang, n, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def siblings(tree, i):
        for level in tree[:-1]:
            yield i % 2, (level[i ^ 1] if i ^ 1 < len(level) else None)
            i //= 2

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for x in langs:
        trees[x].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(*r)))
        built[x] = levels([leaf(*r) for r in trees[x]])
    crown = levels([built[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            path = [*siblings(built[x], i), *siblings(crown, k)]
            d, text, lang, source, n = r
            tampered = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
            now = leaf(d, text, lang, source, n + 1) if tampered else leaf(*r)
            for right, sib in path:
                now = h(now) if sib is None else h(sib, now) if right else h(now, sib)
            out.append((d, leaf(*r), built[x][-1][0], crown[-1][0], h(*(s for _, s in path if s)), now, now == crown[-1][0]))
    return ordered(out)


def test_manifest_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randint(-50, 10**6), f"text {i} é", rng.choice(["en", "fr", "", None, "漢"]), rng.choice(["s", None]), rng.choice([None, i])) for i in range(400)]
    rows += [(7, f"t{i}", "en", None, i) for i in range(90)] + [(8, "same", "fr", "s", 4)] * 60 + [(None, "x", "en", "s", 1)] * 3 + [(-(1 << 63), None, "one", None, None), ((1 << 63) - 1, "", "en", "", 0)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    want = manifest_by_hand(rows)
    assert ordered(merkle.manifest(docs).collect()) == want
    monkeypatch.setattr(merkle, "CELL", 8)  # ids that repeat are counted on through leaf and row number
    monkeypatch.setattr(merkle, "BLOCK_DIGITS", 2)
    assert ordered(merkle.manifest(docs).collect()) == want
    one = spark.createDataFrame(rows[:1], DOCS)
    assert ordered(merkle.manifest(one).collect()) == manifest_by_hand(rows[:1])
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


# Phrases


def phrases_by_hand(rows, window=35):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return ordered(out)


def test_phrases_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = ["w" + str(i) for i in range(40)] + ["é漢", "x\x1cy", "a b"]
    passages = [rng.choices(vocabulary, k=n) for n in (34, 35, 36, 60, 200)]
    rows = [(1, "a " * 36), (2, "b " * 80 + "c"), (3, None), (4, ""), (4, " \t\n"), (None, "x y"), (5, " ".join(map(str, range(100)))), (5, " ".join(map(str, range(50, 90))))]
    rows += [(6, " ".join(map(str, range(35))) + "\n\tq"), (7, " ".join(["a", "b"] * 20)), (8, "a b c " * 13), (8, "a b c " * 13)]
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choices(vocabulary, k=rng.randint(0, 50))
            p = rng.choice(passages)
            words += p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        rows.append((100 + i, rng.choice([" ", "\n", " \x0b\r"]).join(words)))
    want = phrases_by_hand(rows)
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    for part_bytes, shard in ((3000, 120), (10**6, 10**6)):
        monkeypatch.setattr(phrases, "PART_BYTES", part_bytes)
        monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
        assert ordered(phrases.repeats_removed(docs).collect()) == want
    assert phrases.repeats_removed(spark.createDataFrame([], DOCS)).collect() == []


def test_texts_in_parts_are_not_shuffled_again(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    table, drop = common.in_parts(docs, 100)
    some = table.select("part").distinct()
    both = table.groupBy("part").cogroup(some.groupBy("part")).applyInArrow(lambda a, b: a, "part bigint, doc_id bigint, text string")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert both.count() == 50 and "text" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    drop()
    import os

    assert not os.path.exists(path.removeprefix("file:"))


# Mended cases of earlier operators


def test_fit_with_null_ids(spark):
    rows = [(None, f"the cat sat {i}", "en", None, None) for i in range(200)] + [(None, f"le chat noir {i}", "fr", None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    assert langid.fit(docs, 20)[0] == ["en", "fr"]
    pages = spark.createDataFrame([(None, "u", f"<article><p>Some text, number {i}.</p></article><nav>menu</nav>") for i in range(200)], "page_id bigint, url string, html string")
    assert not np.array_equal(html_text.fit(pages, 20), html_text.PRIOR)


def test_cut_of_a_long_page_with_close_calls():
    rng = random.Random(1)
    n = 20_000
    edges = defaultdict(dict)
    for i in range(1, n):
        edges[i][i - 1] = edges[i - 1][i] = 0.8
        if i >= 3 and i % 3 == 0:
            edges[i][i - 3] = edges[i - 3][i] = 0.4
    gain = [rng.uniform(-0.9, 0.9) for _ in range(n)]
    found = html_text.cut(gain, edges)
    cost = lambda x: -sum(g for g, y in zip(gain, x) if y) + sum(w for i in edges for j, w in edges[i].items() if i < j and x[i] != x[j])
    best = cost(found)
    for _ in range(300):  # no stretch that changes sides makes it less
        a = rng.randrange(n)
        b = min(n, a + rng.randint(1, 6))
        assert cost([not y if a <= i < b else y for i, y in enumerate(found)]) >= best - 1e-3


def test_token_files_ascend(spark):
    rows = [(i * 7919 % 900, f"text number {i}", None, None, None) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = common.scratch(spark, "tokens")
    token_store.write_tokens(clashing(docs), out, rows_each=40)
    blocks = spark.read.parquet(out).withColumn("file", F.input_file_name()).collect()
    ids = [d for r in sorted(blocks, key=lambda r: (r.file, r.range, r.part)) for d in r.doc_ids]
    assert ids == sorted(ids) and len(ids) == 900
    assert len({r.file for r in blocks}) > 1
