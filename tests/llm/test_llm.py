import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row, functions as F

import corpus_pipeline
from skeinlab.llm import bpe, common, components, exact_dedup, fingerprints, html_text, langid, mixing, ngram_join, queries, revisits, token_store, transcripts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Nulls in every column, empty and white texts, a long text, copies, near copies, repeated rows."""
    base = [words(60, i) for i in range(30)]
    rows = [(i, t, ("en", "fr")[i % 2], f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[3] + " " * i, "en", "s1", None) for i in range(5)]
    rows += [(200 + i, base[5].replace(base[5].split()[7 + i], "zz", 1), "fr", None, 5) for i in range(4)]
    rows += [(300, None, "en", "s0", None), (301, "", None, "s0", 0), (302, " \t\n", "en", None, 3), (303, words(4000, 99), "en", "s2", 9)]
    rows += [(304, "one two three", "en", "s3", 13), (305, "12 34 !!", None, "s3", 8), (306, "Ünïcode ß Σας 漢字 🙂 <|endoftext|> it's 'LL", "fr", "s3", 40)]
    rows += [rows[7], rows[7], (None, "no id at all", None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    own = bpe.ForcedBoundaryBPE(bpe.vocabulary_path())
    texts = [r[1] or "" for r in corpus()] + ["x" * 3000, "é" * 500 + "a", "a\x1cb\x85c\xa0d", "<|startoftext|><|endoftext", "İstanbul ﬁ Å", "don't I'LL '"]
    texts += ["a" + chr(c) + "b " + chr(c) * 2 + "1" for c in itertools.chain(range(0x2000), range(0x2000, 0xD800, 97), range(0xE000, 0x110000, 997))]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(docs).collect())
    want = Counter()
    for d, t, *_ in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_documents(docs).filter("doc_id = 306").first().decoded == lib.decode(own.encode(corpus()[-4][1]), skip_special_tokens=False)


def test_exact_dedup_against_brute_force(docs, none):
    groups = defaultdict(list)
    for d, t, *_ in corpus():
        groups[WHITE.sub("", t or "")].append((d, t or ""))
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(corpus())
    kept = Counter()
    for norm, rows in groups.items():
        best = max(rows, key=lambda r: (len(r[1]), r[0] is not None, -(r[0] or 0)))
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()]
        assert len(mine) == len(rows) and all(r.keep_id == best[0] and r.group_size == len(rows) for r in mine)
        assert [r.doc_id for r in mine if r.kept] == [best[0]]
        kept[best[0]] += 1
    assert Counter(r.doc_id for r in exact_dedup.keep_first(docs).collect()) == kept
    assert exact_dedup.exact_groups(none).count() == exact_dedup.keep_first(none).count() == 0


def test_exact_dedup_survives_a_weak_hash(docs):
    weak = exact_dedup.exact_groups(docs, lambda norm: F.substring(F.md5(norm), 1, 1))
    key = lambda df: Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    assert key(weak) == key(exact_dedup.exact_groups(docs))


def test_ngram_join_against_brute_force(spark, docs, none):
    extra = docs.withColumn("label", F.lit(1)).withColumn("node", F.lit("x")).withColumn("n", F.lit(2))  # clashing names
    got = ngram_join.near_classes(extra).collect()
    assert len(got) == len(corpus())
    sets, key = {}, {}
    for d, t, *_ in corpus():
        key[d] = " ".join((t or "").lower().split())
        sets[key[d]] = set(ngram_join.shingles(ngram_join.words_of(t)).tolist())
    links = {a: {b for b in sets if b != a and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in sets}
    least = {a: min((d for d in key if d is not None and key[d] == a), default=None) for a in sets}
    label = dict(least)
    for _ in range(len(sets)):
        label = {a: min([label[a]] + [label[b] for b in links[a]], key=lambda x: (x is None, x)) for a in sets}
    for r in got:
        assert (r.class_id, r.copy_id, r.n_links) == (label[key[r.doc_id]], least[key[r.doc_id]], len(links[key[r.doc_id]])), r
    assert sum(map(len, links.values())) > 4
    one = ngram_join.keep_one(extra)
    assert one.columns == extra.columns and one.count() == len(set(label.values()))
    assert ngram_join.near_classes(none).count() == ngram_join.keep_one(none).count() == 0


def test_ngram_join_splits_large_buckets(spark, monkeypatch):
    base = words(50, 1).split()
    texts = [" ".join(w if i != j % 50 else f"w{j}" for i, w in enumerate(base)) for j in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(ngram_join, "SMALL", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    sets = [set(ngram_join.shingles(ngram_join.words_of(t)).tolist()) for t in texts]
    want = [sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) - 1 for a in sets]
    got = {r.doc_id: r.n_links for r in ngram_join.near_classes(df).collect()}
    assert [got[i] for i in range(150)] == want and sum(want) > 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_fingerprints_estimate_generalised_jaccard(spark, docs, none):
    got = fingerprints.edited_prints(docs).collect()
    rows = sorted(((-(1 << 63) if d is None else d), t or "") for d, t, *_ in corpus())[::-1]
    assert len(got) == len(rows)
    counts = lambda t: Counter(tuple(w[i : i + 5]) for w in [WHITE.sub(" ", t).split(" ") and [x for x in WHITE.split(t) if x]] for i in range(max(1, len(w) - 4)))
    by_id = {r.doc_id: r for r in got}
    errors = []
    for i, (d, t) in enumerate(rows):
        if d == 7:  # repeated rows: next is a copy for some
            continue
        following = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = by_id[None if d == -(1 << 63) else d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        likeness = lambda a, b: sum((a & b).values()) / sum((a | b).values())
        errors += [r.near_edited - likeness(counts(t), counts(edited)), r.near_next - likeness(counts(t), counts(following))]
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.12
    assert len({r.fingerprint for r in got if r.doc_id in (100, 101, 3)}) == 1
    assert fingerprints.edited_prints(none).count() == 0
    heavy = spark.createDataFrame([(1, "a b c d e " * 40 + "x y z"), (2, "a b c d e " * 20 + "x y z")], "doc_id bigint, text string")
    a, b = (r.fingerprint for r in fingerprints.fingerprint(heavy, 128).orderBy("doc_id").collect())
    same = sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 1024, 8)) / 128
    ca, cb = counts("a b c d e " * 40 + "x y z"), counts("a b c d e " * 20 + "x y z")
    assert same == pytest.approx(sum((ca & cb).values()) / sum((ca | cb).values()), abs=0.15)


def test_fingerprints_in_many_ranges_find_the_next_document(docs):
    few, many = fingerprints.with_next(docs, 10**6), fingerprints.with_next(docs, 5)
    key = lambda df: Counter((r.doc_id, r.text, r.next_text) for r in df.filter("ghost = 0").collect())
    assert key(few) == key(many)


def test_language_id_on_held_out_documents(spark, none):
    rng = random.Random(4)
    make = {"aa": "abcde", "bb": "defgh", "cc": "éèàxyz"}
    rows = [(i, " ".join("".join(rng.choices(make[lang], k=5)) for _ in range(8)), lang) for i, lang in enumerate(rng.choices(list(make), k=300))]
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None), (903, "abc abd " * 60000, None), (None, "abcd", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[d].lang_pred == lang for d, _, lang in held]) > 0.95
    assert [got[d].lang_pred for d in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and got[900].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.keep_identified(df).count() == len(rows) - 3
    assert langid.identify(none).count() == 0 and langid.fit(none) is None


def test_language_id_against_sums_by_hand(spark):
    """The posterior of a multinomial naive Bayes with an even prior, from counted grams (none of these share a bucket)."""
    rows = [(1, "ab ab", "x"), (3, "ba", "y"), (4, "abc", None), (5, "ab", None), (7, "zz", None), (9, "Ba b", None), (11, "cab ab", "x")]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    grams = lambda t: Counter(f" {t.lower()} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n))
    bucket = lambda g: int(next(itertools.islice(langid._buckets(np.frombuffer(g.encode("utf-32-le"), np.uint32), 1), len(g) - 1, None))[0])
    every = {g for _, t, _ in rows for g in grams(t)}
    assert len({bucket(g) for g in every}) == len(every)
    seen = {lang: sum((grams(t) for _, t, x in rows if x == lang), Counter()) for lang in ("x", "y")}
    assert all(seen.values())
    log_p = lambda g, lang: np.log(seen[lang][g] + langid.SMOOTHING) - np.log(sum(seen[lang].values()) + langid.BUCKETS * langid.SMOOTHING)
    for r in langid.identify(df).collect():
        total = {lang: sum(n * log_p(g, lang) for g, n in grams(r.text).items()) for lang in ("x", "y")}
        best = max(total, key=lambda x: (total[x], x == "x"))
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(np.exp(v - total[best]) for v in total.values()), abs=1e-4)
    tied = spark.createDataFrame([(1, "q", "y"), (3, "q", "x"), (4, "q", None)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in langid.identify(tied).collect()} == {"x"}


def test_rare_languages_are_learned(spark):
    rows = [(i, "abc abd", "aa") for i in range(400)] + [(1000 + i, "xyz xyw", "rare") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert langid.fit(df, rows=20)[0] == ["aa", "rare"]


CLASH = ["mix_pass", "mix_words", "mix_size", "mix_text", "mix_shard", "score", "lang_pred", "row", "rows", "h", "norm", "id", "tk", "k", "s", "c", "turn", "node", "label", "key", "block", "size", "n_tokens", "range", "place", "text_key", "part", "digest", "best"]


def test_stages_keep_clashing_columns(spark, docs):
    odd = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASH])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, odd, "").cache(), stage(spark, docs, "")
        assert got.columns == odd.columns, name
        assert Counter(map(tuple, got.select(*docs.columns).collect())) == Counter(map(tuple, plain.collect())), name
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in got.collect() for c in CLASH), name
    key = lambda df: Counter(map(tuple, df.collect()))
    assert key(bpe.digest_documents(odd)) == key(bpe.digest_documents(docs))
    assert key(fingerprints.edited_prints(odd.filter("doc_id <> 7"))) == key(fingerprints.edited_prints(docs.filter("doc_id <> 7")))
    assert key(exact_dedup.exact_groups(odd)) == key(exact_dedup.exact_groups(docs))
    assert key(mixing.taken_of(odd)) == key(mixing.taken_of(docs))
    assert set(mixing.MIX) < set(mixing.mix(odd).columns)


def test_least_and_null_ids(spark):
    low = -(1 << 63)
    rows = [(low, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "lone"), (low, "g h"), (low + 1, "g h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == Counter([(low, low, 3, True), (1, low, 3, False), (None, low, 3, False), (None, None, 1, True), (low, low, 2, True), (low + 1, low, 2, False)])
    near = Counter((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_classes(df).collect())
    assert near == Counter([(low, low, low, 0), (1, low, low, 0), (None, low, low, 0), (None, None, None, 0), (low, low, low, 0), (low + 1, low, low, 0)])
    assert ngram_join.keep_one(df).count() == exact_dedup.keep_first(df).count() == 3


def test_hot_groups_stay_where_they_are(spark, docs, monkeypatch):
    key = lambda df: Counter(map(tuple, df.collect()))
    exact, near = key(exact_dedup.exact_groups(docs)), key(ngram_join.near_classes(docs))
    hub = spark.createDataFrame([(i, 1000) for i in range(30)] + [(i, i + 200) for i in range(10)], "a bigint, b bigint")
    monkeypatch.setattr(common, "HOT", 2)
    assert key(exact_dedup.exact_groups(docs)) == exact and key(ngram_join.near_classes(docs)) == near
    assert {r.label for r in components.components(hub).collect()} == {0}
    monkeypatch.setattr(common, "SENT", 0 + 1)  # hashes too many to be sent: all texts are grouped
    assert key(exact_dedup.exact_groups(docs)) == exact


def test_near_pairs_are_found_at_the_promised_rate(spark):
    """Pairs of texts at a similarity of exactly 0.8, found by the sampled search alone."""
    assert ngram_join.pair_missed(ngram_join.runs_needed()) <= 1 - ngram_join.RECALL
    rows = []
    for i in range(600):
        base = words(49, i).split()  # 45 shingles; 5 of them change with the last word of 5: 40 / 50
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(["zz", *base[1:44], "yy", *base[45:]]))]
    sets = [set(ngram_join.shingles(ngram_join.words_of(t)).tolist()) for _, t in rows]
    exact = {i for i in range(0, 1200, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in ngram_join.near_classes(df).collect() if r.n_links == 1 and r.doc_id % 2 == 0}
    assert got <= exact and len(got) >= 0.99 * len(exact)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(str, got.select(*want.columns).collect())) == Counter(str(Row(**dict(zip(want.columns, r)))) for r in want.fetchall())


def test_documents_without_any_label_stay(docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("extra", F.lit(1))
    got = langid.keep_identified(bare)
    want = Counter((d, t, None, s, n, 1) for d, t, _, s, n in corpus() if langid.has_letter(t))
    assert got.columns == bare.columns and Counter(map(tuple, got.collect())) == want and len(want) > 30
    held = bare.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "en"))  # labels, but none to learn from
    assert Counter(r.lang for r in langid.keep_identified(held).collect())["en"] > 0
    assert langid.keep_identified(held).count() == sum(want.values())


def test_mixing_meets_targets(docs, none):
    got = mixing.mix_plan(docs).collect()
    size = Counter()
    for _, t, _, s, _ in corpus():
        size[s] += len([w for w in WHITE.split(t or "") if w])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_ = 1.5 * sum(size.values()), set(names)
    target = {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    target |= share
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.mix_source], abs=1e-5) and r.source_size == size[r.mix_source]
        assert 0 <= sum(r.takes) <= 2 * r["size"]
        taken[r.mix_source] += sum(r.takes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    mixed = mixing.mix(docs, shards=5)
    rows = mixed.collect()
    assert sum(r.mix_words for r in rows) == sum(taken.values()) and {r.mix_shard for r in rows} <= set(range(5))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(2), shards=5).collect()))
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns and sum(len([w for w in WHITE.split(r.text) if w]) for r in again.collect()) == sum(taken.values())
    assert mixing.mix_plan(none).count() == mixing.mixed_documents(none).count() == 0


def test_mix_is_dealt_to_shards_in_order(spark, docs, monkeypatch):
    rows = mixing.mix(docs, shards=5).withColumn("at", F.spark_partition_id()).collect()
    assert len({r.mix_shard for r in rows}) > 1 and all(r["at"] == r.mix_shard for r in rows)
    places = defaultdict(list)
    for r in rows:
        places[r.mix_shard].append(r.mix_place)
    assert all(p == sorted(p) for p in places.values())
    key = lambda rs: Counter((r.doc_id, r.mix_pass, r.mix_words, r.mix_shard, r.mix_place) for r in rs)
    monkeypatch.setattr(mixing, "SENT_BLOCKS", 0)
    assert key(mixing.mix(docs, shards=5).collect()) == key(rows)
    want = [(r.doc_id, r.mix_words, r.mix_place) for s in sorted(places) for r in sorted((x for x in rows if x.mix_shard == s), key=lambda x: x.mix_place)]
    assert [(r.doc_id, r.mix_words, r.mix_place) for r in rows] == want


def test_mixing_query_reads_the_dealt_mix(docs, none, monkeypatch):
    kept = []
    store = common.stored
    monkeypatch.setattr(mixing.common, "stored", lambda df, name: kept.append((name, store(df, name))) or kept[-1][1])
    key = lambda rs: Counter(tuple(r) for r in rs)
    got = mixing.taken_of(docs, shards=5).collect()
    assert key(got) == key(mixing.mix_plan(docs).select("mix_id", "size", "source_size", "target", F.expr("takes[0] + takes[1]")).collect())
    shards = dict(kept)["mix-shards"].collect()
    assert len({r.mix_shard for r in shards}) > 1 and sum(r.mix_words for r in shards) == sum(r.taken for r in got)
    assert key((r.doc_id, r.mix_pass, r.mix_words, r.mix_shard) for r in mixing.mix(docs, shards=5).collect()) == key((r.mix_id, r.mix_pass, r.mix_words, r.mix_shard) for r in shards)
    assert mixing.taken_of(none).count() == 0


def test_splitting_tree_keeps_quotas():
    quotas = [1000, 0, 37, 5]
    tree = np.array(mixing.splitting_tree(quotas, 7, 3))
    assert tree.sum(axis=0).tolist() == quotas and tree.min() >= 0
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 4


def test_token_files_round_trip(spark, docs, none, tmp_path):
    ids = np.concatenate([np.arange(600), np.random.default_rng(0).integers(0, 2**32 - 1, 900)]).astype(np.uint32)
    block = token_store.Block(token_store.pack(ids, np.array([600, 0, 900])))
    assert [block.token(i) for i in range(1500)] == ids.tolist()
    for lo, hi in ((0, 1500), (7, 7), (511, 514), (600, 1500)):
        assert (block.tokens(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(IndexError):
        block.token(1500)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    out = str(tmp_path / "tokens")
    token_store.write_tokens(docs, out, rows_each=7)
    got = token_store.read_tokens(spark, out).collect()
    total, want = 0, Counter()
    for d, t in sorted(((r[0], r[1]) for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0)):
        mine = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[d, total, len(mine), zlib.crc32(np.array(mine, "<u4").tobytes())] += 1
        total += len(mine)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    token_store.write_tokens(none, str(tmp_path / "none"))
    assert token_store.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_minimum_cut_is_optimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = defaultdict(dict)
        for i, j in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[i][j] = edges[j][i] = rng.random()
        cost = lambda x: sum(w for i in edges for j, w in edges[i].items() if i < j and x[i] != x[j]) - sum(g for g, y in zip(gain, x) if y)
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_text.cut(gain, edges)) == pytest.approx(best, abs=1e-4)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="page with-sidebar"><article><h1>Head &amp; line</h1><p>First   part<br>of it, with <b>bold</b>ness.<p>Second &eacute;&nbsp;one.
<form><input>Sign up now</form><section id="comments"><p>A reader writes a rather long comment here, to be left out.</p></section></article>
<aside>Other</aside><footer>&copy; us</footer>"""


def test_main_text(spark):
    w = html_text.PRIOR
    assert html_text.main_text(PAGE, w) == "Head & line\nFirst part of it, with boldness.\nSecond é one."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>a</nav>"), (5, "u", "<" * 5000), (None, "u", PAGE), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(df).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3, 4)] == [""] * 3
    assert html_text.extract(df.limit(0)).count() == 0


def test_long_pages_and_formulas(spark):
    w = html_text.PRIOR
    prose = "A sentence of some length, written for readers, and it goes on for a while. "
    page = "<nav><a>x</a></nav><article>" + "".join(f"<p>{i}. {prose}</p>" for i in range(20000)) + "</article>"
    assert html_text.main_text(page, w).count("\n") == 19999
    formula = f"<article><p>{prose}<math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> holds.</p></article>"
    assert html_text.main_text(formula, w) == f"{prose}a+b holds."
    df = spark.createDataFrame([(1, "u", page), (2, "u", formula)], "page_id bigint, url string, html string")
    assert [r.n_chars > 0 for r in html_text.extract(df).collect()] == [True, True]


def test_the_cut_and_the_classifier_decide():
    """Without marks (article, nav, names) the classifier labels, and the cut mends what it gets wrong alone."""
    prose = "A sentence of some length, written for readers, and it goes on for a while. It has a second part, too."
    page = "<div><div><a href=x>Home</a></div><div><a href=y>News</a></div></div>" + f"<div><p>{prose}</p><p>{prose}</p><div>One word</div><p>{prose}</p></div>"
    blocks = html_text.blocks_of(page)
    alone = [bool(x > 0) for x in html_text.features(blocks) @ html_text.PRIOR]
    both = html_text.labels(blocks, html_text.PRIOR)
    assert both == [False, False, True, True, True, True] and alone == [False, False, True, True, False, True]
    assert html_text.labels(html_text.blocks_of(page), np.zeros(len(html_text.NAMES))) != both


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="driver tables are not here")
def test_pages_without_marks_are_labelled_alike(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_text.fit(pages.filter("page_id % 2 = 0"))
    good = total = 0
    for r in pages.filter("page_id % 2 = 1").collect():
        main = set(html_text.main_text(r.html, weights).split("\n"))
        bare = re.sub(r"<div [^>]*>", "<div>", re.sub(r"<(/?)(article|main|nav|footer|aside|header|section)\b[^>]*>", r"<\1div>", r.html))
        blocks = html_text.blocks_of(bare)
        good += sum((b.text in main) == kept for b, kept in zip(blocks, html_text.labels(blocks, weights)))
        total += len(blocks)
    assert good > 0.97 * total > 0


def test_names_cost_but_do_not_bind():
    w = html_text.PRIOR
    prose = "This is a sentence of some length, written for readers, and it goes on for a while. It has a second part, too."
    body = f"<h1>Title</h1><p>{prose}</p><p>Again. {prose}</p>"
    whole = f"Title\n{prose}\nAgain. {prose}"
    side = '<div class="sidebar"><p>Other posts</p></div>'
    for start in ('<div id="page" class="site sidebar-right">', '<div class="post comments-open">'):
        assert html_text.main_text(f"{start}<article>{body}</article></div>{side}", w) == whole
        assert prose in html_text.main_text(f"{start}{body}</div>{side}", w)
        assert "Other posts" not in html_text.main_text(f"{start}{body}</div>{side}", w)
    for part in ('<h2 id="social-impact">Impact</h2>', f'<section id="related-work"><p>Related. {prose}</p></section>', f'<div class="search-algorithms"><p>Search. {prose}</p></div>'):
        assert len(html_text.main_text(f"<article>{body}{part}</article>", w).split("\n")) == 4
    comments = f'<div id="comments"><ol class="comment-list"><li><article class="comment-body"><p>Reply. {prose} {prose}</p></article></ol></div>'
    assert html_text.main_text(f"<article>{body}{comments}</article>", w) == whole
    cards = "<div><article><a href=x>Card one</a></article><article><a href=y>Card two</a></article></div>"
    assert prose in html_text.main_text(f"<div>{body}</div>{cards}", w)
    assert html_text.main_text(f"<article><svg/><svg a='b' c/>{body}<math display='block'/></article>", w) == whole
    assert html_text.main_text(f"<article>{body}<svg a=b/>no</svg></article>", w) == whole
    assert html_text.EVIDENCE < html_text.LIMIT


def test_revisits_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        revisit = rng.random() < 0.5
        head = {"etag": rng.choice(['"a"', 'W/"a"', '"b"']), "date": str(i), "content-length": "9"} if rng.random() < 0.8 else {"last-modified": rng.choice("xy")}
        rows.append((i, rng.choice(["http://A.com/x/", "https://www.a.com/x?utm_source=f#t", "http://b.com", None]), rng.choice([None, *range(60)]), revisit, head, f"d{i}", i))
    rows += [(500, "http://b.com", 5, None, None, None, None), rows[3]]
    df = spark.createDataFrame(rows, "record_id bigint, url string, warc_time bigint, is_revisit boolean, headers map<string,string>, digest string, length bigint").withColumn("k", F.lit(0))
    got = {r.record_id: r for r in revisits.resolve(df, span=7).collect()}
    key = {"http://A.com/x/": "a.com/x", "https://www.a.com/x?utm_source=f#t": "a.com/x", "http://b.com": "b.com", None: None}
    plain = lambda tag: tag.removeprefix("W/")
    seen = Counter()
    for i, url, t, revisit, head, digest, length in rows:
        r, head = got[i], head or {}
        assert r.url_key == key[url]
        if not revisit:
            assert (r.status, r.source_id, r.merged) == ("full", i, head)
            continue
        before = [x for x in rows if not x[3] and key[x[1]] == key[url] and url and t is not None and x[2] is not None and (x[2], x[0]) < (t, i)]
        if not before:
            assert (r.status, r.source_id) == ("orphan", None)
        else:
            b = max(before, key=lambda x: (x[2], x[0]))
            old = b[4] or {}
            same = plain(old["etag"]) == plain(head["etag"]) if "etag" in old and "etag" in head else "last-modified" in old and old["last-modified"] == head.get("last-modified")
            assert r.status == ("resolved" if same else "mismatch")
            if same:
                assert (r.source_id, r.source_digest) == (b[0], b[5])
                assert r.merged == {**old, **{k: v for k, v in head.items() if k in revisits.PERMITTED}}
        seen[r.status] += 1
    assert min(seen[s] for s in ("resolved", "mismatch", "orphan")) > 0
    assert revisits.resolve(df.limit(0)).count() == 0


def test_transcripts_recover_roles(spark):
    rng = random.Random(8)
    rows = []
    for c in range(80):
        for t in range(rng.randint(2, 6)):
            role = ("user", "assistant")[t % 2]
            rows.append((c, t, role, words(6, c * 10 + t) + "?" if role == "user" else f"{words(40, c * 10 + t)}.\n{words(30, c + t)}."))
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = transcripts.transcripts(turns)
    model = transcripts.fit(parts)
    got = {(r.conv_id, r.part): r for r in transcripts.parse(parts.drop("role"), model).collect()}
    held = [(c, t, role) for c, t, role, _ in rows if zlib.crc32(str(c).encode()) % 4 == 2]
    assert np.mean([got[c, t].role_pred == role for c, t, role in held]) > 0.9
    odd = spark.createDataFrame([(1, 0, None), (1, 0, None), (None, None, ""), (2, -3, "User: hi\n"), (2, 5, "x" * 10000)], "conv_id bigint, part bigint, raw string").withColumn("seg", F.lit("clash"))
    assert transcripts.parse(odd, model).count() == 5
    assert transcripts.parse(odd.limit(0), model).count() == 0


def test_long_transcripts_are_cut_without_change(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["User: ", "Assistant: ", ""]) + words(rng.randint(1, 30), t)) for t in range(90)] + [(8, 0, "Q: a?")]
    df = spark.createDataFrame(rows, "conv_id bigint, part bigint, raw string")
    labelled = df.withColumn("role", F.when(F.col("part") % 2 == 0, "user").otherwise("assistant"))
    model = transcripts.fit(labelled)
    whole = sorted(map(str, transcripts.parse(df, model).collect()))
    monkeypatch.setattr(transcripts, "RANGE", 4)
    assert sorted(map(str, transcripts.parse(df, model).collect())) == whole
    assert transcripts.in_ranges(df)[0].select("range").distinct().count() > 8
    monkeypatch.setattr(transcripts, "CHUNK", 16)
    assert transcripts.fit(labelled).roles == model.roles


def test_transcripts_take_the_best_path(spark):
    """Against all paths of small transcripts, and the rendered form written out by hand."""
    rng = random.Random(3)
    n = 4
    emit = [np.log(np.array([[rng.uniform(0.1, 1) for _ in range(n)] for _ in range(k)])) for k in transcripts.SIZES]
    model = transcripts.Model(["a", "b"], np.log([0.01, 0.5, 0.01, 0.48]), np.log([[rng.uniform(0.1, 1) for _ in range(n)] for _ in range(n)]), emit)
    rows = []
    for c in (None, -(1 << 63), 3, 4):
        for part in range(rng.randint(1, 3)):
            rows.append((c, part, "\n".join(rng.choice(["User: hi?", "bot: " + "x" * 50, "", "Go on."]) for _ in range(rng.randint(1, 2)))))
    df = spark.createDataFrame(rows, "conv_id bigint, part bigint, raw string")
    got = {(r.conv_id, r.part): r for r in transcripts.parse(df, model).collect()}
    assert len(got) == len(rows)
    for c in {r[0] for r in rows}:
        parts = sorted((p, raw) for x, p, raw in rows if x == c)
        lines = [(p, line) for p, raw in parts for line in raw.split("\n")]
        seen = [transcripts.observed(x) for _, x in lines]
        cost = lambda path: model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(e[v, s] for s, o in zip(path, seen) for e, v in zip(emit, o))
        best = max(itertools.product(range(n), repeat=len(lines)), key=cost)
        out, opened = {p: [] for p, _ in parts}, False
        for s, (p, line) in zip(best, lines):
            if s % 2:
                out[p] += ["<|end|>"] * opened + [f"<|{'ab'[s // 2]}|>"]
                opened, line = True, transcripts.stripped(line)
            out[p].append(line)
        out[parts[-1][0]].append("<|end|>")
        for p, _ in parts:
            mine = [s for s, (q, _) in zip(best, lines) if q == p]
            assert (got[c, p].role_pred, got[c, p].n_begun, got[c, p].rendered) == ("ab"[mine[0] // 2], sum(s % 2 for s in mine), "\n".join(out[p]))


def test_pipeline_stages(spark, docs, none):
    table, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        table = common.stored(stage(spark, table, ""), name)
        seen.append(table.count())
        if name != "encode":
            assert table.columns == docs.columns
    texts = {WHITE.sub("", r[1] or "") for r in corpus()}
    assert seen[0] == len(corpus()) - 4 and seen[1] == len(texts) - 2 and seen[2] == seen[1] - 4 and seen[3] == seen[4] > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_pipeline_mixes_whole_documents(spark, docs):
    texts = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect())
    plan = mixing.mix_plan(docs).select("row.*", "mix_source", "block", "key", "mix_id", F.col("size").alias("n"), "source_size", "target").collect()
    want = Counter()
    for s in {r.mix_source for r in plan}:
        walk = sorted((r for r in plan if r.mix_source == s), key=lambda r: (r.key, r.mix_id is not None, r.mix_id or 0, r.n))
        done, goal = 0, int(walk[0].target + 0.5)
        for r in walk + walk:
            # nearer to the target with the document than without it, the longer walk on ties
            if r.n and done < goal and abs(done + r.n - goal) <= goal - done:
                want[r.doc_id, r.text, r.lang, r.source, r.n_chars] += 1
            done += r.n
    rows = corpus_pipeline.mix_sources(spark, docs, "").collect()
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)
    assert got == want and set(got) <= set(texts)
    cut = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in mixing.mixed_documents(docs).collect())
    assert any(k not in texts for k in cut)  # some walk ends inside a document


def test_every_operator_has_a_query():
    assert sorted(int(q.split("_")[0][2:]) for q in queries.QUERIES) == list(range(1, 11))
