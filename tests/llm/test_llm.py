"""The training-data operators on hand-made and random fixtures, against brute force, exact round trips or the library."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import ann, bpe, components, html_extract, language, line_dedup, mixing, ngram_join, quality, substring_dedup, toxicity
from tidemark.llm import queries as registry
from tidemark.llm.common import lower_ascii, window_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it for was alpha beta gamma delta omega sigma kappa river stone cloud house tree light night".split()
LONG = " ".join(WORDS[i * i % len(WORDS)] for i in range(30_000))


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows."""
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, LONG, "en", "a", len(LONG)), (3, "Hello world", "en", None, 11), (3, "Hello world", "en", None, 11), (None, "x y z", None, "b", 5), (5, " \n\t ", "de", "b", 4)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_queries_are_registered():
    found = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(found)


# 1: BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    own, other = bpe.load(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    pool = [chr(c) for c in range(32, 0x2FF)] + list("aeiouthsn '") * 80 + ["<|endoftext|>"] * 20 + list(" \t\n\r\x0b\x0c\x1c\x85\xa0") * 10 + ["\U0001f600", "日", "本"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(1500)] + ["", "a" * 6000, " " * 500, "<|endoftext|>", LONG]
    got = own.encode_batch(texts)
    assert got == [",".join(map(str, e.ids)) for e in other.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(bpe._ids(g)) for g in got] == texts


def test_bpe_splits_every_character_like_the_library():
    from tokenizers import pre_tokenizers

    own, other = bpe.load(bpe.default_vocabulary()), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1{chr(code)}! {chr(code)}{chr(code)} b"
            assert ["".join(own.alphabet[b] for b in w.encode()) for w in own.cut(text)] == [w for w, _ in other.pre_tokenize_str(text)], hex(code)


def test_bpe_one_text_of_several_megabytes(spark):
    text = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 997) for i in range(400_000))
    got = bpe.round_trip(frame(spark, [text])).first()
    assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got.n_tokens > 400_000


def test_bpe_pair_check_agrees_with_merging():
    b = bpe.load(bpe.default_vocabulary())
    rng = np.random.default_rng(1)
    a, c = rng.integers(0, 5000, 3000), rng.integers(0, 5000, 3000)
    reach = [i for i in range(3000) if b.merge(b.piece[a[i]]) == [a[i]] and b.merge(b.piece[c[i]]) == [c[i]]]
    ok = b.compatible(a[reach], c[reach])
    for k, i in enumerate(reach):
        assert ok[k] == (b.merge(b.piece[a[i]] + b.piece[c[i]]) == [a[i], c[i]])


def test_bpe_frames(spark, odd):
    got = {r.doc_id: r for r in bpe.round_trip(odd).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[0].ids_sha256 == got[1].decoded_sha256 == nothing
    assert got[2].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and bpe.round_trip(odd).count() == 7
    clash = odd.withColumn("token_ids", F.lit("mine")).withColumn("decoded", F.lit(1))
    back = bpe.decode(bpe.encode(clash)).orderBy("n_chars").collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == 7
    assert bpe.round_trip(empty(spark)).count() == 0


# 2: line dedup


def brute_lines(texts, least):
    """All runs of lines with enough words that occurred before, by definition."""
    seqs = []
    for t in texts:
        seqs.append([(k, x.strip(" \t\r\f\v"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)])
    first, gone = {}, [set() for _ in texts]
    for d, s in enumerate(seqs):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                run = tuple(x[1] for x in s[i:j])
                if sum(x[2] for x in s[i:j]) >= least and first.setdefault(run, (d, i)) != (d, i):
                    gone[d] |= {x[0] for x in s[i:j]}
    return gone


def test_line_dedup_against_definition(spark):
    rng = random.Random(5)
    pool = ["one", "two words", "three words here", "a line of five words", "yes", "no", "a much longer line with many words in it"]
    texts = ["\n".join(rng.choice([*pool, "", "  one "]) if rng.random() < 0.7 else words(rng, rng.randrange(1, 6)) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, ""]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for d, gone in enumerate(brute_lines(texts, line_dedup.MIN_WORDS)):
        assert got[d]["_n_removed"] == len(gone), d
        kept = "\n".join(x for k, x in enumerate((texts[d] or "").split("\n")) if k not in gone)
        want = texts[d] if not gone else kept if re.search(r"[^\x20\x09-\x0D]", kept) else ""
        assert got[d].text == want


def test_line_dedup_keeps_clashing_names(spark, odd):
    clash = odd.withColumn("_d", F.lit(1)).withColumn("_drop", F.lit(2)).withColumn("_h", F.lit(3)).withColumn("_n_lines", F.lit("x"))
    out = line_dedup.dedup_lines(clash)
    assert {"_d", "_drop", "_h"} <= set(out.columns) and len(out.columns) == len(set(out.columns)) and {r["_drop"] for r in out.collect()} == {2}


def test_line_dedup_odd_rows(spark, odd):
    clash = odd.withColumn("ids", F.lit(1)).withColumn("words", F.lit("w")).withColumn("i", F.lit(2)).withColumn("name", F.lit(3))
    out = line_dedup.dedup_lines(clash)
    assert out.count() == 7 and set(clash.columns) < set(out.columns)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    one = frame(spark, ["same line of five words\nown words of mine here", "same line of five words\nother words of mine here"])
    assert [r.text for r in line_dedup.dedup_lines(one).orderBy("doc_id").collect()][1] == "other words of mine here"


# 3: mixing


def water(sizes, weights, share):
    caps, goal = [2 * s for s in sizes], share * sum(sizes)
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for c, w in zip(caps, weights)) < goal else (low, mid)  # noqa: B905
    return [min(c, low * w) for c, w in zip(caps, weights)]  # noqa: B905


def test_mixing_targets_and_limits(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 30)), None, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None, 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, block_docs=32, shard_words=3000).toPandas()
    assert len(got) == 3000 and (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    assert (got.shards.map(len) == got.copies).all()
    per = got.assign(key=got.source.fillna("~")).groupby("key").agg(size=("size", "sum"), source=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    want = water(per["size"].tolist(), [3, 1, 2, 3, 1, 2, 3, 1, 2][: len(per)], 1.5)
    assert (per["size"] == per.source).all() and np.allclose(per.target, want) and (abs(per.taken - per.target) <= 30).all()
    shard = {}
    for n, s in zip(got["size"], got.shards):  # noqa: B905
        for x in s:
            shard[x] = shard.get(x, 0) + n
    assert max(shard.values()) < 2.5 * min(shard.values())
    again = mixing.mix(docs.repartition(7), block_docs=32, shard_words=3000).toPandas()
    a, b = got.sort_values("doc_id"), again.sort_values("doc_id")
    assert a.taken.tolist() == b.taken.tolist() and [list(x) for x in a.shards] == [list(x) for x in b.shards]


def test_mixing_odd_rows(spark, odd):
    clash = odd.withColumn("copies", F.lit(9))
    got = mixing.mix(clash).toPandas()
    assert len(got) == 7 and (got[got.doc_id.isin([0, 1, 5])].taken == 0).all()
    assert mixing.mix(empty(spark)).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns


def test_mixing_of_repeated_and_null_ids(spark):
    repeated = spark.createDataFrame([(7, "two words", None, "a", 0)] * 600, DOCS)
    nulls = spark.createDataFrame([(None, f"{i} words", None, "a", 0) for i in range(600)], DOCS)
    same_id = spark.createDataFrame([(7, f"{i} words", None, "a", 0) for i in range(600)], DOCS)
    for docs in (repeated, nulls, same_id):
        got = mixing.mix(docs, block_docs=32).toPandas()
        assert len(got) == 600 and abs(got.taken.sum() - 1800) <= 2 and set(got.copies) == {1, 2}
        again = mixing.mix(docs.repartition(5), block_docs=32).toPandas()
        assert sorted(again.copies) == sorted(got.copies)


def test_mixing_fills_what_a_long_document_leaves(spark):
    rows = [(i, words(random.Random(i), 7), None, "a", 0) for i in range(400)] + [(1000, LONG[:6_000], None, "a", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block_docs=16).toPandas()
    assert abs(got.taken.sum() - got.target.iloc[0]) <= 7


def test_mixing_keeps_clashing_names(spark, odd):
    clash = odd.withColumn("_h", F.lit(1)).withColumn("_u", F.lit(2)).withColumn("target", F.lit("x")).withColumn("_sidx", F.lit(3))
    out = mixing.mix(clash)
    assert {"_h", "_u", "_sidx"} <= set(out.columns) and len(out.columns) == len(set(out.columns)) and {r["_h"] for r in out.collect()} == {1}
    assert mixing.mixed_documents(clash).columns == clash.columns


def test_hypergeometric_draws(spark):
    df = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), mixing._uniform(F.lit(1), "id")).alias("x"))
    x = np.array([r.x for r in df.collect()])
    assert x.min() >= 0 and x.max() <= 10 and abs(x.mean() - 4.0) < 0.1 and abs(x.var() - 10 * 0.4 * 0.6 * 40 / 49) < 0.2
    q = spark.createDataFrame([(0, 37), (1, 5), (2, 100)], "_sidx int, quota long")
    out = mixing.split_quotas(q, 3).toPandas()
    assert out.groupby("_sidx").quota.sum().to_dict() == {0: 37, 1: 5, 2: 100} and out.groupby("_shard").quota.sum().between(17, 18).all()


# 4: language


def test_language(spark):
    rng = random.Random(2)
    make = {"en": "the house and that they with when", "de": "das haus und nicht für über schön", "fr": "la maison qui les être déjà", "es": "la casa que los niño está más", "xx": "qzx wvq zzxq xwv"}
    rows = [(i, " ".join(rng.choice(make[k].split()) for _ in range(12)), k, "s", 0) for i in range(400) for k in [list(make)[i % 5]]]
    docs = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "123 !!", "en", "s", 0), (902, "", None, "s", 0)], DOCS)
    model = language.learn(docs, F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(docs, language.learn(docs, F.lit(False))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.predict(empty(spark), model).count() == 0


def test_language_of_repeated_rows_one_language_and_clashing_names(spark):
    rows = [(None, "the house and that", "en", "s", 0)] * 1500 + [(i, f"das haus und nicht {i}", "de", "s", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_o", F.lit("x")).withColumn("o", F.lit(1)).withColumn("_cut", F.lit(2))
    model = language.learn(docs, F.lit(True), 20)
    got = {(r.doc_id is None, r.lang_pred) for r in language.predict(docs, model).collect()}
    assert got == {(True, "en"), (False, "de")}
    one = spark.createDataFrame(rows[:3], DOCS)
    assert {(r.lang_pred, r.score) for r in language.predict(one, language.learn(one, F.lit(True))).collect()} == {("en", 1.0)}


# 5: toxicity


def test_toxicity(spark):
    rng = random.Random(4)
    bad, rows, labels = ["grumpf", "zorkel"], [], []
    for i in range(900):
        y = int(rng.random() < 0.3)
        t = words(rng, 60).split()
        if y:
            for _ in range(3):
                t[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "en", "ish"])
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, y))
    docs = spark.createDataFrame([*rows, (2000, None, None, None, None), (2001, "", None, None, None), (2002, LONG, None, None, None)], DOCS)
    table = spark.createDataFrame([*labels, (2000, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs.withColumn("toxicity", F.lit("x")), model).collect()}
    held = [(got[i], y) for i, _, y in labels if i % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95 and all(0 <= s <= 1 for s in got.values()) and got[2002] < 0.5
    none = toxicity.fit(docs, table.where("false"), F.lit(True))
    assert {r.toxicity for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_of_repeated_rows_and_one_class(spark):
    docs = spark.createDataFrame([(1, "you idiot", None, None, 0)] * 5 + [(2, "fine words", None, None, 0)] * 5, DOCS)
    both = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, both, F.lit(True))).collect()} == {1.0}
    assert {r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, both.where("toxic = 0"), F.lit(True))).collect()} == {0.0}


def test_disguised_words():
    assert toxicity.plain("1d10t!")[0] == "idiot" and toxicity.plain("i.d.i.o.t")[0] == "idiot" and toxicity.plain("STUUUPID")[0] == "stupid"


# 6: n-gram join


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, [len(s) for s in sets]


@pytest.mark.parametrize("k,percent,task", [(3, 90, 10**6), (5, 80, 10**6), (3, 90, 600)])
def test_ngram_join_against_all_pairs(spark, k, percent, task):
    rng = random.Random(k)
    texts = [None, "", "one", "ONE", "two words", "x"]
    for _ in range(25):
        base = words(rng, rng.choice([4, 12, 30, 90])).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 25) + 1)):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            texts.append(" ".join(t))
    got = {r.doc_id: r for r in ngram_join.similar(frame(spark, texts).select("doc_id", "text"), k, percent, task).collect()}
    root, sizes = brute_components(texts, k, percent)
    assert [got[i].component_id for i in range(len(texts))] == root and [got[i].n_shingles for i in range(len(texts))] == sizes


def test_ngram_join_odd_rows(spark, odd):
    got = ngram_join.similar(odd.select("doc_id", "text")).collect()
    assert len(got) == 7 and {r.component_id for r in got if r.doc_id == 3} == {3}
    assert ngram_join.similar(empty(spark).select("doc_id", "text")).count() == 0


def test_ngram_join_of_null_and_repeated_ids_and_hot_groups(spark):
    rng = random.Random(3)
    base = words(rng, 60).split()
    near = [" ".join(w if k != i % 60 else f"x{i}" for k, w in enumerate(base)) for i in range(40)]  # one large group
    rows = [(None, t) for t in near[:10]] + [(5, near[10]), (5, near[11]), (5, "another text of its own here")] + [(100 + i, t) for i, t in enumerate(near[12:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("place", F.lit(1))
    for task in (10**6, 500):
        got = ngram_join.similar(docs, 3, 80, task).collect()
        assert len(got) == len(rows) and len({r.component for r in got}) == 2
        assert {r.component_id for r in got if r.doc_id != 5} == {5}


@pytest.mark.parametrize("percent", [70, 60, 50])
def test_ngram_join_below_eighty_percent(spark, percent):
    rng = random.Random(percent)
    rows = []
    for i in range(60):
        base = words(rng, 102).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: percent + 2]))]  # sets of 100 and of percent shingles
    got = {r.doc_id: r.component_id for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(60))


def test_keys_share_one_whatever_is_common():
    rng = np.random.default_rng(4)
    shingles = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    short = np.sort(ngram_join.mix64(shingles[:900] ^ ngram_join._ODD) >> np.uint64(24 - 8))
    for common in ((np.empty(0, np.uint64), np.empty(0, np.int64)), (short, rng.integers(9, 99, 900))):
        for percent in (50, 80, 90):
            for _ in range(60):
                n = int(rng.integers(2, 300))
                a = np.unique(rng.choice(shingles, n, replace=False))
                b = a[: -(-n * percent // 100)]
                assert set(ngram_join.keys(a, percent, common, 8).tolist()) & set(ngram_join.keys(b, percent, common, 8).tolist())


@pytest.mark.parametrize("percent", [1, 50, 80, 90, 100])
def test_linked_sets_share_as_many_keys_as_asked(percent):
    rng = np.random.default_rng(percent)
    shingles = rng.integers(0, 1 << 62, 9000).astype(np.uint64)
    short = np.sort(ngram_join.mix64(shingles[:3000] ^ ngram_join._ODD) >> np.uint64(24 - 8))
    common = short, rng.integers(9, 99, len(short))
    for _ in range(200):
        a = np.unique(rng.choice(shingles[: int(rng.integers(3000, 9000))], int(rng.integers(1, 2500)), replace=False))
        b = rng.permutation(a)[: max(1, -(-len(a) * percent // 100))]  # a link at the very bound
        shared = len(set(ngram_join.keys(a, percent, common, 8).tolist()) & set(ngram_join.keys(np.sort(b), percent, common, 8).tolist()))
        assert shared >= min(ngram_join.shared_keys(len(x), percent) for x in (a, b)) > 0


def test_long_texts_do_not_hang_together_by_a_phrase(spark, monkeypatch):
    # Each of thirty long texts shares a phrase with the next; near copies of five of them are the only links.
    rng = random.Random(12)
    made = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrases = [made(14) for _ in range(30)]
    long = [[*phrases[i - 1], *made(1000), *phrases[i]] for i in range(30)]
    copies = [[w if j % 200 else "other" for j, w in enumerate(t)] for t in long[:5]]
    read = []
    monkeypatch.setattr(ngram_join, "_parted", lambda sets, *_: read.append(sets.count()) or sets)
    got = {r.doc_id: r.component_id for r in ngram_join.similar(frame(spark, [" ".join(t) for t in long + copies]).select("doc_id", "text"), 5, 80).collect()}
    assert [got[i] for i in range(35)] == [*range(30), *range(5)]
    assert read == [10]


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 9, (900, 32)).astype(np.int32)
    sizes = points.sum(axis=1)
    tree = ngram_join.Tree(points, sizes)
    for q in range(0, 900, 97):
        want = np.flatnonzero(np.minimum(points, points[q]).sum(axis=1) * 190 >= 90 * (sizes + sizes[q]))
        assert sorted(tree.near(points[q], int(sizes[q]), 90).tolist()) == want.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100 and 200 not in got


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    apart = 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(rng.integers(0, int((100 - percent) * n / 100) + 1))
        added = int(max(0, (n - gone) * 100 // percent - n)) if rng.random() < 0.7 else 0  # links at the very bound
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, added).astype(np.uint64)]))
        if len(b) and 100 * (n - gone) >= percent * (n + added):
            for x, y in ((a, b), (b, a)):
                assert set(ngram_join.signatures(x, percent).tolist()) & set(ngram_join.signatures(y, percent).tolist())
        apart += not set(ngram_join.signatures(a, percent).tolist()) & set(ngram_join.signatures(a ^ np.uint64(1 << 62), percent).tolist())
    assert percent < 90 or apart > 300


def test_empty_groups_tie_no_sets():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64)) for _ in range(60)]
    signed = [set(ngram_join.signatures(s, 80).tolist()) for s in sets]
    assert not any(a & b for i, a in enumerate(signed) for b in signed[:i])


def test_large_components_are_taken_apart(spark):
    # A hundred texts that share a stock phrase, too large for a task together; of each, a copy with a word changed at its end.
    rng = random.Random(31)
    stock = words(rng, 60)
    texts = [f"{stock} {words(rng, 240)}" for _ in range(100)]
    texts += [f"{t} more" for t in texts]
    sets = [ngram_join.shingle_set(t, 3) for t in texts]
    rows = [(1, n, len(s), s.tobytes()) for n, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "coarse long, node long, n long, bytes binary")
    got = ngram_join._parted(df, 90, 20_000).groupBy("coarse").agg(F.collect_set("node").alias("v"), F.sum("n").alias("n")).collect()
    held = {x: frozenset(r.v) for r in got for x in r.v}
    assert all(held.get(n) == held.get(n + 100) and n in held for n in range(100))  # no link is lost
    assert max(r.n for r in got) < 20_000


# 7: quality rules


def test_quality_against_definition(spark, odd):
    rng = random.Random(9)
    texts = [None, "", "a b", "same " * 40, "\n".join(["one line of words here"] * 9), LONG] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(40)] + ["#*$ " * 30, "x\n\n x \nx"]
    got = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = {}
        for j in range(len(w) - 7):
            grams.setdefault(tuple(w[j : j + 8]), []).append(j)
        covered = {p for s in grams.values() if len(s) > 1 for j in s for p in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), i
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>") and r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judge(odd).count() == 7 and quality.judge(empty(spark)).count() == 0


# 8: substring dedup


def test_substring_finds_planted_passages(spark):
    rng = random.Random(6)
    passage = words(rng, 80).split()
    edited = [w if k % 20 else "changed" for k, w in enumerate(passage)]
    clean = [words(rng, 120) for _ in range(12)]
    texts = [*clean, f"{words(rng, 30)} {' '.join(passage)} {words(rng, 30)}", f"{words(rng, 50)} {' '.join(edited)} {words(rng, 10)}", f"{' '.join(passage).upper()}", None, "", "short"]
    got = substring_dedup.passages(frame(spark, texts).select(F.col("doc_id").alias("doc"), "text")).collect()
    pairs = {(r.doc, r.rep) for r in got}
    assert {d for d, _ in pairs} == {13, 14} and all(r >= 12 for _, r in pairs)
    hit = next(r for r in got if (r.doc, r.rep) == (13, 12))
    assert abs(hit.start - 50) <= 6 and abs(hit.end - 130) <= 6 and hit.identity >= 0.8
    assert substring_dedup.passages(empty(spark).select(F.col("doc_id").alias("doc"), "text")).count() == 0


def test_chains_follow_both_orders():
    pos = np.array([0, 10, 20, 30, 40, 45])
    rpos = np.array([100, 110, 5, 131, 141, 300])
    best = substring_dedup.chains(pos, rpos)[0]
    assert best.tolist() == [0, 1, 3, 4]
    assert substring_dedup.align(np.arange(50), np.arange(50), np.array([[10, 10], [20, 20]]))[:4] == (0, 50, 0, 50)


def test_chains_begin_anew_after_a_long_passage():
    long = np.arange(0, 120, 5)
    for at, rat in ((300, 300), (900, 900), (300, 200), (120, 400)):  # the last: far in the earlier text only
        pos, rpos = np.concatenate([long, at + np.arange(0, 50, 5)]), np.concatenate([long, rat + np.arange(0, 50, 5)])
        assert sorted(len(c) for c in substring_dedup.chains(pos, rpos)) == [10, 24]


def test_substring_finds_two_passages_far_apart(spark):
    rng = random.Random(8)
    one, two = words(rng, 120), words(rng, 50)
    texts = [f"{one} {words(rng, 180)} {two}", f"{one} {words(rng, 220)} {two}"]
    got = substring_dedup.passages(frame(spark, texts).select(F.col("doc_id").alias("doc"), "text")).collect()
    assert sorted((r.start // 100, r.end - r.start >= 48) for r in got) == [(0, True), (3, True)]


def test_substring_finds_a_whole_passage_whose_parts_stand_elsewhere(spark):
    rng = random.Random(9)
    whole = words(rng, 60).split()
    parts = [" ".join(whole[:30]), " ".join(whole[30:])]
    stock = f"{words(rng, 20)} {' '.join(whole[20:32])} {words(rng, 40)} {' '.join(whole)}"  # holds some seeds twice
    texts = [f"{words(rng, 20)} {parts[0]} {words(rng, 20)}", f"{words(rng, 20)} {parts[1]} {words(rng, 20)}", stock, f"{words(rng, 33)} {' '.join(whole)} {words(rng, 9)}"]
    got = substring_dedup.passages(frame(spark, texts).select(F.col("doc_id").alias("doc"), "text")).collect()
    assert [(r.doc, r.rep, abs(r.start - 33) < 3, abs(r.rstart - 72) < 3, r.equal >= 58) for r in got] == [(3, 2, True, True, True)]


def best_chain(pos, rpos, k, cost, gap):
    """The value of the best chain, by trying every predecessor."""
    value = [float(k)] * len(pos)
    for j in range(len(pos)):
        for i in range(j):
            if 0 < pos[j] - pos[i] <= gap and 0 < rpos[j] - rpos[i] <= gap:
                new = min(k, pos[j] - pos[i], rpos[j] - rpos[i])
                value[j] = max(value[j], value[i] - cost * (pos[j] - pos[i] + rpos[j] - rpos[i]) + new)
    return max(value)


def test_chains_reach_the_value_of_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        pairs = sorted({(6 * rng.randrange(25), 6 * rng.randrange(25)) for _ in range(rng.randrange(2, 25))})  # no two overlap
        pos, rpos = (np.array(x) for x in zip(*pairs))  # noqa: B905
        chain = substring_dedup.chains(pos, rpos, 6, 0.05, 40)[0]
        p, r = pos[chain], rpos[chain]
        assert (np.diff(p) > 0).all() and (np.diff(r) > 0).all() and (np.diff(p) <= 40).all() and (np.diff(r) <= 40).all()
        got = 6.0 + sum(min(6, p[i + 1] - p[i], r[i + 1] - r[i]) - 0.05 * (p[i + 1] - p[i] + r[i + 1] - r[i]) for i in range(len(p) - 1))
        assert abs(got - best_chain(pos, rpos, 6, 0.05, 40)) < 1e-9


def test_substring_tries_every_chain_of_a_pair_in_both_rounds(spark, monkeypatch):
    made, plain = [], substring_dedup._chain_all
    monkeypatch.setattr(substring_dedup, "_chain_all", lambda *a: made.append(plain(*a)) or made[-1])
    rng = random.Random(21)
    texts = [words(rng, 90), words(rng, 90)]
    substring_dedup.passages(frame(spark, texts).select(F.col("doc_id").alias("doc"), "text")).collect()
    # Seven places of the earlier text hold seeds of the same 36 words, too far from each other for one chain.
    matches = pd.DataFrame([(2, 1, p, p + 500 * n) for p in range(0, 36, 6) for n in range(7)], columns=["doc", "rep", "pos", "rpos"])
    assert len(made) == 2
    for work in made:
        assert sum(len(f) for f in work(iter([matches]))) == 7


def test_many_chains_of_a_pair_are_aligned_together():
    import time

    rng = np.random.default_rng(22)
    rows, want = [], set()
    for doc in range(2, 602):  # 600 pairs of 20 straight chains and a bent one each
        a, b = (rng.integers(0, 9 if doc % 2 else 1 << 30, 1280).astype(np.uint32) for _ in range(2))
        chains = []
        for n in range(20):
            p, r, size = 30 + 60 * n, 20 + 60 * ((7 * n) % 20), int(rng.integers(20, 55))
            b[r : r + size] = a[p : p + size]
            b[r + 14] = 77
            chains.append(np.array([[p + 1, r + 1], [p + 15, r + 15]]))
        b[41 + 6 : 41 + 20] = a[50 + 6 - 20 : 50 + 20 - 20]
        chains.append(np.array([[30, 20], [50 - 14, 41 + 6]]))
        rows += [(doc, 1, -1, n, c.astype(np.int32).tobytes()) for n, c in enumerate(chains)]
        rows += [(doc, 1, side, n, x[n * 128 : n * 128 + 128].tobytes()) for side, x in ((0, a), (1, b)) for n in range(10)]
        kept = []
        for c in chains:
            low = np.maximum(c[0] - substring_dedup.FLANK, 0) // 128 * 128
            high = ((c[-1] + 6 + substring_dedup.FLANK) // 128 + 1) * 128
            a0, a1, b0, b1, equal = substring_dedup.align(a[low[0] : high[0]], b[low[1] : high[1]], c - low)
            span = (a0 + low[0], a1 + low[0], b0 + low[1], b1 + low[1])
            if equal >= 40 and equal / max(a1 - a0, b1 - b0) >= 0.8 and not any(x[0] <= span[0] and span[1] <= x[1] and x[2] <= span[2] and span[3] <= x[3] for x in kept):
                kept.append(span)
                want.add((doc, *map(int, span), int(equal)))
    frames = pd.DataFrame(rows, columns=["doc", "rep", "side", "place", "bytes"])
    began = time.process_time()
    got = pd.concat(substring_dedup._align_all(6, 40, 0.8)(iter([frames[:5_000], frames[5_000:]])))
    took = time.process_time() - began
    assert {tuple(map(int, r)) for r in got[["doc", "start", "end", "rstart", "rend", "equal"]].to_numpy()} == want and len(got) == len(want) > 3_000
    assert took < 6  # a frame for each chain took a thousandth of a second and more


def test_substring_of_null_repeated_ids_and_clashing_names(spark):
    rng = random.Random(12)
    shared = words(rng, 60)
    body = lambda: f"{words(rng, 30)} {shared} {words(rng, 30)}"
    rows = [(None, body()), (None, body()), (7, body()), (7, body()), (9, body()), (11, words(rng, 90))]
    rows += [rows[4], rows[5]]  # repeated rows are the same document
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("x")).withColumn("seed", F.lit(1))
    got = substring_dedup.repeated(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id is not None) != [] and 11 not in {r.doc_id for r in got} | {r.source_doc_id for r in got}
    assert len(got) == 4 and {r.doc_id for r in got} | {r.source_doc_id for r in got} == {None, 7, 9}
    assert substring_dedup.repeated(docs.where("false")).count() == 0


def test_seeds_share_within_equal_stretches():
    rng = random.Random(1)
    shared = words(rng, substring_dedup.K + substring_dedup.WINDOW - 1)
    a, b = (set(substring_dedup.seeds(word_hashes(f"{words(rng, 40)} {shared} {words(rng, 40)}".encode()))[0].tolist()) for _ in range(2))
    assert a & b


def test_seeds_of_many_texts_equal_those_of_each():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(n)).encode() for n in [*range(40), 300, 0, 5, 2_000]] + [b"", b" \n ", b"x"]
    rng.shuffle(texts)
    for some in (texts, texts[:1], [b""], []):
        for text, (h, at) in zip(some, substring_dedup.all_seeds(some), strict=True):
            want = substring_dedup.seeds(word_hashes(text))
            assert h.tolist() == want[0].tolist() and at.tolist() == want[1].tolist()


# 9: nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("c1", T.StringType())]))


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:500] = x[200]  # many copies
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    bad = [(5000, None, ""), (5020, [0.0] * 16, ""), (5040, [float("nan")] * 16, ""), (5060, [None] * 16, ""), (None, [1.0] * 16, ""), (5080, [1.0] * 3, ""), (5100, [float("inf")] + [0.0] * 15, "")]
    got = ann.search(vectors(spark, rows + bad), F.col("vec_id") % 20 == 0, 20).toPandas()
    assert got.query_id.max() < 1500 and got.vec_id.max() < 1500 and (got.groupby("query_id").size() == 20).all()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        hit, total = hit + len(set(want) & set(g.vec_id)), total + 20
        g = g.sort_values("rank")
        assert np.allclose(g.score, s[g.vec_id]) and g.score.is_monotonic_decreasing
    assert hit / total >= 0.9
    copies = got[got.query_id == 200].sort_values("rank")
    assert copies.vec_id.tolist() == list(range(201, 221))


def test_neighbours_of_repeated_queries(spark):
    x = np.random.default_rng(5).normal(size=(60, 8)).astype(np.float32)
    rows = [(2 * i + 1, v.tolist(), "") for i, v in enumerate(x)]
    rows += [(20, x[0].tolist(), "")] * 3 + [(40, x[1].tolist(), ""), (40, x[2].tolist(), "")]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).toPandas()
    one = got[got.query_id == 20]
    assert sorted(one["rank"]) == list(range(1, 21)) and one[one.vec_id != 40].vec_id.is_unique
    assert sorted(got[got.query_id == 40]["rank"]) == sorted([*range(1, 21)] * 2)


def test_neighbours_of_few(spark):
    got = ann.search(vectors(spark, [(0, [1.0, 0.0], ""), (20, [0.5, 0.5], ""), (3, [2.0, 1.0], "")]), F.col("vec_id") % 20 == 0, 20)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_candidates_grow_with_the_queries_only(spark):
    # Twenty rows of each of some 20 blocks were given for each query, and more blocks with more entries.
    x = np.random.default_rng(6).normal(size=(20_000, 8)).astype(np.float32)
    df = vectors(spark, [(i, v.tolist(), "") for i, v in enumerate(x)])
    asked = F.col("vec_id") % 500 == 0
    n = ann.candidates(df, asked, 20).count()
    assert 40 * 20 <= n <= 40 * 20 * ann.SPLITS
    got = ann.search(df, asked, 20).toPandas()
    s = x.astype(float) @ x[::500].astype(float).T
    hit = 0
    for q, g in got.groupby("query_id"):
        own = s[:, q // 500].copy()
        own[q] = -np.inf
        hit += len(set(np.argsort(-own)[:20]) & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, own[g.sort_values("rank").vec_id])
    assert hit >= 0.9 * 40 * 20


def test_best_so_far_in_tiles_equals_one_sort():
    rng = np.random.default_rng(7)
    x, ids = rng.integers(-2, 3, (9_000, 6)).astype(float), rng.permutation(9_000)
    f = pd.DataFrame({"vec_id": ids[:300], "ask": ids[:300], "least": -np.inf, "v": list(x[:300])})
    best, zero = ann.Best(f, 20), np.zeros(9_000, np.int64)
    for n in range(0, 9_000, 700):  # many equal products: ties go to the smaller id wherever they are cut
        p = slice(n, n + 700)
        best.see(x[p], ids[p], zero[p], zero[p], np.zeros((1, 3)), np.zeros((1, 3)))
    got = best.found().groupby("query_id")["vec_id"].apply(list)
    for i in range(300):
        s = x @ x[i]
        s[i] = -np.inf
        assert got[ids[i]] == ids[np.lexsort((ids, -s))[:20]].tolist()


# 10: HTML


PAGE = """<html><head><title>T</title><style>p{}</style><script>x="</p>"</script></head><body><header><h1>Site</h1></header><nav><a href=a>Home</a></nav>
<div class="cookie-banner">We use cookies on this site.</div><form><label>Name</label><input></form>{body}<aside>Side words</aside><section id="comments"><p>Nice post of the day!</p></section><footer>&copy; me</footer></body></html>"""
TEXT = "The cat is on the mat and it was for the dog that this is by the of and to in is that it for all of them."


def test_html_with_and_without_article():
    inner = f"<h1>Head &amp; more</h1><p>{TEXT}<br>second   line<p><b>Short.<p>Last&nbsp;one <a href=x>link</a>.</p><div class=ad>Buy now</div>"
    want = f"Head & more\n{TEXT} second line\nShort.\nLast one link."
    assert html_extract.main_text(PAGE.replace("{body}", f"<article>{inner}</article>")) == want
    plain = f"<div><h2>Head</h2><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p></div>"
    assert html_extract.main_text(PAGE.replace("{body}", plain)) == f"Head\n{TEXT}\nShort.\n{TEXT}"


def test_html_articles_beside_or_with_other_text():
    cards = "".join(f'<article><h3><a href=x>Card {i}</a></h3><p>Read this next.</p></article>' for i in range(4))
    body = f"<div><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div>"
    assert html_extract.main_text(PAGE.replace("{body}", body + cards)).startswith(f"{TEXT}\n{TEXT}\n{TEXT}")
    assert "Card 2" not in html_extract.main_text(PAGE.replace("{body}", body + cards))
    links = "<ul>" + "".join(f"<li><a href=x>More about number {i}</a></li>" for i in range(6)) + "</ul>"
    assert html_extract.main_text(PAGE.replace("{body}", f"<article><p>{TEXT}</p>{links}</article>")) == TEXT


def test_html_with_few_stop_words_and_no_article():
    odd = "Thinhaea stouti ered thanenon areth ndth eringes threin erin onoth wathan thedes."
    body = f"<div><h2>Head</h2><p>{odd}</p><p>Short.</p><p>{odd}</p><p>Last one.</p></div>"
    assert html_extract.main_text(PAGE.replace("{body}", body)) == f"Head\n{odd}\nShort.\n{odd}\nLast one."


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- x", "<script>never closed <p>x</p>", "<nav><a>x</a></nav>", "</div></div></article>"])
def test_html_odd(page):
    assert html_extract.main_text(page) in ("", "<", "<p")


def test_html_frames(spark):
    rows = [(1, "u", PAGE.replace("{body}", f"<main><p>{TEXT}</p></main>"), "x"), (2, None, None, "x"), (1, "u", "", "x"), (4, "u", f"<article><p>{'word ' * 50_000}</p></article>", "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id == 2} == {""} and max(r.n_chars for r in got) == 249_999
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# fingerprints


def test_word_fingerprints():
    a, b = word_hashes(b"alpha beta  gamma\n"), word_hashes(b"\tbeta gamma alpha")
    assert len(a) == 3 and a[1] == b[0] and a[0] == b[2] and len(word_hashes(b" \n")) == 0
    assert word_hashes(lower_ascii("ABC É")).tolist() == word_hashes("abc É".encode()).tolist()
    assert len(window_hashes(a, 3)) == 1 and len(window_hashes(a, 4)) == 0
    assert len(set(word_hashes(" ".join(f"w{i}" for i in range(5000)).encode()).tolist())) == 5000
