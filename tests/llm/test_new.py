"""Alignment against both libraries, exact deduplication and fill-in-middle against brute force, on odd rows and forced clashes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, exact_dedup, fill_middle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, groups string, output string, kept boolean, _norm string"
SIGNS = [chr(c) for c in range(1, 0x2FF)] + list("aeiouthsn '") * 80 + ["<|endoftext|>", "<s>", "<unk>"] * 9 + list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　") * 10
SIGNS += ["😀", "日", "本", " the", " and", "\n\n", "  ", "\r\n", "<P>", "\x1e0", "\x1f1"] * 9


def random_texts(seed, n, longest=80):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(longest))) for _ in range(n)]


EDGE = ["", " ", "\n", "\n\n", "a ", "a\n\nb", "a\r\n\nb", "a\r", " \n ", "x▁y", "▁", "<|endoftext|>", "a" * 700, " " * 50, "The cat sat.", "the CAT sat.", "The cat sat."]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} of the Text." for i in range(30_000))
    rows = [(0, None), (1, ""), (2, long), (3, "Hello World"), (3, "Hello World"), (None, "x y z"), (None, "X Y z"), (5, " \n\t "), (6, long.upper()), (7, "hello world"), (8, "hellö"), (9, "hellÖ"), (None, None)]
    return spark.createDataFrame([(i, t, None, "s", None, "g", "o", None, "n") for i, t in rows], DOCS)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "g", "o", True, "n") for i, t in enumerate(texts)], DOCS)


# 11: alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    vocabulary, model = alignment.default_paths()
    a = Tokenizer.from_file(vocabulary)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=model), alignment.load(vocabulary, model)


def by_hand(libraries, text):
    """A and B ids, groups and linked pairs, token by token."""
    a, b, both = libraries
    if not text:
        return [], [], "", []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [both.a.piece[i] for i in ids[0]], [both.b_piece[i] for i in ids[1]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return [], [], "", []
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    groups, links, at = [], [], [0, 0]
    for c in sorted(set(ends[0]) & set(ends[1])):
        sides = []
        for k in (0, 1):
            n = ends[k].index(c) + 1
            sides.append(ids[k][at[k] : n])
            at[k] = n
        groups.append("|".join(",".join(map(str, s)) for s in sides))
        links.append((sides[0][-1], sides[1][-1]))
    return ids[0], ids[1], ";".join(groups), links


def test_owners():
    over_a, over_b, cut_a, cut_b = alignment.owners(np.array([2, 3, 1]), np.array([2, 1, 3]))
    assert list(zip(over_a, over_b)) == [(0, 0), (1, 1), (1, 2), (2, 2)]
    assert (cut_a.tolist(), cut_b.tolist()) == ([0, 2], [0, 2])
    none = np.array([], np.int64)
    assert all(len(x) == 0 for x in alignment.owners(none, none))


def test_alignment_equals_the_libraries(libraries):
    both, texts = libraries[2], random_texts(1, 1500) + EDGE
    assert both.divides
    first, second = both.pairs()
    for whole in (False, True):
        both.reset()
        both.divides = not whole
        stats, groups, n_links, links = both.align(texts)
        ends = np.cumsum(n_links)
        for k, t in enumerate(texts):
            a, b, want, pairs = by_hand(libraries, t)
            own = links[ends[k] - n_links[k] : ends[k]]
            assert (stats[0][k], stats[1][k], groups[k], list(zip(first[own], second[own]))) == (len(a), len(b), want, pairs), t
    both.divides = True


def test_alignment_cache_shrinks_without_effect(libraries, monkeypatch):
    both, texts = libraries[2], random_texts(2, 400, 400)
    both.reset()
    want = both.align(texts)
    monkeypatch.setattr(alignment, "CACHE_BYTES", 60_000)
    both.reset()
    for _ in range(2):
        for k in range(0, len(texts), 20):
            stats, groups, n_links, _ = both.align(texts[k : k + 20])
            assert groups == want[1][k : k + 20] and (stats == want[0][:, k : k + 20]).all() and (n_links == want[2][k : k + 20]).all()
    assert both.held < 3_000_000
    both.reset()


def test_alignment_spans(libraries):
    found = libraries[2].spans("Straßenbahn übergangslos")
    assert found["cuts"][-1] == len(" Straßenbahn übergangslos".encode()) and len(found["overlap_a"]) >= max(len(found["a"]), len(found["b"]))


def test_alignment_query_counts(spark, libraries, tmp_path):
    texts = random_texts(3, 300) + EDGE + [None]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in alignment.op11_alignment(spark, str(tmp_path)).collect()}
    hand = [by_hand(libraries, t) for t in texts]
    count = Counter(p for h in hand for p in h[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    assert len(got) == len(texts)
    for k, (a, b, groups, pairs) in enumerate(hand):
        r = got[k]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (len(a), len(b), len(pairs), len(pairs), digest)
        assert (r["n_best"], r["count_sum"]) == (sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs))


def test_alignment_of_odd_rows(spark, odd):
    rows = alignment.align(odd).collect()
    assert len(rows) == odd.count() and {"_norm", "output", "n_chars"} <= set(rows[0].asDict())
    assert all((r["n_a"] > 0) == bool(r["text"]) for r in rows)
    nothing = alignment.align(odd.limit(0))
    assert alignment.link_scores(nothing, alignment.pair_counts(nothing)).count() == 0


# 12: exact deduplication


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def groups_by_hand(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[lowered(t)].append(i)
    return sorted(
        (repr(i), repr(max((j for j in by[lowered(t)] if j is not None), default=None)), len(by[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest())
        for i, t in rows
    )


def check_groups(df, rows):
    got = df.collect()
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == groups_by_hand(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) <= {1} and set(kept) == {r["text_sha256"] for r in got}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def copies(seed):
    rng = random.Random(seed)
    texts = random_texts(seed, 60, 900) + EDGE
    texts += [rng.choice(texts) for _ in range(60)] + [rng.choice(texts).swapcase() for _ in range(20)] + [texts[0] + texts[1], texts[1] + texts[0]]
    return texts


def test_exact_dedup(spark, odd):
    texts = copies(5)
    check_groups(exact_dedup.groups_of_copies(frame(spark, texts)), list(enumerate(texts)))
    check_groups(exact_dedup.groups_of_copies(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert exact_dedup.groups_of_copies(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 3])
def test_exact_dedup_tells_clashing_fingerprints_apart(spark, bits):
    texts = copies(6)
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("long")
    check_groups(exact_dedup.groups_of_copies(frame(spark, texts), weak), list(enumerate(texts)))


def test_chunks_are_whole_bounded_and_local(spark):
    rng = random.Random(9)
    prose = " ".join(rng.choice(["river", "stone", "the", "under", "are", "light", "bears", "find", "hidden", "leaves", "when"]) for _ in range(9_000))
    edited = prose[:20_000] + "inserted words here " + prose[20_000:]
    rows = frame(spark, [prose, edited, "日" * 20_000, "", *random_texts(8, 40, 2_000)]).select("text", exact_dedup.chunks("text").alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] and max(map(len, r["c"]), default=0) <= exact_dedup.MAX_CHARS for r in rows)
    one, other = (Counter(r["c"]) for r in rows[:2])
    assert len(rows[0]["c"]) > 50 and sum((one - other).values()) <= 20
    store = exact_dedup.chunk_store(frame(spark, [prose, prose, edited]))
    assert store.count() < 1.1 * len(rows[0]["c"]) + 3


# 13: fill-in-middle


def middle_by_hand(i, t):
    t = t or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    pre, mid, suf = t[:a], t[a:b], t[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def test_fill_middle(spark, odd, tmp_path):
    texts = random_texts(11, 600) + EDGE + [None, "<", "<S", "S><P", "\x1e", "\x1f", "\x1e0\x1e1\x1f", "a<M>b"]
    frame(spark, texts).union(odd.withColumn("doc_id", F.col("doc_id") + 10_000)).write.parquet(f"{tmp_path}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(repr(i), *map(repr, m[:4]), sha(m[4]), sha(t or "")) for i, t in given for m in [middle_by_hand(i, t)]]
    got = [(*(repr(r[c]) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")), r["output_sha256"], r["restored_sha256"]) for r in fill_middle.op13_fill_middle(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {w[2] for w in want} == {"'plain'", "'psm'", "'spm'"}


def test_fill_middle_of_words(spark, odd):
    out = fill_middle.transform(frame(spark, ["one two  three\nfour \x1f five ", "x", "  "] * 20), unit=fill_middle.WORDS).withColumn("back", fill_middle.restored()).collect()
    assert all(r["back"] == r["text"] for r in out) and {r["n"] for r in out} == {6, 1, 0}
    assert all(r["prefix"] == "" or r["text"][len(r["prefix"])] in " \n" or r["middle"] + r["suffix"] == "" for r in out if r["form"] != "plain" and r["n"] == 6 and r["prefix"] + r["middle"] != "")
    kept = fill_middle.transform(odd).columns
    assert kept[:3] == ["doc_id", "text", "lang"] and kept.count("output") == 1
    assert fill_middle.transform(odd.limit(0)).count() == 0


# Earlier operators: what was mended


def test_mixing_fills_with_many_small_documents(spark):
    from tidemark.llm import mixing

    rows = [(i, "w " * 10, "s") for i in range(2_000)] + [(10_000 + i, "v " * 9_000, "s") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).select("doc_id", "size", "target", "taken", "copies").toPandas()
    target, taken = got["target"].iloc[0], got["taken"].sum()
    unused = got[(got["copies"] == 1) & (got["size"] > 0)]["size"]
    assert taken <= target + 1 and (target - taken < 10 or not (unused <= target - taken).any())
    assert (got["taken"] <= 2 * got["size"]).all()


def test_mixing_equals_its_twin_of_targets(spark):
    from tidemark.llm import mixing

    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 300), f"s{min(9, int(rng.expovariate(0.4)))}" if i % 11 else None) for i in range(3_000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += t.count("w")
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:  # shares by weight; what is above twice the size stops there, and its excess is shared again
        level = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    by = got.assign(source=got["source"].where(got["source"].notna(), None)).groupby("source", dropna=False)
    for s, part in by:
        s = s if isinstance(s, str) else None
        assert part["target"].iloc[0] == pytest.approx(target[s]) and part["source_size"].iloc[0] == sizes[s]
        assert abs(part["taken"].sum() - target[s]) < 2


def test_toxicity_learns_from_one_row_of_an_id(spark, monkeypatch):
    import pandas as pd

    from tidemark.llm import toxicity

    rng = random.Random(2)
    text = lambda bad: " ".join(rng.choice(["you idiot scum", "worthless loser"] if bad else ["the river runs", "a stone house"]) for _ in range(12))
    rows = [(i, text(i % 3 == 0)) for i in range(400)] + [(7, f"many rows of one id {k % 5}") for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    held, own = [], pd.DataFrame.sort_values
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda self, *a, **k: held.append(len(self)) or own(self, *a, **k))
    model = toxicity.fit(docs, labels, F.lit(True), sample_rows=300)
    assert held and max(held) <= 300
    got = toxicity.score(docs.where("doc_id <> 7"), model).toPandas()
    assert ((got["toxicity"] >= 0.5) == (got["doc_id"] % 3 == 0)).mean() > 0.95


PROSE = "The river of the north is a long one and it was for years the way by which the people of the land came to the sea. " * 3


@pytest.mark.parametrize("name", ["share-price", "content-header", "related-work", "social-history"])
def test_html_names_that_may_mean_furniture_do_not_decide(name):
    from tidemark.llm.html_extract import main_text

    assert main_text(f'<body><div class="{name}"><p>{PROSE}</p><p>{PROSE}</p></div></body>').count("river") == 6
    assert main_text(f'<body><div id="{name}"><p>{PROSE}</p></div></body>')


def test_html_marks_on_paragraphs_items_and_words():
    from tidemark.llm.html_extract import main_text

    page = f'<p>{PROSE}</p><p class="advertisement">BUY {PROSE}</p><ul><li class="advert">BUY {PROSE}</li></ul><p hidden>BUY {PROSE}</p><p>Now <span class="ad">BUY <span>x</span></span>here. {PROSE}</p>'
    text = main_text(page)
    assert "BUY" not in text and "Now here." in text and text.count("river") == 6


def test_html_sentences_with_links_go_with_their_neighbours():
    from tidemark.llm.html_extract import main_text

    linked = 'It is said that <a href="/x">the people of the land came to the sea</a> and that they stayed there for a year.'
    menu = "".join(f'<li><a href="/{i}">the way of the land {i}</a>' for i in range(9))
    text = main_text(f"<p>{PROSE}</p><p>{linked}</p><p>{PROSE}</p><ul>{menu}</ul>")
    assert "It is said" in text and "way of the land" not in text
    assert "x + y" in main_text(f"<p>{PROSE}<math>x + y</math></p>")


@pytest.mark.parametrize("piece", ["<div>", "<title ", "<!--", "<script>", "<b>", "<p class='ad'>", "</div>", "<span class=ad>", "<a href=x>"])
def test_html_long_odd_pages_take_linear_time(piece):
    import time

    from tidemark.llm.html_extract import main_text

    main_text(piece * 10)
    began = time.process_time()
    main_text(piece * 60_000)
    assert time.process_time() - began < 5
