"""The pipeline's stages on a small corpus: decisions take effect, and the columns stay those of documents."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    pool = "the of and to in is that river stone cloud house tree light night".split()
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(pool) + str(rng.randrange(80)) for _ in range(60)]
        y = int(i % 6 == 0)
        for _ in range(4 * y):
            w[rng.randrange(60)] = "idiot"
        rows.append((i, " ".join(w[:30]) + "\n" + " ".join(w[30:]), "en", f"s{i % 4}", 0))
        labels.append((i, 1, y))
    rows += [(300, rows[1][1], "en", "s1", 0), (301, rows[2][1].replace("\n", " ") + " one more", "en", "s1", 0), (302, None, None, None, None), (303, "", "en", "s0", 0)]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, corpus)
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == COLUMNS and not ids & set(range(0, 240, 6)) and len(ids) > 190
    deduped = stage["line_dedup"](spark, docs, corpus)
    ids = {r.doc_id for r in deduped.collect()}
    assert deduped.columns == COLUMNS and 300 not in ids and {1, 301, 302, 303} <= ids
    joined = stage["ngram_join"](spark, docs, corpus)
    ids = {r.doc_id for r in joined.collect()}
    assert joined.columns == COLUMNS and not ids & {300, 301} and {1, 2, 302, 303} <= ids
    assert stage["mixing"](spark, docs, corpus).columns == COLUMNS


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus).collect()
    assert out and all(r.n_tokens > 0 for r in out)
