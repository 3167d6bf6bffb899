import numpy as np

from staylens.llm import lm_corpus as M
from staylens.llm import lm_score
from tests.conftest import SF_ORACLE
from tests.llm.test_lm_score import LABELS, brute


def test_matches_brute_force_whatever_is_broadcast(spark, monkeypatch):
    """Every word and bigram counts; lists, blocks and buckets of any size give the same losses."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").where("doc_id < 150")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    want = brute(texts, good, 10**7, 10**7)
    for frequent, sample, bucket, block, held in ((0, 1 << 24, 1 << 21, 1 << 21, 400_000), (300, 1 << 14, 1_000, 500, 50),
                                                  (M.FREQUENT, M.SAMPLE_CHARS, 5_000, M.BLOCK_WORDS, M.HELD)):
        for name, value in (("FREQUENT", frequent), ("SAMPLE_CHARS", sample), ("BUCKET_WORDS", bucket),
                            ("BLOCK_WORDS", block), ("HELD", held), ("SLICE_ROWS", 16)):
            monkeypatch.setattr(M, name, value)
        monkeypatch.setattr(M, "TARGET_IDS", 0 if frequent == 300 else 1 << 21)  # both joins of the labels
        out, c = M.score_corpus(docs.repartition(3), labels, keep=["doc_id"])
        rows = out.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
        for r in rows:
            assert np.allclose([r[c]["target_loss"], r[c]["background_loss"]], want[r["doc_id"]], rtol=1e-9)


def test_agrees_with_the_stored_models(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    one, c = M.score_corpus(docs, labels, keep=["doc_id"])
    two, d = lm_score.score(docs, lm_score.fit(docs, labels), keep=["doc_id"])
    got, want = ({r["doc_id"]: tuple(r[1]) for r in x.collect()} for x in (one, two))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)


def test_edges(spark, docs_of):
    docs = docs_of([None, "", " .,", *["red green blue " * 9] * 9, *["one two three " * 9] * 9,
                    (50, "red " * 30_000), (50, "red " * 30_000), (None, "red green")],
                   extra=["lm_", "good_", "text_", "id_"])
    labels = spark.createDataFrame([(3, 1, None), (4, 1, 0), (None, 1, 0), (5, 0, 0), (5, 1, 0)], LABELS)
    out, c = M.score_corpus(docs, labels)
    assert out.columns == [*docs.columns, c]
    rows = out.collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r[c] for r in rows}
    assert all(tuple(by_id[i]) == (0, 0.0, 0.0, 0.0) for i in (0, 1, 2))
    assert by_id[6]["difference"] < 0 < by_id[13]["difference"]
    assert [r[c]["n_words"] for r in rows if r["doc_id"] == 50] == [30_000] * 2
    plain = {r["doc_id"]: tuple(r[1]) for r in lm_score.score(docs, lm_score.fit(docs, labels), keep=["doc_id"])[0].collect()}
    assert all(np.allclose(tuple(by_id[k]), plain[k], rtol=1e-9, atol=1e-9) for k in plain)
    none = docs.where("false")
    assert M.score_corpus(none, labels)[0].count() == 0
    assert M.score_corpus(docs, labels.where("false"))[0].count() == len(rows)
