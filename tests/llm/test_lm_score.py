import math
from collections import Counter

import numpy as np

from staylens.llm import lm_score as M
from staylens.llm.common import folded_words
from tests.conftest import SF_ORACLE

LABELS = "doc_id bigint, quality int, toxic int"


def brute(texts, good, vocabulary, bigrams):
    words = {d: folded_words((t or "").encode()) for d, t in texts.items()}
    counts = Counter(w for ws in words.values() for w in ws)
    vocab = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]}
    seq = {d: [w if w in vocab else None for w in ws] for d, ws in words.items()}
    uni, bi = (Counter(), Counter()), (Counter(), Counter())
    for d, ws in seq.items():
        for m in [0, 1] if d in good else [1]:
            uni[m].update(ws)
            bi[m].update(zip(ws, ws[1:]))
    sizes = sorted(bi[1].values(), reverse=True)
    least = next((c for c in sorted(set(sizes)) if sum(n >= c for n in sizes) <= bigrams), 10**9)
    kept = {b for b, n in bi[1].items() if n >= least}
    out = {}
    size = len(vocab) + 1
    held = [Counter(), Counter()]
    for b in kept:
        for m in (0, 1):
            held[m][b[0]] += bi[m][b]
    for d, ws in seq.items():
        loss = [0.0, 0.0]
        for m in (0, 1):
            total = sum(uni[m].values())
            p1 = lambda w: (uni[m][w] + 1) / (total + size)
            for i, w in enumerate(ws):
                p = p1(w) if i == 0 else ((bi[m][(ws[i - 1], w)] if (ws[i - 1], w) in kept else 0) + M.STRENGTH * p1(w)) / (
                    held[m][ws[i - 1]] + M.STRENGTH)
                loss[m] -= math.log(p)
        out[d] = [x / len(ws) if ws else 0.0 for x in loss]
    return out


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").where("doc_id < 150")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    for vocabulary, bigrams in ((300, 500), (100_000, 10**7)):
        models = M.fit(docs, labels, vocabulary=vocabulary, bigrams=bigrams)
        out, c = M.score(docs, models, keep=["doc_id"])
        want = brute(texts, good, vocabulary, bigrams)
        for r in out.collect():
            assert np.allclose([r[c]["target_loss"], r[c]["background_loss"]], want[r["doc_id"]], rtol=1e-9)


def test_models_are_distributions(spark, docs_of):
    docs = docs_of(["a b a c", "b b a", "a c d"])
    m = M.fit(docs, spark.createDataFrame([(0, 1, 0)], LABELS), vocabulary=3, bigrams=100)
    assert np.allclose(m.p.sum(axis=1), 1)
    size = len(m.words) + 1
    for k in (0, 1):
        for v in range(size):
            row = M.STRENGTH * m.p[k].copy()
            for code, n in zip(m.codes, m.code_counts[k]):
                if code // size == v:
                    row[code % size] += n
            assert abs((row / m.held[k][v]).sum() - 1) < 1e-12


def test_prefers_the_target_and_edges(spark, docs_of):
    docs = docs_of([None, "", *["red green blue " * 9] * 9, *["one two three " * 9] * 9, (50, "red " * 30_000)],
                   extra=["n_words", "good"])
    labels = spark.createDataFrame([(2, 1, None), (3, 1, 0), (None, 1, 0), (4, 0, 0), (4, 1, 0)], LABELS)
    out, c = M.score(docs, M.fit(docs, labels))
    rows = {r["doc_id"]: r[c] for r in out.collect()}
    assert rows[0]["difference"] == rows[1]["difference"] == 0.0
    assert rows[5]["difference"] < 0 < rows[12]["difference"] and rows[50]["n_words"] == 30_000
    none = docs.where("false")
    assert M.score(none, M.fit(none, labels))[0].count() == 0


def test_whole_models_keep_every_word_bigram_and_label(spark, monkeypatch):
    """More words than any fixed vocabulary, each bigram, and all labelled documents."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").where("doc_id < 150")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    want = brute(texts, good, 10**7, 10**7)
    for cached, short, sample in ((0, 0, 1), (2_000, 300, 1), (M.CACHED, M.SHORT_KEYS, M.SAMPLE)):
        monkeypatch.setattr(M, "CACHED", cached)
        monkeypatch.setattr(M, "SHORT_KEYS", short)
        monkeypatch.setattr(M, "SAMPLE", sample)
        models = M.fit(docs, labels)
        assert models.losses.agg({"every": "sum"}).first()[0] == sum(len(folded_words((t or "").encode())) for t in texts.values())
        out, c = M.score(docs, models, keep=["doc_id"])
        rows = out.collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert np.allclose([r[c]["target_loss"], r[c]["background_loss"]], want[r["doc_id"]], rtol=1e-9)


def test_whole_models_back_off(spark, docs_of):
    labels = spark.createDataFrame([(0, 1, 0)], LABELS)
    models = M.fit(docs_of(["a b a c", "b b a", "a c d"]), labels)
    out, c = M.score(docs_of([(7, "b d zzz")]), models)
    p = [lambda n: (n + 1) / (4 + 5), lambda n: (n + 1) / (10 + 5)]
    counts, held = {"b": (1, 3), "d": (0, 1), "zzz": (0, 0)}, {"b": (1, 3), "d": (0, 0)}
    for k, field in ((0, "target_loss"), (1, "background_loss")):
        q = [p[k](counts[w][k]) for w in ("b", "d", "zzz")]
        loss = -(math.log(q[0]) + sum(math.log(M.STRENGTH * q[i + 1] / (held[w][k] + M.STRENGTH)) for i, w in enumerate(("b", "d"))))
        assert math.isclose(out.first()[c][field], loss / 3, rel_tol=1e-12)


def test_every_labelled_document_is_in_the_target(spark):
    n = 20_100
    docs = spark.range(n).selectExpr("id as doc_id", "'a b' as text")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    m = M.fit(docs, labels, vocabulary=2, bigrams=10)
    assert m.word_counts.tolist() == [[n, n, 0], [n, n, 0]]
    back = M.fit(docs, labels).words.select("held_a", "held_b").where("held_a is not null").collect()
    assert [tuple(r) for r in back] == [(n, n)]
