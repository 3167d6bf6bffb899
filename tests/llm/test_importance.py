import math
from collections import Counter

import numpy as np

from staylens.llm import importance as I
from staylens.llm.common import folded_words
from tests.conftest import SF_ORACLE

LABELS = "doc_id bigint, quality int, toxic int"


def test_weights_and_ranks_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    got = {r["doc_id"]: r for r in I.resample(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    grams = {d: Counter(I.buckets(folded_words(t.encode())).tolist()) for d, t in texts.items()}
    target, raw = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if d in good:
            target.update(g)
    nt, nr = sum(target.values()), sum(raw.values())
    for d, g in grams.items():
        want = sum(n * math.log((target[b] + I.PRIOR * raw[b] / nr) / (nt + I.PRIOR) / (raw[b] / nr)) for b, n in g.items())
        assert abs(got[d]["log_weight"] - want) < 1e-6 * max(1, abs(want))
    order = sorted(got.values(), key=lambda r: (-r["gumbel_key"], r["doc_id"]))
    assert [r["rank"] for r in order] == list(range(1, len(order) + 1))
    assert sum(r["selected"] for r in order) == math.ceil(len(order) / 2)


def test_prefers_the_target(spark, docs_of):
    docs = docs_of([("red green blue " * 5) if i % 2 else ("one two three " * 5) for i in range(60)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 30, 2)], LABELS)
    rows = I.resample(docs, labels).collect()
    assert all((r["doc_id"] % 2 == 1) == (r["log_weight"] > 0) for r in rows)


def test_gumbel_draws_in_proportion(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    labels = spark.createDataFrame([], LABELS)
    out = I.resample(rows, labels, share=0.25)
    got = out.collect()
    keys = np.array([r["gumbel_key"] for r in got])
    assert abs(keys.mean() - 0.5772) < 0.03 and abs(keys.std() - math.pi / math.sqrt(6)) < 0.03
    assert sum(r["selected"] for r in got) == 5000


def test_edges(spark, docs_of):
    docs = docs_of([None, "", "a b", (5, "x " * 50_000), (6, "same"), (6, "same"), (None, "a b")], extra=["rank", "id_"])
    out = I.resample(docs, spark.createDataFrame([(2, 1, None), (5, 0, 0), (5, 1, 0), (None, 1, 1)], LABELS))
    rows = out.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 8)) and sum(r["selected"] for r in rows) == 4
    assert all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (0, 1))
    empty = docs.where("false")
    assert I.resample(empty, spark.createDataFrame([], LABELS)).count() == 0
