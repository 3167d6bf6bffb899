import random
import re

import numpy as np
import pytest

from staylens.llm import quality_rules as Q
from tests.conftest import SF_ORACLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base statistics, straight from their definition."""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))


@pytest.mark.parametrize("text", [
    "", " \n\t", "one", "a b c a b c", "a b c\na b c\n\n a b c", "é ü x\x0by\x0cz\r\n<#|> %", "w " * 90,
    "x y z w x y z q", "same\nsame\n same\nsame ", "퟿😀 # a",
])
def test_base_statistics(text):
    assert Q.statistics_of(text.encode())[:5] == plain(text)


def test_random_texts():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b", " ", "\n", "é", "|", " a b c ", "\t"]) for _ in range(rng.randrange(60)))
        assert Q.statistics_of(t.encode())[:5] == plain(t), repr(t)


def test_learn_finds_the_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] <= 0.3) | (x[:, 2] > 0.95)
    rules = Q.learn(x, bad, names=("a", "b", "c"))
    verdict = np.zeros(len(x), bool)
    for r in rules.rules:
        hit = np.ones(len(x), bool)
        for n, op, t in r.conditions:
            v = x[:, "abc".index(n)]
            hit &= v <= t if op == "<=" else v > t
        verdict |= hit
    assert (verdict == bad).mean() > 0.98 and (verdict & ~bad).sum() <= 0.03 * verdict.sum()


def test_learn_without_contrast():
    x = np.ones((50, 2))
    assert Q.learn(x, np.zeros(50, bool), names=("a", "b")).rules == []
    assert Q.learn(x, np.ones(50, bool), names=("a", "b")).rules == []
    assert Q.learn(x, np.arange(50) % 2 == 0, names=("a", "b")).rules == []


def test_edges(spark, docs_of):
    long = "word " * 5 + " ".join(f"w{i}" for i in range(20_000))
    docs = docs_of([None, "", "short", long, (7, long), (7, long), (None, long)], extra=["kept", "N_Words", "quality_"])
    labels = spark.createDataFrame([(3, 1, None), (None, 0, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    rules = Q.fit(docs, labels)
    assert rules.rules == []
    out, c = Q.judge(docs, rules)
    got = {(r["doc_id"], r[c]["n_words"], r[c]["kept"]) for r in out.collect()}
    assert (0, 0, False) in got and (3, 20_005, True) in got and (None, 20_005, True) in got
    kept = Q.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.count() == 4  # repeated rows stay
    assert Q.keep_good(docs.where("false"), Q.fit(docs.where("false"), labels)).count() == 0


def test_ordered_conditional(spark):
    rules = Q.DecisionList([Q.Rule([("a", ">", 2.0)], False), Q.Rule([("a", ">", 1.0), ("b", "<=", 0.0)], True)], default=False)
    df = spark.createDataFrame([((3.0, 0.0),), ((2.0, 0.0),), ((2.0, 1.0),)], "s struct<a:double,b:double>")
    rows = df.select(rules.column("s").alias("v"), rules.number("s").alias("n")).collect()
    assert [tuple(r) for r in rows] == [(False, 1), (True, 2), (False, 0)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    rules = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    out, c = Q.judge(docs, rules, keep=["doc_id"])
    odd = out.join(labels.where("doc_id % 2 = 1"), "doc_id").where(f"not {c}.base_failed").select(f"{c}.kept", "quality").collect()
    good = [r.kept for r in odd if r.quality == 1]
    bad = [r.kept for r in odd if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)
