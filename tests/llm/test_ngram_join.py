"""Operator 13 against all pairs compared."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens.llm import ngram_join as J
from tests.conftest import SF_SMALL

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, size=4):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, percent=85, size=4):
    sets = [plain_set(t, size) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        names.setdefault(root(i), []).append(d)
    return sorted([(d, len(sets[i]), min((x for x in names[root(i)] if x is not None), default=None))
                   for i, (d, _) in enumerate(rows)], key=str)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at:at + 1] = rng.choice([[], [f"new{rng.random()}"], [words[at]] * 2])
    return " ".join(words)


def sample(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=90)
    texts = [None, "", " \t\n", "one", "One", "one two three", "one two three four", "a a a a a a a a a", "a a a a a a a a",
             "ünï Ünï Ä b c d e f"]
    for n in (7, 10, 30, 120, 300):
        base = rng.choices(vocabulary, k=n)
        texts += [edited(rng, base, rng.randint(0, max(1, n // 15))) for _ in range(8)]
        texts += [edited(rng, base, max(1, n // 60)) + f" tail{n} {i}" for i in range(6)]
    for i in range(60):  # one passage in unlike texts, in copies of it and in near ones
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 60)) + passage + rng.choices(vocabulary, k=rng.randint(0, 12))))
        texts.append(edited(rng, passage, rng.randint(0, 4)))
    texts += [" ".join(passage)] * 40 + [" ".join(rng.choices(vocabulary, k=20_000))] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (None, texts[20]), (5, texts[25]), (5, texts[25]), (None, "alone with no id at all here")]


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in ("id", "key", "n", "set_", "mark"):
        df = df.withColumn(name, F.lit("mine"))
    return sorted((tuple(r) for r in J.join(df, **options).collect()), key=str)


@pytest.mark.parametrize("percent, frequent, block", [(85, 32, 256), (85, 3, 2), (70, 2, 5)])
def test_equals_all_pairs(spark, monkeypatch, percent, frequent, block):
    """Production settings; nearly all tokens frequent, small blocks and shares."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "LEADER_SHARE", 3)
    monkeypatch.setattr(J, "SMALL", 48 if block == 256 else 4)
    monkeypatch.setattr(J, "COLUMNS", 4096 if block == 256 else 7)
    rows = sample(percent + frequent)
    assert result(spark, rows, percent=percent) == brute(rows, percent)


@given(st.integers(0, 10**6), st.sampled_from([67, 75, 85, 95, 100]))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_enough_keys(seed, percent):
    """Sets just above the threshold, tokens of all classes: the promised keys are shared."""
    rng = random.Random(seed)
    n = rng.randint(1, 200)
    common = [rng.getrandbits(64) for _ in range(n)]
    out = n * (100 - percent) // percent  # tokens that may differ in all
    cut = rng.randint(0, out)
    sets = [np.unique(np.array(common + [rng.getrandbits(64) for _ in range(k)], np.uint64)) for k in (cut, out - cut)]
    share, salt = rng.random(), rng.getrandbits(64)
    a, b = (J.index_keys(s, np.array([0 if hash((int(t), salt)) % 1000 >= share * 1000 else 1 + hash((int(t), salt, 1)) % 4 for t in s]), percent)
            for s in sets)
    both = len(np.intersect1d(*sets))
    if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) and set(sets[0].tolist()) != set(sets[1].tolist()):
        sure = min(a[1], b[1])
        assert sure >= 1 and len(np.intersect1d(a[0], b[0])) >= sure


def test_token_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdef", k=30)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(4)
    want = {}
    for t in set(texts):
        for s in plain_set(t):
            want[s] = want.get(s, 0) + 1
    got = [r["every"] for r in J.token_counts(df, 4, 3).collect()]
    assert sorted(got) == sorted(n for n in want.values() if n >= 3)


def test_empty_table_and_bounds(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    with pytest.raises(ValueError):
        J.join(spark.createDataFrame([], "doc_id bigint, text string"), percent=50)


def test_query_equals_all_pairs(spark):
    from staylens.llm.queries import op13_ngram_join

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_ngram_join(spark, SF_SMALL).collect()), key=str) == brute(rows)
