import random
from collections import Counter

import numpy as np
import pytest

from staylens.llm import minhash as M
from staylens.llm.common import folded_words
from tests.conftest import SF_ORACLE, SF_SMALL


def grams(text):
    ws = folded_words((text or "").encode())
    if not ws:
        return Counter()
    if len(ws) < 5:
        return Counter([tuple(ws)])
    return Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))


def similarity(a, b, low=0.0):
    """Probability Jaccard from its definition (0 if even its upper bound is low)."""
    total, na, nb = 0.0, sum(a.values()), sum(b.values())
    if sum(min(a[d] / na, b[d] / nb) for d in a.keys() & b.keys()) < low - 1e-9:
        return 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys())
    return total


def classes(texts):
    """Brute force: components of all pairs at 0.8 or more, named by the smallest id."""
    sets = {d: grams(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    index = {}
    for d, g in sets.items():
        for e in g:
            index.setdefault(e, []).append(d)
    pairs = {(a, b) for ds in index.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        if top(a) != top(b) and similarity(sets[a], sets[b], 0.8) >= 0.8 - 1e-9:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: top(d) for d in texts}


def test_probability_jaccard():
    rng = random.Random(0)
    hashes = M.WordHashes()

    def sets(ws):
        _, c, w = M.shingles([ws], hashes)
        return c, w

    for _ in range(60):
        a = [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(1, 25))]
        b = [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(1, 25))]
        want = similarity(grams(b" ".join(a).decode()), grams(b" ".join(b).decode()))
        assert abs(M.probability_jaccard(*sets(a), *sets(b)) - want) < 1e-9
    assert M.probability_jaccard(*sets([b"q"]), *sets([b"q"])) == 1.0


def test_registers_estimate_it():
    rng = np.random.default_rng(1)
    code = M.mix(np.arange(300, dtype=np.uint64))
    wa, wb = rng.integers(1, 5, 200), rng.integers(1, 5, 200)
    ca, cb = np.sort(code[:200]), np.sort(code[60:260])
    who = np.repeat([0, 1], 200)
    sig = M.signatures(who, np.concatenate((ca, cb)), np.concatenate((wa, wb)), 2, 4096)
    want = M.probability_jaccard(ca, wa, cb, wb)
    assert abs((sig[0] == sig[1]).mean() - want) < 5 * (want * (1 - want) / 4096) ** 0.5
    alone = M.signatures(np.zeros(200, int), ca, wa, 1, 4096)  # a text's registers are its own
    assert (alone[0] == sig[0]).all()


def test_weights_do_not_scale():
    code = np.sort(M.mix(np.arange(50, dtype=np.uint64)))
    w = np.arange(1, 51)
    z = np.zeros(50, int)
    assert (M.signatures(z, code, w, 1, 64) == M.signatures(z, code, 7 * w, 1, 64)).all()


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_classes_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(docs).collect()}
    assert got == classes(texts)


def chain(n):
    """Texts of which only neighbours are near copies, and a base with many variants."""
    rng = random.Random(4)
    ws = [f"w{i}" for i in range(n * 6 + 200)]
    texts = [" ".join(ws[i * 6:i * 6 + 200]) for i in range(n)]
    base = [f"b{i}" for i in range(120)]
    for k in range(40):
        v = list(base)
        v[rng.randrange(120)] = f"v{k}"
        v[rng.randrange(120)] = f"u{k}"
        texts.append(" ".join(v))
    return [*texts, " ".join(base)]


def test_chains_and_stars(spark, monkeypatch):
    texts = dict(enumerate(chain(30)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    want = classes(texts)
    for leaders, block in ((False, 256), (True, 256), (False, 7), (True, 7)):  # the same classes in any order and blocks
        monkeypatch.setattr(M, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(docs, leaders=leaders).collect()}
        assert got == want


def test_components(spark):
    rng = random.Random(9)
    for _ in range(3):
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
        df = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in edges], "a binary, b binary")
        got = {int(bytes(r["key"])): int(bytes(r["root"])) for r in M.components(df).collect()}
        root = {}

        def top(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x
        for a, b in edges:
            if a != b:
                x, y = sorted((top(a), top(b)))
                root[y] = x
        assert got == {x: top(x) for x in list(root)}


def test_edges(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = docs_of([None, "", "...", "a b", "A, b!", (7, long), (6, long + " end"), (6, long + " end"), (None, long), (9, "lone text")],
                   extra=["key", "class_id", "key_"])
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in M.near_duplicates(docs).collect())
    assert got == sorted([("0", "0"), ("1", "1"), ("2", "2"), ("3", "3"), ("4", "3"), ("7", "6"), ("6", "6"), ("6", "6"), ("None", "6"), ("9", "9")])
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "2", "3", "6", "9"]
    nobody = docs.selectExpr("cast(null as bigint) doc_id", "text").where("length(text) > 100")
    assert M.keep_one(nobody).count() == 1
    assert M.near_duplicates(docs.where("false")).count() == 0 and M.keep_one(docs.where("false")).count() == 0


@pytest.mark.parametrize("threshold,bands", [(0.6, 24), (0.6, 6), (0.8, 24)])
def test_every_pair_that_shares_a_band_is_verified(threshold, bands):
    """Registers that agree in one band alone say nothing against a link."""
    rng, rows = np.random.default_rng(3), 5
    a, b, c = rng.integers(0, 2**32, (3, bands * rows), dtype=np.uint32)
    b[:rows] = c[:rows] = a[:rows]
    near = " ".join(f"w{i}" for i in range(100))
    held = [(k, k, 0, 0, sig.tobytes(), text.encode()) for k, sig, text in (
        (b"a", a, near), (b"b", b, near + " x y z"), (b"c", c, "something else entirely " * 20))]
    assert M._meet((1, 0, 0), held, M.WordHashes(), rows, threshold, M.SHINGLE) == [(b"a", b"b")]
