"""Operator 11 against a plain Python tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from staylens.llm import merkle, queries
from tests.conftest import SF_SMALL

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, slots):
    """(top, siblings of each node as (left, right) steps)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            lo = p // slots * slots
            paths[i].append(("".join(nodes[lo:p]), "".join(nodes[p + 1:lo + slots])))
            at[i] = p // slots
        nodes = [h("".join(nodes[lo:lo + slots])) for lo in range(0, len(nodes), slots)]
    return nodes[0], paths


def brute(rows, slots=16):
    """Sorted (doc_id, leaf, subroot, root, siblings) of all rows."""
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[1] is None else "1" + r[1], []).append(r)
    keys = sorted(groups, key=str.encode)
    trees = {}
    for g in keys:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = own, *climb([plain_leaf(r) for r in own], slots)
    root, upper = climb([trees[g][1] for g in keys], slots) if keys else (None, [])
    out = []
    for g, up in zip(keys, upper):
        own, subroot, paths = trees[g]
        out += [(r[0], plain_leaf(r), subroot, root, "".join(a + b for a, b in [*p, *up])) for r, p in zip(own, paths)]
    return sorted(out, key=str)


ROWS = [
    (None, None, None, None, None), (3, None, "en", 5, "Hello"), (3, None, "en", 5, "Hello"), (3, None, "en", 5, "hellO"),
    (1, "", "", 0, ""), (7, "one", "de", 4, "Ünï:-"), (-5, "one", None, 1, "x"),
    *[(i, "many", "en", i, f"Text {i} " * (i % 7)) for i in range(300)],
    *[(9, "same", "en", 1, "A")] * 40, (2, "long", "fr", 400_000, "Wort " * 80_000),
]


@pytest.mark.parametrize("slots", [3, 16])
def test_equals_a_plain_tree(spark, slots):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    made = merkle.manifest(df, FIELDS, "doc_id", "source", slots=slots)
    got = made.rows.select("key", "leaf", "subroot", "root", merkle.siblings(F.col("path")),
                           merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(ROWS, slots)
    assert {r[5] for r in got} == {made.root}


def test_lone_rows_and_empty_table(spark):
    one = merkle.manifest(spark.createDataFrame(ROWS[:1], SCHEMA), FIELDS, "doc_id", "source")
    row = one.rows.first()
    assert row["leaf"] == row["subroot"] == row["root"] == one.root == h("-----") and row["path"] == []
    none = merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS, "doc_id", "source")
    assert none.root is None and none.rows.count() == 0


def test_columns_of_any_name(spark):
    df = spark.createDataFrame(ROWS[:20], SCHEMA)
    clash = df
    for name in ("g", "digest", "pos", "m", "key_", "tie_", "c0", "path", "leaf", "also_", "a.b"):
        clash = clash.withColumn(name, F.lit("x"))
    a, b = (merkle.manifest(x, FIELDS, "doc_id", "source").rows.select("key", "leaf", "root", "path").collect() for x in (df, clash))
    assert sorted(a, key=str) == sorted(b, key=str)


def test_query_finds_the_tampered_rows(spark):
    rows = queries.op11_merkle_manifest(spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*FIELDS).collect()
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows) == sorted(
        (a, b, c, d, h(e)) for a, b, c, d, e in brute([tuple(r) for r in docs]))
    text = {r["doc_id"]: r["text"] for r in docs}
    for r in rows:
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text[r["doc_id"]] or "")
        assert r["verified"] == (not hit) == (r["folded_root"] == r["root"])
