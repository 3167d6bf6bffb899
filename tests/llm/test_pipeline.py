"""run() against a plain Python pipeline with the same learned rules."""

import hashlib
import re

import corpus_pipeline as P
from staylens.llm import quality_rules as Q
from staylens.llm.queries import tokenizer
from tests.conftest import SF_SMALL
from tests.llm import test_decontaminate, test_minhash, test_quality_rules, test_secret_scan


def test_stages():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "minhash_dedup", "decontaminate", "secret_scan", "byte_bpe"]
    assert P.ORACLE_SQL is None


def test_run_matches_brute_force(spark):
    import tiktoken

    from staylens.llm.bpe import read_ranks

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rules = Q.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    texts = {}
    for r in docs.collect():
        stats = dict(zip((*Q.BASE, *Q.RATIOS), Q.statistics_of(r["text"].encode())))
        assert tuple(stats[n] for n in Q.BASE) == test_quality_rules.plain(r["text"])
        if stats["n_words"] < 50 or 100 * stats["n_repeat_words"] > 50 * stats["n_words"]:
            continue
        first = next((x for x in rules.rules if all(stats[n] <= t if op == "<=" else stats[n] > t
                                                     for n, op, t in x.conditions)), None)
        if first is None or first.keep:
            texts[r["doc_id"]] = r["text"]
    texts = {d: texts[d] for d, c in test_minhash.classes(texts).items() if d == c}
    clean = {}
    for d, t in texts.items():
        n, h, _ = test_decontaminate.brute(t, items, 13)
        if not (h and 20 * h >= n):
            clean[d] = t
    ranks = read_ranks(tokenizer()["path"])
    enc = tiktoken.Encoding("own", pat_str=tokenizer()["pattern"], mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in clean.items():
        out, at = [], 0
        for a, _, b in test_secret_scan.plain(t):
            if a >= at:
                out.append(t[at:a] + "[SECRET]")
            at = max(at, b)
        ids = enc.encode_ordinary("".join(out) + t[at:])
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in P.run(spark, SF_SMALL).collect()}
    assert got == want


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.schema.names == docs.schema.names and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name


def test_empty_table(spark):
    none = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        assert stage(spark, none, SF_SMALL).count() == 0, name


def test_pattern_is_the_public_one():
    assert re.search("p\\{L\\}", tokenizer()["pattern"])
