import random
import re

import duckdb
import pytest

from staylens.llm import oracles, secret_scan as S
from staylens.llm.queries import op6_secret_scan
from tests.conftest import SF_ORACLE, SF_SMALL

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEY = "0123456789abcdef" * 2


def plain(text):
    """All spans, with Python's regexes and the patterns as the contract states them."""
    out = []
    for i, r in enumerate(S.RULES):
        pattern = "[0-9a-f]+" if r.kind == "hex" else r.pattern
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if r.any_case else 0)):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "password=abcdef", "PassWord : 'abc.def=='", "api_key=\"x\" apikey: yyyyyy", "secret=token:abcdefgh",
    "token==abc token==abcd5", f"é😀 AKIA{'Z' * 16} AKIA{'Z' * 15}", f"AKIAAKIA{'0' * 16}", KEY, KEY[:23], KEY + "g" + KEY,
    f"token = \"{KEY}\"\npasswd={KEY}", "ghp_" + "a" * 36, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----",
    "eyJhbGciOi.eyJzdWIiOi.abcdefgh12", "sK_live_" + "a" * 20, "sk_live_" + "a" * 20, "AIza" + "b" * 35,
    "toKen=abcdef ſecret=abcdef", "x" * 100_000 + "secret=0123456789" + "é" * 1000 + KEY,
    "passpassword=passwd=secret", " password=abcdef" * 300,
]


def test_spans(spark, docs_of):
    docs = docs_of([*TEXTS, (3, TEXTS[3]), (None, "token=abcdef")], extra=["key", "rules", "Body_"])
    out, c = S.scan(docs)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        got = [(s["start"], s["kind"], s["end"]) for s in r[c]]
        assert got == plain(r["text"] or ""), (r["text"] or "")[:80]
    assert S.scan(docs.where("false"))[0].count() == 0


def test_random_texts(spark, docs_of):
    rng = random.Random(2)
    bits = ["password", "passwd", "secret", "Token", "api_key", "=", ":", " ", "'", "abcdef", "AKIA", "AB12" * 5, KEY, "é", ".", "\n"]
    docs = docs_of(["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)])
    out, c = S.scan(docs)
    for r in out.collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r[c]] == plain(r["text"]), r["text"]


def test_trigram_queries():
    by = {r.kind: S.trigram_query(r.pattern) for r in S.RULES}
    assert by["hex"] == [] and len(by["assign"]) == 6 and by["access"] == [frozenset({"aki", "kia"})]
    for pattern, want in [("ab", []), ("abc", [{"abc"}]), ("(abc|de)", []), ("(abc|def)x?", [{"abc"}, {"def"}]),
                          ("abcd*", [{"abc"}]), ("abc[0-9]+def", [{"abc", "def"}]), ("(?:abc)+", [{"abc"}]), ("a.c", []),
                          ("x(abcd|abce)y", [{"xab", "abc", "bcd", "cdy"}, {"xab", "abc", "bce", "cey"}])]:
        assert sorted(map(sorted, S.trigram_query(pattern))) == sorted(map(sorted, want)), pattern


def test_every_match_satisfies_its_query():
    for r in S.RULES:
        query = S.trigram_query(r.pattern)
        for text in TEXTS:
            for m in re.finditer(r.pattern, text or "", re.IGNORECASE | re.ASCII if r.any_case else 0):
                low = m[0].lower()
                assert not query or any(all(t in low for t in clause) for clause in query)


def test_native_plan(spark):
    plan = op6_secret_scan(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_redact(spark, docs_of):
    docs = docs_of(["a password=abcdef, b", f"token={KEY} end", None, "clean é", KEY], extra=["spans_"])
    out = S.redact(docs, length="n_chars")
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {0: ("a [SECRET], b", 13), 1: ("[SECRET] end", 12), 2: (None, 0), 3: ("clean é", 7), 4: ("[SECRET]", 8)}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r for r in con.execute(oracles.OP6).fetchall()}
    assert {r[0]: tuple(r) for r in op6_secret_scan(spark, sf).collect()} == want
