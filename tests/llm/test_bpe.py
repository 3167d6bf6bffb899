import hashlib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import bpe as B
from staylens.llm.queries import op9_byte_bpe, tokenizer
from tests.conftest import SF_SMALL

tiktoken = pytest.importorskip("tiktoken")
T = tokenizer()
RANKS = B.read_ranks(T["path"])
CODEC = B.Codec(RANKS, T["pattern"])
WANT = tiktoken.Encoding("own", pat_str=T["pattern"], mergeable_ranks=RANKS, special_tokens={}).encode_ordinary

TEXTS = ["", " ", "  ", "\n", " a", "a  b", "a \n b", "don't we'll 'S", "x  y", "x 　y", "123 456", "<|endoftext|>", "é ü 漢字 😀👨‍👩‍👧",
         "a\x1c b", "  x", "tab\tspace \t x", "trailing ", "ends\n", "\r\n\r\n ", "a" * 3000, "word " * 2000]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == WANT(text)
    assert CODEC.decode_bytes(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids == WANT(text) and CODEC.decode(ids) == text


def test_every_character():
    for c in map(chr, range(0x110000)):
        if unicodedata.category(c) != "Cs" and ord(c) % 7 == 0:
            assert CODEC.encode(f"a{c} {c}b") == WANT(f"a{c} {c}b"), hex(ord(c))


def test_offsets_and_split_characters():
    text = "né 😀漢x"
    ids = CODEC.encode(text)
    places = CODEC.offsets(text, ids)
    raw, at = text.encode(), 0
    for i, (a, b) in zip(ids, places):
        piece = CODEC.bytes[i]
        first, last = len(raw[:at].decode("utf-8", "ignore")), at + len(piece)
        assert a <= first and text[a:b].encode().find(piece) >= 0 and b >= len(raw[:last].decode("utf-8", "ignore"))
        at = last
    single = [i for i in ids if len(CODEC.bytes[i]) == 1 and CODEC.bytes[i][0] >= 128]
    assert single and "�" in CODEC.decode(single[:1])
    assert CODEC.offsets("", []) == []


def test_rows(spark, docs_of):
    docs = docs_of([None, "", "é 😀", (5, "x " * 60_000), (5, "x " * 60_000), (None, "a")], extra=["ids", "n_tokens", "bpe_"])
    out, c = B.encode(docs, **T, offsets=True)
    flat = out.selectExpr("doc_id", "text", f"{c}.ids as ids", f"{c}.starts as starts")
    rows = flat.collect()
    assert len(rows) == 6 and all(list(r["ids"]) == WANT(r["text"] or "") and len(r["ids"]) == len(r["starts"]) for r in rows)
    back = B.decode(flat.drop("text"), T["path"]).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in rows)
    assert B.encode(docs.where("false"), **T)[0].count() == 0


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = op9_byte_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = WANT(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
