import re

import pandas as pd
import pytest

from staylens.operators import encode

from .test_functions import PHRASE_TEXTS, PY_PATTERN


@pytest.fixture()
def levels(spark):
    data = [(1, "b", "x", None, "Apt"), (2, "a", "x", None, "apt"), (3, None, "x", None, "APT"),
            (4, "c d", "x", None, "a.b"), (5, "a", None, None, "a_b")]
    return spark.createDataFrame(data, "id long, c string, one string, nul string, odd string")


def test_one_hot_matches_get_dummies(levels):
    out = encode.one_hot(levels.select("id", "c", "one"), ["c", "one"])
    pdf = levels.select("id", "c", "one").toPandas()
    want = pd.get_dummies(pdf, columns=["c", "one"], dummy_na=True, drop_first=True)
    want.columns = [re.sub(r"[^0-9A-Za-z_]+", "_", c) for c in want.columns]
    got = out.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    for col in want.columns:
        assert list(got.sort_values("id")[col].astype(int)) == list(want.sort_values("id")[col].astype(int)), col
    # one-level column keeps only the missing-level indicator
    assert [c for c in out.columns if c.startswith("one_")] == ["one_nan"]


def test_one_hot_all_null_and_names(levels):
    out = encode.one_hot(levels.select("id", "nul"), ["nul"])
    assert out.columns == ["id"]  # the only level (missing) is the first and is dropped
    # 'APT' / 'Apt' / 'apt' and 'a.b' / 'a_b' sanitise alike: the later ones get a hash suffix
    fitted = encode.fit_one_hot(levels.select("id", "odd"), ["odd"])
    names = fitted.names("odd")
    assert len({n.lower() for n in names}) == len(names)
    assert names[0] == "odd_Apt" and names[-1] == "odd_nan"
    out = encode.apply_one_hot(levels.select("id", "odd"), fitted)
    assert sorted(out.columns) == sorted(["id", *names])


def test_fit_apply_reuse(levels, spark):
    fitted = encode.fit_one_hot(levels, ["c"])
    new = spark.createDataFrame([(9, "zzz"), (10, "b")], "id long, c string")
    got = encode.apply_one_hot(new, fitted).orderBy("id").collect()
    assert [r["c_b"] for r in got] == [0, 1]  # unseen level: all zeros


def _py_indicators(texts):
    sets = [set(PY_PATTERN.findall(t.lower())) if t is not None else set() for t in texts]
    vocab = sorted(set().union(*sets))
    return vocab, [[1 if p in s else 0 for p in vocab] for s in sets]


def test_phrase_indicators_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PHRASE_TEXTS)], "id long, s string")
    vocab, want = _py_indicators(PHRASE_TEXTS)
    fitted = encode.fit_phrase_indicators(df, ["s"])
    assert fitted.phrases["s"] == vocab
    out = encode.apply_phrase_indicators(df, fitted).orderBy("id")
    assert "s" not in out.columns
    names = fitted.names("s")
    got = [[r[n] for n in names] for r in out.collect()]
    assert got == want


def test_phrase_vocabulary_counts_rows(spark):
    df = spark.createDataFrame([("{TV,tv,Internet}",), ("{TV}",), (None,)], "s string")
    got = dict((r[0], r[1]) for r in encode.phrase_vocabulary(df, "s").collect())
    assert got == {"tv": 2, "internet": 1}


def test_phrases_long_on_documents(spark):
    from .conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = encode.phrases_long(docs, "doc_id", "text")
    pdf = docs.toPandas()
    want = {(r.doc_id, p) for r in pdf.itertuples() if r.text is not None
            for p in PY_PATTERN.findall(r.text.lower())}
    assert {(r[0], r[1]) for r in got.collect()} == want


def test_fit_encoders_equals_separate_fits(spark):
    df = spark.createDataFrame(
        [(1, "{TV,Internet}", "House", "a"), (2, None, "Flat", None), (3, "{tv}", None, "b")],
        "id long, amenities string, pt string, rt string")
    vocab, levels = encode.fit_encoders(df, ["amenities"], ["pt", "rt"])
    assert vocab.phrases == encode.fit_phrase_indicators(df, ["amenities"]).phrases
    assert levels.levels == encode.fit_one_hot(df, ["pt", "rt"]).levels


def test_empty_input_through_encoders(spark):
    df = spark.createDataFrame([], "id long, amenities string, pt string")
    assert encode.phrase_indicators(df, ["amenities"]).columns == ["id", "pt"]
    out = encode.one_hot(df, ["pt"])
    assert out.columns == ["id", "amenities"] and out.count() == 0
    vocab, levels = encode.fit_encoders(df, ["amenities"], ["pt"])
    assert vocab.phrases == {"amenities": []} and levels.levels == {"pt": []}
    assert encode.phrase_vocabulary(df, "amenities").count() == 0


def test_encoded_vector_equals_the_columns(spark):
    df = spark.createDataFrame(
        [(1, "{TV,Internet}", "House", "a"), (2, None, "Flat", None), (3, "{tv}", None, "b"), (4, "", "", "b")],
        "id long, amenities string, pt string, rt string")
    vocab, levels = encode.fit_encoders(df, ["amenities"], ["pt", "rt"])
    wide = encode.apply_one_hot(encode.apply_phrase_indicators(df, vocab), levels)
    out, names = encode.encoded_vector(df, vocab, levels, "v")
    assert names == wide.columns[1:]
    want = {r["id"]: [float(r[n]) for n in names] for r in wide.collect()}
    assert {r["id"]: r["v"].toArray().tolist() for r in out.collect()} == want


def test_thousands_of_phrases(spark):
    df = spark.range(0, 3000).selectExpr("id", "concat('{p', id, ',q', id % 10, '}') AS s")
    vocab, levels = encode.fit_encoders(df, ["s"], [])
    out, names = encode.encoded_vector(df, vocab, levels, "v")
    assert len(names) == 3010 and out.where("id = 7").first()["v"].numNonzeros() == 2
