import datetime as dt
import re

from pyspark.sql import functions as F

from staylens.functions import bucket_midpoint, extract_phrases, parse_date, parse_number, phrase_set
from staylens.functions.numbers import unparsable

# Fixed value: the Python phrase pattern of the original analysis, used here as
# the oracle for the Unicode-class pattern run by the JVM.
PY_PATTERN = re.compile(r"\w[\w\s\/\(\)\-\_]*")


def _py_number(s):
    if s is None:
        return None
    text = re.sub(r"[^\d.]", "", s)
    try:
        return float(text)
    except ValueError:
        return None


def test_parse_number_money_fixture(spark):
    values = ["$1,250.00", "98%", "-$5", "", None, "$", "1.2.3", "$0.50", ".5", "5.",
              "\u0661\u0662\u0663.5 \u062c", "\U0001D7D9\U0001D7DA", "\u0967,\u0966\u0966\u0966"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(parse_number("s")).collect()]
    assert got == [_py_number(v) for v in values]
    assert got[:3] == [1250.0, 98.0, 5.0]  # percent not scaled, minus sign dropped
    bad = df.select(F.count_if(unparsable("s"))).first()[0]
    assert bad == 3  # '', '$', '1.2.3'


def test_parse_date(spark):
    df = spark.createDataFrame([("2016-01-04",), ("2017-01-02",), ("bad",), (None,)], "d string")
    got = [r[0] for r in df.select(parse_date("d")).collect()]
    assert got == [dt.date(2016, 1, 4), dt.date(2017, 1, 2), None, None]


def test_bucket_midpoint_truncates_toward_zero(spark):
    df = spark.createDataFrame([(v,) for v in [0, 9, 10, 49, 50, None, -7]], "v long")
    w10 = [r[0] for r in df.select(bucket_midpoint("v", 10)).collect()]
    w50 = [r[0] for r in df.select(bucket_midpoint("v", 50)).collect()]
    py = lambda v, w: None if v is None else int(v / w) * w + w / 2
    assert w10 == [py(v, 10) for v in [0, 9, 10, 49, 50, None, -7]]
    assert w50 == [py(v, 50) for v in [0, 9, 10, 49, 50, None, -7]]
    assert w10[-1] == 5.0


PHRASE_TEXTS = [
    '{TV,"Cable TV",Internet,"Wireless Internet"}',
    "['email', 'phone', 'reviews']",
    "{}",
    None,
    "{Café,Crème brûlée,Ñandú}",
    '{"24-Hour Check-in","Washer / Dryer",(Pets)}',
    "{TV,tv,TV,Tv}",
    "MiXeD CaSe, ÅNGSTRÖM_x",
    "",
    "{Cable\u00a0TV,a\u3000b,x\x1cy,p\x0bq,r\u2009s,\u00a0lead}",
]


def test_extract_phrases_matches_python(spark):
    df = spark.createDataFrame([(t,) for t in PHRASE_TEXTS], "s string")
    got = [r[0] for r in df.select(extract_phrases("s")).collect()]
    for text, phrases in zip(PHRASE_TEXTS, got):
        if text is None:
            assert phrases is None
        else:
            assert phrases == PY_PATTERN.findall(text.lower()), text


def test_phrase_set_distinct_and_empty_for_missing(spark):
    df = spark.createDataFrame([(t,) for t in PHRASE_TEXTS], "s string")
    got = [r[0] for r in df.select(phrase_set("s")).collect()]
    for text, phrases in zip(PHRASE_TEXTS, got):
        expect = set(PY_PATTERN.findall(text.lower())) if text is not None else set()
        assert set(phrases) == expect
        assert len(phrases) == len(set(phrases))
    assert got[3] == []
    assert set(got[4]) == {"café", "crème brûlée", "ñandú"}


def test_phrase_class_equals_python_on_every_bmp_character(spark):
    from staylens.functions.phrases import PHRASE_PATTERN

    chars = [chr(cp) for cp in range(1, 0x10000) if not 0xD800 <= cp <= 0xDFFF]
    texts = ["a" + c + "b" for c in chars]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select(
        "i", F.regexp_extract_all("t", F.lit(PHRASE_PATTERN), F.lit(0)).alias("p")).collect()}
    bad = [chars[i] for i, t in enumerate(texts) if got[i] != PY_PATTERN.findall(t)]
    # white space and punctuation agree exactly; the only differences are letters
    # and digits added in Unicode versions newer than the JVM's character tables
    import unicodedata
    assert all(unicodedata.category(c)[0] in "LN" for c in bad), [hex(ord(c)) for c in bad]
    assert len(bad) < 200


def test_parse_number_passes_numbers_through(spark):
    df = spark.createDataFrame([(12345678.0, -5, None), (-0.5, 7, "$1,000")], "d double, i int, s string")
    got = [tuple(r) for r in df.select(parse_number("d"), parse_number("i"), parse_number("s")).collect()]
    assert got == [(12345678.0, -5.0, None), (-0.5, 7.0, 1000.0)]


def test_bucket_of_values_without_one(spark):
    from staylens.functions import bucket_midpoint

    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (-7.0,)], "x double")
    assert [r[0] for r in df.select(bucket_midpoint("x", 10)).collect()] == [None, None, None, 5.0]
