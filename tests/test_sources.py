import datetime as dt
import os

from pyspark.sql import types as T

from staylens.sources import head_rows, profile, read_table, tail_rows, write_table
from staylens.sources import standins

from .conftest import SF_SMALL, rows

CSV = '''id,name,price,note,empty,score
1,"Cosy flat","$1,250.00","multi
line ""quoted"" cell",,9.5
2,Loft,$85.00,N/A,,NaN
3,,$40.00,plain,,
'''


def test_read_csv_fixture(spark, scratch):
    path = os.path.join(scratch, "listings.csv")
    with open(path, "w") as fh:
        fh.write(CSV)
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("price", T.StringType()), T.StructField("note", T.StringType()),
        T.StructField("empty", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    df = read_table(spark, path, schema)
    got = rows(df.orderBy("id"))
    assert len(got) == 3  # multi-line quoted cell stays one row
    assert got[0] == (1, "Cosy flat", "$1,250.00", 'multi\nline "quoted" cell', None, 9.5)
    assert got[1][3] is None  # N/A is missing
    assert got[1][5] is None  # NaN becomes NULL
    assert got[2][1] is None  # empty text is missing
    assert dict(df.dtypes)["empty"] == "double"  # all-empty column keeps its declared type
    out = os.path.join(scratch, "listings.parquet")
    write_table(df, out)
    assert rows(read_table(spark, out, fmt="parquet").orderBy("id")) == got


def test_head_tail_profile(spark):
    cal = standins.calendar(spark, SF_SMALL)
    order = ["date", "listing_id", "available"]
    head = rows(head_rows(cal, 5, order))
    tail = rows(tail_rows(cal, 5, order))
    allrows = sorted(rows(cal), key=lambda r: (r[1], r[0], r[2]))
    assert head == allrows[:5]
    assert tail == allrows[-5:]
    p = profile(cal, ["listing_id", "date"], ["date"]).first()
    assert p["rows"] == len(allrows)
    assert p["distinct_listing_id"] == len({r[0] for r in allrows})
    assert p["distinct_date"] == len({r[1] for r in allrows})
    assert isinstance(p["min_date"], dt.date)
    approx = profile(cal, ["listing_id"], approx=True).first()
    assert abs(approx["distinct_listing_id"] - p["distinct_listing_id"]) <= 0.05 * p["distinct_listing_id"]


def test_standin_listings_shape(spark):
    df = standins.listings(spark, SF_SMALL)
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    assert df.count() == part.count()
    for c in ["id", "neighbourhood_cleansed", "price", "availability_365", "amenities",
              "host_verifications", "square_feet", "review_scores_rating"]:
        assert c in df.columns


def test_read_single_line_csv_splits(spark, scratch):
    path = os.path.join(scratch, "cal.csv")
    with open(path, "w") as fh:
        fh.write("listing_id,date,available,price\n")
        for i in range(2000):
            fh.write(f"{i},2016-01-04,t,$85.00\n")
    schema = T.StructType([T.StructField("listing_id", T.LongType()),
                           T.StructField("date", T.StringType()),
                           T.StructField("available", T.StringType()),
                           T.StructField("price", T.StringType())])
    a = read_table(spark, path, schema)
    b = read_table(spark, path, schema, multi_line=False)
    assert sorted(rows(a)) == sorted(rows(b)) and b.count() == 2000


def test_parquet_is_cleaned_like_csv(spark, scratch):
    import os

    from pyspark.sql import types as T

    path = os.path.join(scratch, "t.parquet")
    spark.createDataFrame([("1", float("nan"), "x"), ("N/A", 2.0, "NA")], "a string, b double, c string").write.parquet(path)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    got = rows(read_table(spark, path, schema, fmt="parquet"), "sorted")
    assert got == sorted([(1, None, "x"), (None, 2.0, None)], key=repr)


def test_profile_range_skips_nan(spark):
    from staylens.sources import preview

    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    r = preview.profile(df, [], ["x"]).first()
    assert (r["min_x"], r["max_x"]) == (1.0, 3.0)
