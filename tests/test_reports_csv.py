"""End to end on listing-shaped CSV files: read, clean and run every report."""

import csv
import datetime as dt
import os
import random

import pytest

from staylens.plans import reports as R
from staylens.plans.constants import REVIEW_FEATURES
from staylens.sources import read_table
from staylens.sources.schemas import CALENDAR_SCHEMA, LISTINGS_SCHEMA

NEIGHBOURHOODS = ["Harbour", "Old Town", "Riverside", "Hillcrest", "Market Square",
                  "Northgate", "Eastbank", "Parkview", "University", "Lakeside",
                  "Greenfield", "City Centre"]


@pytest.fixture(scope="module")
def files(spark):
    rnd = random.Random(7)
    folder = os.path.join(spark._scratch, "csv-reports")
    os.makedirs(folder, exist_ok=True)
    lpath, cpath = os.path.join(folder, "listings.csv"), os.path.join(folder, "calendar.csv")
    header = [f.name for f in LISTINGS_SCHEMA.fields] + ["name", "summary", "zipcode", "bed_type",
                                                         "latitude", "license"]
    with open(lpath, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        for i in range(1, 121):
            row = {
                "id": i,
                "neighbourhood_cleansed": "" if i % 29 == 0 else rnd.choice(NEIGHBOURHOODS),
                "is_location_exact": rnd.choice("tttf"),
                "has_availability": "t",
                "availability_365": rnd.randint(0, 365),
                "price": f"${rnd.choice([55, 85, 99, 100, 120, 150, 175, 250, 1200]):,}.00",
                "property_type": "" if i == 7 else rnd.choice(["House", "Apartment", "Condominium"]),
                "room_type": rnd.choice(["Entire home/apt", "Private room", "Shared room"]),
                "bedrooms": rnd.choice(["1", "2", "3", ""]),
                "bathrooms": rnd.choice(["1.0", "1.5", "2.0", ""]),
                "square_feet": "" if i % 10 else "700",
                **{f: rnd.choice(["", "8", "9", "10"]) for f in REVIEW_FEATURES},
                "number_of_reviews": rnd.randint(0, 120),
                "cleaning_fee": rnd.choice(["", "$40.00", "$1,000.00"]),
                "security_deposit": rnd.choice(["", "$100.00", "$250.00"]),
                "host_acceptance_rate": rnd.choice(["N/A", "100%", "98%"]),
                "host_response_rate": rnd.choice(["", "100%", "90%"]),
                "extra_people": rnd.choice(["$0.00", "$15.00"]),
                "host_verifications": rnd.choice(["['email', 'phone', 'reviews']", "['phone']", "[]"]),
                "amenities": rnd.choice(['{TV,"Cable TV",Internet}', '{"Wireless Internet",Kitchen}', "{}"]),
                "name": f"Cosy place {i}",
                "summary": "Quiet street,\nclose to the \"market\"",
                "zipcode": "10001",
                "bed_type": rnd.choice(["Real Bed", "Futon"]),
                "latitude": f"{47.5 + rnd.random() / 10:.6f}",
                "license": "",
            }
            w.writerow([row[c] for c in header])
    start = dt.date(2016, 1, 4)
    with open(cpath, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(["listing_id", "date", "available", "price"])
        for i in range(1, 121):
            for d in range(40):
                avail = "t" if rnd.random() < 0.6 else "f"
                w.writerow([i, (start + dt.timedelta(days=d)).isoformat(), avail,
                            "$85.00" if avail == "t" else ""])
    listings = read_table(spark, lpath, LISTINGS_SCHEMA)
    calendar = read_table(spark, cpath, CALENDAR_SCHEMA)
    return listings, calendar


def test_read_keeps_undeclared_columns(files):
    listings, calendar = files
    assert listings.count() == 120 and calendar.count() == 120 * 40
    assert {"name", "summary", "zipcode", "bed_type"} <= set(listings.columns)
    types = dict(listings.dtypes)
    # undeclared columns: numbers (and the all-empty column) become doubles, text stays text
    assert types["latitude"] == "double" and types["license"] == "double"
    assert types["bed_type"] == "string" and types["summary"] == "string"
    assert dict(listings.dtypes)["availability_365"] == "double"
    assert listings.where("neighbourhood_cleansed IS NULL").count() == 4
    assert listings.where("host_acceptance_rate IS NULL").count() > 0  # N/A is missing


def test_all_reports_run(files):
    listings, calendar = files
    r1 = R.popular_neighbourhoods(listings).collect()
    assert 10 <= len(r1) <= 12
    assert sum(r["in_both"] for r in r1) == 20 - len(r1)
    r2 = R.busy_dates(calendar, listings).collect()
    assert len(r2) == 40 and all(0.0 <= r["vacant_ratio"] <= 1.0 for r in r2)
    assert isinstance(r2[0]["date"], dt.date)
    r3 = R.price_by_location(listings).collect()
    assert len(r3) == 10 and all(r["overall_median"] == r3[0]["overall_median"] for r in r3)
    assert len(R.price_by_type(listings).collect()) <= 10
    assert len(R.price_by_size(listings).collect()) <= 10
    r6 = R.price_by_review(listings).collect()
    assert {r["feature"] for r in r6} == set(REVIEW_FEATURES)
    assert any(r["level"] == -1.0 for r in r6)
    r7 = R.price_by_reviews_count(listings).collect()
    assert sum(r["count"] for r in r7) == 120
    res = R.price_drivers(listings, trees=10)
    names = {r["feature"] for r in res.features.collect()}
    assert "square_feet" not in names and "id" not in names and "zipcode" not in names
    assert any(n.startswith("amenities-") for n in names)
    assert any(n.startswith("bed_type_") for n in names)  # undeclared text column is encoded
    assert "latitude" in names and "license" not in names  # numeric feature; all-empty is sparse
    assert abs(sum(r["importance"] for r in res.importance.collect()) - 1.0) < 1e-9
    assert {r["fold"] for r in res.scores.collect()} == {"train", "test"}


def test_run_all_reports_writes_tables(spark, files, scratch):
    from staylens.plans.run import all_reports

    listings, calendar = files
    out = all_reports(listings, calendar, forest=False)
    for name, df in out.items():
        df.write.mode("overwrite").parquet(os.path.join(scratch, name))
        assert spark.read.parquet(os.path.join(scratch, name)).count() == df.count(), name
    assert set(out) >= {"popular_neighbourhoods", "busy_dates", "price_by_review"}


def test_runner_command_line(spark, files, scratch):
    from staylens.plans.run import main

    folder = os.path.join(spark._scratch, "csv-reports")
    out = os.path.join(scratch, "reports")
    main([os.path.join(folder, "listings.csv"), os.path.join(folder, "calendar.csv"),
          "--out", out, "--no-forest"])
    assert spark.read.parquet(os.path.join(out, "busy_dates")).count() == 40
    assert spark.read.parquet(os.path.join(out, "price_by_review")).count() > 0
