"""Run the whole analysis on listing and calendar files: every report, one call.

    python -m staylens.plans.run LISTINGS CALENDAR [--out FOLDER] [--fmt csv|parquet]
                                 [--no-forest] [--forest-task classify|regress] [--single-line]

Without ``--out`` the report tables are shown (first rows); with it each table
is written as Parquet under ``FOLDER/<report>``. The session comes from the
environment (``spark-submit`` settings); only a bare local run builds one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..sources import read_table
from ..sources.schemas import CALENDAR_SCHEMA, LISTINGS_SCHEMA
from . import constants as C
from . import reports as R


def all_reports(listings: DataFrame, calendar: DataFrame, k: int = C.TOP_K,
                forest: bool = True, forest_task: str = "classify") -> dict[str, DataFrame]:
    """R1-R8 as named DataFrames (the forest is fitted once when ``forest``)."""
    out = {
        "listing_filter": R.listing_filter_report(listings),
        "popular_neighbourhoods": R.popular_neighbourhoods(listings, k),
        "busy_dates": R.busy_dates(calendar, listings, k),
        "price_by_location": R.price_by_location(listings, k),
        "price_by_type": R.price_by_type(listings, k),
        "price_by_size": R.price_by_size(listings, k),
        "price_by_review": R.price_by_review(listings),
        "price_by_reviews_count": R.price_by_reviews_count(listings),
    }
    if forest:
        drivers = R.price_drivers(listings, task=forest_task)
        out["price_driver_importance"] = drivers.importance
        out["price_driver_scores"] = drivers.scores
    return out


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("listings")
    ap.add_argument("calendar")
    ap.add_argument("--out")
    ap.add_argument("--fmt", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--no-forest", action="store_true")
    ap.add_argument("--forest-task", default="classify", choices=["classify", "regress"],
                    help="prices as classes (as the original) or a regression forest")
    ap.add_argument("--single-line", action="store_true",
                    help="CSV records never span lines: split files across tasks")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("staylens").getOrCreate()
    listings = read_table(spark, args.listings, LISTINGS_SCHEMA, fmt=args.fmt,
                          multi_line=not args.single_line)
    calendar = read_table(spark, args.calendar, CALENDAR_SCHEMA, fmt=args.fmt,
                          multi_line=not args.single_line)
    reports = all_reports(listings, calendar, forest=not args.no_forest,
                          forest_task=args.forest_task)
    for name, df in reports.items():
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            print(f"== {name}")
            df.show(20, truncate=False)


if __name__ == "__main__":
    main()
