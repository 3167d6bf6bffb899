"""The composed reports (R1-R8): popular neighbourhoods, busy dates, price drivers.

Each report takes its input tables as parameters and returns DataFrames; the
tables behind the original charts are the deliverables. Column names of the
inputs default to the usual listing / calendar names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import qcol, spread
from ..functions.numbers import parse_date, parse_number
from ..operators import clean, dictionary, encode, groups, members
from ..session import cut_lineage
from . import constants as C
from . import model as M

NB = "neighbourhood_cleansed"


# --------------------------------------------------------------------------- R1

def filtered_listings(listings: DataFrame, key: str = NB) -> DataFrame:
    """Listings with a neighbourhood, an exact location and availability."""
    out = clean.drop_missing(listings, [key])
    return clean.keep_equal(out, {"is_location_exact": "t", "has_availability": "t"})


def listing_filter_report(listings: DataFrame, key: str = NB) -> DataFrame:
    """P3 for the R1 filter: total, kept, dropped rows in one pass."""
    pred = (qcol(key).isNotNull() & (F.col("is_location_exact") == "t")
            & (F.col("has_availability") == "t"))
    return clean.filter_report(listings, pred)


def neighbourhood_stats(filtered: DataFrame, key: str = NB,
                        metric: str = "availability_365") -> DataFrame:
    """Listing count and median availability per neighbourhood, one grouping."""
    return groups.median_count(filtered, [key], metric, median_name="median_availability",
                               count_name="list_count")


def top_listed(filtered: DataFrame, k: int = C.TOP_K, key: str = NB) -> DataFrame:
    """The k most listed neighbourhoods (key, list_count)."""
    return groups.top_k_values(filtered, key, k, name="list_count")


def least_available(filtered: DataFrame, k: int = C.TOP_K, key: str = NB,
                    metric: str = "availability_365") -> DataFrame:
    """A2 + T2 + J2: the k neighbourhoods with the lowest median availability, with counts."""
    return groups.bottom_k(neighbourhood_stats(filtered, key, metric),
                           "median_availability", k, keys=[key])


def popular_both(filtered: DataFrame, k: int = C.TOP_K, key: str = NB,
                 metric: str = "availability_365") -> DataFrame:
    """Neighbourhoods in both top-k lists.

    Both lists are ranked from one statistics table, so the plan shuffles the
    listings once (the second use is a reused exchange).
    """
    stats = neighbourhood_stats(filtered, key, metric)
    top = groups.top_k(stats, "list_count", k, keys=[key])
    least = groups.bottom_k(stats, "median_availability", k, keys=[key])
    return members.common_keys(top, least, key)


def popular_neighbourhoods(listings: DataFrame, k: int = C.TOP_K, key: str = NB,
                           metric: str = "availability_365") -> DataFrame:
    """Union of the two top-k lists with their statistics and membership flags."""
    filtered = filtered_listings(listings, key)
    stats = neighbourhood_stats(filtered, key, metric)
    top = groups.top_k(stats, "list_count", k, keys=[key]).select(key)
    least = groups.bottom_k(stats, "median_availability", k, keys=[key]).select(key)
    out = members.flag_members(stats, key, top, "in_top_listed")
    out = members.flag_members(out, key, least, "in_least_available")
    return (out.where(F.col("in_top_listed") | F.col("in_least_available"))
            .withColumn("in_both", F.col("in_top_listed") & F.col("in_least_available"))
            .select(qcol(key).alias("neighbourhood"), "list_count", "median_availability",
                    "in_top_listed", "in_least_available", "in_both")
            .orderBy(F.desc("list_count"), F.asc("neighbourhood")))


# --------------------------------------------------------------------------- R2

def _dated(calendar: DataFrame, date: str) -> DataFrame:
    if isinstance(calendar.schema[date].dataType, T.StringType):
        return calendar.withColumn(date, parse_date(qcol(date)))
    return calendar


def _available(flag: str = "available", yes: str = "t"):
    return qcol(flag) == F.lit(yes)


def daily_vacancy(calendar: DataFrame, date: str = "date", flag: str = "available",
                  name: str = "vacant_ratio") -> DataFrame:
    """A4: share of listings available per date (all rows of the date in the denominator)."""
    return groups.group_share(_dated(calendar, date), [date], _available(flag), name)


def popular_ids(listings: DataFrame, k: int = C.TOP_K, key: str = NB,
                metric: str = "availability_365") -> DataFrame:
    """P5: ids of the filtered listings in neighbourhoods on both top-k lists."""
    filtered = filtered_listings(listings, key)
    both = popular_both(filtered, k, key, metric)
    return members.keep_members(filtered, key, both).select(F.col("id"))


def vacancy_side_by_side(calendar: DataFrame, ids: DataFrame, date: str = "date",
                         flag: str = "available", listing: str = "listing_id",
                         id_col: str = "id") -> DataFrame:
    """J1 + A4: (date, vacant_ratio, vacant_ratio_popular) on every calendar date.

    Both ratios come from one scan of the calendar, joined with the distinct ids.
    """
    cal = _dated(calendar, date)
    marked = members.flag_members(cal.select(qcol(date), qcol(listing), qcol(flag)), listing, ids, "__hit", id_col)
    avail = F.when(_available(flag), F.lit(1.0)).otherwise(F.lit(0.0))
    return (marked.where(qcol(date).isNotNull()).groupBy(qcol(date)).agg(
        F.avg(avail).alias("vacant_ratio"),
        F.avg(F.when(F.col("__hit"), avail)).alias("vacant_ratio_popular")))


def vacancy_series(calendar: DataFrame, ids: DataFrame, date: str = "date", flag: str = "available",
                   listing: str = "listing_id", id_col: str = "id") -> DataFrame:
    """J1 + A4 + J3: the same columns from two daily series, aligned on the date."""
    cal = _dated(calendar, date)
    subset = members.keep_members(cal, listing, ids, id_col)
    return members.align_on(date, daily_vacancy(cal, date, flag, "vacant_ratio"),
                            daily_vacancy(subset, date, flag, "vacant_ratio_popular"))


def busy_dates(calendar: DataFrame, listings: DataFrame, k: int = C.TOP_K,
               low: float = C.LOW_VACANCY, low_popular: float = C.LOW_VACANCY_POPULAR,
               key: str = NB) -> DataFrame:
    """R2: daily ratios, all listings and the popular ones, with the low-date flags."""
    side = vacancy_side_by_side(calendar, popular_ids(listings, k, key))
    return (side.withColumn("is_low", F.col("vacant_ratio") < F.lit(low))
            .withColumn("is_low_popular",
                        F.coalesce(F.col("vacant_ratio_popular") < F.lit(low_popular), F.lit(False)))
            .orderBy("date"))


def low_dates(daily: DataFrame, expr: str, date: str = "date") -> DataFrame:
    """The dates of a daily series meeting a predicate text."""
    return clean.below(daily, expr, [date])


# --------------------------------------------------------------------------- R3-R7

def priced(listings: DataFrame, price: str = "price") -> DataFrame:
    """listings with the price text parsed to a number."""
    return listings.withColumn(price, parse_number(qcol(price)))


def price_by_location(listings: DataFrame, k: int = C.TOP_K, key: str = NB) -> DataFrame:
    """Median price of each top-k most listed neighbourhood, with the overall median."""
    all_priced = priced(listings)
    overall = groups.total_median(all_priced, "price", "overall_median")
    top = top_listed(filtered_listings(listings, key), k, key)
    med = groups.group_median(all_priced, [key], "price", "median_price")
    return (members.keep_members(med, key, top)
            .select(qcol(key).alias("neighbourhood"), "median_price",
                    overall.scalar().alias("overall_median"))
            .orderBy(F.desc("median_price"), F.asc("neighbourhood")))


def price_by_pair(listings: DataFrame, keys, k: int = C.TOP_K) -> DataFrame:
    """R4/R5 pattern: median price and count per key pair; the k largest groups by price."""
    stats = groups.median_count(priced(listings), keys, "price", "price", "count")
    return groups.top_k_then_sort(stats, "count", k, "price", keys=keys)


def price_by_type(listings: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Property type and room type."""
    return price_by_pair(listings, ["property_type", "room_type"], k)


def price_by_size(listings: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Bedrooms and bathrooms."""
    return price_by_pair(listings, ["bedrooms", "bathrooms"], k)


def review_filled(listings: DataFrame, features=C.REVIEW_FEATURES,
                  sentinel: int = C.REVIEW_SENTINEL) -> DataFrame:
    """A missing review score becomes the sentinel level."""
    return clean.fill_sentinel(priced(listings), {f: sentinel for f in features})


def price_by_review(listings: DataFrame, features=C.REVIEW_FEATURES) -> DataFrame:
    """Median price and count per level of each review feature (one grouping)."""
    prof = groups.profile_by_features(review_filled(listings, features), list(features), "price",
                                      median_name="price", count_name="count")
    return prof.orderBy("feature", "level")


def price_by_reviews_count(listings: DataFrame, width: float = C.REVIEW_BUCKET_WIDTH,
                           col: str = "number_of_reviews") -> DataFrame:
    """Median price and count per bucket of the number of reviews (key = midpoint)."""
    out = groups.group_by_bucket(review_filled(listings), col, width, "price",
                                 median_name="price", count_name="count")
    return out.orderBy(col)


# --------------------------------------------------------------------------- R8

@dataclass
class PriceDrivers:
    importance: DataFrame     # (feature, importance), sorted descending
    scores: DataFrame         # (fold, r2)
    predictions: DataFrame    # (id, fold, price, predicted)
    forest: M.PriceForest
    features: DataFrame       # (index, feature)
    vectors: DataFrame        # (id, price, features, fold)
    unparsable: int           # listings left out for a price that is no number


@dataclass
class FeaturePlan:
    """The listings' columns by their part in the feature table; see :func:`price_features`."""

    rows: DataFrame           # __key, target and the source columns, parsed
    numeric: list             # numeric columns that are not sparse
    phrases: list             # phrase columns
    levels: list              # text columns
    stats: clean.ColumnStats


def unparsable_prices(listings: DataFrame, target: str = "price") -> DataFrame:
    """One row (rows, missing, unparsable): listings without a usable price."""
    text, value = qcol(target), parse_number(qcol(target))
    return listings.agg(F.count(F.lit(1)).alias("rows"), F.count_if(text.isNull()).alias("missing"),
                        F.count_if(text.isNotNull() & value.isNull()).alias("unparsable"))


def plan_features(listings: DataFrame, key: str = "id", target: str = "price",
                  sparse_share: float = C.SPARSE_SHARE) -> FeaturePlan:
    """One pass fetches the non-missing counts and means of the numeric
    columns (encoded columns are complete by construction, so they are always kept and never
    imputed). Rows without a parsable target are left out (no model can learn from them);
    :func:`unparsable_prices` counts them.

    The rows are dealt out by their key before they are parsed, and stored: the scan may have
    one partition, and statistics, encoders and features are each a pass over the same rows.
    """
    dealt = spread(listings, key, None)
    df = dealt.withColumn(target, parse_number(qcol(target))).where(qcol(target).isNotNull())
    df = clean.to_number_columns(df, [c for c in C.NUMBER_TEXT_FEATURES if c in df.columns],
                                 parse_number)
    df = cut_lineage(df.select(qcol(key).alias("__key"), *[qcol(c) for c in df.columns]), "parsed")
    phrase_cols = [c for c in C.PHRASE_FEATURES if c in df.columns]
    kept = [c for c in df.columns if c not in C.REDUNDANT_COLUMNS and c not in phrase_cols]
    text = [c for c in clean.columns_of_type(df.select(*[qcol(c) for c in kept]), "string")
            if c != target]
    numeric = [c for c in clean.columns_of_type(df.select(*[qcol(c) for c in kept]), "numeric")
               if c not in ("__key", target)]
    stats = clean.fit_column_stats(df, numeric)
    dense = set(stats.kept(sparse_share))
    return FeaturePlan(df, [c for c in numeric if c in dense], phrase_cols, text, stats)


def price_features(listings: DataFrame, key: str = "id", target: str = "price",
                   sparse_share: float = C.SPARSE_SHARE):
    """F1 -> F4 -> P7 -> P9 -> F5 -> P12 -> P13: complete numeric feature table, wide.

    Returns ``(table, features)``: ``key``, the parsed target and one column per feature.
    """
    plan = plan_features(listings, key, target, sparse_share)
    vocab, levels = encode.fit_encoders(plan.rows, plan.phrases, plan.levels)
    df = encode.apply_phrase_indicators(plan.rows, vocab)
    df = clean.drop_columns(df, C.REDUNDANT_COLUMNS, strict=False)
    df = encode.apply_one_hot(df, levels)
    sparse = set(plan.stats.present) - set(plan.numeric)
    feats = [c for c in df.columns if c not in ("__key", target) and c not in sparse]
    df = clean.impute_mean(df.select("__key", qcol(target), *[qcol(c) for c in feats]),
                           plan.numeric, plan.stats)
    return df.select(F.col("__key").alias(key), qcol(target), *[qcol(c) for c in feats]), feats


def price_vectors(listings: DataFrame, key: str = "id", target: str = "price",
                  sparse_share: float = C.SPARSE_SHARE):
    """The same features as one sparse vector column ``features``; returns ``(table, names)``.

    ``names`` is a table (index, feature): phrases and levels are numbered in a dictionary
    table and joined, so neither is a list of the driver.
    """
    plan = plan_features(listings, key, target, sparse_share)
    taken = [c for c in plan.rows.columns if c not in {*plan.phrases, *plan.levels}]
    of = dictionary.fit_dictionary(plan.rows, plan.phrases, plan.levels, taken=taken)
    df = clean.impute_mean(plan.rows, plan.numeric, plan.stats).withColumnRenamed(target, "__target")
    table = dictionary.sparse_vectors(df, of, plan.numeric, ["__key", "__target"])
    return (table.select(F.col("__key").alias(key), F.col("__target").alias(target), "features"),
            dictionary.names_table(of, plan.numeric))


def price_drivers(listings: DataFrame, key: str = "id", trees: int = C.FOREST_TREES,
                  depth: int = C.FOREST_DEPTH, seed: int = C.SEED, test: float = C.TEST_SHARE,
                  task: str = "classify", rows_per_partition: int = M.ROWS_PER_PARTITION) -> PriceDrivers:
    """Fit the forest on the price and report feature importances and R2 per fold."""
    vec, feats = price_vectors(listings, key)
    # the rows are dealt by their key: the scan may have one partition, prediction is the work
    vec = cut_lineage(spread(M.split_rows(vec, key, test, seed), key, None), "features")
    train = vec.where(F.col("fold") == "train")
    forest = M.fit_forest(train, "features", "price", trees, depth, seed, task, key=key,
                          rows_per_partition=rows_per_partition)
    # voted once: scores and checks read the stored predictions
    preds = cut_lineage(forest.predict(vec).select(key, "fold", "price", "predicted"), "predictions")
    scores = M.r2_score(preds, "price", "predicted", by=["fold"])
    importance = cut_lineage(M.importance_table(forest, feats, listings.sparkSession), "importance").orderBy(
        F.desc("importance"), F.asc("feature"))
    bad = unparsable_prices(listings).first()
    return PriceDrivers(importance, scores, preds, forest, feats, vec, bad["unparsable"])
