"""

Every query reads the driver's tables through the stand-in views of
``staylens.sources.standins`` (listings from ``part``, calendar from
``lineitem``) or ``documents`` directly, over all rows. The oracle SQL
rebuilds the same views in DuckDB and states the expected result
independently of the Spark operators.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from staylens.functions.numbers import parse_date, parse_number  # noqa: E402
from staylens.functions.phrases import PHRASE_PATTERN_RE2  # noqa: E402
from staylens.operators import clean, encode, groups, members  # noqa: E402
from staylens.plans import constants as C  # noqa: E402
from staylens.plans import model as M  # noqa: E402
from staylens.plans import reports as R  # noqa: E402
from staylens.session import scratch_path  # noqa: E402
from staylens.sources import preview, standins, tables  # noqa: E402

try:  # the training-data operators are an optional subpackage
    from staylens.llm import queries as training_data  # noqa: E402
except ImportError:
    training_data = None

SMOKE_DIR = "/root/testdata/sf0.001"
NB = R.NB


def _listings(spark, d):
    return standins.listings(spark, d)


def _calendar(spark, d):
    return standins.calendar(spark, d)


def _filtered(spark, d):
    return R.filtered_listings(_listings(spark, d))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: busy dates (R2), which runs the popular-neighbourhood report (R1) inside."""
    return R.busy_dates(_calendar(spark, SMOKE_DIR), _listings(spark, SMOKE_DIR))


# --------------------------------------------------------------------------- Spark queries

def _q_filter_report(spark, d):
    return R.listing_filter_report(_listings(spark, d))


def _q_filtered_listings(spark, d):
    return _filtered(spark, d)


def _q_listings_profile(spark, d):
    return preview.profile(_listings(spark, d), [NB, "property_type", "room_type"],
                           ["availability_365"])


def _q_value_counts(spark, d):
    return groups.value_counts(_filtered(spark, d), NB, "list_count")


def _q_top_listed(spark, d):
    return R.top_listed(_filtered(spark, d))


def _q_least_available(spark, d):
    return R.least_available(_filtered(spark, d))


def _q_popular_both(spark, d):
    return R.popular_both(_filtered(spark, d))


def _q_calendar_profile(spark, d):
    return preview.profile(_calendar(spark, d), ["listing_id", "date"], ["date"])


_CAL_ORDER = ["date", "listing_id", "available"]


def _q_calendar_head(spark, d):
    return preview.head_rows(_calendar(spark, d), 5, _CAL_ORDER)


def _q_calendar_tail(spark, d):
    return preview.tail_rows(_calendar(spark, d), 5, _CAL_ORDER)


def _q_daily_vacancy(spark, d):
    return R.daily_vacancy(_calendar(spark, d))


def _q_low_vacancy_days(spark, d):
    return R.low_dates(R.daily_vacancy(_calendar(spark, d)), f"vacant_ratio < {C.LOW_VACANCY}")


def _q_low_popular_days(spark, d):
    side = R.vacancy_side_by_side(_calendar(spark, d), R.popular_ids(_listings(spark, d)))
    return R.low_dates(side, f"vacant_ratio_popular < {C.LOW_VACANCY_POPULAR}")


def _q_vacancy_side_by_side(spark, d):
    return R.vacancy_side_by_side(_calendar(spark, d), R.popular_ids(_listings(spark, d)))


_AUDIT = ["price", "property_type", "room_type", "bedrooms", "bathrooms", "square_feet",
          *C.REVIEW_FEATURES]


def _q_missing_report(spark, d):
    return clean.missing_report(_listings(spark, d), _AUDIT)


def _q_parsed_price(spark, d):
    cols = ["price", *C.NUMBER_TEXT_FEATURES]
    return clean.to_number_columns(_listings(spark, d).select("id", *cols), cols, parse_number)


_MEANS = ["availability_365", "bedrooms", "bathrooms", "square_feet", *C.REVIEW_FEATURES,
          "number_of_reviews", "accommodates"]


def _q_column_means(spark, d):
    means = groups.column_means(_listings(spark, d), _MEANS)
    return means.select(*[F.round(F.col(c), 6).alias(c) for c in _MEANS])


def _q_overall_median(spark, d):
    return groups.total_median(R.priced(_listings(spark, d)), "price", "overall_median")


def _q_median_among_top(spark, d):
    return R.price_by_location(_listings(spark, d))


def _q_type_room_price(spark, d):
    return R.price_by_type(_listings(spark, d))


def _q_size_price(spark, d):
    return R.price_by_size(_listings(spark, d))


def _q_sentinel_groups(spark, d):
    filled = R.review_filled(_listings(spark, d), ["review_scores_rating"])
    return groups.median_count(filled, ["review_scores_rating"], "price", "price", "count")


def _q_bucket_price(spark, d):
    return R.price_by_reviews_count(_listings(spark, d))


def _q_feature_profile(spark, d):
    return R.price_by_review(_listings(spark, d))


def _documents(spark, d):
    return standins.documents(spark, d)


def _q_phrases_long(spark, d):
    return encode.phrases_long(_documents(spark, d), "doc_id", "text")


def _q_phrase_vocabulary(spark, d):
    return encode.phrase_vocabulary(_documents(spark, d), "text", key="doc_id")


def _long(df, key: str, names=None):
    """(key, feature, value): the made columns as rows, so that no name is typed in."""
    names = names or [c for c in df.columns if c != key]
    wide = df.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return wide.unpivot([key], names, "feature", "value")


def _q_phrase_indicators(spark, d):
    df = _listings(spark, d).select("id", *C.PHRASE_FEATURES)
    return _long(encode.phrase_indicators(df, list(C.PHRASE_FEATURES)), "id")


def _q_one_hot(spark, d):
    df = _listings(spark, d).select("id", "property_type", "room_type")
    return _long(encode.one_hot(df, ["property_type", "room_type"]), "id")


_SPARSE_CANDIDATES = ["bathrooms", "square_feet", "review_scores_rating", "availability_365"]


def _q_drop_sparse(spark, d):
    df = _listings(spark, d).select("id", *_SPARSE_CANDIDATES)
    return _long(clean.drop_sparse(df, C.SPARSE_SHARE, _SPARSE_CANDIDATES), "id")


_IMPUTE = ["bathrooms", "square_feet", "review_scores_rating", "number_of_reviews"]


def _q_impute_mean(spark, d):
    out = clean.impute_mean(_listings(spark, d).select("id", *_IMPUTE), _IMPUTE)
    return out.select("id", *[F.round(F.col(c), 6).alias(c) for c in _IMPUTE])


def _q_drop_columns(spark, d):
    return clean.drop_columns(_listings(spark, d), C.REDUNDANT_COLUMNS, strict=False)


def _q_split_rows(spark, d):
    return M.split_rows(_listings(spark, d).select("id"), "id", C.TEST_SHARE, C.SEED)


def _q_r2_score(spark, d):
    priced = R.priced(_listings(spark, d)).select("id", NB, "price")
    means = priced.groupBy(NB).agg(F.avg("price").alias("predicted"))
    scored = M.split_rows(priced.join(means, NB), "id", C.TEST_SHARE, C.SEED)
    out = M.r2_score(scored, "price", "predicted", by=["fold"])
    return out.select("fold", F.round("r2", 6).alias("r2"))


def _q_report_popular_neighbourhoods(spark, d):
    return R.popular_neighbourhoods(_listings(spark, d))


def _q_report_busy_dates(spark, d):
    return R.busy_dates(_calendar(spark, d), _listings(spark, d))


def _q_price_features(spark, d):
    table, feats = R.price_features(_listings(spark, d))
    long = _long(table, "id", feats)
    return long.select("id", "feature", F.round("value", 6).alias("value"))


def _q_assembled_features(spark, d):
    """M1: the vector's slots, read back by position."""
    table, names = R.price_vectors(_listings(spark, d))
    slots = names.select(F.col("index").alias("slot"), "feature")
    long = table.select("id", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return long.join(slots, "slot").select("id", "feature", F.round("value", 6).alias("value"))


def _q_vacancy_series(spark, d):
    """J1 + J3 on a large id set: two daily series aligned on the date."""
    ids = _listings(spark, d).where("accommodates > 2").select("id")
    return R.vacancy_series(_calendar(spark, d), ids.unionByName(ids))


def _q_grouped_median(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return groups.median_count(lines, ["l_returnflag"], "l_extendedprice", "median", "count")


def _q_total_median(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return groups.total_median(lines, "l_extendedprice", "median")


def _q_size_price_nan(spark, d):
    """R5 with NaN in place of NULL: a NaN key is no group."""
    nan = F.lit(float("nan"))
    df = _listings(spark, d).withColumns({c: F.coalesce(c, nan) for c in ("bedrooms", "bathrooms")})
    return R.price_by_size(df)


_TEXT_PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
                           T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])


def _q_typed_part(spark, d):
    """Columns that come as text, with missing tokens among them, get their types."""
    part = spark.read.parquet(f"{d}/part.parquet")
    text = part.select(*[F.col(c).cast("string").alias(c) for c in _TEXT_PART.names])
    return tables.typed(text.withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, "N/A").otherwise(F.col("p_size"))),
                        _TEXT_PART)


def _q_parsed_dates(spark, d):
    """date text, a third of it malformed."""
    text = F.when(F.col("listing_id") % 3 == 0, F.lit("no date")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    days = _calendar(spark, d).select(parse_date(text).alias("date"))
    return days.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


def _q_split_target(spark, d):
    """Target and features apart, joined again on the key."""
    df = _listings(spark, d).select("id", "price", "accommodates", "bedrooms")
    target, features = clean.split_target(df, "price", "id")
    return target.join(features, "id").select("id", "price", "accommodates", "bedrooms")


def _q_with_names(spark, d):
    return clean.with_names(groups.value_counts(_filtered(spark, d), NB), ["place", "listings"])


def _q_sorted_stats(spark, d):
    """T4: the place of each row in the sorted result."""
    done = groups.sort_rows(R.neighbourhood_stats(_filtered(spark, d)), "median_availability", True, [NB])
    order = Window.orderBy(F.monotonically_increasing_id())  # one row per neighbourhood
    return done.withColumn("place", F.row_number().over(order).cast("bigint"))


def _q_lookup(spark, d):
    """J2 with A2: the median of each group beside its count."""
    filtered = _filtered(spark, d)
    counts = groups.value_counts(filtered, NB, "list_count")
    return members.lookup(counts, groups.group_median(filtered, [NB], "availability_365"), NB)


def _q_calendar_span(spark, d):
    """Distinct listings, first and last date."""
    cal = _calendar(spark, d)
    both = groups.distinct_count(cal, "listing_id", "listings").join(groups.date_range(cal, "date"))
    return both.select("listings", "first", "last")


def _q_unparsable_prices(spark, d):
    df = _listings(spark, d).withColumn("price", F.when(F.col("id") % 5 == 0, F.lit("ask")).when(
        F.col("id") % 5 == 1, F.lit(None)).otherwise(F.col("price")))
    return R.unparsable_prices(df)


def _q_top_means(spark, d):
    """M6 and M7 on the vector of the column means."""
    means = groups.column_means(_listings(spark, d), _MEANS).first()
    top = M.top_importance(M.importance_table([means[c] for c in _MEANS], _MEANS, spark), 5)
    return top.select("feature", F.round("importance", 6).alias("importance"))


def _q_forest_recovers(spark, d):
    """M3 and M4: one feature that fixes the label; every label comes back."""
    df = _listings(spark, d).select("id", "accommodates", (F.col("accommodates") * 10.0).alias("price"))
    vec = M.assemble(df, ["accommodates"])
    forest = M.fit_forest(vec, "features", "price", trees=20, depth=6, key="id")
    return forest.predict(vec).select("id", "price", "predicted")


_FITS: dict[tuple, R.PriceDrivers] = {}  # the price driver queries of a session share one fit


def forget_fits() -> None:
    _FITS.clear()


def _drivers(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITS:
        _FITS[key] = R.price_drivers(_listings(spark, d))
    return _FITS[key]


_CSV_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                            T.StructField("price", T.StringType()), T.StructField("bedrooms", T.DoubleType())])


def _q_csv_listings(spark, d):
    """The listings as CSV (quotes, line breaks, N/A inside) in the checkpoint folder, read back."""
    name = F.concat("name", F.lit(' "'), NB, F.lit('",\n'), F.coalesce("property_type", F.lit("-")))
    text = _listings(spark, d).select(
        F.col("id"), name.alias("name"), F.when(F.col("id") % 7 == 0, "N/A").otherwise(F.col("price")).alias("price"),
        F.when(F.col("id") % 5 == 0, "N/A").otherwise(F.col("bedrooms").cast("string")).alias("bedrooms"),
        F.when(F.col("id") % 3 > 0, F.col("number_of_reviews")).alias("reviews"), F.col("room_type").alias("note"))
    path = scratch_path(spark, "listings-csv")
    text.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_table(spark, path, _CSV_SCHEMA)


def _q_price_driver_checks(spark, d):
    """R8 as one row of what must hold for any forest."""
    out = _drivers(spark, d)
    folds = out.predictions.agg(
        F.count_if(F.col("fold") == "train").alias("train_rows"), F.count_if(F.col("fold") == "test").alias("test_rows"))
    known = out.predictions.where("fold = 'train'").select(F.col("price").alias("predicted")).distinct()
    unknown = out.predictions.join(known, "predicted", "left_anti").agg(F.count(F.lit(1)).alias("unknown_predictions"))
    total = out.importance.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("importance_sum"))
    return total.join(folds).join(unknown)  # three one-row tables


def _q_price_drivers(spark, d):
    return _drivers(spark, d).importance


def _q_price_driver_top(spark, d):
    return M.top_importance(_drivers(spark, d).importance, C.TOP_K)


def _q_price_driver_scores(spark, d):
    return _drivers(spark, d).scores


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "filter_report": _q_filter_report,
        "filtered_listings": _q_filtered_listings,
        "listings_profile": _q_listings_profile,
        "value_counts": _q_value_counts,
        "top_listed": _q_top_listed,
        "least_available": _q_least_available,
        "popular_both": _q_popular_both,
        "calendar_profile": _q_calendar_profile,
        "calendar_head": _q_calendar_head,
        "calendar_tail": _q_calendar_tail,
        "daily_vacancy": _q_daily_vacancy,
        "low_vacancy_days": _q_low_vacancy_days,
        "vacancy_side_by_side": _q_vacancy_side_by_side,
        "low_popular_days": _q_low_popular_days,
        "missing_report": _q_missing_report,
        "parsed_price": _q_parsed_price,
        "column_means": _q_column_means,
        "overall_median": _q_overall_median,
        "median_among_top": _q_median_among_top,
        "type_room_price": _q_type_room_price,
        "size_price": _q_size_price,
        "sentinel_groups": _q_sentinel_groups,
        "bucket_price": _q_bucket_price,
        "feature_profile": _q_feature_profile,
        "phrases_long": _q_phrases_long,
        "phrase_vocabulary": _q_phrase_vocabulary,
        "phrase_indicators": _q_phrase_indicators,
        "one_hot": _q_one_hot,
        "drop_sparse": _q_drop_sparse,
        "impute_mean": _q_impute_mean,
        "drop_columns": _q_drop_columns,
        "split_rows": _q_split_rows,
        "r2_score": _q_r2_score,
        "report_popular_neighbourhoods": _q_report_popular_neighbourhoods,
        "report_busy_dates": _q_report_busy_dates,
        "price_features": _q_price_features,
        "price_drivers": _q_price_drivers,
        "price_driver_scores": _q_price_driver_scores,
        "price_driver_top": _q_price_driver_top,
        "assembled_features": _q_assembled_features,
        "vacancy_series": _q_vacancy_series,
        "grouped_median": _q_grouped_median,
        "total_median": _q_total_median,
        "size_price_nan": _q_size_price_nan,
        "typed_part": _q_typed_part,
        "csv_listings": _q_csv_listings,
        "parsed_dates": _q_parsed_dates,
        "split_target": _q_split_target,
        "with_names": _q_with_names,
        "sorted_stats": _q_sorted_stats,
        "lookup": _q_lookup,
        "calendar_span": _q_calendar_span,
        "unparsable_prices": _q_unparsable_prices,
        "top_means": _q_top_means,
        "forest_recovers": _q_forest_recovers,
        "price_driver_checks": _q_price_driver_checks,
        **(training_data.queries() if training_data else {}),
    }


# --------------------------------------------------------------------------- DuckDB oracles

def _money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"


_REVIEWS_SQL = ",\n".join(
    f"    CASE WHEN (p_size + {j}) % 5 <> 0 THEN CAST((p_size * {j + 1}) % 10 + 1 AS DOUBLE) END AS {name}"
    for j, name in enumerate(C.REVIEW_FEATURES))

_VIEWS = f"""
listings AS (
  SELECT
    p_partkey AS id,
    p_name AS name,
    p_brand AS neighbourhood_cleansed,
    CASE WHEN p_size > 10 THEN 't' ELSE 'f' END AS is_location_exact,
    CASE WHEN p_type = 'PROMO' THEN 'f' ELSE 't' END AS has_availability,
    CAST(p_size * 7 AS DOUBLE) AS availability_365,
    {_money('p_retailprice * 10')} AS price,
    CASE WHEN p_name NOT LIKE 'new %' THEN p_type END AS property_type,
    split_part(p_name, ' ', 2) AS room_type,
    CAST(floor(p_size / 10.0) AS DOUBLE) AS bedrooms,
    CASE WHEN p_size % 5 <> 0 THEN CAST((p_size % 3) * 0.5 + 1.0 AS DOUBLE) END AS bathrooms,
    CASE WHEN p_size <= 5 THEN CAST(p_size * 100 AS DOUBLE) END AS square_feet,
{_REVIEWS_SQL},
    CAST(p_size * 3 AS BIGINT) AS number_of_reviews,
    CAST(p_size % 8 + 1 AS BIGINT) AS accommodates,
    CASE WHEN p_size % 4 <> 0 THEN {_money('p_size * 2.5')} END AS cleaning_fee,
    CASE WHEN p_size % 3 <> 0 THEN {_money('p_size * 20.0')} END AS security_deposit,
    CAST(100 - p_size AS VARCHAR) || '%' AS host_response_rate,
    CASE WHEN p_size % 2 = 1 THEN '100%' END AS host_acceptance_rate,
    {_money('(p_size % 7) * 5.0')} AS extra_people,
    '[''email'', ''' || lower(p_type) || ''']' AS host_verifications,
    '{{"' || replace(p_name, ' ', '","') || '",' || p_type || '}}' AS amenities
  FROM part
),
calendar AS (
  SELECT l_partkey AS listing_id, CAST(l_shipdate AS DATE) AS date,
         CASE WHEN l_linestatus = 'O' THEN 't' ELSE 'f' END AS available
  FROM lineitem
),
filtered AS (
  SELECT * FROM listings
  WHERE neighbourhood_cleansed IS NOT NULL AND is_location_exact = 't' AND has_availability = 't'
),
stats AS (
  SELECT neighbourhood_cleansed, count(*) AS list_count,
         median(availability_365) AS median_availability
  FROM filtered GROUP BY neighbourhood_cleansed
),
top AS (
  SELECT neighbourhood_cleansed, list_count FROM stats
  ORDER BY list_count DESC, neighbourhood_cleansed LIMIT {C.TOP_K}
),
least AS (
  SELECT neighbourhood_cleansed, median_availability, list_count FROM stats
  ORDER BY median_availability ASC NULLS LAST, neighbourhood_cleansed LIMIT {C.TOP_K}
),
both_lists AS (
  SELECT neighbourhood_cleansed FROM top INTERSECT SELECT neighbourhood_cleansed FROM least
),
ids AS (
  SELECT id FROM filtered WHERE neighbourhood_cleansed IN (SELECT neighbourhood_cleansed FROM both_lists)
),
daily AS (
  SELECT date, avg(CASE WHEN available = 't' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vacant_ratio
  FROM calendar WHERE date IS NOT NULL GROUP BY date
),
daily_popular AS (
  SELECT date, avg(CASE WHEN available = 't' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vacant_ratio_popular
  FROM calendar WHERE date IS NOT NULL AND listing_id IN (SELECT id FROM ids) GROUP BY date
),
side AS (
  SELECT d.date, d.vacant_ratio, p.vacant_ratio_popular
  FROM daily d LEFT JOIN daily_popular p ON d.date = p.date
),
priced AS (
  SELECT * REPLACE (TRY_CAST(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE) AS price)
  FROM listings
)"""


def _sql(body: str) -> str:
    return f"WITH {_VIEWS}\n{body}"


_PATTERN = PHRASE_PATTERN_RE2  # the same phrases, in RE2 syntax


def _phrases_sql(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{_PATTERN}')"


def _parse_sql(col: str) -> str:
    return f"TRY_CAST(regexp_replace({col}, '[^0-9.]', '', 'g') AS DOUBLE)"


def _indicator_sql() -> str:
    """Every phrase that occurs, as a feature of every listing."""
    pairs = " UNION ALL ".join(f"SELECT id, '{c}' AS col, unnest({_phrases_sql(c)}) AS phrase FROM listings"
                               for c in C.PHRASE_FEATURES)
    return f""", pairs AS (SELECT DISTINCT id, col, phrase FROM ({pairs})),
vocab AS (SELECT DISTINCT col, phrase FROM pairs)
SELECT b.id, v.col || '-' || v.phrase AS feature, CASE WHEN p.id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value
FROM listings b CROSS JOIN vocab v LEFT JOIN pairs p ON p.id = b.id AND p.col = v.col AND p.phrase = v.phrase"""


def _one_hot_sql() -> str:
    """Every level but the first of its column, and the missing level."""
    pairs = " UNION ALL ".join(f"SELECT id, '{c}' AS col, {c} AS level FROM listings"
                               for c in ("property_type", "room_type"))
    return f""", pairs AS ({pairs}),
levels AS (SELECT DISTINCT col, level FROM pairs p WHERE level > (SELECT min(level) FROM pairs q WHERE q.col = p.col))
SELECT id, p.col || '_' || l.level AS feature, CASE WHEN p.level = l.level THEN 1.0 ELSE 0.0 END::DOUBLE AS value
FROM pairs p JOIN levels l ON p.col = l.col
UNION ALL SELECT id, col || '_nan', CASE WHEN level IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE FROM pairs"""


def _drop_sparse_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM listings"
                               for c in _SPARSE_CANDIDATES)
    return f""", pairs AS ({pairs}),
kept AS (SELECT feature FROM pairs GROUP BY feature HAVING count(value) >= floor({C.SPARSE_SHARE} * count(*)))
SELECT id, feature, value FROM pairs WHERE feature IN (SELECT feature FROM kept)"""


def _missing_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS total FROM listings"
             for c in _AUDIT]
    return "\nUNION ALL ".join(parts)


def _feature_profile_sql() -> str:
    fill = ", ".join(f"COALESCE({f}, -1) AS {f}" for f in C.REVIEW_FEATURES)
    parts = [f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS level, median(price) AS price, "
             f"count(*) AS count FROM filled GROUP BY {f}" for f in C.REVIEW_FEATURES]
    return (f", filled AS (SELECT price, {fill} FROM priced)\n" + "\nUNION ALL ".join(parts))


_NUMERIC_FEATURES = ["availability_365", "bedrooms", "bathrooms", "square_feet", *C.REVIEW_FEATURES,
                     "number_of_reviews", "accommodates", *C.NUMBER_TEXT_FEATURES]
_TEXT_FEATURES = ["neighbourhood_cleansed", "is_location_exact", "has_availability",
                  "property_type", "room_type"]


def _price_features_sql() -> str:
    """R8 feature table in long form, with the data-dependent columns derived in SQL."""
    def san(x: str) -> str:
        return f"regexp_replace({x}, '[^0-9A-Za-z_]+', '_', 'g')"

    parsed = ", ".join(f"{_parse_sql(c)} AS {c}" for c in C.NUMBER_TEXT_FEATURES)
    plain = ", ".join(c for c in _NUMERIC_FEATURES if c not in C.NUMBER_TEXT_FEATURES)
    num = " UNION ALL ".join(
        f"SELECT id, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM fbase" for c in _NUMERIC_FEATURES)
    phr = " UNION ALL ".join(
        f"SELECT id, '{c}' AS col, unnest({_phrases_sql(c)}) AS phrase FROM fbase"
        for c in C.PHRASE_FEATURES)
    txt = " UNION ALL ".join(
        f"SELECT id, '{c}' AS col, CAST({c} AS VARCHAR) AS level FROM fbase" for c in _TEXT_FEATURES)
    return f""", fbase AS (
  SELECT id, {plain}, {parsed}, {", ".join(_TEXT_FEATURES)}, {", ".join(C.PHRASE_FEATURES)}
  FROM priced WHERE price IS NOT NULL
),
num AS ({num}),
nstats AS (SELECT feature, count(v) AS present, avg(v) AS mean FROM num GROUP BY feature),
num_out AS (
  SELECT num.id, num.feature, round(COALESCE(num.v, nstats.mean), 6) AS value
  FROM num JOIN nstats ON num.feature = nstats.feature
  WHERE nstats.present >= floor({C.SPARSE_SHARE} * (SELECT count(*) FROM fbase))
),
phr AS (SELECT DISTINCT id, col, phrase FROM ({phr})),
vocab AS (SELECT DISTINCT col, phrase FROM phr),
phr_out AS (
  SELECT b.id, v.col || '-' || {san('v.phrase')} AS feature,
         CASE WHEN p.id IS NULL THEN 0.0 ELSE 1.0 END AS value
  FROM fbase b CROSS JOIN vocab v
  LEFT JOIN phr p ON p.id = b.id AND p.col = v.col AND p.phrase = v.phrase
),
txt AS ({txt}),
lv AS (SELECT col, level FROM txt WHERE level IS NOT NULL GROUP BY col, level),
enc AS (SELECT col, level FROM lv WHERE level > (SELECT min(l2.level) FROM lv l2 WHERE l2.col = lv.col)),
txt_out AS (
  SELECT t.id, e.col || '_' || {san('e.level')} AS feature,
         CASE WHEN t.level = e.level THEN 1.0 ELSE 0.0 END AS value
  FROM txt t JOIN enc e ON t.col = e.col
  UNION ALL
  SELECT id, col || '_nan' AS feature, CASE WHEN level IS NULL THEN 1.0 ELSE 0.0 END AS value
  FROM txt
)
SELECT id, feature, value FROM num_out
UNION ALL SELECT id, feature, value FROM phr_out
UNION ALL SELECT id, feature, value FROM txt_out"""


def oracle_sql() -> dict[str, str]:
    nb = "neighbourhood_cleansed"
    daily_bin = "avg(CASE WHEN available = 't' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    fold = ("CASE WHEN ('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8))::BIGINT % 10000 < 3000 "
            "THEN 'test' ELSE 'train' END")
    imputed = ", ".join(
        f"round(COALESCE(CAST({c} AS DOUBLE), avg(CAST({c} AS DOUBLE)) OVER ()), 6) AS {c}"
        for c in _IMPUTE)
    return {
        "filter_report": _sql(
            "SELECT count(*) AS total, count(*) FILTER (WHERE neighbourhood_cleansed IS NOT NULL "
            "AND is_location_exact = 't' AND has_availability = 't') AS kept, "
            "count(*) - count(*) FILTER (WHERE neighbourhood_cleansed IS NOT NULL "
            "AND is_location_exact = 't' AND has_availability = 't') AS dropped FROM listings"),
        "filtered_listings": _sql("SELECT * FROM filtered"),
        "listings_profile": _sql(
            f"SELECT count(*) AS rows, count(DISTINCT {nb}) AS distinct_{nb}, "
            "count(DISTINCT property_type) AS distinct_property_type, "
            "count(DISTINCT room_type) AS distinct_room_type, "
            "min(availability_365) AS min_availability_365, "
            "max(availability_365) AS max_availability_365 FROM listings"),
        "value_counts": _sql(f"SELECT {nb}, count(*) AS list_count FROM filtered GROUP BY {nb}"),
        "top_listed": _sql("SELECT * FROM top"),
        "least_available": _sql("SELECT * FROM least"),
        "popular_both": _sql("SELECT * FROM both_lists"),
        "calendar_profile": _sql(
            "SELECT count(*) AS rows, count(DISTINCT listing_id) AS distinct_listing_id, "
            "count(DISTINCT date) AS distinct_date, min(date) AS min_date, max(date) AS max_date "
            "FROM calendar"),
        "calendar_head": _sql("SELECT * FROM calendar ORDER BY date, listing_id, available LIMIT 5"),
        "calendar_tail": _sql(
            "SELECT * FROM calendar ORDER BY date DESC, listing_id DESC, available DESC LIMIT 5"),
        "daily_vacancy": _sql("SELECT * FROM daily"),
        "low_vacancy_days": _sql(f"SELECT date FROM daily WHERE vacant_ratio < {C.LOW_VACANCY}"),
        "vacancy_side_by_side": _sql("SELECT * FROM side"),
        "low_popular_days": _sql(
            f"SELECT date FROM side WHERE vacant_ratio_popular < {C.LOW_VACANCY_POPULAR}"),
        "missing_report": _sql(_missing_sql()),
        "parsed_price": _sql(
            "SELECT id, " + ", ".join(f"{_parse_sql(c)} AS {c}"
                                      for c in ["price", *C.NUMBER_TEXT_FEATURES]) + " FROM listings"),
        "column_means": _sql(
            "SELECT " + ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in _MEANS)
            + " FROM listings"),
        "overall_median": _sql("SELECT median(price) AS overall_median FROM priced"),
        "median_among_top": _sql(
            f"SELECT {nb} AS neighbourhood, median(price) AS median_price, "
            "(SELECT median(price) FROM priced) AS overall_median FROM priced "
            f"WHERE {nb} IN (SELECT {nb} FROM top) GROUP BY {nb}"),
        "type_room_price": _sql(
            "SELECT property_type, room_type, median(price) AS price, count(*) AS count FROM priced "
            "WHERE property_type IS NOT NULL AND room_type IS NOT NULL GROUP BY property_type, room_type "
            f"ORDER BY count DESC, property_type, room_type LIMIT {C.TOP_K}"),
        "size_price": _sql(
            "SELECT bedrooms, bathrooms, median(price) AS price, count(*) AS count FROM priced "
            "WHERE bedrooms IS NOT NULL AND bathrooms IS NOT NULL GROUP BY bedrooms, bathrooms "
            f"ORDER BY count DESC, bedrooms, bathrooms LIMIT {C.TOP_K}"),
        "size_price_nan": _sql(
            "SELECT bedrooms, bathrooms, median(price) AS price, count(*) AS count FROM priced "
            "WHERE bedrooms IS NOT NULL AND bathrooms IS NOT NULL GROUP BY bedrooms, bathrooms "
            f"ORDER BY count DESC, bedrooms, bathrooms LIMIT {C.TOP_K}"),
        "sentinel_groups": _sql(
            "SELECT CAST(COALESCE(review_scores_rating, -1) AS DOUBLE) AS review_scores_rating, "
            "median(price) AS price, count(*) AS count FROM priced GROUP BY 1"),
        "bucket_price": _sql(
            "SELECT CAST(trunc(number_of_reviews / 10.0::DOUBLE) AS DOUBLE) * 10.0::DOUBLE + 5.0::DOUBLE "
            "AS number_of_reviews, median(price) AS price, count(*) AS count FROM priced "
            "WHERE number_of_reviews IS NOT NULL GROUP BY 1"),
        "feature_profile": _sql(_feature_profile_sql()),
        "phrases_long": (
            f"SELECT DISTINCT doc_id, unnest({_phrases_sql('text')}) AS phrase FROM documents"),
        "phrase_vocabulary": (
            "SELECT phrase, count(*) AS documents FROM ("
            f"SELECT DISTINCT doc_id, unnest({_phrases_sql('text')}) AS phrase FROM documents) "
            "GROUP BY phrase"),
        "phrase_indicators": _sql(_indicator_sql()),
        "one_hot": _sql(_one_hot_sql()),
        "drop_sparse": _sql(_drop_sparse_sql()),
        "impute_mean": _sql(f"SELECT id, {imputed} FROM listings"),
        "drop_columns": _sql("SELECT * EXCLUDE (id, name) FROM listings"),
        "split_rows": _sql(f"SELECT id, {fold} AS fold FROM listings"),
        "r2_score": _sql(
            f", m AS (SELECT {nb}, avg(price) AS predicted FROM priced GROUP BY {nb}), "
            f"j AS (SELECT {fold} AS fold, price AS y, predicted AS p FROM priced JOIN m USING ({nb}) "
            "WHERE price IS NOT NULL) "
            "SELECT fold, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 "
            "FROM j GROUP BY fold"),
        "price_features": _sql(_price_features_sql()),
        "assembled_features": _sql(_price_features_sql()),
        "vacancy_series": _sql(
            f", sub AS (SELECT date, {daily_bin} AS vacant_ratio_popular FROM calendar WHERE date IS NOT NULL "
            "AND listing_id IN (SELECT id FROM listings WHERE accommodates > 2) GROUP BY date) "
            "SELECT date, vacant_ratio, vacant_ratio_popular FROM daily LEFT JOIN sub USING (date)"),
        "grouped_median": (
            "SELECT l_returnflag, median(CAST(l_extendedprice AS DOUBLE)) AS median, count(*) AS count FROM lineitem "
            "WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag"),
        "total_median": "SELECT median(CAST(l_extendedprice AS DOUBLE)) AS median FROM lineitem",
        "csv_listings": _sql(
            "SELECT id, name || ' \"' || neighbourhood_cleansed || '\",' || chr(10) || coalesce(property_type, '-') AS name, "
            "CASE WHEN id % 7 <> 0 THEN price END AS price, CASE WHEN id % 5 <> 0 THEN bedrooms END AS bedrooms, "
            "CASE WHEN id % 3 > 0 THEN CAST(number_of_reviews AS DOUBLE) END AS reviews, room_type AS note FROM listings"),
        "typed_part": (
            "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_size END "
            "AS INTEGER) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part"),
        "parsed_dates": _sql(
            "SELECT CASE WHEN listing_id % 3 <> 0 THEN date END AS date, count(*) AS rows FROM calendar GROUP BY 1"),
        "split_target": _sql("SELECT id, price, accommodates, bedrooms FROM listings"),
        "with_names": _sql(f"SELECT {nb} AS place, count(*) AS listings FROM filtered GROUP BY {nb}"),
        "sorted_stats": _sql(
            f"SELECT {nb}, list_count, median_availability, row_number() OVER "
            f"(ORDER BY median_availability DESC NULLS LAST, {nb}) AS place FROM stats"),
        "lookup": _sql(f"SELECT {nb}, list_count, median_availability AS median FROM stats"),
        "calendar_span": _sql(
            "SELECT count(DISTINCT listing_id) AS listings, min(date) AS first, max(date) AS last FROM calendar"),
        "unparsable_prices": _sql(
            "SELECT count(*) AS rows, count(*) FILTER (id % 5 = 1) AS missing, "
            "count(*) FILTER (id % 5 = 0) AS unparsable FROM listings"),
        "top_means": _sql(
            ", means AS (" + " UNION ALL ".join(
                f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS importance FROM listings" for c in _MEANS)
            + ") SELECT feature, importance FROM means ORDER BY importance DESC, feature LIMIT 5"),
        "forest_recovers": _sql(
            "SELECT id, accommodates * 10.0::DOUBLE AS price, accommodates * 10.0::DOUBLE AS predicted FROM listings"),
        "price_driver_checks": _sql(
            _price_features_sql().replace("SELECT id, feature, value FROM num_out", ", long AS (SELECT id, feature, value FROM num_out")
            + f""")
SELECT (SELECT count(DISTINCT feature) FROM long) AS features, 1.0::DOUBLE AS importance_sum,
  (SELECT count(*) FROM (SELECT {fold} AS fold FROM fbase) WHERE fold = 'train') AS train_rows,
  (SELECT count(*) FROM (SELECT {fold} AS fold FROM fbase) WHERE fold = 'test') AS test_rows,
  0::BIGINT AS unknown_predictions"""),
        "report_popular_neighbourhoods": _sql(
            f"SELECT s.{nb} AS neighbourhood, s.list_count, s.median_availability, "
            f"t.{nb} IS NOT NULL AS in_top_listed, l.{nb} IS NOT NULL AS in_least_available, "
            f"(t.{nb} IS NOT NULL AND l.{nb} IS NOT NULL) AS in_both "
            f"FROM stats s LEFT JOIN top t ON s.{nb} = t.{nb} LEFT JOIN least l ON s.{nb} = l.{nb} "
            f"WHERE t.{nb} IS NOT NULL OR l.{nb} IS NOT NULL"),
        "report_busy_dates": _sql(
            f"SELECT date, vacant_ratio, vacant_ratio_popular, vacant_ratio < {C.LOW_VACANCY} AS is_low, "
            f"COALESCE(vacant_ratio_popular < {C.LOW_VACANCY_POPULAR}, false) AS is_low_popular "
            "FROM side"),
        **(training_data.oracle_sql() if training_data else {}),
    }
