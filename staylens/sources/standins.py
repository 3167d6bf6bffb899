"""Stand-in ``listings`` and ``calendar`` tables derived from the driver's data.

The original listing CSVs are not available, so the reports run on views of
the driver's ``part`` and ``lineitem`` tables that carry the listing columns
under their usual names. Every rule is a per-row expression of the source
columns, so the views grow with the source tables and all rows are kept.
The same rules are written in DuckDB SQL in ``__spark_entry__.py`` for the
oracle.

listings (one row per ``part`` row)
    id, name, neighbourhood_cleansed (brand), is_location_exact (size > 10),
    has_availability (type is not PROMO), availability_365 (7 x size),
    price (money text of 10 x the retail price),
    property_type (type, missing when the name starts with "new"), room_type
    (second word of the name), bedrooms, bathrooms, square_feet (present for
    sizes up to 5: 90% missing), seven
    review scores (each missing for a fifth of the sizes), number_of_reviews,
    accommodates, cleaning_fee, security_deposit, host_response_rate,
    host_acceptance_rate, extra_people, host_verifications (list text),
    amenities (set text).

calendar (one row per ``lineitem`` row)
    listing_id (part key), date (ship date), available ('t' when the line
    status is O).

Both are one projection written as SQL expressions: parsed once on the JVM
side, without a Python round trip per expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.constants import REVIEW_FEATURES
from .tables import read_table

Q = "'"  # a single quote, for the list text below


def _money(x: str) -> str:
    return f"concat('$', format_number({x}, 2))"


def _review(j: int, name: str) -> str:
    return (f"CASE WHEN (p_size + {j}) % 5 <> 0 "
            f"THEN CAST((p_size * {j + 1}) % 10 + 1 AS DOUBLE) END AS {name}")


_LISTING_EXPRS = [
    "p_partkey AS id",
    "p_name AS name",
    "p_brand AS neighbourhood_cleansed",
    "CASE WHEN p_size > 10 THEN 't' ELSE 'f' END AS is_location_exact",
    "CASE WHEN p_type = 'PROMO' THEN 'f' ELSE 't' END AS has_availability",
    "CAST(p_size * 7 AS DOUBLE) AS availability_365",
    f"{_money('p_retailprice * 10')} AS price",
    "CASE WHEN p_name NOT LIKE 'new %' THEN p_type END AS property_type",
    "split_part(p_name, ' ', 2) AS room_type",
    "CAST(floor(p_size / 10.0) AS DOUBLE) AS bedrooms",
    "CAST(CASE WHEN p_size % 5 <> 0 THEN (p_size % 3) * 0.5 + 1.0 END AS DOUBLE) AS bathrooms",
    "CASE WHEN p_size <= 5 THEN CAST(p_size * 100 AS DOUBLE) END AS square_feet",
    *[_review(j, name) for j, name in enumerate(REVIEW_FEATURES)],
    "CAST(p_size * 3 AS BIGINT) AS number_of_reviews",
    "CAST(p_size % 8 + 1 AS BIGINT) AS accommodates",
    f"CASE WHEN p_size % 4 <> 0 THEN {_money('p_size * 2.5')} END AS cleaning_fee",
    f"CASE WHEN p_size % 3 <> 0 THEN {_money('p_size * 20.0')} END AS security_deposit",
    "concat(CAST(100 - p_size AS STRING), '%') AS host_response_rate",
    "CASE WHEN p_size % 2 = 1 THEN '100%' END AS host_acceptance_rate",
    f"{_money('(p_size % 7) * 5.0')} AS extra_people",
    # ['email', '<type>']
    f"concat('[{Q}{Q}email{Q}{Q}, {Q}{Q}', lower(p_type), '{Q}{Q}]') AS host_verifications",
    # {"<word1>","<word2>",<TYPE>}
    "concat('{\"', replace(p_name, ' ', '\",\"'), '\",', p_type, '}') AS amenities",
]

_CALENDAR_EXPRS = [
    "l_partkey AS listing_id",
    "CAST(l_shipdate AS DATE) AS date",
    "CASE WHEN l_linestatus = 'O' THEN 't' ELSE 'f' END AS available",
]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/part.parquet", fmt="parquet").selectExpr(*_LISTING_EXPRS)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/lineitem.parquet", fmt="parquet").selectExpr(*_CALENDAR_EXPRS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", fmt="parquet").select("doc_id", "text")
