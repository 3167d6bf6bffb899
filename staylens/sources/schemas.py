"""Declared types of the listing and calendar files (columns the reports use).

Other columns of a file are read as text by :func:`read_table`; text columns
that survive the model's column drop are one-hot encoded like any other.
"""

from pyspark.sql import types as T

from ..plans.constants import REVIEW_FEATURES

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

CALENDAR_SCHEMA = T.StructType([
    T.StructField("listing_id", _L),
    T.StructField("date", _S),          # yyyy-MM-dd text, parsed by the reports
    T.StructField("available", _S),     # 't' / 'f'
    T.StructField("price", _S),         # money text, unused by the reports
])

LISTINGS_SCHEMA = T.StructType([
    T.StructField("id", _L),
    T.StructField("neighbourhood_cleansed", _S),
    T.StructField("is_location_exact", _S),
    T.StructField("has_availability", _S),
    T.StructField("availability_365", _D),
    T.StructField("price", _S),
    T.StructField("property_type", _S),
    T.StructField("room_type", _S),
    T.StructField("bedrooms", _D),
    T.StructField("bathrooms", _D),
    T.StructField("square_feet", _D),
    *[T.StructField(name, _D) for name in REVIEW_FEATURES],
    T.StructField("number_of_reviews", _L),
    T.StructField("cleaning_fee", _S),
    T.StructField("security_deposit", _S),
    T.StructField("host_acceptance_rate", _S),
    T.StructField("host_response_rate", _S),
    T.StructField("extra_people", _S),
    T.StructField("host_verifications", _S),
    T.StructField("amenities", _S),
])
