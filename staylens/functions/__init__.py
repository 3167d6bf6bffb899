"""Scalar column functions."""

from .numbers import NON_NUMERIC, bucket_midpoint, parse_date, parse_number, unparsable
from .phrases import PHRASE_PATTERN, extract_phrases, phrase_set

__all__ = [
    "NON_NUMERIC", "PHRASE_PATTERN", "bucket_midpoint", "extract_phrases",
    "parse_date", "parse_number", "phrase_set", "unparsable",
]
