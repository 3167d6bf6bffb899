"""Scalar column functions: money and percent text, dates, bucket midpoints.

All are built-in Catalyst expressions, so they stay inside whole-stage code
generation; none of them needs a Python worker.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import as_col

# Fixed value: characters kept by the number parse (digits and the dot);
# everything else, the minus sign included, is removed before the cast.
NON_NUMERIC = "[^0-9.]"
NUMERIC_TYPES = "^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


@functools.lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit (Unicode category Nd) and its ASCII digit.

    Built by rule from the Unicode database rather than listed.
    """
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch) == "Nd":
            src.append(ch)
            dst.append(str(unicodedata.decimal(ch)))
    return "".join(src), "".join(dst)


def parse_number(c) -> Column:
    """``'$1,234.50'`` -> 1234.5, ``'98%'`` -> 98.0 (no scaling).

    Decimal digits of any script count as digits (mapped to ASCII first);
    everything but digits and dots is removed. Unparsable text (empty after
    stripping, several dots) becomes NULL instead of failing the job; NULL
    stays NULL. A column that is numeric already passes through as double.
    """
    src, dst = _decimal_digits()
    c = as_col(c)
    ascii_digits = F.translate(c.cast("string"), src, dst)
    text = F.regexp_replace(ascii_digits, NON_NUMERIC, "").try_cast("double")
    # the type is known when the plan is analysed, so only one branch is left
    return F.when(F.typeof(c).rlike(NUMERIC_TYPES), c.try_cast("double")).otherwise(text)


def unparsable(c) -> Column:
    """True where the text is present but does not parse as a number."""
    c = as_col(c)
    return c.isNotNull() & parse_number(c).isNull()


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """Text date to DATE; malformed text gives NULL rather than an error."""
    return F.try_to_date(as_col(c), fmt)


def bucket_midpoint(c, width: float) -> Column:
    """Midpoint of the bucket holding ``c``: ``trunc(c / width) * width + width / 2``.

    Truncation goes toward zero as in Python's ``int()``, so -7 with width 10
    lands in the bucket with midpoint 5, not -5. NULL, NaN and infinite values have no
    bucket (NULL).
    """
    w = float(width)
    x = as_col(c).cast("double") / F.lit(w)
    return F.when(~F.isnan(x), x).try_cast("bigint").cast("double") * F.lit(w) + F.lit(w / 2.0)
