"""Phrase extraction from delimited list text such as ``{TV,"Cable TV"}``.

A phrase starts with a letter, digit or underscore and continues over
letters, digits, underscores, white space, ``/``, ``(``, ``)`` and ``-``; the
text is lower-cased first. Letters and digits are Unicode classes, so
``café`` stays whole (the JVM's ``\\w`` would stop at the accent).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import as_col

# The phrase pattern, a first character (letter, digit or
# underscore) followed by letters, digits, underscores, white space, "/", "(",
# ")" and "-"; letters and digits are Unicode classes. White space is
# Python's Unicode white space, which the JVM's and RE2's \s (ASCII-only) are
# not: the JVM form is Character.isWhitespace plus next line (U+0085) and the
# three no-break spaces (U+00A0, U+2007, U+202F); the RE2 form (for the DuckDB
# oracle) lists the same set: tab to carriage return, U+001C to U+0020, U+0085,
# U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PHRASE_PATTERN = (r"[\p{L}\p{N}_][\p{L}\p{N}_/()\-\x{85}\x{A0}\p{javaWhitespace}"
                  r"\x{2007}\x{202F}]*")
WHITE_SPACE_RE2 = (r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                   r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PHRASE_PATTERN_RE2 = r"[\p{L}\p{N}_][\p{L}\p{N}_" + WHITE_SPACE_RE2 + r"/()\-]*"


def extract_phrases(c) -> Column:
    """All phrases of the lower-cased text, in order, repeats kept (NULL stays NULL)."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(PHRASE_PATTERN), F.lit(0))


def phrase_set(c) -> Column:
    """Distinct phrases of a row; missing text gives an empty array."""
    return F.array_distinct(
        F.coalesce(extract_phrases(c), F.array().cast("array<string>")))
