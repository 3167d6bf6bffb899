"""Set and membership operators: U1 intersection, P5/J1 semi joins, J2/J3 alignment.

Member keys are always made distinct, and every join is one lazy plan: Spark broadcasts
a side whose estimated or measured size is under its threshold, and shuffles otherwise
(AQE splits a hot key). No size is tested here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._util import as_list, qcol


def member_set(members: DataFrame, member_col: str) -> DataFrame:
    """The distinct non-missing member keys as ``__member``."""
    keys = members.select(qcol(member_col).alias("__member"))
    return keys.where(F.col("__member").isNotNull()).distinct()


def common_keys(a: DataFrame, b: DataFrame, key: str | None = None,
                b_key: str | None = None) -> DataFrame:
    """Distinct keys present in both tables (set intersection).

    Without ``key``, both tables must have a single column (two key lists).
    """
    if key is None:
        if len(a.columns) != 1 or len(b.columns) != 1:
            raise ValueError("common_keys without a key needs two one-column tables")
        key, b_key = a.columns[0], b.columns[0]
    right = b.select(qcol(b_key or key).alias(key))
    return a.select(qcol(key)).intersect(right)


def keep_members(df: DataFrame, col: str, members: DataFrame, member_col: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``col`` is in ``members[member_col]`` (left semi join).

    NULL never matches, as with ``isin``.
    """
    right = member_set(members, member_col or col)
    return df.join(right, qcol(col) == F.col("__member"), "left_semi")


def flag_members(df: DataFrame, col: str, members: DataFrame, flag: str,
                 member_col: str | None = None) -> DataFrame:
    """Add boolean ``flag``: is ``col`` among the members."""
    right = member_set(members, member_col or col).withColumn(flag, F.lit(True))
    out = df.join(right, qcol(col) == F.col("__member"), "left").drop("__member")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def lookup(df: DataFrame, table: DataFrame, key, how: str = "left") -> DataFrame:
    """Attach the columns of a keyed table (for example a count per group)."""
    return df.join(table, on=as_list(key), how=how)


def align_on(key, base: DataFrame, *others: DataFrame, how: str = "left") -> DataFrame:
    """Series side by side on a key (never by row position).

    Rows of ``base`` are all kept; a key missing from another series gives NULL.
    """
    out = base
    for other in others:
        out = out.join(other, on=as_list(key), how=how)
    return out
