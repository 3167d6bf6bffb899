"""S2 ordered previews and S3 table profiles.

A Spark table has no file order, so a preview needs an explicit order; the
plan is a TakeOrderedAndProject (each task keeps its n best rows, the driver
merges n x tasks rows), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._util import as_list, nan_to_null, qcol


def _sort_cols(order, descending: bool):
    cols = []
    for c in as_list(order):
        c = qcol(c) if isinstance(c, str) else c
        cols.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return cols


def head_rows(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows by ``order`` (ascending, missing last)."""
    return df.orderBy(*_sort_cols(order, False)).limit(n)


def tail_rows(df: DataFrame, n: int, order) -> DataFrame:
    """Last ``n`` rows by ``order``, returned in ascending order."""
    last = df.orderBy(*_sort_cols(order, True)).limit(n)
    return last.orderBy(*_sort_cols(order, False))


def profile(df: DataFrame, distinct_cols=(), range_cols=(), approx: bool = False,
            rsd: float = 0.01) -> DataFrame:
    """One row: ``rows``, ``distinct_<c>`` per column, ``min_<c>``/``max_<c>`` per range column.

    One aggregation over the table. ``approx=True`` uses HyperLogLog++ sketches
    (bounded memory, no extra shuffle per column) instead of exact distinct
    counts.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in as_list(distinct_cols):
        if approx:
            aggs.append(F.approx_count_distinct(qcol(c), rsd).alias(f"distinct_{c}"))
        else:
            aggs.append(F.count_distinct(qcol(c)).alias(f"distinct_{c}"))
    for c in as_list(range_cols):
        v = nan_to_null(c) if df.schema[c].dataType.typeName() in ("double", "float") else qcol(c)
        aggs += [F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}")]
    return df.agg(*aggs)


def column_names(df: DataFrame) -> list[str]:
    """Column names (schema only, no job)."""
    return list(df.columns)


def column_count(df: DataFrame) -> int:
    return len(df.columns)
