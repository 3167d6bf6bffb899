"""Cleaning and auditing operators.

Operators return new DataFrames. Whole-table statistics (missing counts,
non-missing shares, means) are computed for all columns in one aggregation,
which returns one row to the driver regardless of the table size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import as_list, is_present, nan_to_null, qcol, require_columns

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def _is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


_present = is_present  # NULL, and NaN in floating columns, count as missing


# --------------------------------------------------------------------------- P1-P4

def drop_missing(df: DataFrame, subset) -> DataFrame:
    """Remove rows with a missing value in any of the named columns."""
    subset = as_list(subset)
    require_columns(df, subset)
    cond = None
    for name in subset:
        c = _present(df, name)
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def equal_predicate(equal: dict) -> Column:
    cond = None
    for name, value in equal.items():
        c = qcol(name) == F.lit(value)
        cond = c if cond is None else cond & c
    return cond if cond is not None else F.lit(True)


def keep_equal(df: DataFrame, equal: dict) -> DataFrame:
    """Conjunction of equality tests; a missing value fails the test."""
    require_columns(df, equal.keys())
    return df.where(equal_predicate(equal))


def filter_report(df: DataFrame, predicate) -> DataFrame:
    """One row (total, kept, dropped) from a single pass over the table.

    ``predicate`` is a boolean Column or a dict of equality tests (as for
    :func:`keep_equal`); a missing value fails the test.
    """
    if isinstance(predicate, dict):
        require_columns(df, predicate.keys())
        predicate = equal_predicate(predicate)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(predicate, F.lit(False))).alias("kept"),
    ).withColumn("dropped", F.col("total") - F.col("kept"))


def below(df: DataFrame, expr: str, select=None) -> DataFrame:
    """Rows meeting a SQL predicate text, e.g. ``"vacant_ratio < 0.6"``."""
    out = df.where(F.expr(expr))
    return out.select(*[qcol(c) for c in as_list(select)]) if select else out


# --------------------------------------------------------------------------- P6-P9

def split_target(df: DataFrame, target: str, key=None) -> tuple[DataFrame, DataFrame]:
    """(target table, feature table); ``key`` columns are kept on both sides."""
    key = as_list(key)
    require_columns(df, [target, *key])
    return (df.select(*[qcol(k) for k in key], qcol(target)),
            df.drop(target))


def drop_columns(df: DataFrame, names, strict: bool = True) -> DataFrame:
    """Drop named columns; an unknown name is an error unless ``strict=False``."""
    names = as_list(names)
    if strict:
        require_columns(df, names)
    present = [n for n in names if n in df.columns]
    return df.drop(*present)


def drop_counts(df: DataFrame, names) -> dict:
    """P7 accounting from the schema alone (no job): names requested, dropped, columns left."""
    names = as_list(names)
    present = [n for n in names if n in df.columns]
    return {"requested": len(names), "dropped": len(present),
            "remaining": len(df.columns) - len(set(present))}


def with_names(df: DataFrame, names) -> DataFrame:
    """Positional rename of all columns."""
    names = as_list(names)
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def columns_of_type(df: DataFrame, kind: str = "string") -> list[str]:
    """Names of the columns of a type (``string`` or ``numeric``); no job."""
    if kind == "numeric":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    return [f.name for f in df.schema.fields if f.dataType.typeName() == kind]


# --------------------------------------------------------------------------- P10-P13

def missing_report(df: DataFrame, cols=None) -> DataFrame:
    """P10: per column (column, missing, total), from one aggregation then an unpivot."""
    cols = as_list(cols) or list(df.columns)
    require_columns(df, cols)
    wide = df.agg(
        F.count(F.lit(1)).alias("__total"),
        *[F.count_if(~_present(df, c)).alias(f"__m{i}") for i, c in enumerate(cols)],
    )
    pairs = [x for i, c in enumerate(cols) for x in (F.lit(c), F.col(f"__m{i}"))]
    return wide.select(F.stack(F.lit(len(cols)), *pairs).alias("column", "missing"),
                       F.col("__total").alias("total"))


def fill_sentinel(df: DataFrame, values: dict) -> DataFrame:
    """Missing (NULL or NaN) becomes the given value, so it forms its own group."""
    require_columns(df, values.keys())
    out = []
    for name in df.columns:
        if name in values:
            c = nan_to_null(qcol(name)) if _is_float(df, name) else qcol(name)
            out.append(F.coalesce(c, F.lit(values[name]).cast(df.schema[name].dataType)).alias(name))
        else:
            out.append(qcol(name))
    return df.select(*out)


@dataclass(frozen=True)
class ColumnStats:
    """Result of :func:`fit_column_stats`: row count, non-missing counts and means."""
    rows: int
    present: dict
    means: dict

    def kept(self, min_share: float) -> list[str]:
        limit = math.floor(min_share * self.rows)
        return [c for c, n in self.present.items() if n >= limit]


def fit_column_stats(df: DataFrame, cols=None) -> ColumnStats:
    """One aggregation: rows, non-missing count and mean of every listed column.

    Means are taken over numeric columns only (as doubles, NaN skipped).
    """
    cols = as_list(cols) or list(df.columns)
    numeric = set(columns_of_type(df.select(*[qcol(c) for c in cols]), "numeric"))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(_present(df, c)).alias(f"__n{i}"))
        if c in numeric:
            v = qcol(c).cast("double")
            aggs.append(F.avg(nan_to_null(v) if _is_float(df, c) else v).alias(f"__a{i}"))
    row = df.agg(*aggs).first()
    present = {c: int(row[f"__n{i}"]) for i, c in enumerate(cols)}
    means = {c: row[f"__a{i}"] for i, c in enumerate(cols) if c in numeric}
    return ColumnStats(int(row["__rows"]), present, means)


def drop_sparse(df: DataFrame, min_share: float = 0.5, cols=None,
                stats: ColumnStats | None = None) -> DataFrame:
    """Keep a column when it has at least ``floor(min_share * rows)`` values."""
    cols = as_list(cols) or list(df.columns)
    stats = stats or fit_column_stats(df, cols)
    keep = set(stats.kept(min_share))
    return df.select(*[qcol(c) for c in df.columns if c not in cols or c in keep])


def impute_mean(df: DataFrame, cols=None, stats: ColumnStats | None = None,
                fit_on="all", fold: str = "fold") -> DataFrame:
    """Missing numeric values become the column mean (columns become doubles).

    The means come from precomputed ``stats`` or from ``fit_on``: ``'all'``
    (every row, the original order of work), ``'train'`` (rows whose ``fold``
    column is ``'train'``) or a DataFrame. A column without any value keeps
    its NULLs.
    """
    cols = as_list(cols) or columns_of_type(df, "numeric")
    if isinstance(fit_on, str):
        if fit_on not in ("all", "train"):
            raise ValueError("fit_on must be 'all', 'train' or a DataFrame")
        fit_on = df if fit_on == "all" else df.where(qcol(fold) == F.lit("train"))
    stats = stats or fit_column_stats(fit_on, cols)
    out = []
    for name in df.columns:
        if name in cols and name in stats.means:
            v = qcol(name).cast("double")
            v = nan_to_null(v) if _is_float(df, name) else v
            mean = stats.means[name]
            out.append((F.coalesce(v, F.lit(float(mean))) if mean is not None else v).alias(name))
        else:
            out.append(qcol(name))
    return df.select(*out)


def to_number_columns(df: DataFrame, cols, parse) -> DataFrame:
    """Replace text columns by ``parse(column)`` in one projection."""
    cols = set(as_list(cols))
    require_columns(df, cols)
    return df.select(*[parse(qcol(c)).alias(c) if c in cols else qcol(c) for c in df.columns])
