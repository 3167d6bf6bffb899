"""Aggregations (A1-A9, A11) and rankings.

Group keys that are missing (NULL or NaN) are left out (a missing key is not a group
unless a sentinel was filled first), counts are ``count(*)`` over all rows of the group
(missing values included), and medians skip missing values.

Exact medians never gather a key's values in one task. ``(keys, value) -> rows`` counts are
shuffled on key and value, then the middle ranks are selected digit by digit: a first
digit cuts the values' logarithms (sign, exponent and leading bits, so the order of the values
is kept), a second the range of the one cell that holds the middle ranks. Each digit
is one small count by cell; only values that share both digits with the median are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._util import as_list, is_present, nan_to_null, qcol
from ..functions.numbers import bucket_midpoint

_V, _N = "__value", "__rows"

#: Cells of a doubling of the value (first digit) and of the cell that is cut again (second).
CELLS_PER_DOUBLING = 1 << 10
CELLS = 1 << 16


def _key_cols(keys) -> list[Column]:
    return [qcol(k) for k in as_list(keys)]


def _not_missing(df: DataFrame, keys) -> Column | None:
    cond = None
    for k in as_list(keys):
        c = is_present(df, k)
        cond = c if cond is None else cond & c
    return cond


def _numeric(df: DataFrame, value) -> Column:
    if isinstance(value, str) and value in df.columns:
        c, dtype = qcol(value), df.schema[value].dataType.typeName()  # cached schema
    else:
        c = qcol(value) if isinstance(value, str) else value
        dtype = df.select(c).schema.fields[0].dataType.typeName()
    c = c.cast("double")
    return nan_to_null(c) if dtype in ("double", "float") else c


# --------------------------------------------------------------------------- A1, T1

def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Rows per value, missing values left out, most frequent first (ties by value)."""
    return (df.where(is_present(df, col)).groupBy(qcol(col))
            .agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), qcol(col).asc()))


def top_k_values(df: DataFrame, col: str, k: int, name: str = "count") -> DataFrame:
    """The ``k`` most frequent values (TakeOrderedAndProject over the counts)."""
    return value_counts(df, col, name).limit(k)


# --------------------------------------------------------------------------- A2, A3, A5

def median_count(df: DataFrame, keys, value, median_name: str = "median",
                 count_name: str | None = "count", exact: bool = True,
                 accuracy: int = 10_000, weight: str | None = None) -> DataFrame:
    """Per key tuple: median of ``value`` (missing skipped) and row count.

    ``exact=True`` gives the midpoint of the two middle values for even counts;
    ``exact=False`` uses ``percentile_approx`` with ``accuracy``. With ``weight``, a column
    of whole numbers, a row stands for that many equal ones (exact medians only).
    """
    keys = as_list(keys)
    if weight and not exact:
        raise ValueError("weights need exact=True")
    base = df.select(*_key_cols(keys), _numeric(df, value).alias(_V), *([qcol(weight).alias(_N)] if weight else []))
    cond = _not_missing(base, keys)
    if cond is not None:
        base = base.where(cond)
    if not exact:
        aggs = [F.percentile_approx(F.col(_V), F.lit(0.5), F.lit(accuracy)).alias(median_name)]
        if count_name:
            aggs.append(F.count(F.lit(1)).alias(count_name))
        return base.groupBy(*_key_cols(keys)).agg(*aggs)
    names = [f"__k{i}" for i in range(len(keys))] or ["__k0"]
    # without keys, a key that is always 0 but is computed from the value: a literal
    # would be folded and turn the joins below into nested loops
    cols = ([qcol(k).alias(n) for k, n in zip(keys, names)]
            or [F.pmod(F.xxhash64(F.col(_V)), F.lit(1)).alias("__k0")])
    medians = _medians(base.select(*cols, F.col(_V), *([F.col(_N)] if weight else [])), names)
    out = [F.col(n).alias(k) for k, n in zip(keys, names)]
    out.append(F.col("__median").alias(median_name))
    if count_name:
        out.append(F.col("__total").alias(count_name))
    if not keys:  # one row, also for an empty table
        return medians.agg(F.max("__median").alias(median_name),
                           *([F.coalesce(F.max("__total"), F.lit(0)).alias(count_name)] if count_name else []))
    return medians.select(*out)


group_median_count = median_count  # A3 under its catalogue name


def _first_digit(v: Column) -> Column:
    """A whole number that never falls when ``v`` rises: sign and cut logarithm of the size."""
    size = F.abs(v)
    lowest = 1075 * CELLS_PER_DOUBLING  # below the smallest double
    cut = F.when(size == float("inf"), F.lit(1025 * CELLS_PER_DOUBLING)).otherwise(
        F.floor(F.log2(F.when(size > 0, size)) * CELLS_PER_DOUBLING)) + lowest
    return F.when(v > 0, cut).when(v < 0, -cut).when(v == 0, F.lit(0)).cast("bigint")


def _second_digit(v: Column, lo: Column, hi: Column) -> Column:
    return F.floor((v - lo) / (hi - lo) * CELLS).cast("bigint")


def _cells(values: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Rows and range of the values of each cell."""
    return values.groupBy(*keys, "__cell").agg(
        F.sum(_N).alias("__rows"), F.min(_V).alias("__lo"), F.max(_V).alias("__hi"), *more)


def _located(cells: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """One row for each key: __total, the median where the cells tell it, else the cell
    (__cell, __lo, __hi) to be cut again with the two middle ranks inside it (__low, __high).

    ``low`` and ``high`` are 0-based ranks, which may use ``__n`` (rows with a value).
    """
    whole = Window.partitionBy(*keys)
    up_to = whole.orderBy(F.col("__cell").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.select(
        "*", F.sum("__rows").over(whole).alias("__all"),
        F.coalesce(F.sum("__rows").over(up_to), F.lit(0)).alias("__before"),
        F.coalesce(F.sum(F.when(F.col("__cell").isNotNull(), F.col("__rows"))).over(whole), F.lit(0)).alias("__n"))
    ranked = ranked.withColumns({"__rank_low": low, "__rank_high": high})

    def holder(rank: str) -> Column:
        r = F.col(rank)
        inside = F.col("__cell").isNotNull() & (F.col("__before") <= r) & (r < F.col("__before") + F.col("__rows"))
        return F.max(F.when(inside, F.struct("__cell", "__lo", "__hi", (F.col("__rank_low") - F.col("__before")).alias("low"),
                                             (F.col("__rank_high") - F.col("__before")).alias("high"))))

    found = ranked.groupBy(*keys).agg(F.max("__all").alias("__total"), holder("__rank_low").alias("a"),
                                      holder("__rank_high").alias("b"))
    a, b = F.col("a"), F.col("b")
    known = (a["__cell"] != b["__cell"]) | (a["__lo"] == a["__hi"])
    # ranks in two cells are the last value of the one and the first of the other
    return found.select(
        *keys, "__total", F.when(known, F.lit(0.5) * a["__hi"] + F.lit(0.5) * b["__lo"]).alias("__median"),
        F.when(~known, a["__cell"]).alias("__cell"), a["__lo"].alias("__lo"), a["__hi"].alias("__hi"),
        a["low"].alias("__low"), a["high"].alias("__high"))


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __total, __median): exact, whatever the number of values of a key."""
    v, n = F.col(_V), F.col(_N)
    each = F.sum(_N) if _N in rows.columns else F.count(F.lit(1))
    counts = rows.groupBy(*keys, _V).agg(each.alias(_N)).withColumn("__cell", _first_digit(v))
    first = _located(_cells(counts, keys), keys, F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2))

    def inside(values: DataFrame, found: DataFrame) -> DataFrame:
        """The values of the cells to be cut, with the middle ranks inside them."""
        cells = found.where(F.col("__cell").isNotNull()).select(*keys, "__cell", "__lo", "__hi", "__low", "__high")
        return values.select(*keys, "__cell", _V, _N).join(cells, [*keys, "__cell"])

    again = inside(counts, first).withColumn("__cell", _second_digit(v, F.col("__lo"), F.col("__hi")))
    cells = _cells(again, keys, F.first("__low").alias("__low"), F.first("__high").alias("__high"))
    second = _located(cells, keys, F.col("__low"), F.col("__high"))
    left = inside(again, second)
    until = F.sum(_N).over(Window.partitionBy(*keys).orderBy(_V).rowsBetween(Window.unboundedPreceding, 0))
    ranked = left.withColumn("__until", until)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("__until") - n <= F.col(rank)) & (F.col(rank) < F.col("__until")), v))

    third = ranked.groupBy(*keys).agg((F.lit(0.5) * at("__low") + F.lit(0.5) * at("__high")).alias("__third"))
    return (first.select(*keys, "__total", "__median")
            .join(second.select(*keys, F.col("__median").alias("__second")), keys, "left").join(third, keys, "left")
            .select(*keys, "__total", F.coalesce("__median", "__second", "__third").alias("__median")))


def group_median(df: DataFrame, keys, value, name: str = "median", exact: bool = True) -> DataFrame:
    """A2: median per group."""
    return median_count(df, keys, value, median_name=name, count_name=None, exact=exact)


def total_median(df: DataFrame, value, name: str = "median", exact: bool = True) -> DataFrame:
    """A5: one-row median of the whole column."""
    return median_count(df, [], value, median_name=name, count_name=None, exact=exact)


# --------------------------------------------------------------------------- A4

def share_of(predicate: Column) -> Column:
    """Share of rows meeting ``predicate``; a missing value counts as not meeting it."""
    return F.avg(F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0)))


def group_share(df: DataFrame, keys, predicate: Column, name: str = "share") -> DataFrame:
    """Share of rows per key meeting ``predicate`` (partial + final aggregate)."""
    keys = as_list(keys)
    cond = _not_missing(df, keys)
    src = df.where(cond) if cond is not None else df
    return src.groupBy(*_key_cols(keys)).agg(share_of(predicate).alias(name))


# --------------------------------------------------------------------------- A6, A7, A11

def distinct_count(df: DataFrame, col: str, name: str | None = None, approx: bool = False,
                   rsd: float = 0.01) -> DataFrame:
    name = name or f"distinct_{col}"
    agg = F.approx_count_distinct(qcol(col), rsd) if approx else F.count_distinct(qcol(col))
    return df.agg(agg.alias(name))


def column_means(df: DataFrame, cols) -> DataFrame:
    """One row: the mean of every listed column (missing and NaN skipped), one pass."""
    return df.agg(*[F.avg(_numeric(df, c)).alias(c) for c in as_list(cols)])


def date_range(df: DataFrame, col: str, first: str = "first", last: str = "last") -> DataFrame:
    return df.agg(F.min(qcol(col)).alias(first), F.max(qcol(col)).alias(last))


# --------------------------------------------------------------------------- A8, A9

def profile_by_features(df: DataFrame, features, value, feature_name: str = "feature",
                        level_name: str = "level", median_name: str = "median",
                        count_name: str = "count", exact: bool = True) -> DataFrame:
    """For every feature: median of ``value`` and row count per level.

    Rows that agree in all features and the value are counted first; the distinct ones are
    unpivoted into weighted (feature, level) pairs, so the features share one grouping.
    """
    features = as_list(features)
    rows = df.select(_numeric(df, value).alias(_V), *[qcol(f).cast("double").alias(f) for f in features])
    if not exact:
        long = rows.unpivot([_V], features, feature_name, level_name)
        return median_count(long, [feature_name, level_name], _V, median_name, count_name, exact)
    tuples = rows.groupBy(_V, *[qcol(f) for f in features]).agg(F.count(F.lit(1)).alias(_N))
    long = tuples.unpivot([_V, _N], features, feature_name, level_name)
    return median_count(long, [feature_name, level_name], _V, median_name, count_name, weight=_N)


def group_by_bucket(df: DataFrame, col: str, width: float = 50, value="price",
                    bucket_name: str | None = None,
                    median_name: str = "median", count_name: str = "count",
                    exact: bool = True) -> DataFrame:
    """Median and count of ``value`` per bucket of ``col`` (key = bucket midpoint)."""
    bucket_name = bucket_name or col
    keyed = df.select(bucket_midpoint(qcol(col), width).alias(bucket_name),
                      _numeric(df, value).alias(_V))
    return median_count(keyed, [bucket_name], _V, median_name, count_name, exact)


# --------------------------------------------------------------------------- T2-T4

def _ties(keys) -> list[Column]:
    return [qcol(k).asc_nulls_last() for k in as_list(keys)]


def bottom_k(df: DataFrame, metric: str, k: int, keys=()) -> DataFrame:
    """``k`` rows with the lowest ``metric`` (missing last, ties by ``keys``)."""
    return df.orderBy(qcol(metric).asc_nulls_last(), *_ties(keys)).limit(k)


def top_k(df: DataFrame, metric: str, k: int, keys=()) -> DataFrame:
    """``k`` rows with the highest ``metric`` (missing last, ties by ``keys``)."""
    return df.orderBy(qcol(metric).desc_nulls_last(), *_ties(keys)).limit(k)


def top_k_then_sort(df: DataFrame, by: str, k: int, then: str, keys=(),
                    then_descending: bool = True) -> DataFrame:
    """Keep the ``k`` rows with the largest ``by``, present them ordered by ``then``."""
    kept = top_k(df, by, k, keys)
    order = qcol(then).desc_nulls_last() if then_descending else qcol(then).asc_nulls_last()
    return kept.orderBy(order, *_ties(keys))


def sort_rows(df: DataFrame, by, descending: bool = False, keys=()) -> DataFrame:
    """Full sort of a (small, aggregated) result."""
    cols = [qcol(c).desc_nulls_last() if descending else qcol(c).asc_nulls_last()
            for c in as_list(by)]
    return df.orderBy(*cols, *_ties(keys))
