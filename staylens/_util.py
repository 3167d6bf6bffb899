"""Small shared helpers (no Spark jobs here)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def quote(name: str) -> str:
    """Backtick-quote a column name for use in ``F.col`` / SQL text."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    """Column by exact name, safe for names with dots, spaces or brackets."""
    return F.col(quote(name))


def require_columns(df: DataFrame, names: Iterable[str], what: str = "column") -> None:
    present = set(df.columns)
    missing = [n for n in names if n not in present]
    if missing:
        raise ValueError(f"unknown {what}(s) {missing}; table has {df.columns}")


def nan_to_null(c) -> Column:
    """NaN -> NULL for floating columns, so averages and medians skip it."""
    c = qcol(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


_NAME_BAD = re.compile(r"[^0-9A-Za-z_]+")


def safe_name(prefix: str, value: str, sep: str = "_") -> str:
    """Generated column name: ``prefix`` + sanitised value (letters, digits, _)."""
    return f"{prefix}{sep}{_NAME_BAD.sub('_', value)}"


def unique_names(prefix: str, values: Sequence, sep: str = "_",
                 taken: Iterable[str] = ()) -> list[str]:
    """Generated column names ``<prefix><sep><value>``, sanitised and unique.

    Spark resolves names case-insensitively, so a name equal (ignoring case) to
    a taken one gets the first 8 hex digits of the value's MD5 appended; the
    result is deterministic for a given value list. ``None`` names the
    missing-value column ``<prefix><sep>nan``.
    """
    used = {t.lower() for t in taken}
    out = []
    for v in values:
        base = f"{prefix}{sep}nan" if v is None else safe_name(prefix, str(v), sep)
        name = base
        if name.lower() in used:
            name = f"{base}_{hashlib.md5(repr(v).encode()).hexdigest()[:8]}"
        i = 2
        while name.lower() in used:
            name, i = f"{base}_{i}", i + 1
        used.add(name.lower())
        out.append(name)
    return out


def is_present(df: DataFrame, name: str) -> Column:
    """Neither NULL nor (in a floating column) NaN."""
    c = qcol(name)
    floating = df.schema[name].dataType.typeName() in ("double", "float")
    return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()


def spread(df: DataFrame, key: str | None, partitions: int | None) -> DataFrame:
    """Rows dealt out evenly before CPU-heavy work: by a hash of ``key`` (round robin
    without one) to ``partitions``, by default the session's shuffle partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, qcol(key)) if key else df.repartition(n)
