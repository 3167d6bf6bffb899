"""A dictionary of encoded values as a table (F4, F5 and class labels without a driver list).

``fit_dictionary`` finds the phrases and levels of many columns in one pass and numbers
them by ranges, so no task and no driver holds them all; ``sparse_vectors`` joins a table's
values with the dictionary and makes one sparse vector for each row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import as_list, qcol, require_columns
from ..functions.phrases import phrase_set
from ..session import cut_lineage, scratch_path

_SAFE = "[^0-9A-Za-z_]+"


def dense_index(df: DataFrame, order, name: str = "index") -> DataFrame:
    """``df``, stored, with ``name`` = 0, 1, ... in the order of the columns ``order``.

    The rows are dealt by ranges of the order, each range is numbered on its own and moved
    by the rows before it; rows of equal ``order`` are numbered in any order.
    """
    order = as_list(order)
    part, own, before, rows = "__part", "__own", "__before", "__rows"
    by = [qcol(c).asc_nulls_first() for c in order]
    dealt = cut_lineage(df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), "ranges")
    # a row for each range: as many as the session has shuffle partitions
    up_to = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    moved = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(rows)).select(
        part, F.coalesce(F.sum(rows).over(up_to), F.lit(0)).alias(before))
    numbered = dealt.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*by)))
    return cut_lineage(numbered.join(F.broadcast(moved), part).select(
        *[qcol(c) for c in df.columns], (F.col(before) + F.col(own) - 1).alias(name)), "numbered")


@dataclass(frozen=True)
class Dictionary:
    """``entries``: (column, kind, value, index, name); kind p: phrase, l: level, n: missing."""

    entries: DataFrame
    size: int
    phrase_cols: list
    level_cols: list


def _position(cols, column: str) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in cols]), F.col(column))


def _named(entries: DataFrame, sep: str, taken) -> DataFrame:
    """Column names: sanitised; of names equal ignoring case the first keeps it, the others
    (and all that equal a taken one) get 8 hex digits of the quoted value's MD5."""
    value = F.coalesce("value", F.lit(""))
    base = F.concat("column", F.when(F.col("kind") == "p", F.lit(sep)).otherwise(F.lit("_")),
                    F.when(F.col("kind") == "n", F.lit("nan")).otherwise(F.regexp_replace(value, _SAFE, "_")))
    based = entries.withColumn("__base", base).withColumn("__low", F.lower("__base"))
    first = based.groupBy("__low").agg(F.min("index").alias("__first"))
    quoted = F.when(F.col("kind") == "n", F.lit("None")).otherwise(F.concat(F.lit("'"), value, F.lit("'")))
    suffix = F.concat(F.lit("_"), F.substring(F.md5(quoted), 1, 8))
    plain = (F.col("index") == F.col("__first")) & ~F.col("__low").isin([t.lower() for t in taken])
    return based.join(first, "__low").select(
        "column", "kind", "value", "index", F.when(plain, F.col("__base")).otherwise(F.concat("__base", suffix)).alias("name"))


def _values(df: DataFrame, phrase_cols, level_cols) -> list[Column]:
    """The (kind, column, value) entries of a row, an array for each column."""
    def phrases(c: str) -> Column:
        return F.transform(phrase_set(qcol(c)), lambda p: F.struct(
            F.lit("p").alias("kind"), F.lit(c).alias("column"), p.alias("value")))

    lists = [phrases(c) for c in phrase_cols]
    for c in level_cols:
        v = qcol(c).cast("string")
        lists.append(F.array(F.struct(F.when(v.isNull(), F.lit("n")).otherwise(F.lit("l")).alias("kind"),
                                      F.lit(c).alias("column"), v.alias("value"))))
    return lists


def fit_dictionary(df: DataFrame, phrase_cols=(), level_cols=(), sep: str = "-", drop_first: bool = True,
                   dummy_null: bool = True, taken=()) -> Dictionary:
    """Phrases (sorted, all kept) and levels (sorted, the first dropped, a missing one added)
    of the columns, in their order, with dense indices. ``taken``: names already in use."""
    phrase_cols, level_cols = as_list(phrase_cols), as_list(level_cols)
    require_columns(df, [*phrase_cols, *level_cols])
    spark = df.sparkSession
    schema = "kind string, column string, value string"
    lists = _values(df, phrase_cols, level_cols)
    pairs = (df.select(F.explode(F.concat(*lists)).alias("e")).select("e.*").where("kind <> 'n'").distinct()
             if lists else spark.createDataFrame([], schema))
    if dummy_null:
        pairs = pairs.unionByName(spark.createDataFrame([("n", c, None) for c in level_cols], schema))
    if drop_first:  # one row for each level column
        first = pairs.where("kind <> 'p'").groupBy(F.col("column").alias("__c")).agg(
            F.min(F.struct("kind", "value")).alias("__f"))
        same = (F.col("column") == F.col("__c")) & (F.col("kind") != "p")
        pairs = pairs.join(F.broadcast(first), same, "left").where(
            F.col("__f").isNull() | ~F.struct("kind", "value").eqNullSafe(F.col("__f"))).drop("__c", "__f")
    cols = [*phrase_cols, *level_cols]
    placed = pairs.withColumn("__at", (_position(cols, "column") if cols else F.lit(0)))
    numbered = dense_index(placed, ["__at", "kind", "value"]).drop("__at")
    entries = cut_lineage(_named(numbered, sep, taken), "dictionary")
    return Dictionary(entries, entries.count(), phrase_cols, level_cols)


def sparse_vectors(df: DataFrame, dictionary: Dictionary, numeric=(), keep=(), out: str = "features") -> DataFrame:
    """``keep`` columns and one sparse vector: the numeric columns, then the dictionary's.

    A row's entries are joined with the dictionary and gathered again by row, so the work
    follows the values present and not the width; the table is written once (its vectors
    are Parquet structs read back as vectors).
    """
    numeric, keep = as_list(numeric), as_list(keep)
    lists = _values(df, dictionary.phrase_cols, dictionary.level_cols)
    none = F.array().cast("array<struct<kind:string,column:string,value:string>>")
    rows = cut_lineage(df.select(
        *[qcol(c) for c in keep], F.array(*[qcol(c).cast("double") for c in numeric]).cast("array<double>").alias("__numbers"),
        F.concat(*lists).alias("__entries") if lists else none.alias("__entries")).withColumn(
            "__row", F.monotonically_increasing_id()), "entries")
    of = dictionary.entries.select("kind", "column", F.coalesce("value", F.lit("")).alias("value"), "index")
    each = rows.select("__row", F.explode("__entries").alias("e")).select(
        "__row", "e.kind", "e.column", F.coalesce("e.value", F.lit("")).alias("value"))
    found = each.join(of, ["kind", "column", "value"]).groupBy("__row").agg(
        F.sort_array(F.collect_set(F.col("index").cast("int"))).alias("__slots"))
    width = len(numeric)
    slots = F.coalesce("__slots", F.array().cast("array<int>"))
    first = F.array(*[F.lit(i) for i in range(width)]).cast("array<int>")
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(width + dictionary.size).alias("size"),
        F.concat(first, F.transform(slots, lambda i: i + width)).alias("indices"),
        F.concat("__numbers", F.transform(slots, lambda i: F.lit(1.0))).alias("values"))
    made = rows.join(found, "__row", "left").select(*[qcol(c) for c in keep], vector.alias(out))
    path = scratch_path(df.sparkSession, "vectors")
    made.write.parquet(path)
    schema = T.StructType([f if f.name != out else T.StructField(out, VectorUDT()) for f in made.schema.fields])
    return df.sparkSession.read.schema(schema).parquet(path)


def names_table(dictionary: Dictionary, numeric=()) -> DataFrame:
    """(index, feature) of the slots of :func:`sparse_vectors`.

    The numeric names are a range with literals, whose size Spark knows: a join with the
    table deals out the other side only if the dictionary is large.
    """
    numeric = as_list(numeric)
    names = F.array(*[F.lit(c) for c in numeric]).cast("array<string>")
    first = dictionary.entries.sparkSession.range(len(numeric)).select(
        F.col("id").alias("index"), F.get(names, F.col("id").cast("int")).alias("feature"))
    return first.unionByName(dictionary.entries.select((F.col("index") + len(numeric)).alias("index"), F.col("name").alias("feature")))
