"""Operator 11: Merkle manifest of a table, one tree a group and one tree over the groups.

1. A leaf is the SHA-256 of a row's fields (byte count, ``:``, value; ``-`` if NULL).
2. Rows are numbered within their group by the key: the leaves are dealt by ranges of
   (group, key), each range is numbered on its own and moved by the rows of the ranges
   before it, so a hot group is spread over as many tasks as it has ranges.
3. Slot pivot: ``slots`` consecutive nodes are one row of the next level; conditional
   aggregates spread them into the columns c0, c1, ...; the concatenated columns hash to
   the parent. A group is done when one node remains, its subroot; a second tree of the
   same shape over the subroots gives the root.
4. Going down again, the columns but the own slot's are a node's siblings: every run of
   nodes gets the path of its parent, ``slots`` leaves share one row of it.

Only the number of levels and the root go through the driver.

Defined results: a NULL group is a group of its own, before all others; a NULL key comes
first in its group; rows of equal keys are ordered by their leaves, and equal rows get
one leaf each; a lone leaf is its group's subroot and a lone subroot the root (their paths
are empty); an empty table has no rows; other columns of the table do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import stored

#: Children of a node.
SLOTS = 16

_STEP = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


@dataclass
class Manifest:
    """``rows``: key, group, leaf, subroot, root, path (an array of left and right
    siblings, lowest level first) and the columns asked for."""

    rows: DataFrame
    root: str | None  # None for an empty table


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored ``rows`` with pos (0-based rank in the group ``g``) and m (the group's rows)."""
    by = [F.col(c).asc_nulls_first() for c in [*order, "tie_"]]  # equal rows part as well
    dealt = stored(rows.withColumn("tie_", F.monotonically_increasing_id())
                   .repartitionByRange("g", *by).withColumn("part_", F.spark_partition_id()), name)
    whole = Window.partitionBy("g")
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("g", "part_").agg(F.count("*").alias("k_")).select(
        "g", "part_", F.coalesce(F.sum("k_").over(before), F.lit(0)).alias("before_"), F.sum("k_").over(whole).alias("m"))
    own = F.row_number().over(Window.partitionBy("g", "part_").orderBy(*by))
    return stored(dealt.withColumn("own_", own).join(ranges, ["g", "part_"])
                  .select(*rows.columns, (F.col("before_") + F.col("own_") - 1).alias("pos"), "m"), name)


def _slots(slots: int) -> list[str]:
    return [f"c{i}" for i in range(slots)]


def climb(nodes: DataFrame, slots: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, lowest first (g, run, m, c0, ...), and the tops (g, digest).

    ``nodes``: g, pos, m, digest; m is the number of the group's nodes of that level.
    """
    most = nodes.agg(F.max("m")).first()[0] or 0
    levels, tops = [], nodes.where("m = 1").select("g", "digest")
    while most > 1:
        slot = F.col("pos") % slots
        runs = stored(nodes.where("m > 1").groupBy("g", "m", F.expr(f"pos div {slots}").alias("run")).agg(
            *[F.max(F.when(slot == i, F.col("digest"))).alias(c) for i, c in enumerate(_slots(slots))]), "runs")
        joined = F.concat(*[F.coalesce(c, F.lit("")) for c in _slots(slots)])
        nodes = runs.select("g", F.col("run").alias("pos"), F.expr(f"(m + {slots - 1}) div {slots}").alias("m"),
                            F.sha2(joined, 256).alias("digest"))
        tops = tops.unionByName(nodes.where("m = 1").select("g", "digest"))
        levels.append(runs)
        most = -(-most // slots)
    return levels, stored(tops, "tops")


def _step(slot: Column, slots: int) -> Column:
    """The siblings of ``slot``: all slot columns but its own."""
    def side(inside):
        return F.concat(*[F.when(inside(F.lit(i)), F.coalesce(c, F.lit(""))).otherwise(F.lit(""))
                          for i, c in enumerate(_slots(slots))])
    return F.array(F.struct(side(lambda i: i < slot).alias("left"), side(lambda i: i > slot).alias("right")))


def descend(levels: list[DataFrame], tops: DataFrame, slots: int) -> DataFrame | None:
    """The lowest runs with subroot and path of their parents; ``tops``: g, subroot, path."""
    above = None
    for runs in reversed(levels):
        found = runs.where(F.col("m") <= slots).join(tops, "g")
        if above is not None:  # a parent is a slot of a run one level up
            up = above.select("g", F.col("run").alias("up_"), "subroot", "path", *_slots(slots))
            low = runs.where(F.col("m") > slots).select(
                "g", "m", "run", F.expr(f"run div {slots}").alias("up_"), F.struct(*_slots(slots)).alias("kids_"))
            deeper = low.join(up, ["g", "up_"]).select(
                "g", "m", "run", "kids_", "subroot", F.concat(_step(F.col("run") % slots, slots), "path").alias("path"))
            found = found.unionByName(deeper.select("g", "m", "run", "kids_.*", "subroot", "path"))
        above = stored(found, "paths")
    return above


def _with_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, slots: int) -> DataFrame:
    """``nodes`` with subroot and path; lone nodes have their group's path."""
    names = nodes.columns
    out = nodes.where("m = 1").join(tops, "g").select(*names, "subroot", "path")
    if levels:
        runs = descend(levels, tops, slots)
        many = nodes.where("m > 1").withColumn("run", F.expr(f"pos div {slots}")).drop("m")
        many = many.join(runs, ["g", "run"])
        out = out.unionByName(many.select(*names, "subroot", F.concat(_step(F.col("pos") % slots, slots), "path").alias("path")))
    return out


def manifest(table: DataFrame, fields: list[str], key: str, group: str, also: dict[str, Column] | None = None,
             slots: int = SLOTS) -> Manifest:
    """The trees of ``table``; ``also`` names further columns of its rows to carry along."""
    also = also or {}
    rows = stored(table.select(
        F.coalesce(F.concat(F.lit("1"), qcol(group).cast("string")), F.lit("0")).alias("g"),  # NULL first
        qcol(key).alias("key_"), leaf([qcol(f) for f in fields]).alias("digest"),
        F.struct(qcol(group).alias("group"), *[c.alias(n) for n, c in also.items()]).alias("also_")), "leaves")
    nodes = numbered(rows, ["key_", "digest"], "leaves")
    levels, tops = climb(nodes, slots)
    upper = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("key_"), "digest"), ["key_"], "subroots")
    upper_levels, top = climb(upper, slots)
    found = top.select("digest").first()
    root = found["digest"] if found else None
    paths = stored(_with_paths(upper, upper_levels, top.select(
        "g", F.col("digest").alias("subroot"), F.array().cast(_STEP).alias("path")), slots).select(
        F.col("key_").alias("g"), F.col("digest").alias("subroot"), "path"), "paths")
    out = _with_paths(nodes, levels, paths, slots)
    return Manifest(out.select(F.col("key_").alias("key"), F.col("also_.group").alias("group"), F.col("digest").alias("leaf"),
                               "subroot", F.lit(root).alias("root"), "path",
                               *[F.col(f"also_.{n}").alias(n) for n in also]), root)


def siblings(path: Column) -> Column:
    """All siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
