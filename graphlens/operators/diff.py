"""Structural differences of two catalogs, with renames and blast radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut
from .catalog import running_total


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change_type, id, from_id``: added, removed, modified or renamed.

    ``old`` and ``new``: id (unique), content_hash.  Removed and added entities
    of one non-empty hash pair up one to one, in the order of their ids.  A null
    hash pairs with nothing and equals only a null one.
    """
    a = old.select(F.col("id").alias("a_id"), F.col("content_hash").alias("a_hash"))
    b = new.select(F.col("id").alias("b_id"), F.col("content_hash").alias("b_hash"))
    both = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer")
    modified = both.where("a_id is not null and b_id is not null and not (a_hash <=> b_hash)").select(F.lit("modified").alias("change_type"), F.col("b_id").alias("id"), F.lit(None).cast("string").alias("from_id"))
    gone = both.where("b_id is null").select("a_id", "a_hash")
    come = both.where("a_id is null").select("b_id", "b_hash")
    nth = lambda h, i: F.row_number().over(Window.partitionBy(h).orderBy(i))
    usable = lambda c: (F.col(c).isNotNull()) & (F.col(c) != "")
    g = gone.withColumn("k", F.when(usable("a_hash"), nth("a_hash", "a_id")))
    c = come.withColumn("k2", F.when(usable("b_hash"), nth("b_hash", "b_id")))
    paired = g.join(c, (F.col("a_hash") == F.col("b_hash")) & (F.col("k") == F.col("k2")), "full_outer")
    kind = F.when(F.col("a_id").isNull(), "added").when(F.col("b_id").isNull(), "removed").otherwise("renamed")
    rest = paired.select(kind.alias("change_type"), F.coalesce("b_id", "a_id").alias("id"), F.when(F.col("b_id").isNotNull(), F.col("a_id")).alias("from_id"))
    return modified.unionByName(rest)


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id`` of the entities that both have with the same hash."""
    both = old.select("id", F.col("content_hash").alias("a")).join(new.select("id", F.col("content_hash").alias("b")), "id")
    return both.where("a <=> b").select("id")


def counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def blast_radius(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) with both ends among the changed entities."""
    ids = changed.select("id").distinct()
    e = edges.select("src", "dst").distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


# Colours of the kinds of change, fill and stroke.
COLOURS = {"added": ("#9f9", "#0a0"), "removed": ("#f99", "#a00"), "modified": ("#fb8", "#d60"), "renamed": ("#9ff", "#0aa")}


def lines(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, k, line`` of the differences as a flowchart.

    ``changed``: change_type, id, from_id, kind, name, file.  ``edges``: src, dst
    of the new side.  Nodes are numbered through kinds of change and ids, over
    ranges of the whole relation; edges are drawn between changed entities only.
    """
    order = F.array_position(F.array(*(F.lit(k) for k in COLOURS)), F.col("change_type")).cast("int")
    short = lambda c: F.regexp_replace(c, "^code:", "")
    renamed = F.concat(short(F.coalesce("from_id", F.lit(""))), F.lit(" ↪ "), short("id"))
    kind, file = F.coalesce("kind", F.lit("")), F.coalesce("file", F.lit(""))
    name = F.when(F.col("change_type") == "modified", S.name_from_id(F.col("id"), kind)).otherwise(F.coalesce("name", F.lit("")))
    label = F.when(F.col("change_type") == "renamed", renamed).otherwise(S.entity_label(kind, name, file, F.col("id")))
    numbered = running_total(changed.select(order.alias("o"), "change_type", "id", label.alias("label")).withColumn("one", F.lit(1)), ["o", "id"], "one", "n")
    numbered = cut(numbered.withColumn("node", F.concat(F.lit("n"), (F.col("n") - 1).cast("string"))).select("o", "change_type", "id", "label", "node"))
    key = lambda *c: F.concat_ws("\0", *c)
    nodes = numbered.select(F.col("o").alias("part"), key(F.lit("1"), "id").alias("k"), F.concat(F.lit("    "), "node", F.lit('["'), F.translate("label", '"', "'"), F.lit('"]:::'), "change_type").alias("line"))
    heads = numbered.groupBy("o", "change_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("o").alias("part"), F.lit("0").alias("k"), F.concat(F.lit("    %% "), "change_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    ends = numbered.select("id", "node")
    inside = edges.select("src", "dst").distinct().join(ends.select(F.col("id").alias("src"), F.col("node").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("node").alias("b")), "dst")
    drawn = inside.select(F.lit(9).alias("part"), key("src", "dst").alias("k"), F.concat(F.lit("    "), "a", F.lit(" --> "), "b").alias("line"))
    radius = drawn.limit(1).select(F.lit(8).alias("part"), F.lit("").alias("k"), F.lit("    %% blast-radius edges (both ends changed)").alias("line"))
    return heads.unionByName(nodes).unionByName(radius).unionByName(drawn)


def head(old: str, new: str) -> str:
    """The first lines of that flowchart."""
    return "\n".join(["graph TD", f"    %% diff: {old} → {new}", *(f"    classDef {k} fill:{a},stroke:{b},color:#000" for k, (a, b) in COLOURS.items())])
