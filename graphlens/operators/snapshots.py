"""What changed between full snapshots (problem 1).

Gaps and islands: every entity's presence in the snapshots of its series is cut
into validity intervals of one state.  An interval that starts right after
another one of the same entity is a change, any other start an addition, and an
end that no interval follows is a removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

#: Upper estimate of one row of the snapshot dimension in memory, in bytes.
_DIM_ROW = 200


def slashes(c: Column) -> Column:
    r"""``\`` written as ``/``."""
    return F.translate(c, "\\", "/")


def known_hash(c: Column) -> Column:
    """A content hash as it compares; null where it is unknown."""
    h = F.regexp_replace(F.lower(F.trim(c)), "^sha256:", "")
    return F.when(h != "", h)


def edge_set(c: Column) -> Column:
    """Fingerprint of an edge list as a set; a null list is the empty set.

    ``xxhash64`` over the sorted set.  Only neighbouring versions of one entity
    are ever compared, so 64 bits leave a chance of 2**-64 per comparison.
    """
    edges = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(edges, slashes))))


def snapshot_dimension(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot: ``snapshot_id, series, ord, n_entities``.

    Deliveries repeat; the earliest delivery of a snapshot counts.  ``series``
    is a number for a (repo, source_root), ``ord`` the place by ``taken_at``
    (ties by id) within it.  Snapshots without id, series or time are dropped.
    """
    one = (
        snapshots.where("snapshot_id is not null and repo is not null and source_root is not null and taken_at is not null")
        .groupBy("snapshot_id")
        .agg(F.min(F.struct("delivered_at", "taken_at", "repo", "source_root", "n_entities")).alias("s"))
        .select("snapshot_id", "s.taken_at", "s.repo", "s.source_root", "s.n_entities")
    )
    series = F.xxhash64("repo", "source_root")
    at = Window.partitionBy("series").orderBy("taken_at", "snapshot_id")
    return one.withColumn("series", series).withColumn("ord", F.row_number().over(at)).select("snapshot_id", "series", "ord", "n_entities")


def counting_snapshots(entities: DataFrame, dim: DataFrame) -> DataFrame:
    """Snapshots of ``dim`` that are complete: ``snapshot_id, series, ord, place``.

    Complete means exactly ``n_entities`` distinct ids.  Ids are counted by 96
    bits of hashes, so this pass shuffles a few bytes a row; ``place`` is the
    order among the complete ones of the series.
    """
    marks = entities.select("snapshot_id", slashes(F.col("id")).alias("k")).where("k is not null and snapshot_id is not null")
    sizes = (
        marks.select(F.xxhash64("snapshot_id").alias("s"), F.xxhash64("k").alias("a"), F.hash("k").alias("b"))
        .distinct()
        .groupBy("s")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    full = dim.withColumn("s", F.xxhash64("snapshot_id")).join(sizes, "s").where("n = n_entities")
    return full.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("ord"))).select("snapshot_id", "series", "place")


def validity_intervals(entities: DataFrame, places: DataFrame) -> DataFrame:
    """Islands of one state: ``series, id, first, last, before, after``.

    ``before``: the interval follows another one of the entity without a gap.
    ``after``: another one follows it without a gap.  An unknown hash differs
    from nothing, so it never starts an island by itself; the state it stands
    beside is compared with the row just before, as the rows come.

    Repeated rows of an id in a snapshot are one row with the greatest known
    hash and the greatest edge fingerprint.
    """
    rows = (
        entities.where("id is not null")
        .select("snapshot_id", slashes(F.col("id")).alias("id"), F.xxhash64(known_hash(F.col("content_hash"))).alias("h0"), known_hash(F.col("content_hash")).isNull().alias("u"), edge_set(F.col("edges_out")).alias("e"))
        .join(broadcast_if_small(places, _DIM_ROW), "snapshot_id")
        .select("series", "id", "place", F.when(~F.col("u"), F.col("h0")).alias("h"), "e")
        .repartition("series", "id")
        .groupBy("series", "id", "place")
        .agg(F.max("h").alias("h"), F.max("e").alias("e"))
    )
    by = Window.partitionBy("series", "id").orderBy("place")
    prev = lambda c: F.lag(c).over(by)
    near = F.coalesce(prev("place") == F.col("place") - 1, F.lit(False))
    same = near & (prev("e") == F.col("e")) & F.coalesce(prev("h") == F.col("h"), F.lit(True))
    marked = rows.select("series", "id", "place", near.alias("near"), (~same).alias("start"))
    island = marked.withColumn("island", F.sum(F.col("start").cast("int")).over(by))
    spans = island.groupBy("series", "id", "island").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.max(F.col("start") & F.col("near")).alias("before")
    )
    nxt = Window.partitionBy("series", "id").orderBy("first")
    return spans.withColumn("after", F.coalesce(F.lead("first").over(nxt) == F.col("last") + 1, F.lit(False))).drop("island")


def snapshot_changes(entities: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Entities added, removed or changed between neighbouring full snapshots.

    ``entities``: snapshot_id, id, content_hash, edges_out (more columns are
    ignored).  ``snapshots``: snapshot_id, repo, source_root, n_entities,
    taken_at, delivered_at.  Returns ``snapshot_id, entity_id, change_type``.

    A snapshot counts if it holds exactly ``n_entities`` distinct ids; each is
    compared with the counting one before it in its series, the first has no
    cases.  Null ids are ignored; an empty table gives no rows; an entity that
    leaves and comes back is a removal and an addition.
    """
    places = cut(counting_snapshots(entities, snapshot_dimension(snapshots)))  # a few rows a series, used three times
    spans = validity_intervals(entities, places)
    kind = F.when(F.col("before"), "changed").otherwise("added")
    events = spans.select(
        "series", F.col("id").alias("entity_id"),
        F.explode(F.array(
            F.struct(F.col("first").alias("place"), F.when(F.col("first") > 1, kind).alias("change_type")),
            F.struct((F.col("last") + 1).alias("place"), F.when(~F.col("after"), F.lit("removed")).alias("change_type")),
        )).alias("x"),
    ).select("series", "entity_id", "x.*").where("change_type is not null")
    # A removal after the last counting snapshot finds no place and drops out.
    return events.join(broadcast_if_small(places, _DIM_ROW), ["series", "place"]).select("snapshot_id", "entity_id", "change_type")
