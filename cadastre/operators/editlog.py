"""Provenance and edit-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.operators.graphs import places
from cadastre.sources.tables import written


def lww_merge(ops: DataFrame) -> DataFrame:
    """(doc, key, value, writes): the value of the latest (ts, actor) for each key."""
    return ops.groupBy("doc", "key").agg(F.max_by("value", F.struct("ts", "actor")).alias("value"), F.count("*").alias("writes"))


def vertex_state(ops: DataFrame) -> DataFrame:
    """(doc, vertex, x, y): where the latest insert or move put each vertex that no delete ever named."""
    placed = ops.where("kind in ('insert', 'move')").groupBy("doc", "vertex").agg(F.max_by(F.struct("x", "y"), F.struct("ts", "actor")).alias("p"))
    gone = ops.where("kind = 'delete'").select("doc", "vertex").distinct()
    return placed.join(gone, ["doc", "vertex"], "left_anti").select("doc", "vertex", "p.x", "p.y")


def manifest_hashes(entries: DataFrame) -> DataFrame:
    """(manifest, entries, hash): SHA-256 of each manifest's entries in order, joined by line feeds."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda e: e["entry"])
    return entries.groupBy("manifest").agg(F.count("*").alias("entries"), F.sha2(F.array_join(listed, "\n").cast("binary"), 256).alias("hash"))


def tamper_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """(manifest, problem) of manifests that changed, are missing or are new."""
    both = old.select("manifest", F.col("hash").alias("was")).join(new.select("manifest", F.col("hash").alias("now")), "manifest", "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return both.select("manifest", problem.alias("problem")).where("problem is not null")


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """(grp, root): SHA-256 tree over leaves(grp, pos, hash) with hex hashes and positions 0, 1, 2, ... in each group.

    A level halves every group's rows by one aggregation, so no group is ever
    in one task; an odd last hash is paired with itself. No leaves, no root.
    """
    longest = leaves.agg(F.max("pos")).first()[0] or 0
    level = leaves.join(leaves.groupBy("grp").agg(F.max("pos").alias("last")), "grp")
    for _ in range(int(longest).bit_length()):
        up = level.groupBy("grp", F.floor(F.col("pos") / 2).alias("pos")).agg(F.min_by("hash", "pos").alias("l"), F.max_by("hash", "pos").alias("r"), F.first("last").alias("last"))
        paired = F.sha2(F.concat(F.unhex("l"), F.unhex("r")), 256)
        level = up.select("grp", "pos", F.when(F.col("last") > 0, paired).otherwise(F.col("l")).alias("hash"), F.floor(F.col("last") / 2).alias("last"))
    return level.select("grp", F.col("hash").alias("root"))


def presence(cursors: DataFrame, stale: str = "30 seconds") -> DataFrame:
    """(doc, actor, ts, x, y): each actor's latest of cursors(doc, actor, ts, x, y), those within ``stale`` of the document's latest."""
    last = cursors.groupBy("doc", "actor").agg(F.max(F.struct("ts", "x", "y")).alias("at"))
    newest = last.groupBy("doc").agg(F.max("at.ts").alias("newest"))
    return last.join(newest, "doc").where(F.col("at.ts") >= F.col("newest") - F.expr(f"interval {stale}")).select("doc", "actor", "at.*")


def polygon_vertices(ops: DataFrame) -> DataFrame:
    """(doc, vertex, after, stamp, place, gone): what ops(doc, kind, vertex, after, x, y, ts, actor) say of each vertex, in whatever order and however often they come.

    The earliest insert with coordinates, by struct(ts, actor), makes a vertex: ``after`` and ``stamp`` are its.
    ``place``, struct(stamp, x, y), is the latest of that insert and of the moves;
    ``gone`` says that a delete named it.  Minima and maxima, so the same plan
    serves a stream (update or complete mode) with state of one row for each vertex.
    """
    stamp, at = F.struct("ts", "actor"), F.struct(F.struct("ts", "actor").alias("stamp"), "x", "y")
    put = F.col("x").isNotNull() & F.col("y").isNotNull()
    return ops.groupBy("doc", "vertex").agg(
        F.min(F.when((F.col("kind") == "insert") & put, F.struct(stamp.alias("stamp"), "x", "y", "after"))).alias("made"),
        F.max(F.when((F.col("kind") == "move") & put, at)).alias("moved"),
        F.coalesce(F.max(F.col("kind") == "delete"), F.lit(False)).alias("gone"),
    ).select("doc", "vertex", "made.after", "made.stamp", F.when(F.col("moved.stamp") > F.col("made.stamp"), F.col("moved")).otherwise(F.struct("made.stamp", "made.x", "made.y")).alias("place"), "gone")


def ring_order(vertices: DataFrame) -> DataFrame:
    """(doc, pos, vertex, x, y): the visible vertices of polygon_vertices() in ring order, pos 0, 1, 2, ...

    Inserts are a forest: each hangs on the vertex it names in ``after``, those on
    one vertex by (stamp, vertex), later ones further from it; without an
    anchor that was made before it, it goes to the end of the ring.  Deleted
    vertices keep their place but aren't shown.  The forest is walked as a
    list of entries and exits whose places are found by doubling, in log turns:
    a polygon of many operations is many rows in every step.
    """
    vertices = written(vertices, "vertices")  # read thrice, and aggregated in tasks of its own
    made = vertices.where("stamp is not null")
    anchors = made.select("doc", F.col("vertex").alias("after"), F.col("stamp").alias("older"))
    hung = made.join(anchors, ["doc", "after"], "left").select("doc", "vertex", "stamp", F.when(F.col("older") < F.col("stamp"), F.col("after")).alias("parent"))
    siblings = Window.partitionBy("doc", "parent").orderBy("stamp", "vertex")
    hung = hung.withColumn("before", F.lag("vertex").over(siblings))
    last = hung.where("parent is not null").groupBy("doc", F.col("parent").alias("vertex")).agg(F.max_by("vertex", F.struct("stamp", "vertex")).alias("last"))
    walk = hung.join(last, ["doc", "vertex"], "left")
    step = lambda v, out: F.struct("doc", F.col(v).alias("vertex"), F.lit(out).alias("out"))
    link = lambda out, prev: F.struct(step("vertex", out).alias("id"), prev.alias("prev"))
    enter = link(False, F.when(F.col("before").isNotNull(), step("before", True)).when(F.col("parent").isNotNull(), step("parent", False)))
    leave = link(True, F.when(F.col("last").isNotNull(), step("last", True)).otherwise(step("vertex", False)))
    steps = walk.select(F.explode(F.array(enter, leave)).alias("s")).select("s.*")
    ranked = places(steps, heads=False).where("not id.out").select("id.doc", "id.vertex", F.col("place").alias("at"))
    shown = ranked.join(vertices.where("not gone"), ["doc", "vertex"])
    return shown.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1).alias("pos"), "vertex", "place.x", "place.y")


def replay_geometry(ops: DataFrame) -> DataFrame:
    """(doc, pos, vertex, x, y): the polygons that the operations ops(doc, kind, vertex, after, x, y, ts, actor) leave, their order and repetition being no matter.

    Operations of other kinds, inserts and moves without coordinates, and moves and
    deletes of vertices that were never made change nothing.
    """
    return ring_order(polygon_vertices(ops))


def presence_events(cursors: DataFrame, stale: str = "30 seconds") -> DataFrame:
    """(doc, actor, event, ts): when each actor of cursors(doc, actor, ts) joined and left a document.

    An actor joins with a cursor that follows none, or one more than ``stale``
    ago, and leaves ``stale`` after the last one before such a gap or the end.
    """
    of = Window.partitionBy("doc", "actor").orderBy("ts")
    over = F.col("ts") + F.expr(f"interval {stale}")
    rows = cursors.where("ts is not null").select("doc", "actor", F.col("ts").cast("timestamp").alias("ts")).withColumns({"before": F.lag(over).over(of), "next": F.lead("ts").over(of), "over": over})
    join, leave = F.col("before").isNull() | (F.col("ts") > F.col("before")), F.col("next").isNull() | (F.col("next") > F.col("over"))
    both = F.array_compact(F.array(F.when(join, F.struct(F.lit("join").alias("event"), "ts")), F.when(leave, F.struct(F.lit("leave").alias("event"), F.col("over").alias("ts")))))
    return rows.select("doc", "actor", F.explode(both).alias("e")).select("doc", "actor", "e.event", "e.ts")
