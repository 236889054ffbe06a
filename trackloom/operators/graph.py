"""The temporal graph and commands on it (A14, A16, section 2.10): nodes, edges, decisions.

Edges hold from ``valid_from`` until ``valid_to`` (null: still).  Commands are appended
rows; states are derived, so that any instant can be shown and any decision undone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.joins import written


def as_of(edges: DataFrame, t: int) -> DataFrame:
    """The edges that hold at ``t``."""
    return edges.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def family(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (root, id): each root and all that were merged into it, over merges at any time.

    Merges may form cycles over time, so each round adds only what is new.
    """
    merges = edges.where("kind = 'MERGED_INTO'").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    found = written(roots.select("root", F.col("root").alias("id")).distinct())
    new = found
    while True:
        met = new.join(merges, F.col("id") == F.col("parent")).select("root", F.col("child").alias("id")).distinct()
        new = written(met.join(found, ["root", "id"], "left_anti"))
        if not new.limit(1).count():
            return found
        found = written(found.union(new))


def explain(edges: DataFrame, decisions: DataFrame, roots: DataFrame) -> DataFrame:
    """Every edge that touches a root's family, with the decision that made it, oldest first."""
    own = family(edges, roots)
    touching = own.join(edges, F.col("id") == F.col("src")).union(own.join(edges, F.col("id") == F.col("dst")))
    cols = ["edge_id", "kind", "src", "dst", "valid_from", "valid_to", "decision_id"]
    return touching.select("root", *cols).distinct().join(decisions, "decision_id", "left").orderBy("root", "valid_from", "edge_id")


def undo(edges: DataFrame, decision: DataFrame, at: int) -> DataFrame:
    """The edges after ``decision`` (decision_id) is undone at ``at``: what it opened and still
    holds is closed, what it closed is opened again as a new edge."""
    ids = decision.select("decision_id")
    opened = edges.join(ids, "decision_id", "left_semi").select("edge_id", F.lit(True).alias("_opened"))
    marked = edges.join(opened, "edge_id", "left")
    closed_now = F.col("_opened") & F.col("valid_to").isNull()
    kept = marked.withColumn("valid_to", F.when(closed_now, F.lit(at)).otherwise(F.col("valid_to"))).drop("_opened")
    again = edges.join(ids.withColumnRenamed("decision_id", "ended_by"), "ended_by", "left_semi")
    again = again.withColumns({"edge_id": -F.col("edge_id"), "valid_from": F.lit(at).cast("long"), "valid_to": F.lit(None).cast("long"), "ended_by": F.lit(None).cast("long")})
    return kept.unionByName(again)


def undo_blockers(decisions: DataFrame, touched: DataFrame) -> DataFrame:
    """Decisions of people that stand in the way of an undo: later ones on the same nodes.

    ``touched``: (decision_id, node); ``decisions``: (decision_id, at, human).
    """
    both = touched.join(decisions, "decision_id")
    later = both.select(F.col("node"), F.col("at").alias("later_at"), F.col("decision_id").alias("blocker"), F.col("human").alias("by_human"))
    return both.join(later, "node").where("by_human and later_at > at").groupBy("decision_id").agg(F.min("blocker").alias("blocker"), F.count_distinct("blocker").alias("blockers"))


def merge(edges: DataFrame, kept: str, gone: str, decision_id: int, at: int, next_id: int) -> DataFrame:
    """``gone`` ends, its contributors belong to ``kept`` from ``at`` on, and the merge is an edge."""
    live = F.col("valid_to").isNull() & (F.col("kind") == "CONTRIBUTES_TO") & (F.col("dst") == gone)
    moved = edges.where(live).withColumns({"edge_id": F.col("edge_id") + next_id, "dst": F.lit(kept), "valid_from": F.lit(at).cast("long"), "decision_id": F.lit(decision_id).cast("long")})
    ended = edges.withColumns({"ended_by": F.when(live, F.lit(decision_id)).otherwise(F.col("ended_by")).cast("long"), "valid_to": F.when(live, F.lit(at)).otherwise(F.col("valid_to")).cast("long")})
    link = edges.sparkSession.createDataFrame([(next_id, "MERGED_INTO", gone, kept, at, None, decision_id, None)], edges.select("edge_id", "kind", "src", "dst", "valid_from", "valid_to", "decision_id", "ended_by").schema)
    return ended.unionByName(moved).unionByName(link)
