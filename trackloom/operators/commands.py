"""Commands of track managers as a log (section 2.10): what each sets, which undos hold, what follows.

A command sets slots of the graph: a source's track, or whether two nodes are paired, kept
apart, or member and group.  The log is never rewritten: an undo is a row of it, and the
edges are derived, with the time and the decision that opened and ended each.

Undos depend on earlier undos (of what stands in their way), so verdicts are found in
rounds, each a join of all that is still open; their number is the depth to which undos
wait for one another, not the length of the log.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.joins import written

#: What a command does to an edge from each of its subjects to its object (fixed values): kind, and whether it opens it.
EFFECTS = {
    "merge": ("REPORTS_FOR", True),
    "split": ("REPORTS_FOR", True),
    "delete_track": ("REPORTS_FOR", False),
    "pair_tracks": ("PAIRED_WITH", True),
    "unpair_tracks": ("PAIRED_WITH", False),
    "do_not_pair": ("DO_NOT_PAIR", True),
    "accept": ("DO_NOT_PAIR", False),
    "create_group": ("MEMBER_OF", True),
    "group_members": ("MEMBER_OF", True),
    "dissolve_group": ("MEMBER_OF", False),
}
#: Accepting a proposal is the one command that cannot be undone.
UNDOABLE = sorted(set(EFFECTS) - {"accept"})
AUTOMATIC = ("engine", "system")


def effects(commands: DataFrame) -> DataFrame:
    """Rows (decision_id, slot, value, src, dst): what each command sets, one row a slot.

    ``commands`` (decision_id, at, actor, op, subjects, object, undoes, with_decision).  The
    slot of a source is its track, so that a source which reports for one ends with the
    other; every other edge is a slot of its own, open or not, without direction where it is
    between equals.  Unknown ops, null subjects and null objects set nothing.
    """
    kind = F.create_map(*map(F.lit, chain.from_iterable((op, k) for op, (k, _) in EFFECTS.items())))[F.col("op")]
    opens = F.create_map(*map(F.lit, chain.from_iterable((op, o) for op, (_, o) in EFFECTS.items())))[F.col("op")]
    each = commands.where(kind.isNotNull()).withColumns({"kind": kind, "opens": opens, "subject": F.explode("subjects")}).where("subject is not null and object is not null")
    mutual = F.col("kind").isin("PAIRED_WITH", "DO_NOT_PAIR")
    each = each.withColumns({"src": F.when(mutual, F.least("subject", "object")).otherwise(F.col("subject")), "dst": F.when(mutual, F.greatest("subject", "object")).otherwise(F.col("object"))})
    slot = F.when(F.col("kind") == "REPORTS_FOR", F.struct("kind", "src", F.lit("").alias("to"))).otherwise(F.struct("kind", "src", F.col("dst").alias("to")))
    return each.groupBy("decision_id", slot.alias("slot")).agg(F.max(F.when(F.col("opens"), F.col("dst"))).alias("value"), F.max("src").alias("src"), F.max("dst").alias("dst"))


def _covers(commands: DataFrame) -> DataFrame:
    """Rows (u, x): undo u and the decisions that it names, a decision and those made with it."""
    undos = commands.where("op = 'undo'").select(F.col("decision_id").alias("u"), F.col("undoes").alias("d"))
    named = commands.where("op <> 'undo'").select(F.col("decision_id").alias("x"), F.explode(F.array_compact(F.array_distinct(F.array("decision_id", "with_decision")))).alias("d"))
    return undos.join(named, "d").where("x < u").select("u", "x")


def undo_verdicts(commands: DataFrame) -> DataFrame:
    """Rows (decision_id, undoes, verdict, blocker), one for each undo.

    ``unknown``: no earlier decision of that number; ``not undoable``: its op, or the engine's
    own; ``undone already``; ``changed since``: a person's later decision, not undone by
    then, touches a node that it or those made with it touch, and ``blocker`` is the first
    such; else ``undone``.  The engine's decisions never stand in the way.
    """
    made = commands.select(F.col("decision_id").alias("d"), F.col("op").alias("d_op"), F.col("actor").alias("d_actor"))
    undos = commands.where("op = 'undo'").select(F.col("decision_id").alias("u"), F.col("undoes").alias("d")).join(made, "d", "left")
    known = F.col("d_op").isNotNull() & (F.col("d") < F.col("u"))
    barred = ~F.col("d_op").isin(UNDOABLE) | F.col("d_actor").isin(*AUTOMATIC)
    undos = written(undos.select("u", "d", F.when(~F.coalesce(known, F.lit(False)), "unknown").when(barred, "not undoable").alias("verdict")))
    covers = written(_covers(commands))
    touched = effects(commands).select(F.col("decision_id").alias("x"), F.explode(F.array("src", "dst")).alias("node")).distinct()
    touched = written(touched.join(commands.select(F.col("decision_id").alias("x"), F.col("actor").isin(*AUTOMATIC).alias("own")), "x"))

    asked = undos.where("verdict is null").select("u", "d")
    nodes = asked.join(covers, "u").join(touched, "x").select("u", "d", "node").distinct()
    later = nodes.join(touched.where("not coalesce(own, false)"), "node").where("x > d and x < u").select("u", "x").distinct()
    others = later.join(covers, ["u", "x"], "left_anti").withColumn("target", F.lit(False))
    stand = others.union(asked.select("u", F.col("d").alias("x"), F.lit(True)))
    # Each decision that matters to an undo, and the earlier undos that name it.
    waits = written(stand.join(covers.withColumnRenamed("u", "by"), "x", "left").select("u", "x", "target", F.when(F.col("by") < F.col("u"), F.col("by")).alias("by")).distinct())

    decided = written(undos.where("verdict is not null").select("u", "verdict", F.lit(None).cast("long").alias("blocker")))
    while True:
        heard = waits.join(decided.select("u"), "u", "left_anti").join(decided.select(F.col("u").alias("by"), (F.col("verdict") == "undone").alias("held")), "by", "left")
        by_x = heard.groupBy("u", "x", "target").agg(F.bool_or(F.col("by").isNotNull() & F.col("held").isNull()).alias("open"), F.coalesce(F.bool_or("held"), F.lit(False)).alias("gone"))
        told = by_x.groupBy("u").agg(F.bool_or("open").alias("open"), F.bool_or(F.col("target") & F.col("gone")).alias("again"), F.min(F.when(~F.col("target") & ~F.col("gone"), F.col("x"))).alias("blocker"))
        verdict = F.when(F.col("again"), "undone already").when(F.col("blocker").isNotNull(), "changed since").otherwise("undone")
        new = written(told.where("not open").select("u", verdict.alias("verdict"), F.when(~F.col("again"), F.col("blocker")).alias("blocker")))
        if new.isEmpty():
            break
        decided = written(decided.union(new))
    return decided.join(undos.select("u", "d"), "u").select(F.col("u").alias("decision_id"), F.col("d").alias("undoes"), "verdict", "blocker")


def edges(commands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (kind, src, dst, valid_from, valid_to, decision_id, ended_by): the edges of the log.

    A decision that was undone gives each slot back what it held before it; a slot that held
    nothing before is emptied, unless the engine has set it since.  Setting what a slot
    holds already changes nothing.
    """
    made = commands.select("decision_id", "at", F.coalesce(F.col("actor").isin(*AUTOMATIC), F.lit(False)).alias("own"))
    sets = effects(commands).select("slot", F.col("decision_id").alias("id"), "value", F.lit(None).cast("long").alias("target"))
    held = _covers(commands).join(verdicts.where("verdict = 'undone'").select(F.col("decision_id").alias("u")), "u").groupBy("x").agg(F.min("u").alias("u"))
    backs = sets.join(held, F.col("id") == F.col("x")).groupBy("slot", "u").agg(F.min("x").alias("target")).select("slot", F.col("u").alias("id"), F.lit(None).cast("string").alias("value"), "target")
    rows = sets.union(backs).join(made.withColumnRenamed("decision_id", "id"), "id")
    order = Window.partitionBy("slot").orderBy("id")
    engine = F.last(F.when(F.col("own") & F.col("target").isNull(), F.col("id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = written(rows.withColumns({"prev": F.lag("id").over(order), "engine": engine}))

    before = rows.where("target is null").select("slot", F.col("id").alias("target"), F.col("prev").alias("before"))
    undone = rows.where("target is not null").select("slot", "id", "target", "engine").join(before, ["slot", "target"])
    points = written(undone.select("slot", "id", F.coalesce("before", F.when(F.col("engine") > F.col("target"), F.col("engine"))).alias("to")))
    # What was held before an undone decision may itself be what an undo gave back: follow, two steps at a time.
    while not points.join(points.select("slot", F.col("id").alias("to")), ["slot", "to"], "left_semi").isEmpty():
        ahead = points.select("slot", F.col("id").alias("to"), F.col("to").alias("then"), F.lit(True).alias("more"))
        points = written(points.join(ahead, ["slot", "to"], "left").select("slot", "id", F.when(F.col("more"), F.col("then")).otherwise(F.col("to")).alias("to")))

    values = rows.where("target is null").select("slot", F.col("id").alias("to"), F.col("value").alias("then"))
    given = points.join(values, ["slot", "to"], "left").select("slot", "id", F.col("then"))
    rows = rows.join(given, ["slot", "id"], "left").select("slot", "id", "at", F.when(F.col("target").isNull(), F.col("value")).otherwise(F.col("then")).alias("value"))
    changed = rows.withColumn("last", F.lag("value").over(order)).where("not (value <=> last)")
    ends = changed.withColumns({"valid_to": F.lead("at").over(order), "ended_by": F.lead("id").over(order)}).where("value is not null")
    return ends.select("slot.kind", "slot.src", F.col("value").alias("dst"), F.col("at").alias("valid_from"), "valid_to", F.col("id").alias("decision_id"), "ended_by")


def track_states(edges: DataFrame) -> DataFrame:
    """Rows (track, sources, retired_at): tracks with a source are live, those that the last has left retired then."""
    reports = edges.where("kind = 'REPORTS_FOR'")
    states = reports.groupBy(F.col("dst").alias("track")).agg(F.count_if(F.col("valid_to").isNull()).alias("sources"), F.max("valid_to").alias("last"))
    return states.select("track", "sources", F.when(F.col("sources") == 0, F.col("last")).alias("retired_at"))
