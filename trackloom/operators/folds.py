"""Sequential folds, in batch and as streams.

A fold is a pair of plain functions: ``step(state, row)`` returns the new state and the
rows that it emits.  In batch each key's rows reach it in order; in a stream the state is
kept between micro-batches by ``applyInPandasWithState`` (see ``streaming``).

Batch folds shuffle once by key and sort on the JVM, so a task streams its keys one after
the other and holds one batch of rows and one state; a hot key is long but not large.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.geo import EARTH_RADIUS_M

Row = dict[str, Any]


@dataclass(frozen=True)
class Fold:
    """``init()`` makes a state; ``step(state, row)`` gives (state, emitted rows); ``end``
    what a key emits after its last row in batch.  A fold that only lets rows through names
    in ``reads`` the columns that it needs: in batch no others become Python objects."""

    init: Callable[[], Any]
    step: Callable[[Any, Row], tuple[Any, list[Row]]]
    schema: str
    end: Callable[[Any], list[Row]] | None = None
    reads: tuple[str, ...] = ()


def run(df: DataFrame, fold: Fold, keys: list[str], order: list[str], *, heavy: bool = False) -> DataFrame:
    """The rows that ``fold`` emits.  ``heavy``: its steps cost far more than their rows weigh, so the number
    of parts is named, which keeps adaptive execution from making it smaller."""
    schema = T._parse_datatype_string(fold.schema)
    names = [f.name for f in schema.fields]

    def out(rows: list[Row]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=to_arrow_schema(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            made: list[Row] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    if at is not None and fold.end:
                        made += fold.end(state)
                    at, state = key, fold.init()
                state, emitted = fold.step(state, row)
                made += emitted
            if made:
                yield out(made)
        if at is not None and fold.end and (rest := fold.end(state)):
            yield out(rest)

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in fold.reads]
            taken: list[int] = []
            for i, (key, values) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*columns, strict=True), strict=True)):
                if key != at:
                    at, state = key, fold.init()
                state, emitted = fold.step(state, dict(zip(fold.reads, values, strict=True)))
                if emitted:
                    taken.append(i)
            if taken:
                yield batch.select(names).take(pa.array(taken))

    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if heavy else df.repartition(*keys)
    arranged = dealt.sortWithinPartitions(*keys, *order)
    if fold.reads:
        return arranged.select(*dict.fromkeys([*names, *keys, *fold.reads])).mapInArrow(let_through, schema)
    return arranged.mapInArrow(work, schema)


def throttle(schema: str, *, min_interval_us: int, heartbeat_us: int = 600_000_000, min_move_m: float = 0.0, time: str = "t_us", changes: tuple[str, ...] = ()) -> Fold:
    """Reports let through (T1): the first, those ``heartbeat`` after the last, and those at
    least ``min_interval`` after it that moved far enough or whose statics changed; ``changes``
    is ("changed",) where rows have such a column."""

    def step(state: Row | None, row: Row):
        if state is not None:
            dt = row[time] - state["t"]
            moved = math.hypot((row["lon"] - state["lon"]) * math.cos(math.radians((row["lat"] + state["lat"]) / 2)), row["lat"] - state["lat"]) * 111_320.0
            changed = state["pending"] or bool(row.get("changed"))
            if dt < min_interval_us or (dt < heartbeat_us and moved < min_move_m and not changed):
                return state | {"pending": changed}, []
        return {"t": row[time], "lat": row["lat"], "lon": row["lon"], "pending": False}, [row]

    return Fold(lambda: None, step, schema, reads=(time, "lat", "lon", *changes))


def gap_filter(schema: str, *, least_us: int, time: str = "t_us") -> Fold:
    """Points at least ``least_us`` after the last one kept; a point of the same time replaces it."""

    def step(state, row: Row):
        if state is None:
            return row, []
        if row[time] == state[time]:
            return row, []
        if row[time] - state[time] < least_us:
            return state, []
        return row, [state]

    return Fold(lambda: None, step, schema, end=lambda s: [s] if s else [])


#: Seconds after which a track without reports is lost, by domain (fixed values).
LOST_AFTER_S = {"air": 60, "space": 60, "surface": 900, "subsurface": 1800}
LOST_AFTER_OTHER_S = 900
DROP_AFTER_S = 6 * 3600


def lifecycle(*, confirm_after: int = 3, time: str = "t_us") -> Fold:
    """State changes of a track (T14, T15): tentative, confirmed after some reports, lost and
    dropped by silence; rows (track, t_us, state), times in event time."""

    def silent(state: Row, until: int) -> list[Row]:
        out = []
        lost = state["t"] + LOST_AFTER_S.get(state["domain"], LOST_AFTER_OTHER_S) * 1_000_000
        drop = state["t"] + DROP_AFTER_S * 1_000_000
        if until >= lost:
            out.append({"track": state["track"], "t_us": lost, "state": "lost"})
        if until >= drop:
            out.append({"track": state["track"], "t_us": drop, "state": "dropped"})
        return out

    def step(state: Row | None, row: Row):
        made: list[Row] = []
        if state is not None:
            if row[time] < state["t"]:  # late reports are left out
                return state, []
            made = silent(state, row[time])
            if len(made) == 2:
                state = None
        n = (state["n"] if state else 0) + 1
        now = "confirmed" if n >= confirm_after else "tentative"
        before = made[-1]["state"] if made else state["state"] if state else None
        if now != before:
            made.append({"track": row["track"], "t_us": row[time], "state": now})
        return {"track": row["track"], "t": row[time], "n": n, "domain": row["domain"], "state": now}, made

    return Fold(lambda: None, step, "track string, t_us long, state string")


def coalesce_writes(schema: str, *, gap_us: int = 5_000_000, time: str = "t_us") -> Fold:
    """At most one message in ``gap_us``, the latest; urgent ones at once (T21).  A message
    held back goes out when its gap ends, at ``published_us``."""

    def step(state: Row | None, row: Row):
        state = state or {"last": None, "held": None}
        made = []
        due = None if state["last"] is None else state["last"] + gap_us
        if state["held"] is not None and row[time] >= due:
            made.append(state["held"] | {"published_us": due})
            state = {"last": due, "held": None}
            due += gap_us
        if due is None or row[time] >= due or row["urgent"]:
            made.append(row | {"published_us": row[time]})
            return {"last": row[time], "held": None}, made
        return state | {"held": row}, made

    def end(state: Row | None) -> list[Row]:
        return [state["held"] | {"published_us": state["last"] + gap_us}] if state and state["held"] else []

    return Fold(lambda: None, step, schema, end)


class Tally:
    """The comparisons of a pair that count: the last ``n``, none older than the window."""

    def __init__(self, n: int):
        self.counted: deque[tuple[int, float, bool]] = deque(maxlen=n)
        self.newest = {True: -math.inf, False: -math.inf}

    def share(self, t: int, by_a: bool, other_us: int, weight: float | None, least_us: int, reuse_us: int) -> float:
        """1 for new reports of both tracks, ``weight`` where the other's counted before, 0 if not at all."""
        since = t - self.counted[-1][0] if self.counted else math.inf
        if since < least_us or t <= self.newest[by_a]:
            return 0.0
        if other_us > self.newest[not by_a]:
            return 1.0
        return min(1.0, weight or 0.0) if since >= reuse_us else 0.0

    def add(self, t: int, by_a: bool, other_us: int, value: float, outside: bool, window_us: int) -> tuple[float, int, int]:
        self.newest[by_a], self.newest[not by_a] = t, other_us
        self.counted.append((t, value, outside))
        while self.counted[0][0] < t - window_us:
            self.counted.popleft()
        return math.fsum(x[1] for x in self.counted), len(self.counted), sum(x[2] for x in self.counted)


def evidence(df: DataFrame, keys: list[str], order: list[str], *, n: int = 5, window_us: int = 30_000_000, least_us: int = 3_000_000, reuse_us: int = 10_000_000) -> DataFrame:
    """The running sum of each pair's last comparisons (K14): the rows of ``df`` that count,
    with sum_ln_lr, comparisons and n_outside.

    Columns: t_us, side ("a" or "b": which track reported), other_us (the time of the other
    side's report), ln_lr, weight, outside; ``order`` begins with t_us.  A comparison counts
    if it is ``least_us`` after the last one and its side's report is newer than any counted;
    if the other side's report is not, it counts by ``weight``, and only ``reuse_us`` after.
    """
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("sum_ln_lr double, comparisons long, n_outside long").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, tally = None, Tally(n)
        for batch in batches:
            pairs = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            columns = [batch.column(c).to_pylist() for c in ("t_us", "side", "other_us", "ln_lr", "weight", "outside")]
            taken, sums = [], []
            for i, (t, side, other_us, ln_lr, weight, outside) in enumerate(zip(*columns, strict=True)):
                if pairs[i] != pair:
                    pair, tally = pairs[i], Tally(n)
                share = tally.share(t, side == "a", other_us, weight, least_us, reuse_us)
                if share > 0:
                    taken.append(i)
                    sums.append(tally.add(t, side == "a", other_us, ln_lr * share, bool(outside), window_us))
            if taken:
                made = [pa.array(c, kind) for c, kind in zip(zip(*sums, strict=True), (pa.float64(), pa.int64(), pa.int64()), strict=True)]
                kept = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


def lifecycle_changes(df: DataFrame, *, confirm_after: int = 3) -> DataFrame:
    """What ``lifecycle`` tells of reports (track, t_us, event_id, domain) in batch: rows (track, t_us, state)."""
    w = Window.partitionBy("track").orderBy("t_us", "event_id")
    silence = F.lit(LOST_AFTER_OTHER_S)
    for domain, seconds in LOST_AFTER_S.items():
        silence = F.when(F.col("domain") == domain, seconds).otherwise(silence)
    rows = df.withColumns({"before": F.lag("t_us").over(w), "lost": F.lag(silence * 1_000_000).over(w) + F.lag("t_us").over(w), "gone": F.lag("t_us").over(w) + DROP_AFTER_S * 1_000_000})
    rows = rows.withColumns({"was_lost": F.coalesce(F.col("t_us") >= F.col("lost"), F.lit(False)), "was_gone": F.coalesce(F.col("t_us") >= F.col("gone"), F.lit(False))})
    rows = rows.withColumn("life", F.sum(F.col("was_gone").cast("int")).over(w))
    number = F.row_number().over(Window.partitionBy("track", "life").orderBy("t_us", "event_id"))
    rows = rows.withColumn("now", F.when(number >= confirm_after, "confirmed").otherwise("tentative"))
    new = F.col("was_lost") | F.col("was_gone") | F.lag("now").over(w).isNull() | (F.lag("now").over(w) != F.col("now"))
    step = lambda test, at, state: F.when(test, F.struct(at.alias("t_us"), state.alias("state")))
    rows = rows.withColumn("new", new)
    made = F.array_compact(F.array(step(F.col("was_lost"), F.col("lost"), F.lit("lost")), step(F.col("was_gone"), F.col("gone"), F.lit("dropped")), step(F.col("new"), F.col("t_us"), F.col("now"))))
    return rows.select("track", F.inline(made))


def send_rule(schema: str, *, heartbeat_us: int = 12_000_000, time: str = "t_us") -> Fold:
    """Reports sent to peers (T22): the first, a change of state, after the heartbeat, and
    where what the peers reckon from the last one is off by more than is allowed: 200 m (air,
    space) or 50 m, or the report's own error if that is greater."""

    def off_by(sent: Row, row: Row) -> float:
        """Metres between the report and the last one carried on to its time."""
        lat, lon = math.radians(sent["lat"]), math.radians(sent["lon"])
        if sent["course"] is not None and sent["speed"] is not None:
            way = sent["speed"] * max(0.0, (row[time] - sent[time]) / 1e6) / EARTH_RADIUS_M
            course = math.radians(sent["course"])
            lon += way * math.sin(course) / max(math.cos(lat), 1e-6)
            lat += way * math.cos(course)
        north, east = math.radians(row["lat"]) - lat, math.radians(row["lon"]) - lon
        return EARTH_RADIUS_M * math.hypot(north, east * math.cos((math.radians(row["lat"]) + lat) / 2))

    def step(sent: Row | None, row: Row):
        if sent is not None and row["state"] == sent["state"] and row[time] - sent[time] < heartbeat_us:
            error = row["error_m"] if row["error_m"] is not None and math.isfinite(row["error_m"]) else 0.0
            if off_by(sent, row) <= max(200.0 if row["domain"] in ("air", "space") else 50.0, error):
                return sent, []
        return row, [row]

    return Fold(lambda: None, step, schema, reads=(time, "lat", "lon", "course", "speed", "domain", "error_m", "state"))
