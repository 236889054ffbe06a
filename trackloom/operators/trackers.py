"""Forming tracks from detections (T2-T8, T13): scans, clustering, Kalman filter, assignment.

A tracker is a fold over scans: the filters of all its tracks are stacked in arrays, one
scan at a time.  Tracks that compete for no plot do not know of each other, so a source is
split into regions: plots and tracks that gates connect.  Which these are depends on the
tracks, so regions are first guessed, then every gate of every track is held against the
plots of other regions; those that it reaches are joined and folded again, until none is
reached.  The tracks are then the same as of one fold over the whole source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import joins
from trackloom.operators.folds import Fold, run

METRES = 111_320.0


@dataclass(frozen=True)
class Tuning:
    """Defaults of a tracker (fixed values)."""

    sigma_m: float = 10.0
    accel: float = 0.5
    speed0: float = 5.0
    gate: float = 13.8
    lifetime_s: float = 600.0
    confirm_p: float = 0.95
    drop_p: float = 0.02
    detect_p: float = 0.9
    clutter: float = 1e-6
    birth: float = 1e-7
    cluster_m: float = 0.0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of least total cost, each row and column at most once (shortest
    augmenting paths with potentials)."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in assign(cost.T)]
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        i, j = row, -1
        while True:
            reduced = cost[i] - u[i] - v
            better = ~used & (reduced < least)
            least[better], back[better] = reduced[better], j
            free = np.where(used, np.inf, least)
            to = int(np.argmin(free))
            step = free[to]
            u[row] += step
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            used[to] = True
            j = to
            if match[to] < 0:
                break
            i = match[to]
        while j >= 0:
            before = back[j]
            match[j] = match[before] if before >= 0 else row
            j = before
    return sorted((int(i), j) for j, i in enumerate(match) if i >= 0)


@dataclass
class Track:
    key: str
    x: np.ndarray
    p: np.ndarray
    exists: float
    hits: int = 1
    confirmed: bool = False
    seen: float = 0.0


@dataclass
class Stack:
    """The tracks of one fold, a row each: states (north, east and their speeds) and the
    covariance that both axes share, as (position, cross, speed)."""

    key: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=object))
    x: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    p: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    exists: np.ndarray = field(default_factory=lambda: np.zeros(0))
    confirmed: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))

    def __len__(self) -> int:
        return len(self.key)

    def predict(self, dt: float, tune: Tuning) -> None:
        self.x[:, :2] += dt * self.x[:, 2:]
        p, q = self.p, tune.accel**2
        p[:, 0] += dt * (2 * p[:, 1] + dt * p[:, 2]) + q * dt**4 / 4
        p[:, 1] += dt * p[:, 2] + q * dt**3 / 2
        p[:, 2] += q * dt**2
        self.exists *= math.exp(-dt / tune.lifetime_s)

    def update(self, i: np.ndarray, z: np.ndarray, var: np.ndarray) -> None:
        """Rows ``i`` with their plots."""
        s = self.p[i, 0] + var
        gain, cross = self.p[i, 0] / s, self.p[i, 1] / s
        y = z - self.x[i, :2]
        self.x[i, :2] += gain[:, None] * y
        self.x[i, 2:] += cross[:, None] * y
        self.p[i, 2] -= cross * self.p[i, 1]
        self.p[i, 1] *= 1 - gain
        self.p[i, 0] *= 1 - gain

    def keep(self, rows: np.ndarray) -> None:
        self.key, self.x, self.p, self.exists, self.confirmed = self.key[rows], self.x[rows], self.p[rows], self.exists[rows], self.confirmed[rows]

    def add(self, key: list[str], z: np.ndarray, var: np.ndarray, tune: Tuning) -> None:
        n = len(key)
        self.key = np.concatenate([self.key, np.array(key, dtype=object)])
        self.x = np.concatenate([self.x, np.concatenate([z, np.zeros((n, 2))], axis=1)])
        self.p = np.concatenate([self.p, np.stack([var, np.zeros(n), np.full(n, tune.speed0**2)], axis=1)])
        self.exists = np.concatenate([self.exists, np.full(n, tune.birth / (tune.birth + tune.clutter))])
        self.confirmed = np.concatenate([self.confirmed, np.zeros(n, dtype=bool)])


@dataclass
class State:
    t: float | None = None
    tracks: Stack = field(default_factory=Stack)
    rows: list = field(default_factory=list)
    late: int = 0


def clustered(z: np.ndarray, r: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Plots closer than ``within`` become one, at the running mean, with the least variance; and of each the first plot in it."""
    out: list[list] = []
    for i, (point, var) in enumerate(zip(z, r, strict=True)):
        for c in out:
            if within > 0 and np.hypot(*(point - c[0])) < within:
                c[2] += 1
                c[0] = c[0] + (point - c[0]) / c[2]
                c[1] = min(c[1], var)
                break
        else:
            out.append([point, var, 1, i])
    return np.array([c[0] for c in out]).reshape(-1, 2), np.array([c[1] for c in out]), [c[3] for c in out]


def predict(track: Track, dt: float, tune: Tuning) -> None:
    f = np.eye(4)
    f[0, 2] = f[1, 3] = dt
    q = tune.accel**2 * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
    track.x = f @ track.x
    track.p = f @ track.p @ f.T
    for k in (0, 1):
        track.p[np.ix_([k, k + 2], [k, k + 2])] += q


def innovation(track: Track, z: np.ndarray, var: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Squared distance, ln of the determinant, residual and inverse covariance of a plot."""
    s = track.p[:2, :2] + var * np.eye(2)
    y = z - track.x[:2]
    inv = np.linalg.inv(s)
    return float(y @ inv @ y), float(math.log(np.linalg.det(s))), y, inv


def update(track: Track, y: np.ndarray, inv: np.ndarray) -> None:
    gain = track.p[:, :2] @ inv
    track.x = track.x + gain @ y
    track.p = track.p - gain @ track.p[:2, :]
    track.p = (track.p + track.p.T) / 2


def matched(cost: np.ndarray, gated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the assignment with the most gated pairs, of these the least cost.
    Pairs that compete with no other need no search; the rest is searched group by group."""
    alone = gated & (gated.sum(axis=1) == 1)[:, None] & (gated.sum(axis=0) == 1)[None, :]
    rows, cols = map(list, np.nonzero(alone))
    left = gated & ~alone
    open_ = set(np.flatnonzero(left.any(axis=1)).tolist())
    while open_:
        group, reach, to = set(), {open_.pop()}, set()
        while reach:
            i = reach.pop()
            group.add(i)
            for j in np.flatnonzero(left[i]).tolist():
                if j not in to:
                    to.add(j)
                    reach |= set(np.flatnonzero(left[:, j]).tolist()) - group
        open_ -= group
        r, c = np.array(sorted(group)), np.array(sorted(to))
        far = 1e12
        for i, j in assign(np.where(left[np.ix_(r, c)], cost[np.ix_(r, c)], far)):
            if left[r[i], c[j]]:
                rows.append(r[i])
                cols.append(c[j])
    return np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)


def scan(state: State, t: float, z: np.ndarray, var: np.ndarray, names: list[str], tune: Tuning) -> list[tuple[str, np.ndarray, float, str, int | None]]:
    """One scan: predict, assign, update or miss, start and drop; what there is to report, as
    (key, state, existence, "confirmed" or "dropped", plot)."""
    dt = 0.0 if state.t is None else t - state.t
    state.t = t
    tracks, free = state.tracks, np.ones(len(z), dtype=bool)
    if len(tracks):
        hit = np.zeros(len(tracks), dtype=bool)
        if len(z):
            s = tracks.p[:, :1] + var[None, :]
            d2 = ((z[None, :, :] - tracks.x[:, None, :2]) ** 2).sum(axis=2) / s
            rows, cols = matched(d2 + 2 * np.log(s), d2 <= tune.gate)
            if len(rows):
                order = np.argsort(rows)
                rows, cols = rows[order], cols[order]
                likelihood = np.exp(-d2[rows, cols] / 2) / s[rows, cols] / (2 * math.pi)
                e = tracks.exists[rows]
                odds = e / np.maximum(1 - e, 1e-12) * (tune.detect_p * likelihood / tune.clutter + 1 - tune.detect_p)
                tracks.exists[rows] = odds / (1 + odds)
                tracks.update(rows, z[cols], var[cols])
                tracks.confirmed[rows] |= tracks.exists[rows] >= tune.confirm_p
                hit[rows], free[cols] = True, False
        missed = tracks.exists[~hit] * (1 - tune.detect_p)
        tracks.exists[~hit] = missed / (missed + 1 - tracks.exists[~hit])
    out = []
    if len(tracks):
        plot = np.full(len(tracks), -1)
        if hit.any():
            plot[rows] = cols
        gone = tracks.exists < tune.drop_p
        out = [(tracks.key[i], tracks.x[i].copy(), float(tracks.exists[i]), "confirmed", int(plot[i])) for i in np.flatnonzero(hit & tracks.confirmed)]
        out += [(tracks.key[i], tracks.x[i].copy(), float(tracks.exists[i]), "dropped", None) for i in np.flatnonzero(gone & tracks.confirmed)]
        if gone.any():
            tracks.keep(~gone)
    if free.any():
        at = np.flatnonzero(free)
        tracks.add([names[j] for j in at], z[at], var[at], tune)
    return out


_MADE = "unit string, source_id string, track_key string, t_us long, lat double, lon double, speed double, course double, exists double, state string, plot int, north double, east double, spread double"


def tracker(tune: Tuning = Tuning(), gates: bool = False) -> Fold:
    """Rows (unit, source_id, t_us, north, east, error_m, plot, lat0, lon0), sorted by time, to
    track reports.  Rows of one time are a scan; one without plot only tells its time.  A
    track is named by the time and number of its first plot.  With ``gates`` also where each
    track looked for its plot (state "gate")."""

    def close(state: State) -> list[dict]:
        if not state.rows:
            return []
        first, state_rows = state.rows[0], [r for r in state.rows if r["plot"] is not None]
        at, lat0, lon0 = first["t_us"], first["lat0"], first["lon0"]
        east = METRES * math.cos(math.radians(lat0))
        z = np.array([[r["north"], r["east"]] for r in state_rows]).reshape(-1, 2)
        var = np.array([max(r["error_m"] or tune.sigma_m, 1e-3) ** 2 for r in state_rows])
        number = [r["plot"] for r in state_rows]
        if tune.cluster_m > 0 and len(z):
            z, var, member = clustered(z, var, tune.cluster_m)
            number = [number[i] for i in member]
        state.rows = []
        base = {"unit": first["unit"], "source_id": first["source_id"], "t_us": at}
        rows = []
        tracks = state.tracks
        if len(tracks):
            tracks.predict(at / 1e6 - state.t, tune)
            if gates:
                rows = [{**base, "track_key": k, "state": "gate", "north": x[0], "east": x[1], "spread": p} for k, x, p in zip(tracks.key, tracks.x.tolist(), tracks.p[:, 0].tolist(), strict=True)]
        for key, (n, e, vn, ve), exists, said, plot in scan(state, at / 1e6, z, var, [f"{at}.{i}" for i in number], tune):
            rows.append({**base, "track_key": key, "lat": lat0 + n / METRES, "lon": lon0 + e / east, "speed": math.hypot(vn, ve), "course": math.degrees(math.atan2(ve, vn)) % 360.0, "exists": exists, "state": said, "plot": None if plot is None else number[plot]})
        return rows

    def step(state: State, row: dict):
        made: list[dict] = []
        if state.rows and row["t_us"] != state.rows[0]["t_us"]:
            made = close(state)
        if state.t is not None and row["t_us"] / 1e6 <= state.t:
            state.late += 1
            return state, made
        state.rows.append(row)
        return state, made

    return Fold(State, step, _MADE, end=close)


_ORDER = ["t_us", "plot"]


def _misses(odds: float, tune: Tuning) -> int:
    """Scans without a plot after which a track of these odds is dropped."""
    if tune.detect_p <= 0:
        return 1 << 20
    return max(1, math.ceil(math.log(max(odds * (1 - tune.drop_p) / tune.drop_p, 1.0)) / -math.log(max(1 - tune.detect_p, 1e-12))) + 1)


def placed_plots(plots: DataFrame) -> DataFrame:
    """Plots with their number in their scan (by position), their scan's number, and metres
    north and east of the source's first plot."""
    scan_of = Window.partitionBy("source_id", "t_us").orderBy("lat", "lon")
    rows = plots.select("source_id", "t_us", "lat", "lon", F.col("error_m").cast("double").alias("error_m")).withColumn("plot", F.row_number().over(scan_of) - 1)
    first = rows.groupBy("source_id").agg(F.min(F.struct("t_us", "lat", "lon")).alias("o")).select("source_id", F.col("o.lat").alias("lat0"), F.col("o.lon").alias("lon0"))
    # The times of a source are one row each.
    times = rows.select("source_id", "t_us").distinct().withColumn("scan", F.row_number().over(Window.partitionBy("source_id").orderBy("t_us")))
    rows = rows.join(first, "source_id").join(times, ["source_id", "t_us"])
    return rows.withColumns({"north": (F.col("lat") - F.col("lat0")) * METRES, "east": (F.col("lon") - F.col("lon0")) * METRES * F.cos(F.radians("lat0")), "id": F.concat_ws("|", "source_id", "t_us", "plot")})


def form_tracks(plots: DataFrame, tune: Tuning = Tuning(), *, regions: bool = False) -> DataFrame:
    """Tracks of every source's detections: rows (source_id, track_key, t_us, lat, lon, speed,
    course, exists, state, plot).

    A source is a unit of work, which does where there are many; ``regions`` splits sources
    further, for those that hold a large share of all plots.  The tracks are the same.
    """
    names = ["source_id", "track_key", "t_us", "lat", "lon", "speed", "course", "exists", "state", "plot"]
    columns = ["unit", "source_id", "t_us", "north", "east", "error_m", "plot", "lat0", "lon0"]
    rows = joins.written(placed_plots(plots))
    if not regions:
        return run(rows.withColumn("unit", F.col("source_id")).select(*columns), tracker(tune), ["unit"], _ORDER, heavy=True).select(*names)

    variance = F.pow(F.greatest(F.coalesce("error_m", F.lit(tune.sigma_m)), F.lit(1e-3)), 2)
    widest = rows.groupBy("source_id").agg(F.max(variance).alias("widest"))
    rows = joins.written(rows.withColumn("var", variance).join(widest, "source_id"))
    # First guess: a plot and those of the next scan that a track begun with it would take.
    size = max(4 * tune.sigma_m, 50.0)
    times = rows.select("source_id", "scan", "t_us").distinct()
    coming = times.select("source_id", (F.col("scan") - 1).alias("scan"), F.col("t_us").alias("next_us"))
    begun = rows.join(coming, ["source_id", "scan"])
    dt = (F.col("next_us") - F.col("t_us")) / 1e6
    begun = begun.withColumn("spread", F.col("var") + dt * dt * tune.speed0**2 + tune.accel**2 * F.pow(dt, F.lit(4.0)) / 4)
    looks = begun.select("source_id", F.col("next_us").alias("t_us"), F.col("id").alias("of"), "north", "east", "spread", "widest")
    if tune.cluster_m > 0:
        near = rows.select("source_id", "t_us", F.col("id").alias("of"), "north", "east", F.lit(4 * tune.cluster_m**2 / tune.gate).alias("spread"), F.lit(0.0).alias("widest"))
        looks = looks.union(near)

    def reached(looks: DataFrame, seen: DataFrame) -> DataFrame:
        """Pairs (of, id): the plots of ``seen`` in the gates of ``looks``.  A gate is listed in the
        cells that it touches of a grid about as wide as itself, four or nine; a plot in one cell
        of each grid in use, of which there are as many as doublings of the narrowest gate."""
        radius = F.sqrt(tune.gate * (F.col("spread") + F.col("widest")))
        looks = joins.written(looks.withColumn("r", radius).withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.col("r") / size))).cast("int")))
        levels = sorted(r[0] for r in looks.select("level").distinct().collect())
        wide = lambda level: F.lit(size) * F.pow(F.lit(2.0), level)
        cells = lambda x: F.explode(F.sequence(F.floor((x - F.col("r")) / wide(F.col("level"))), F.floor((x + F.col("r")) / wide(F.col("level")))))
        left = looks.withColumn("cy", cells(F.col("north"))).withColumn("cx", cells(F.col("east"))).select("source_id", "t_us", "level", "cy", "cx", "of", F.col("north").alias("n"), F.col("east").alias("e"), "spread")
        right = seen.withColumn("level", F.explode(F.array(*map(F.lit, levels or [0]))))
        right = right.withColumns({"cy": F.floor(F.col("north") / wide(F.col("level"))), "cx": F.floor(F.col("east") / wide(F.col("level")))})
        away = F.pow(F.col("north") - F.col("n"), 2) + F.pow(F.col("east") - F.col("e"), 2)
        return left.join(right, ["source_id", "t_us", "level", "cy", "cx"]).where(away <= tune.gate * (F.col("spread") + F.col("var")) * (1 + 1e-9))

    guess = joins.connected(reached(looks, rows).select("of", "id").distinct(), "of", "id").withColumnRenamed("component", "unit")
    rows = joins.written(rows.join(guess, "id", "left").withColumn("unit", F.coalesce("unit", "id")))

    short, long = _misses(tune.birth / tune.clutter, tune), _misses(1e12, tune)
    done, open_ = None, rows
    while True:
        span = open_.groupBy("unit", "source_id").agg(F.min("scan").alias("a"), F.max("scan").alias("b"), F.first("lat0").alias("lat0"), F.first("lon0").alias("lon0"))
        after = F.when(F.col("a") == F.col("b"), short).otherwise(long)
        quiet = span.withColumn("scan", F.explode(F.sequence("a", F.col("b") + after))).join(times, ["source_id", "scan"])
        quiet = quiet.select("unit", "source_id", "t_us", F.lit(None).cast("double").alias("north"), F.lit(None).cast("double").alias("east"), F.lit(None).cast("double").alias("error_m"), F.lit(None).cast("int").alias("plot"), "lat0", "lon0")
        made = joins.written(run(open_.select(*columns).union(quiet), tracker(tune, gates=True), ["unit"], _ORDER))
        done = made if done is None else joins.written(done.join(open_.select("unit").distinct(), "unit", "left_anti").unionByName(made))
        gates = done.where("state = 'gate'").join(widest, "source_id").select("source_id", "t_us", F.col("unit").alias("of"), "north", "east", "spread", "widest")
        met = reached(gates, rows.select("source_id", "t_us", "north", "east", "var", "unit")).where("of <> unit").select("of", "unit").distinct()
        merged = joins.written(joins.connected(met, "of", "unit"))
        if not merged.limit(1).count():
            return done.where("state <> 'gate'").select(*names)
        moved = rows.join(merged.withColumnRenamed("id", "unit"), "unit", "left").withColumn("new", F.coalesce("component", "unit"))
        rows = joins.written(moved.withColumn("touched", F.col("component").isNotNull()).drop("unit", "component").withColumnRenamed("new", "unit"))
        done = joins.written(done.join(merged.select(F.col("id").alias("unit")), "unit", "left_anti"))
        open_ = rows.where("touched").drop("touched")
        rows = rows.drop("touched")
