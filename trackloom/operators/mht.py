"""Multiple-hypothesis tracking (T7): every track is a tree of explanations of the last scans.

A leaf's score is the log likelihood ratio of its plots being one object against clutter.
The picture of a scan is the set of leaves of greatest total score of which no two share a
tree or a plot; branches that disagree with it a few scans back are cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import trackers
from trackloom.operators.folds import Fold, run

#: Defaults (fixed values): scans after which choices are final, branches of a tree, score that ends one, search nodes.
BACK = 3
BRANCHES = 20
DELETE_SCORE = -20.0
SEARCH_NODES = 200_000


@dataclass(slots=True)
class Leaf:
    """``track``: a state (north, east and their speeds) with the covariance that both axes share, as (position,
    cross, speed); plain numbers, as there are hundreds of leaves in a scan of a few plots."""

    track: tuple[tuple[float, float, float, float], tuple[float, float, float]]
    score: float
    plots: tuple[tuple[int, int], ...]
    hits: int

    def predicted(self, dt: float, q: float) -> tuple[tuple[float, float, float, float], tuple[float, float, float]]:
        (n, e, vn, ve), (pp, pv, vv) = self.track
        return (n + dt * vn, e + dt * ve, vn, ve), (pp + dt * (2 * pv + dt * vv) + q * dt**4 / 4, pv + dt * vv + q * dt**3 / 2, vv + q * dt**2)


@dataclass
class State:
    t: float | None = None
    lat0: float = 0.0
    lon0: float = 0.0
    scan: int = 0
    next: int = 1
    trees: dict[int, list[Leaf]] = field(default_factory=dict)
    plots: list = field(default_factory=list)


def best_set(leaves: list[tuple[int, Leaf]]) -> list[int]:
    """The compatible leaves of greatest total score, exact within each group of leaves that
    conflict (up to ``SEARCH_NODES`` steps, then the best found)."""
    owner: dict = {}
    parent = list(range(len(leaves)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (tree, leaf) in enumerate(leaves):
        for k in (("t", tree), *leaf.plots):
            parent[root(i)] = root(owner.setdefault(k, i))
    groups: dict[int, list[int]] = {}
    for i in range(len(leaves)):
        groups.setdefault(root(i), []).append(i)
    out: list[int] = []
    for group in groups.values():
        group.sort(key=lambda i: -leaves[i][1].score)
        scores = [leaves[i][1].score for i in group]
        rest = [*np.cumsum(scores[::-1])[::-1].tolist(), 0.0]
        # What a leaf takes, as bits; what was chosen, as (last, those before).
        bits: dict = {}
        takes = [sum(1 << bits.setdefault(k, len(bits)) for k in {("t", tree), *leaf.plots}) for tree, leaf in (leaves[i] for i in group)]
        best: tuple[float, tuple] = (-1.0, ())
        stack: list[tuple[int, float, tuple, int]] = [(0, 0.0, (), 0)]
        nodes, size = 0, len(group)
        while stack and nodes < SEARCH_NODES:
            at, total, chosen, used = stack.pop()
            nodes += 1
            if total > best[0]:
                best = (total, chosen)
            if at == size or total + rest[at] <= best[0]:
                continue
            stack.append((at + 1, total, chosen, used))
            if not takes[at] & used:
                stack.append((at + 1, total + scores[at], (group[at], chosen), used | takes[at]))
        chosen = best[1]
        while chosen:
            out.append(chosen[0])
            chosen = chosen[1]
    return out


def scan(state: State, t: float, z: np.ndarray, var: np.ndarray, tune: trackers.Tuning, confirm: int = 3) -> list[tuple[Leaf, int, bool]]:
    """One scan: grow, choose, prune; the confirmed leaves of the picture that were hit."""
    dt = 0.0 if state.t is None else t - state.t
    state.t, state.scan = t, state.scan + 1
    points, miss, gain = list(zip(z[:, 0].tolist(), z[:, 1].tolist(), var.tolist(), strict=True)), math.log(1 - tune.detect_p), math.log(tune.detect_p / tune.clutter) - math.log(2 * math.pi)
    for tree, leaves in state.trees.items():
        # (score, leaf before, predicted state, plot); the best become leaves.
        grown: list[tuple] = []
        for leaf in leaves:
            x, p = leaf.predicted(dt, tune.accel**2)
            grown.append((leaf.score + miss, leaf, x, p, -1))
            for j, (n, e, r) in enumerate(points):
                s = p[0] + r
                d2 = ((n - x[0]) ** 2 + (e - x[1]) ** 2) / s
                if d2 <= tune.gate:
                    grown.append((leaf.score + gain - d2 / 2 - math.log(s), leaf, x, p, j))
        grown.sort(key=lambda g: -g[0])
        made = []
        for score, leaf, x, p, j in grown[:BRANCHES]:
            if j < 0:
                made.append(Leaf((x, p), score, leaf.plots, leaf.hits))
                continue
            n, e, r = points[j]
            near, cross = p[0] / (p[0] + r), p[1] / (p[0] + r)
            dn, de = n - x[0], e - x[1]
            made.append(Leaf(((x[0] + near * dn, x[1] + near * de, x[2] + cross * dn, x[3] + cross * de), (p[0] * (1 - near), p[1] * (1 - near), p[2] - cross * p[1])), score, (*leaf.plots, (state.scan, j)), leaf.hits + 1))
        state.trees[tree] = made
    for j, (n, e, r) in enumerate(points):
        state.trees[state.next] = [Leaf(((n, e, 0.0, 0.0), (r, 0.0, tune.speed0**2)), math.log(tune.birth / tune.clutter), ((state.scan, j),), 1)]
        state.next += 1
    every = [(tree, leaf) for tree, leaves in state.trees.items() for leaf in leaves if leaf.score > 0]
    picture = {every[i][0]: every[i][1] for i in best_set(every)}
    old = lambda leaf: tuple(p for p in leaf.plots if p[0] <= state.scan - BACK)
    taken = {p for leaf in picture.values() for p in old(leaf)}
    kept: dict[int, list[Leaf]] = {}
    for tree, leaves in state.trees.items():
        if tree in picture:
            leaves = [x for x in leaves if old(x) == old(picture[tree])]
        else:
            leaves = [x for x in leaves if not taken & set(old(x))]
        leaves = [x for x in leaves if x.score > DELETE_SCORE and (tree in picture or x.plots[-1][0] > state.scan - 2 * BACK)]
        if leaves:
            kept[tree] = leaves
    state.trees = kept
    hit = lambda leaf: leaf.plots[-1][0] == state.scan
    return [(leaf, tree, True) for tree, leaf in picture.items() if leaf.hits >= confirm and hit(leaf)]


def tracker(tune: trackers.Tuning = trackers.Tuning(), confirm: int = 3) -> Fold:
    """The fold of a source's plots, as ``trackers.tracker``."""

    def close(state: State) -> list[dict]:
        if not state.plots:
            return []
        rows, state.plots = state.plots, []
        if state.t is None:
            state.lat0, state.lon0 = rows[0]["lat"], rows[0]["lon"]
        east = trackers.METRES * math.cos(math.radians(state.lat0))
        z = np.array([[(r["lat"] - state.lat0) * trackers.METRES, (r["lon"] - state.lon0) * east] for r in rows])
        var = np.array([max(r.get("error_m") or tune.sigma_m, 1e-3) ** 2 for r in rows])
        z, var, _ = trackers.clustered(z, var, tune.cluster_m)
        out = []
        for leaf, tree, _ in scan(state, rows[0]["t_us"] / 1e6, z, var, tune, confirm):
            n, e, vn, ve = leaf.track[0]
            out.append({"source_id": rows[0]["source_id"], "track_key": str(tree), "t_us": rows[0]["t_us"], "lat": state.lat0 + n / trackers.METRES, "lon": state.lon0 + e / east, "speed": math.hypot(vn, ve), "course": math.degrees(math.atan2(ve, vn)) % 360.0, "score": leaf.score, "state": "confirmed", "plot": leaf.plots[-1][1]})
        return out

    def step(state: State, row: dict):
        made: list[dict] = []
        if state.plots and row["t_us"] != state.plots[0]["t_us"]:
            made = close(state)
        if state.t is None or row["t_us"] / 1e6 > state.t:
            state.plots.append(row)
        return state, made

    return Fold(State, step, "source_id string, track_key string, t_us long, lat double, lon double, speed double, course double, score double, state string, plot int", end=close)


def form_tracks(plots: DataFrame, tune: trackers.Tuning = trackers.Tuning()) -> DataFrame:
    """Tracks of every source's detections, by hypotheses over several scans."""
    return run(plots.select("source_id", "t_us", "lat", "lon", F.col("error_m").cast("double").alias("error_m")), tracker(tune), ["source_id"], ["t_us", "lat", "lon"], heavy=True)
