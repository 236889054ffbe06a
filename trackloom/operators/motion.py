"""Where an emitter is by one moving sensor's bearings over time.

The sensor's own way is the base line.  The bearings of one sensor track are fitted by an
emitter at rest and, where that does not hold, by one of constant velocity.  All starting
ranges of many tracks are fitted at once, as stacked damped Gauss-Newton steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geo

#: Least lines and span of a fit, least lines of a moving one, starting ranges as shares of the
#: sensor's range, the normal quantile of the 99 % gates.
LEAST_LINES, LEAST_SPAN_S, LEAST_LINES_MOVING = 4, 30.0, 8
STARTS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.95)
Z_99 = 2.326


def gate(freedom: int) -> float:
    """Chi-square at 99 % by degrees of freedom (Wilson and Hilferty)."""
    k = max(freedom, 1)
    return k * (1 - 2 / (9 * k) + Z_99 * math.sqrt(2 / (9 * k))) ** 3


def _misfit(x: np.ndarray, t: np.ndarray, sensor: np.ndarray, bearing: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stacked states (north, east[, velocities]): residuals in sigmas, their gradients, and the
    cost, which is infinite where the emitter is not ahead of every sensor position.  The lines are
    those of one track, or of each state's own track."""
    north, east = x[:, :1] - sensor[..., 0], x[:, 1:2] - sensor[..., 1]
    if x.shape[1] == 4:
        north, east = north + x[:, 2:3] * t, east + x[:, 3:] * t
    square = north * north + east * east
    cos, sin = np.cos(bearing), np.sin(bearing)
    along = north * cos + east * sin
    ahead = (square >= 1) & (along > 0)
    r = np.arctan2(north * sin - east * cos, along) / sigma
    weight = 1 / (np.maximum(square, 1) * sigma)
    gn, ge = -east * weight, north * weight
    g = np.stack([gn, ge] if x.shape[1] == 2 else [gn, ge, gn * t, ge * t], axis=1)
    return r, g.swapaxes(1, 2), np.where(ahead.all(axis=1), (r * r).sum(axis=1), np.inf)


def _fits(starts: np.ndarray, *lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tracks with their starts (track, start, state) and lines (track, line): which are fitted, the
    best state of all starts, its covariance and chi-square.  States that no longer move are left out."""
    tracks, each, k = starts.shape
    own = np.repeat(np.arange(tracks), each)
    x, damping = starts.reshape(-1, k).copy(), np.full(tracks * each, 1e-3)
    r, g, cost = _misfit(x, *(v[own] for v in lines))
    normal, slope = np.swapaxes(g, 1, 2) @ g, (np.swapaxes(g, 1, 2) @ r[..., None])[..., 0]
    del r, g
    busy = np.flatnonzero(np.isfinite(cost))
    for _ in range(100):
        if not len(busy):
            break
        # Scaled by its diagonal, so that the damped matrix always has an inverse.
        part = normal[busy]
        scale = np.sqrt(np.maximum(np.diagonal(part, axis1=1, axis2=2), 1e-12))[..., None]
        damped = part / (scale * scale.swapaxes(1, 2)) + damping[busy][:, None, None] * np.eye(k)
        step = np.linalg.solve(damped, slope[busy][..., None] / scale) / scale
        tried = x[busy] + step[..., 0]
        r2, g2, cost2 = _misfit(tried, *(v[own[busy]] for v in lines))
        before = cost[busy]
        better = cost2 < before
        on = np.where(better, before - cost2 >= 1e-6 * np.maximum(before, 1e-9), damping[busy] < 1e9)
        damping[busy] = np.where(better, np.maximum(damping[busy] / 10, 1e-9), damping[busy] * 10)
        i, g2 = busy[better], g2[better]
        x[i], cost[i] = tried[better], cost2[better]
        normal[i], slope[i] = np.swapaxes(g2, 1, 2) @ g2, (np.swapaxes(g2, 1, 2) @ r2[better][..., None])[..., 0]
        busy = busy[on]
    at = np.arange(tracks) * each + np.argmin(cost.reshape(tracks, each), axis=1)
    fitted, information = np.isfinite(cost[at]), normal[at]
    # Scaled by its diagonal: metres and metres a second differ by orders of magnitude.
    scale = np.sqrt(np.maximum(np.diagonal(information, axis1=1, axis2=2), 1e-300))
    scaled = np.where(fitted[:, None, None], information / (scale[:, :, None] * scale[:, None, :]), np.eye(k))
    fitted &= np.linalg.cond(scaled) <= 1e14
    scaled[~fitted] = np.eye(k)
    cov = np.linalg.inv(scaled) / (scale[:, :, None] * scale[:, None, :])
    fitted &= np.isfinite(cov).all(axis=(1, 2)) & (np.diagonal(cov, axis1=1, axis2=2) > 0).all(axis=1)
    return fitted, x[at], cov, cost[at]


def _fit(starts: np.ndarray, *lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The best state of all starts of one track, its covariance and chi-square."""
    fitted, x, cov, chi2 = _fits(starts[None], *(v[None] for v in lines))
    return (x[0], cov[0], float(chi2[0])) if fitted[0] else None


def _located(n: np.ndarray, t: np.ndarray, sensor: np.ndarray, bearing: np.ndarray, sigma: np.ndarray, reach: np.ndarray, moved_before: np.ndarray, most_unseen: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tracks with ``n`` lines each (track, line), in order of time and filled up with first lines of no
    weight: which are located, which of these move, state, position covariance and chi-square."""
    tracks, every = len(n), np.arange(len(n))
    last = np.argmax(t, axis=1)
    at, away = sensor[every, last], bearing[every, last]
    ways = np.array(STARTS)[None, :, None] * reach[:, None, None] * np.stack([np.cos(away), np.sin(away)], axis=1)[:, None]
    starts, lines = at[:, None] + ways, (t, sensor, bearing, sigma)
    limit = lambda less: np.array([gate(int(k) - less) for k in n])
    still, rest, cov, chi2 = np.zeros(tracks, dtype=bool), np.zeros((tracks, 2)), np.zeros((tracks, 2, 2)), np.full(tracks, np.inf)
    if (tried := np.flatnonzero(~moved_before)).size:
        still[tried], rest[tried], cov[tried], chi2[tried] = _fits(starts[tried], *(v[tried] for v in lines))
    holds = still & (chi2 <= limit(2))
    moves, way, way_cov, way_chi2 = np.zeros(tracks, dtype=bool), np.zeros((tracks, 4)), np.zeros((tracks, 4, 4)), np.full(tracks, np.inf)
    if (tried := np.flatnonzero(n >= LEAST_LINES_MOVING)).size:
        # Where nothing at rest fits, a start twice changes nothing.
        some = np.concatenate([starts, np.where(still[:, None], rest, starts[:, 0])[:, None]], axis=1)[tried]
        moves[tried], way[tried], way_cov[tried], way_chi2[tried] = _fits(np.concatenate([some, np.zeros_like(some)], axis=2), *(v[tried] for v in lines))
    moves &= way_chi2 <= limit(4)
    moving = moves & (~holds | (np.where(holds, chi2, 0.0) - np.where(moves, way_chi2, 0.0) > gate(2)))
    # At rest only as far as the bearings can tell: it may have moved over half the window.
    speed = np.minimum(np.hypot(way[:, 2], way[:, 3]) + 2 * np.sqrt(np.maximum(way_cov[:, 2, 2] + way_cov[:, 3, 3], 0.0)), most_unseen)
    unseen = np.where(moves, (speed * -t.min(axis=1) / 2) ** 2 / 2, 0.0)
    cov = np.where(moving[:, None, None], way_cov[:, :2, :2], cov + np.eye(2) * unseen[:, None, None])
    x = np.where(moving[:, None], way, np.concatenate([rest, np.zeros((tracks, 2))], axis=1))
    return moving | holds, moving, x, cov, np.where(moving, way_chi2, chi2)


#: Lines of tracks that are fitted at once.
LINES = 8192


def locate(lines: DataFrame, *, window_us: int = 600_000_000, most_unseen_mps: float = 15.0) -> DataFrame:
    """Rows (sensor_track, t_us, model, lat, lon, v_north, v_east, sigma_m, chi2, lines): where the
    emitters of sensor tracks are at their newest bearing, as far as the bearings say.

    ``lines`` (sensor_track, line_id, t_us, lat, lon, bearing, sigma, range_m, moving); angles in
    degrees, ``moving`` true on any line: seen to move before, so a fixed fit is not tried.
    The lines of the last ``window_us`` of a track count.  Lines with a null or a sigma that
    is not positive are left out, as are tracks whose lines are too few, span too little
    or fit neither model.  A track's window is in one task: what one sensor says of one
    emitter in that time.
    """

    schema = "sensor_track string, t_us long, model string, lat double, lon double, v_north double, v_east double, sigma_m double, chi2 double, lines long"

    def fitted(lines: pa.Table) -> Iterator[pa.RecordBatch]:
        """The rows of whole tracks, in order."""
        names = lines.column("sensor_track").combine_chunks()
        begins = np.flatnonzero(np.r_[True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)]) if len(names) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[begins, len(names)])
        c = {n: lines.column(n).to_numpy() for n in ("t_us", "lat", "lon", "bearing", "sigma", "range_m", "moving")}
        moved = np.add.reduceat(c["moving"].astype(np.int64), begins) > 0 if len(begins) else None
        t0 = c["t_us"][begins + sizes - 1] - c["t_us"][begins] if len(begins) else None
        # Tracks of about one length together, so that little is filled up.
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] >= LEAST_LINES) & (t0[order] / 1e6 >= LEAST_SPAN_S)] if len(begins) else order
        while len(order):
            # Tracks are in order of their length: as many as with the longest's length stay within LINES.
            many = max(1, int(np.searchsorted(sizes[order] * np.arange(1, len(order) + 1), LINES, side="right")))
            some, order = order[:many], order[many:]
            n, begin = sizes[some], begins[some]
            place = np.arange(n.max())[None, :]
            real = place < n[:, None]
            rows = begin[:, None] + np.where(real, place, 0)
            newest = begin + n - 1
            lat, lon = c["lat"][newest], c["lon"][newest]
            east = geo.METRES_PER_DEGREE * np.cos(np.radians(lat))
            sensor = np.stack([(c["lat"][rows] - lat[:, None]) * geo.METRES_PER_DEGREE, ((c["lon"][rows] - lon[:, None] + 180) % 360 - 180) * east[:, None]], axis=2)
            t = (c["t_us"][rows] - c["t_us"][newest][:, None]) / 1e6
            sigma = np.where(real, np.radians(c["sigma"][rows]), np.inf)
            found, moving, x, cov, chi2 = _located(n, t, sensor, np.radians(c["bearing"][rows]), sigma, c["range_m"][newest], moved[some], most_unseen_mps)
            f = np.flatnonzero(found)
            if not len(f):
                continue
            x, cov = x[f], cov[f]
            out = [names.take(pa.array(begin[f])), c["t_us"][newest[f]], np.where(moving[f], "moving", "fixed"), lat[f] + x[:, 0] / geo.METRES_PER_DEGREE, (lon[f] + x[:, 1] / east[f] + 180) % 360 - 180, x[:, 2], x[:, 3], np.sqrt(cov[:, 0, 0] + cov[:, 1, 1]), chi2[f], n[f].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out], names=[part.split()[0] for part in schema.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in filter(len, batches):
            # A batch may end within a track: its last track waits for the next one.
            track = batch.column("sensor_track")
            at = len(batch) - pc.sum(pc.equal(track, track[len(batch) - 1])).as_py()
            if at or (rest and rest[-1].column("sensor_track")[0] != track[0]):
                yield from fitted(pa.Table.from_batches([*rest, batch.slice(0, at)]))
                rest = []
            rest.append(batch.slice(at))
        if rest:
            yield from fitted(pa.Table.from_batches(rest))

    needed = ("t_us", "lat", "lon", "bearing", "sigma", "range_m", "sensor_track")
    whole = lines.where(" and ".join(f"{n} is not null" for n in needed) + " and sigma > 0")
    # The fits cost far more than their rows weigh: a number of parts that is named is not made smaller.
    whole = whole.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sensor_track")
    recent = whole.withColumn("_newest", F.max("t_us").over(Window.partitionBy("sensor_track"))).where(F.col("t_us") >= F.col("_newest") - window_us).drop("_newest")
    d = lambda n: F.col(n).cast("double").alias(n)
    recent = recent.select("sensor_track", "line_id", F.col("t_us").cast("long").alias("t_us"), *map(d, ("lat", "lon", "bearing", "sigma", "range_m")), F.coalesce("moving", F.lit(False)).cast("int").alias("moving"))
    return recent.sortWithinPartitions("sensor_track", "t_us", "line_id").mapInArrow(work, schema)
