"""Bearing-only contacts: association with tracks and cross-fixes of lines."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geo

#: Gates (fixed values): squared distance, chi-square at 99 % by degrees of freedom, least crossing angle and base line.
GATE_D2 = 9.0
CHI2_99 = (6.63, 9.21, 11.34, 13.28)
LEAST_CROSSING_DEG = 20.0
LEAST_BASELINE_M = 200.0
MOST_RANGE_M = 250_000.0
LINES_PER_SENSOR = 4


def associate(bearings: DataFrame, tracks: DataFrame, *, most_range_m: float = 50_000.0, window_us: int = 60_000_000) -> DataFrame:
    """Lines and the tracks ahead of them, in range and within three sigma, with how far off.

    ``bearings`` (line_id, t_us, lat, lon, bearing, sigma), ``tracks`` (uid, t_us, lat, lon).
    The range is a coarse grid: tracks sit in one cell, lines are listed in the cells that
    their range can reach, so this is an equi-join.
    """
    size = most_range_m / geo.METRES_PER_DEGREE
    ty, tx = geo.cell(F.col("lat"), F.col("lon") * F.cos(F.radians("lat")), size)
    by, bx = geo.cell(F.col("lat"), F.col("lon") * F.cos(F.radians("lat")), size)
    around = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: c + d))
    slice_of = lambda c: F.floor(c / window_us).cast("long")
    t = tracks.select("uid", F.col("t_us").alias("t_at"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), ty.alias("cy"), tx.alias("cx"), slice_of(F.col("t_us")).alias("ct"))
    b = bearings.withColumn("cy", around(by)).withColumn("cx", around(bx)).withColumn("ct", around(slice_of(F.col("t_us"))))
    north = (F.col("t_lat") - F.col("lat")) * geo.METRES_PER_DEGREE
    east = (F.col("t_lon") - F.col("lon")) * geo.METRES_PER_DEGREE * F.cos(F.radians("lat"))
    met = b.join(t, ["cy", "cx", "ct"]).withColumns({"range_m": F.sqrt(north * north + east * east), "off_deg": F.pmod(F.degrees(F.atan2(east, north)) - F.col("bearing") + 180.0, F.lit(360.0)) - 180.0})
    near = (F.abs(F.col("t_at") - F.col("t_us")) <= window_us) & (F.col("range_m") <= most_range_m)
    return met.where(near & (F.abs("off_deg") <= 3.0 * F.col("sigma"))).select("line_id", "uid", "range_m", "off_deg", ((F.col("off_deg") / F.col("sigma")) * (F.col("off_deg") / F.col("sigma"))).alias("d2"))


def fixes(points: np.ndarray, bearings: np.ndarray, sigmas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where sets of lines cross: weighted least squares on their normals, reweighted by range.

    Of stacked sets (set, line[, north and east in metres]): which fix a point ahead of all of
    their lines and in range; position, its greatest standard deviation in metres and chi-square.
    """
    rad, sig = np.radians(bearings), np.radians(sigmas)
    sin, cos = np.sin(rad), np.cos(rad)
    offset = cos * points[..., 1] - sin * points[..., 0]
    width = np.full(rad.shape, 1000.0)
    sound, x = np.full(len(points), True), np.zeros((len(points), 2))
    with np.errstate(all="ignore"):
        for _ in range(5):
            w = 1 / (sig * width) ** 2
            nn, ne, ee = (w * sin * sin).sum(axis=1), -(w * sin * cos).sum(axis=1), (w * cos * cos).sum(axis=1)
            most = (nn + ee) / 2 + np.hypot((nn - ee) / 2, ne)
            det = nn * ee - ne * ne
            least = det / most
            sound &= most <= 1e8 * least
            n, e = -(w * offset * sin).sum(axis=1), (w * offset * cos).sum(axis=1)
            x = np.stack([(ee * n - ne * e) / det, (nn * e - ne * n) / det], axis=1)
            to = x[:, None, :] - points
            width = np.maximum(np.hypot(to[..., 0], to[..., 1]), 1.0)
        sound &= ((to[..., 0] * cos + to[..., 1] * sin > 0) & (width <= MOST_RANGE_M)).all(axis=1)
        d = (cos * x[:, 1:] - sin * x[:, :1] - offset) / (sig * width)
        return sound, x, np.sqrt(1 / least), (d * d).sum(axis=1)


def fix(points: np.ndarray, bearings: np.ndarray, sigmas: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """``fixes`` of one set: position, greatest standard deviation and chi-square, or None."""
    sound, x, sigma, chi2 = fixes(points[None], bearings[None], sigmas[None])
    return (x[0], float(sigma[0]), float(chi2[0])) if sound[0] else None


def crossing(bearings: np.ndarray) -> np.ndarray:
    """The best crossing angle of any two lines of each set, in degrees."""
    apart = np.abs(bearings[..., :, None] - bearings[..., None, :]) % 180.0
    return np.minimum(apart, 180.0 - apart).max(axis=(-2, -1))


#: Sets of lines that are fitted at once.
SETS = 200_000


def _sets(sizes: np.ndarray, begins: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Sets of ``least`` rows of one group, for groups of such sizes and beginnings: arrays (set, row)."""
    for size in np.unique(sizes[sizes >= least]).tolist():
        own, every = begins[sizes == size], itertools.combinations(range(size), least)
        while some := list(itertools.islice(every, SETS)):
            some = np.array(some)
            step = max(1, SETS // len(some))
            for at in range(0, len(own), step):
                yield (own[at : at + step, None, None] + some[None]).reshape(-1, least)


def _crossed(lines: pa.Table) -> pa.RecordBatch | None:
    """The fixes of whole groups, sorted by window, emitter, sensor and age."""
    number = lambda c: lines.column(c).to_numpy()
    code = lambda c: pc.fill_null(pc.dictionary_encode(lines.column(c).combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
    n, window, emitter, sensor = len(lines), code("window"), code("emitter"), code("sensor")
    if not n:
        return None
    new = np.r_[True, (window[1:] != window[:-1]) | (emitter[1:] != emitter[:-1])]
    group = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    counts = np.diff(np.r_[begins, n])
    lat, lon, line_id = number("lat"), number("lon"), number("line_id")
    lat0, lon0 = np.add.reduceat(lat, begins) / counts, np.add.reduceat(lon, begins) / counts
    east = geo.METRES_PER_DEGREE * np.cos(np.radians(lat0))
    # The newest lines of each sensor.
    other = np.flatnonzero(np.r_[True, new[1:] | (sensor[1:] != sensor[:-1])])
    last = np.repeat(np.r_[other[1:], n], np.diff(np.r_[other, n]))
    kept = np.flatnonzero((last - np.arange(n) <= LINES_PER_SENSOR) & (sensor >= 0))
    point = np.stack([(lat - lat0[group]) * geo.METRES_PER_DEGREE, (lon - lon0[group]) * east[group]], axis=1)[kept]
    bearing, sigma, own, sensor, ids = number("bearing")[kept], number("sigma")[kept], group[kept], sensor[kept], line_id[kept]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(own)])
    named = pc.not_equal(lines.column("emitter"), "").to_numpy()[kept][starts]
    found = []
    for least, these in ((2, named), (3, ~named)):
        for rows in _sets(sizes[these], starts[these], least):
            rows = rows[(np.diff(sensor[rows], axis=1) != 0).all(axis=1)]
            at = point[rows]
            base = np.hypot(*np.moveaxis(at[:, :, None] - at[:, None], -1, 0)).max(axis=(1, 2))
            rows = rows[(crossing(bearing[rows]) >= LEAST_CROSSING_DEG) & (base >= LEAST_BASELINE_M)]
            sound, x, error, chi2 = fixes(point[rows], bearing[rows], sigma[rows])
            good = sound & (chi2 <= (math.inf if least == 2 else CHI2_99[least - 3]))
            if good.any():
                g = own[rows[good][:, 0]]
                members = np.full((len(g), 3), np.iinfo(np.int64).max)
                members[:, :least] = np.sort(ids[rows[good]], axis=1)
                found.append((g, chi2[good], members, np.full(len(g), least), lat0[g] + x[good][:, 0] / geo.METRES_PER_DEGREE, lon0[g] + x[good][:, 1] / east[g], error[good]))
    if not found:
        return None
    g, chi2, members, length, lat, lon, error = (np.concatenate(c) for c in zip(*found, strict=True))
    # Best first; a line serves one fix.  Two lines always meet: their chi-square is rounding, and the smaller ids go first.
    order = np.lexsort((members[:, 2], members[:, 1], members[:, 0], np.where(length == 2, 0.0, chi2), g))
    single = np.bincount(g, minlength=len(begins)) == 1
    taken, used, at = [], set(), -1
    for i, alone in zip(order.tolist(), single[g[order]].tolist(), strict=True):
        if not alone:
            mine = set(members[i, : length[i]].tolist())
            used, at = (used if at == g[i] else set()), g[i]
            if used & mine:
                continue
            used |= mine
        taken.append(i)
    taken = np.array(taken)
    g, length = g[taken], length[taken]
    flat = members[taken][np.arange(3)[None, :] < length[:, None]]
    first = pa.array(begins[g])
    head = lambda c: lines.column(c).combine_chunks().take(first)
    emitters = head("emitter")
    emitters = pc.if_else(pc.equal(emitters, ""), pa.scalar(None, emitters.type), emitters)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(flat, pa.int64()))
    return pa.RecordBatch.from_arrays([head("window"), emitters, lists, *(pa.array(c[taken]) for c in (lat, lon, error, chi2))], names=["window", "emitter", "lines", "lat", "lon", "sigma_m", "chi2"])


def cross_fixes(lines: DataFrame, *, window_us: int = 10_000_000) -> DataFrame:
    """Fixes of lines of one window: sets of one line from each of two sensors that hear the same
    emitter, or of three sensors without identity (T19).

    ``lines`` (line_id, sensor, t_us, lat, lon, bearing, sigma, emitter or null).  A group is
    one window of one emitter, and of the newest ``LINES_PER_SENSOR`` lines of a sensor, as the
    sweep has it; a set must be consistent, cross well and stand on a base line.  The sets of
    many groups are fitted at once; lines with a null bearing, place or sigma fix nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in filter(len, batches):
            # A batch may end within a group: its last group waits for the next one.
            ends = [batch.column(c)[len(batch) - 1].as_py() for c in ("window", "emitter")]
            same = pc.and_(*(pc.equal(batch.column(c), e) if e is not None else pc.is_null(batch.column(c)) for c, e in zip(("window", "emitter"), ends, strict=True)))
            at = len(batch) - pc.sum(pc.fill_null(same, False)).as_py()
            if at or (rest and any(rest[-1].column(c)[0].as_py() != e for c, e in zip(("window", "emitter"), ends, strict=True))):
                made = _crossed(pa.Table.from_batches([*rest, batch.slice(0, at)]))
                if made is not None:
                    yield made
                rest = []
            rest.append(batch.slice(at))
        if rest and (made := _crossed(pa.Table.from_batches(rest))) is not None:
            yield made

    d = lambda c: F.col(c).cast("double").alias(c)
    keys = ["window", "emitter"]
    windowed = lines.select(F.floor(F.col("t_us") / window_us).cast("long").alias("window"), F.coalesce("emitter", F.lit("")).alias("emitter"), F.col("sensor").cast("string").alias("sensor"), F.col("t_us").cast("long").alias("t_us"), F.col("line_id").cast("long").alias("line_id"), *map(d, ("lat", "lon", "bearing", "sigma")))
    windowed = windowed.dropna(subset=["lat", "lon", "bearing", "sigma"])
    sorted_ = windowed.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "sensor", "t_us", "line_id")
    return sorted_.mapInArrow(work, "window long, emitter string, lines array<long>, lat double, lon double, sigma_m double, chi2 double")


def ground_error(range_m, grazing_deg, bearing_deg, sigma_range_m, sigma_cross_deg):
    """The covariance of a radar target on the ground: slant range error stretched by the
    grazing angle along the line, bearing error across it (C4b), as columns."""
    along = sigma_range_m / F.cos(F.radians(grazing_deg))
    return geo.ellipse_covariance(along, range_m * F.radians(sigma_cross_deg), bearing_deg)
