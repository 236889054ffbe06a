"""Emitters located by one sensor's bearings: against the truth they were made from."""

import math

import numpy as np

from trackloom.functions import geo
from trackloom.operators import motion

SCHEMA = "sensor_track string, line_id long, t_us long, lat double, lon double, bearing double, sigma double, range_m double, moving boolean"


def _lines(name, emitter, velocity, *, n=13, every=10.0, noise=0.0, turn=True, sigma=0.1, seed=0):
    """Lines to an emitter (metres north, east at the end) from a sensor that flies north, then east."""
    rng, rows = np.random.default_rng(seed), []
    end = (n - 1) * every
    for i in range(n):
        t = i * every - end
        half = -end / 2
        north, east = 100.0 * (min(t, half) - half), 100.0 * (max(t, half) - half) if turn else 0.0
        dn, de = emitter[0] + velocity[0] * t - north, emitter[1] + velocity[1] * t - east
        bearing = math.degrees(math.atan2(de, dn)) + noise * rng.standard_normal()
        rows.append((name, i, int((1000 + t) * 1e6), 50 + north / geo.METRES_PER_DEGREE, east / (geo.METRES_PER_DEGREE * math.cos(math.radians(50))), bearing % 360, sigma, 60_000.0, None))
    return rows


def test_fixed_moving_and_unfit(spark):
    rows = _lines("fixed", (3000.0, 9000.0), (0.0, 0.0), noise=0.1) + _lines("moving", (5000.0, 14000.0), (-12.0, 9.0), n=31, noise=0.02, sigma=0.02)
    rows += _lines("few", (3000.0, 9000.0), (0, 0), n=3) + _lines("short", (3000.0, 9000.0), (0, 0), n=13, every=1.0)
    rows += [(*r[:5], (r[5] + 40 * (i % 2)) % 360, *r[6:]) for i, r in enumerate(_lines("noise", (3000.0, 9000.0), (0, 0)))]
    rows += [("fixed", 99, None, 1.0, 1.0, 1.0, 1.0, 1.0, None), ("fixed", 98, 1, 1.0, 1.0, 1.0, 0.0, 1.0, None), (None, 97, 1, 1.0, 1.0, 1.0, 1.0, 1.0, None)]
    got = {r.sensor_track: r for r in motion.locate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(got) == {"fixed", "moving"}
    for name, (n, e) in {"fixed": (3000.0, 9000.0), "moving": (5000.0, 14000.0)}.items():
        r = got[name]
        # The last sensor position is where the legs end: half the time east of the turn.
        north = (r.lat - 50) * geo.METRES_PER_DEGREE
        east = r.lon * geo.METRES_PER_DEGREE * math.cos(math.radians(50))
        assert r.model == name and math.hypot(north - n, east - e) < 4 * r.sigma_m
    assert math.hypot(got["moving"].v_north + 12, got["moving"].v_east - 9) < 3
    assert motion.locate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_gradients_equal_differences_and_covariance_holds():
    """The gradients are those of the bearings, and errors over many draws are as large as the covariance says."""
    rng = np.random.default_rng(1)
    t, sensor = np.linspace(-120, 0, 13), np.stack([np.linspace(0, 6000, 13), np.abs(np.linspace(-4000, 4000, 13))], axis=1)
    sigma, x = np.full(13, 0.002), np.array([[9000.0, 12000.0, 5.0, -8.0]])
    to = x[0, :2] + x[0, 2:] * t[:, None] - sensor
    bearing = np.arctan2(to[:, 1], to[:, 0])
    r, g, cost = motion._misfit(x, t, sensor, bearing, sigma)
    assert np.allclose(r, 0, atol=1e-9) and cost[0] < 1e-12
    for k, h in enumerate((1.0, 1.0, 0.01, 0.01)):
        near = x.copy()
        near[0, k] += h
        assert np.allclose(-motion._misfit(near, t, sensor, bearing, sigma)[0] / h, g[..., k], rtol=2e-3, atol=1e-9)
    errors = []
    for _ in range(60):
        got = motion._fit(x[:, :2] * 0.8, t, sensor, np.arctan2(9000 - sensor[:, 0], 12000 - sensor[:, 1]) * -1 + np.pi / 2 + sigma * rng.standard_normal(13), sigma)
        errors.append((got[0] - [9000, 12000]) @ np.linalg.inv(got[1]) @ (got[0] - [9000, 12000]))
    assert 1.2 < np.mean(errors) < 3.0
