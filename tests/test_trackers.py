"""Trackers split into regions against one fold over the whole source, and the stacked filter against matrices."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import trackers
from trackloom.operators.trackers import Stack, Tuning, form_tracks, matched
from trackloom.sources import simulate


def rows(df):
    return sorted((r.source_id, r.t_us, r.track_key, r.state, r.plot, round(r.lat, 7), round(r.lon, 7), round(r.exists, 9)) for r in df.collect())


@pytest.mark.parametrize("tune", [Tuning(), Tuning(cluster_m=30.0), Tuning(detect_p=0.6, clutter=1e-5, birth=1e-6)])
def test_regions_give_the_tracks_of_one_fold(spark, tune):
    plots = simulate.plots(spark, targets=10, radars=2, scans=20, clutter=5)
    whole, split = rows(form_tracks(plots, tune)), rows(form_tracks(plots, tune, regions=True))
    assert len(whole) > 100 and whole == split


def test_stacked_filters_are_the_filter():
    rng, tune = np.random.default_rng(3), Tuning()
    stack, one = Stack(), trackers.Track("a", np.array([1.0, 2.0, 0.0, 0.0]), np.diag([9.0, 9.0, 25.0, 25.0]), 0.1)
    stack.add(["a", "b"], np.array([[1.0, 2.0], [50.0, 60.0]]), np.array([9.0, 4.0]), tune)
    for _ in range(10):
        dt, z = rng.uniform(0.5, 5), rng.normal(size=2) * 10
        stack.predict(dt, tune)
        trackers.predict(one, dt, tune)
        _, _, y, inv = trackers.innovation(one, z, 16.0)
        trackers.update(one, y, inv)
        stack.update(np.array([0]), z[None, :], np.array([16.0]))
        assert np.allclose(stack.x[0], one.x) and np.allclose(stack.p[0], [one.p[0, 0], one.p[0, 2], one.p[2, 2]])


def test_matches_are_most_then_least():
    import itertools

    rng = random.Random(4)
    for _ in range(200):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        cost, gated = np.array([[rng.random() for _ in range(m)] for _ in range(n)]), np.array([[rng.random() < 0.5 for _ in range(m)] for _ in range(n)])
        sets = [list(zip(r, p, strict=True)) for k in range(min(n, m) + 1) for r in itertools.combinations(range(n), k) for p in itertools.permutations(range(m), k)]
        best = min((-len(c), sum(cost[x] for x in c)) for c in sets if all(gated[x] for x in c))
        i, j = matched(cost, gated)
        assert len(set(i)) == len(i) == len(set(j)) and gated[i, j].all() and math.isclose(-best[0], len(i)) and math.isclose(best[1], cost[i, j].sum(), abs_tol=1e-9)


def test_empty_and_single_plots(spark):
    plots = simulate.plots(spark, targets=2, radars=1, scans=3)
    for regions in (False, True):
        assert form_tracks(plots.where("false"), regions=regions).collect() == []
        assert form_tracks(plots.limit(1), regions=regions).collect() == []
    assert form_tracks(plots.withColumn("error_m", F.lit(None).cast("double"))).count() >= 0
