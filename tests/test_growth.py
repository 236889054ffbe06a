"""What grows with the tables must not grow in one process: plans and sizes that larger tables need."""

import re

from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_documents_are_not_broadcast(spark):
    from trackloom.llm.mixing import draw

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 300).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    ranges = draw(docs)[1]
    # The outermost join is that of pieces and slots.
    joins = re.findall(r"(\w+Join) \[rank#\d+L?, block#\d+L?\]", plan_of(ranges))
    assert joins[0] == "SortMergeJoin"
    assert ranges.count()


def test_neighbours_are_not_broadcast_and_blocks_lose_none(spark):
    from trackloom.operators import joins

    rows = spark.range(300).select("id", (F.col("id") * 7 % 50 * 1_000_000).alias("t_us"), ((F.col("id") * 37 % 101 - 50) / 200.0).alias("lat"), ((F.col("id") * 53 % 97 - 48) / 200.0).alias("lon"))
    met = joins.grid_pairs(rows, rows, max_dt_us=9_000_000, earlier=True)
    assert re.findall(r"(\w+Join) \[cy", plan_of(met)) == ["SortMergeJoin"]
    cell = lambda x: (x / 0.05) // 1
    all_rows = rows.collect()
    near = lambda a, b: abs(cell(a.lat) - cell(b.lat)) <= 1 and abs(cell(a.lon) - cell(b.lon)) <= 1
    want = sorted((a.id, b.id) for a in all_rows for b in all_rows if 0 <= a.t_us - b.t_us <= 9_000_000 and near(a, b))
    assert sorted((r.a_id, r.b_id) for r in met.select("a_id", "b_id").collect()) == want


def test_density_is_counted_without_a_broadcast(spark):
    from trackloom.queries import QUERIES

    plan = plan_of(QUERIES["local_density"](spark, "/root/testdata/sf0.001"))
    assert re.findall(r"(\w+Join) \[cy", plan) == ["SortMergeJoin"]


def test_detected_points_do_not_meet_every_plot_around_them(spark):
    import time

    from trackloom.operators import scoring

    # 3.6 thousand million pairs within a kilometre, if all met; half of the points are far from any plot.
    plots = spark.range(60_000).select(F.lit(1_000_000).alias("t_us"), (50.0 + F.col("id") / 1e8).alias("lat"), F.lit(0.0).alias("lon"))
    points = plots.select(F.monotonically_increasing_id().alias("point_id"), "t_us", "lat", "lon", F.lit(True).alias("scored"))
    points = points.union(points.selectExpr("-point_id - 1", "t_us", "lat + 1", "lon", "scored"))
    start = time.monotonic()
    found = scoring.require_detection(points, plots, within_m=2000.0, window_us=3_600_000_000).groupBy("scored").count().collect()
    assert {r["scored"]: r["count"] for r in found} == {True: 60_000, False: 60_000}
    assert time.monotonic() - start < 40


def test_cross_fixes_of_many_windows_take_one_fit(spark):
    import time

    from trackloom.operators import bearings

    at = spark.range(60_000).select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(e).alias("e")) for k, (n, e) in enumerate(((0.0, 0.2), (0.2, -0.1), (-0.2, -0.1)))))).alias("s"))
    lines = at.select((F.col("id") * 3 + F.col("s.k")).alias("line_id"), F.concat(F.lit("s"), "s.k").alias("sensor"), (F.col("id") * 10_000_000).alias("t_us"), F.col("s.n").alias("lat"), F.col("s.e").alias("lon"), F.pmod(F.degrees(F.atan2(0.03 - F.col("s.e"), 0.01 - F.col("s.n"))), F.lit(360.0)).alias("bearing"), F.lit(0.5).alias("sigma"), F.lit(None).cast("string").alias("emitter"))
    start = time.monotonic()
    found = bearings.cross_fixes(lines).agg(F.count("*"), F.max(F.abs(F.col("lat") - 0.01)), F.max(F.abs(F.col("lon") - 0.03)), F.min(F.size("lines"))).first()
    assert found[0] == 60_000 and found[1] < 1e-4 and found[2] < 1e-4 and found[3] == 3
    assert time.monotonic() - start < 40


def test_cross_fixes_do_not_depend_on_batches(spark):
    from trackloom.operators import bearings

    h = lambda n, m: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(m)).cast("double")
    lines = spark.range(600).select(F.col("id").alias("line_id"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("sensor"), (F.expr("id div 40") * 10_000_000 + h(1, 1000)).cast("long").alias("t_us"), (50 + h(2, 1000) / 4000).alias("lat"), (h(3, 1000) / 2000).alias("lon"), h(4, 3600).alias("bearing") / 10, F.lit(3.0).alias("sigma"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("e"), (F.col("id") % 3).cast("string"))).alias("emitter")).withColumnRenamed("(bearing / 10)", "bearing")
    lines = lines.toDF("line_id", "sensor", "t_us", "lat", "lon", "bearing", "sigma", "emitter").cache()
    rows = lambda: sorted((r["window"], r.emitter or "", r.lines, round(r.lat, 6), round(r.chi2, 6)) for r in bearings.cross_fixes(lines).collect())
    whole = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows() == whole and whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_emitters_of_many_tracks_take_one_fit(spark):
    import time

    from trackloom.functions import geo
    from trackloom.operators import motion

    t = (F.col("i") * 10 - 300).cast("double")
    north, east = 100.0 * F.least(t + 150.0, F.lit(0.0)), 100.0 * F.greatest(t + 150.0, F.lit(0.0))
    rows = spark.range(2500).select("id", F.explode(F.sequence(F.lit(0), 20 + (F.col("id") % 11).cast("int"))).alias("i"))
    bearing = F.pmod(F.degrees(F.atan2(12_000.0 - east, 5_000.0 - north)), F.lit(360.0))
    lines = rows.select(F.col("id").cast("string").alias("sensor_track"), F.col("i").cast("long").alias("line_id"), ((t + 1000) * 1e6).cast("long").alias("t_us"), (north / geo.METRES_PER_DEGREE).alias("lat"), (east / geo.METRES_PER_DEGREE).alias("lon"), bearing.alias("bearing"), F.lit(0.02).alias("sigma"), F.lit(60_000.0).alias("range_m"), F.lit(False).alias("moving"))
    start = time.monotonic()
    found = motion.locate(lines).agg(F.count("*"), F.max(F.abs(F.col("lat") * geo.METRES_PER_DEGREE - 5_000)), F.max(F.abs(F.col("lon") * geo.METRES_PER_DEGREE - 12_000)), F.min("lines"), F.max("lines")).first()
    assert found[0] == 2500 and found[1] < 50 and found[2] < 50 and tuple(found[3:]) == (21, 31)
    assert time.monotonic() - start < 12


def test_hypotheses_are_plain_numbers():
    import time

    from trackloom.operators import mht

    rows = [{"source_id": "r", "t_us": k * 2_500_000, "lat": 54 + ship / 100 + k * 1e-4 + (k * 7 + ship) % 11 * 1e-5, "lon": 3.0 + (k * 5 + ship) % 9 * 1e-5, "error_m": 10.0} for k in range(1, 11) for ship in range(4)]
    start = time.monotonic()
    for _ in range(40):
        fold = mht.tracker()
        state, made = fold.init(), []
        for row in rows:
            state, more = fold.step(state, row)
            made += more
        made += fold.end(state)
        assert len({r["track_key"] for r in made}) == 4 and len(made) == 32
    assert time.monotonic() - start < 4


def test_sparse_assignment_is_the_dense_one():
    import numpy as np

    from trackloom.operators import scoring
    from trackloom.operators.trackers import assign

    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = rng.integers(1, 9, 2)
        d = np.round(rng.random((n, m)) * 12, int(rng.integers(0, 5)))
        i, j = np.nonzero(d < 5)
        kept = scoring.assigned(int(n), int(m), i, j, d[i, j], 5.0)
        assert len(set(i[kept])) == len(set(j[kept])) == len(kept)
        want = sum(min(d[x, y], 5.0) for x, y in assign(np.minimum(d, 5.0))) + 5.0 * max(n - m, 0)
        assert abs(d[i, j][kept].sum() + 5.0 * (n - len(kept)) - want) < 1e-9


def test_gospa_of_many_and_of_large_moments(spark):
    import time

    from trackloom.operators import scoring

    start = time.monotonic()
    few = spark.range(120_000).select(F.expr("id div 4").alias("t_us"), F.col("id").alias("truth_id"), (50.0 + F.col("id") % 4 / 100).alias("lat"), F.lit(1.0).alias("lon"))
    got = scoring.gospa(few, few.selectExpr("t_us", "truth_id AS track", "lat + 1e-4 AS lat", "lon").where("track % 4 <> 3")).agg(F.count("*"), F.sum("pairs"), F.sum("missed"), F.sum("false"), F.max("localisation")).first()
    assert tuple(got[:4]) == (30_000, 90_000, 30_000 * 150.0, 0.0) and abs(got[4] - 3 * 11.119) < 0.01
    # Batches with and without pairs are of one schema.
    apart = few.selectExpr("t_us", "truth_id AS track", "lat + t_us % 2000 div 1000 AS lat", "lon")
    assert scoring.gospa(few, apart).agg(F.sum("pairs")).first()[0] == 60_000
    # A matrix of all pairs of this moment would take 3 GB for each of its steps.
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("t_us"), F.col("id").alias("truth_id"), (40.0 + F.expr("id div 200") / 100).alias("lat"), (F.col("id") % 200 / 100).alias("lon"))
    got = scoring.gospa(many, many.selectExpr("t_us", "truth_id AS track", "lat + 1e-4 AS lat", "lon")).first()
    assert got.pairs == 20_000 and got.missed == got["false"] == 0 and abs(got.gospa / 20_000 - 11.119) < 0.01
    assert time.monotonic() - start < 30


def test_latest_reports_are_listed_in_four_blocks(spark):
    from trackloom.operators import joins

    rows = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 2).cast("string").alias("source_id"), F.col("id").cast("string").alias("track_key"), (F.col("id") * 7 % 50 * 1_000_000).alias("t_us"), ((F.col("id") * 37 % 101 - 50) / 200.0).alias("lat"), ((F.col("id") * 53 % 97 - 48) / 200.0).alias("lon"))
    met = joins.latest_pairs(rows, rows, ["source_id", "track_key"], max_dt_us=20_000_000)
    # A report without another in its track's later slices is listed in three slices and four blocks, 12 times; nine cells were 27.
    assert re.findall(r"(\w+Join) \[cy", plan_of(met)) == ["SortMergeJoin"]
    cell = lambda x: (x / 0.05) // 1
    all_rows = rows.collect()
    near = lambda a, b: abs(cell(a.lat) - cell(b.lat)) <= 1 and abs(cell(a.lon) - cell(b.lon)) <= 1
    want = sorted((a.event_id, b.event_id) for a in all_rows for b in all_rows if 0 <= a.t_us - b.t_us <= 20_000_000 and near(a, b))
    assert sorted((r.a_event_id, r.b_event_id) for r in met.select("a_event_id", "b_event_id").collect()) == want
