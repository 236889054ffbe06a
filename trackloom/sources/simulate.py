"""Seeded scenarios (Q13): targets on straight courses, radars with noise, misses and clutter.

Every number is a hash of what it is for, so that any partitioning gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geo

_ORIGIN = (54.0, 3.0)


def uniform(*of: Column | int | str) -> Column:
    """A number in [0, 1) that depends on ``of`` alone."""
    parts = [x if isinstance(x, Column) else F.lit(x) for x in of]
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def normal(*of: Column | int | str) -> Column:
    """A standard normal number (Box-Muller)."""
    u = F.greatest(uniform(*of, "u"), F.lit(1e-12))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * uniform(*of, "v"))


def _place(north: Column, east: Column) -> tuple[Column, Column]:
    lat, lon = _ORIGIN
    return F.lit(lat) + north / geo.METRES_PER_DEGREE, F.lit(lon) + east / (geo.METRES_PER_DEGREE * math.cos(math.radians(lat)))


def revisit_us(radar: int) -> int:
    return 2_500_000 + 500_000 * radar


def truth(spark: SparkSession, *, targets: int, scans: int, radar: int = 0, seed: int = 1) -> DataFrame:
    """Rows (truth_id, t_us, lat, lon, course, speed) at the scans of a radar."""
    grid = spark.range(targets).withColumnRenamed("id", "truth_id").withColumn("scan", F.explode(F.sequence(F.lit(0), F.lit(scans - 1))))
    k = F.col("truth_id")
    course, speed = 360.0 * uniform(seed, k, "course"), 5.0 + 15.0 * uniform(seed, k, "speed")
    t = F.col("scan") * (revisit_us(radar) / 1e6)
    north = 6000.0 * (uniform(seed, k, "n") - 0.5) + speed * F.cos(F.radians(course)) * t
    east = 6000.0 * (uniform(seed, k, "e") - 0.5) + speed * F.sin(F.radians(course)) * t
    lat, lon = _place(north, east)
    return grid.select("truth_id", (F.col("scan") * revisit_us(radar)).cast("long").alias("t_us"), lat.alias("lat"), lon.alias("lon"), course.alias("course"), speed.alias("speed"))


def plots(spark: SparkSession, *, targets: int, radars: int, scans: int, sigma_m: float = 10.0, detect_p: float = 0.9, clutter: int = 4, seed: int = 1) -> DataFrame:
    """Rows (source_id, t_us, lat, lon, error_m): what the radars see."""
    out = None
    for radar in range(radars):
        seen = truth(spark, targets=targets, scans=scans, radar=radar, seed=seed)
        key = (seed, radar, F.col("truth_id"), F.col("t_us"))
        noise = lambda axis: sigma_m * normal(*key, axis)  # noqa: B023, E731
        lat = F.col("lat") + noise("n") / geo.METRES_PER_DEGREE
        lon = F.col("lon") + noise("e") / (geo.METRES_PER_DEGREE * math.cos(math.radians(_ORIGIN[0])))
        hits = seen.where(uniform(*key, "seen") < detect_p).select("t_us", lat.alias("lat"), lon.alias("lon"))
        false = spark.range(scans * clutter).withColumn("t_us", (F.expr(f"id div {clutter}") * revisit_us(radar)).cast("long"))
        flat, flon = _place(12000.0 * (uniform(seed, radar, F.col("id"), "fn") - 0.5), 12000.0 * (uniform(seed, radar, F.col("id"), "fe") - 0.5))
        both = hits.union(false.select("t_us", flat, flon)).select(F.lit(f"radar{radar}").alias("source_id"), "t_us", "lat", "lon", F.lit(sigma_m).alias("error_m"))
        out = both if out is None else out.union(both)
    return out


def load(spark: SparkSession, *, tracks: int, seconds: int, seed: int = 1) -> DataFrame:
    """Reports of many tracks at 1 Hz, 2 to 15 m/s (the load scenario)."""
    grid = spark.range(tracks * seconds).withColumns({"track": F.expr(f"id div {seconds}"), "s": F.expr(f"id % {seconds}")})
    k = F.col("track")
    course, speed = 360.0 * uniform(seed, k, "course"), 2.0 + 13.0 * uniform(seed, k, "speed")
    lat, lon = _place(200_000.0 * (uniform(seed, k, "n") - 0.5) + speed * F.cos(F.radians(course)) * F.col("s"), 200_000.0 * (uniform(seed, k, "e") - 0.5) + speed * F.sin(F.radians(course)) * F.col("s"))
    return grid.select(F.col("id").alias("event_id"), F.lit("load").alias("source_id"), k.cast("string").alias("track_key"), (F.col("s") * 1_000_000).cast("long").alias("t_us"), lat.alias("lat"), lon.alias("lon"), course.alias("course"), speed.alias("speed"), F.lit(10.0).alias("error_m"), F.lit("surface").alias("domain"))


def bearings(spark: SparkSession, *, targets: int, sensors: int, scans: int, sigma_deg: float = 0.5, seed: int = 1) -> DataFrame:
    """Rows (line_id, sensor, t_us, lat, lon, bearing, sigma, emitter): lines from fixed sensors
    around the targets; every other target's emitter is known by kind."""
    seen = truth(spark, targets=targets, scans=scans, radar=5, seed=seed)
    at = seen.withColumn("sensor", F.explode(F.sequence(F.lit(0), F.lit(sensors - 1))))
    slat, slon = _place(12_000.0 * F.cos(2.0 * math.pi * F.col("sensor") / sensors), 12_000.0 * F.sin(2.0 * math.pi * F.col("sensor") / sensors))
    east = (F.col("lon") - slon) * F.cos(F.radians(slat))
    line = F.pmod(F.degrees(F.atan2(east, F.col("lat") - slat)) + sigma_deg * normal(seed, "b", F.col("sensor"), F.col("truth_id"), F.col("t_us")), F.lit(360.0))
    return at.select(F.xxhash64("sensor", "truth_id", "t_us").alias("line_id"), F.concat(F.lit("s"), F.col("sensor").cast("string")).alias("sensor"), "t_us", slat.alias("lat"), slon.alias("lon"), line.alias("bearing"), F.lit(sigma_deg).alias("sigma"), F.when(F.col("truth_id") % 2 == 0, F.concat(F.lit("e"), F.col("truth_id").cast("string"))).alias("emitter"), "truth_id")
