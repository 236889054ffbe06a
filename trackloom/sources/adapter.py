"""Observations from the ``events`` table, by plain arithmetic (no table holds positions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each event: five feeds, keyed by user, with times in microseconds."""
    d = lambda c: F.col(c).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("source_id"),
        F.col("user_id").cast("string").alias("track_key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        (50.0 + ((F.col("user_id") * 37 + F.col("event_id")) % 1000).cast("double") / 10000.0).alias("lat"),
        (-1.0 + ((F.col("user_id") * 53 + F.col("event_id") * 7) % 1000).cast("double") / 10000.0).alias("lon"),
        (d("value") % 30.0).alias("speed"),
        ((F.col("event_id") * 13) % 360).cast("double").alias("course"),
        (5 + F.col("event_id") % 20).cast("double").alias("error_m"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("uid:"), F.col("user_id").cast("string"))).alias("identity"),
        (0.5 + (F.col("event_id") % 50).cast("double") / 100.0).alias("confidence"),
        F.when(F.col("user_id") % 4 == 0, "air").when(F.col("user_id") % 4 == 1, "surface").when(F.col("user_id") % 4 == 2, "ground").otherwise("subsurface").alias("domain"),
    )


#: The same in DuckDB, as the first table of a WITH.
OBS_SQL = """obs AS (
  SELECT event_id, event_type AS source_id, user_id::varchar AS track_key, epoch_us(ts) AS t_us,
    50.0::double + ((user_id * 37 + event_id) % 1000)::double / 10000.0::double AS lat,
    -1.0::double + ((user_id * 53 + event_id * 7) % 1000)::double / 10000.0::double AS lon,
    value::double % 30.0::double AS speed, ((event_id * 13) % 360)::double AS course,
    (5 + event_id % 20)::double AS error_m,
    CASE WHEN user_id % 3 = 0 THEN 'uid:' || user_id END AS identity,
    0.5::double + (event_id % 50)::double / 100.0::double AS confidence,
    CASE user_id % 4 WHEN 0 THEN 'air' WHEN 1 THEN 'surface' WHEN 2 THEN 'ground' ELSE 'subsurface' END AS domain
  FROM events)"""
