"""From captured records to a proposed mapping."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.analytics import json_paths, probe

#: Names under which feeds send a target's value, most telling first (fixed values).
NAMES = {
    "position.latitude": ("latitude", "lat"), "position.longitude": ("longitude", "lon", "lng", "long"), "kinematics.speed_mps": ("speed", "sog", "gs", "velocity"),
    "kinematics.course_deg": ("course", "cog", "track", "heading"), "observed_at": ("time", "timestamp", "ts", "t", "seen"), "name": ("name", "shipname", "callsign", "flight"),
}
#: Values that a target may hold; a field that goes beyond does not fit.
FITS = {"position.latitude": (-90.0, 90.0), "position.longitude": (-180.0, 180.0), "kinematics.course_deg": (0.0, 360.0), "kinematics.speed_mps": (0.0, 1e4)}
LEAST_PRESENCE = 0.9


def record_path(frames: DataFrame, text: str) -> str | None:
    """The array of objects that holds the records: the one with most elements among those
    present in at least 90 % of the frames."""
    total = frames.count()
    leaves = json_paths(frames.withColumn("_frame", F.monotonically_increasing_id()), text).where(F.col("path").contains("[*].")).withColumn("array", F.regexp_extract("path", r"^(.*?)\[\*\]\.", 1))
    counts = leaves.groupBy("array", "path").agg(F.count("*").alias("n")).groupBy("array").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "array").limit(1).collect()
    return counts[0]["array"].removeprefix("$").removeprefix(".") if counts and counts[0]["n"] >= LEAST_PRESENCE * total else None


def propose(records: DataFrame, text: str, most: int = 1000) -> dict[str, Any]:
    """A mapping for JSON records: targets by name and by fit of their values, and as the key
    the field of most distinct values that is present nearly always.

    The statistics are one row for each path of a probe, the ``most`` records of least hash.
    """
    sample = records.orderBy(F.xxhash64(text), text).limit(most)
    total = sample.count()
    stats = {r["path"].removeprefix("$."): r for r in probe(sample, text).collect()}
    fields: dict[str, Any] = {}
    for target, names in NAMES.items():
        ranked = [(names.index(p.split(".")[-1].lower()), p) for p in stats if p.split(".")[-1].lower() in names]
        low, high = FITS.get(target, (None, None))
        fitting = [(i, p) for i, p in ranked if low is None or (stats[p]["least"] is not None and stats[p]["least"] >= low and stats[p]["most"] <= high)]
        if fitting:
            path = min(fitting)[1]
            fields[target] = {"path": path, "transforms": ["time"]} if target == "observed_at" else path
    used = {f["path"] if isinstance(f, dict) else f for f in fields.values()}
    keys = [(s["n_distinct"] / max(s["n"], 1), s["n_distinct"], p) for p, s in stats.items() if p not in used and s["n"] >= LEAST_PRESENCE * total and "[*]" not in p]
    ids = [k for k in keys if any(w in k[2].split(".")[-1].lower() for w in ("id", "hex", "mmsi", "icao", "key"))]
    chosen = max(ids or keys, default=None)
    return {"rules": [{"name": "records", "key": chosen[2] if chosen else None, "fields": fields}]}
