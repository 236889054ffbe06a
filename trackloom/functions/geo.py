"""Distances, dead reckoning, uncertainty and areas as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth's mean radius, metres per degree, CEP and circle factors.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_320.0
CEP_OF_AXES = 0.59
CEP_OF_SIGMA = 1.1774
#: The fastest a platform of a domain plausibly moves, in m/s (fixed values).
MAX_SPEED = {"surface": 40.0, "subsurface": 40.0, "ground": 70.0, "space": 8000.0}
MAX_SPEED_OTHER = 400.0


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2.0
    half_lon = F.radians(lon2 - lon1) / 2.0
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def flat_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, for short moves."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2.0)) * METRES_PER_DEGREE
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dead_reckon(lat: Column, lon: Column, course: Column, speed: Column, dt_s: Column, max_secs: float) -> tuple[Column, Column]:
    """The position ``dt_s`` later (at most ``max_secs`` either way); unmoved without course or speed."""
    d = speed * clamp(dt_s, -max_secs, max_secs)
    north = F.degrees(d * F.cos(F.radians(course)) / EARTH_RADIUS_M)
    east = F.degrees(d * F.sin(F.radians(course)) / (EARTH_RADIUS_M * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))))
    return lat + F.coalesce(north, F.lit(0.0)), lon + F.coalesce(east, F.lit(0.0))


def max_speed(domain: Column) -> Column:
    out = F.lit(MAX_SPEED_OTHER)
    for name, speed in MAX_SPEED.items():
        out = F.when(domain == name, speed).otherwise(out)
    return out


def ellipse_covariance(major: Column, minor: Column, orientation_deg: Column) -> tuple[Column, Column, Column]:
    """North-north, north-east and east-east covariance of a one-sigma ellipse."""
    c, s = F.cos(F.radians(orientation_deg)), F.sin(F.radians(orientation_deg))
    a, b = major * major, minor * minor
    return a * c * c + b * s * s, (a - b) * s * c, a * s * s + b * c * c


def covariance_ellipse(nn: Column, ne: Column, ee: Column) -> tuple[Column, Column, Column]:
    """Semi-axes and orientation of a covariance."""
    mid, r = (nn + ee) / 2.0, F.sqrt(((nn - ee) / 2.0) * ((nn - ee) / 2.0) + ne * ne)
    angle = F.degrees(F.atan2(2.0 * ne, nn - ee)) / 2.0
    return F.sqrt(mid + r), F.sqrt(F.greatest(mid - r, F.lit(0.0))), F.pmod(angle, F.lit(180.0))


def circular_error(major: Column, minor: Column) -> Column:
    return CEP_OF_AXES * (major + minor)


def inside_polygon(lat: Column, lon: Column, vertices: Column) -> Column:
    """Ray casting over ``vertices``, an array of structs (lat, lon); never null."""
    n = F.size(vertices)
    edges = F.zip_with(vertices, F.concat(F.slice(vertices, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(vertices, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & F.coalesce(lon < at, F.lit(False))

    return F.when(n >= 3, F.size(F.filter(edges, crosses)) % 2 == 1).otherwise(F.lit(False))


def area_centre(vertices: Column) -> tuple[Column, Column]:
    """The mean of the vertices."""
    total = lambda k: F.aggregate(vertices, F.lit(0.0), lambda acc, v: acc + v[k])
    return total("lat") / F.size(vertices), total("lon") / F.size(vertices)


def cell(lat: Column, lon: Column, size_deg: float = 0.05) -> tuple[Column, Column]:
    return F.floor(lat / size_deg).cast("int"), F.floor(lon / size_deg).cast("int")


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Within a box; one with west > east crosses the antimeridian."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return (lat >= south) & (lat <= north) & across


def polar_covariance(bearing_deg: Column, range_m: Column, sigma_range: Column, sigma_bearing_deg: Column) -> tuple[Column, Column, Column]:
    """Covariance of a ranged bearing: range along the line, bearing across it."""
    return ellipse_covariance(sigma_range, range_m * F.radians(sigma_bearing_deg), bearing_deg)


def chi2_quantile(p: float, dof: int) -> float:
    """The value below which a share ``p`` of a chi-square distribution of 2 or 4 degrees lies."""
    x = -2.0 * math.log(1.0 - p)
    if dof == 2:
        return x
    for _ in range(60):  # Newton on 1 - exp(-x/2)(1 + x/2) = p
        x += (p - 1.0 + math.exp(-x / 2) * (1 + x / 2)) / (x / 4 * math.exp(-x / 2))
    return x


def track_quality(error_m: Column) -> Column:
    """Quality 0-15: 15 to 10 m, one less with each doubling of the error; unknown is 0."""
    steps = F.greatest(F.ceil(F.log2(error_m / 10.0)), F.lit(0))
    return F.when(error_m <= 0, 15).when(error_m < float("inf"), F.greatest(15 - steps, F.lit(0))).otherwise(0).cast("int")


def area_of(nn: Column, ne: Column, ee: Column, least_m: float = 2000.0) -> Column:
    """The ellipse of a position that is an area rather than a point: where the root of its
    variances' sum is over ``least_m``, else null (K23)."""
    major, minor, orientation = covariance_ellipse(nn, ne, ee)
    return F.when(F.sqrt(nn + ee) > least_m, F.struct(major.alias("semi_major_m"), minor.alias("semi_minor_m"), orientation.alias("orientation_deg")))
