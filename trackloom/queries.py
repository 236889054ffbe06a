"""The library's queries by name, each with the SQL that says the same in DuckDB.

All run on observations derived from ``events`` (``sources.adapter``) or on the other
given tables, over whole tables.  Floating results are rounded by ``floor(x p + 1/2) / p`` in both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import expr, geo, kinematics, symbols
from trackloom.operators import analytics, bearings, commands, correlate, folds, fusion, graph, joins, maintenance, mapping, mht, motion, peers, registry, scoring, timing, trackers
from trackloom.plans import plugins
from trackloom.plans.flow import Flow
from trackloom.sources import framing, sinks
from trackloom.sources.adapter import OBS_SQL, observations, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rnd(x: Column, places: int = 3) -> Column:
    p = float(10**places)
    return F.floor(x * p + 0.5) / p


def rsql(x: str, places: int = 3) -> str:
    p = f"{10**places}::double"
    return f"floor(({x}) * {p} + 0.5::double) / {p}"


HAV_SQL = """2.0::double * 6371008.8::double * asin(sqrt(sin((radians({lat2}) - radians({lat1})) / 2.0::double) * sin((radians({lat2}) - radians({lat1})) / 2.0::double)
  + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2.0::double) * sin(radians({lon2} - {lon1}) / 2.0::double)))"""


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAV_SQL.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


# --- expressions (E*) ------------------------------------------------------------------


def _specs(df: DataFrame, keep: list[str], specs: dict[str, tuple[object, str]]) -> DataFrame:
    """Columns of value specs: name -> (spec, "n" or "s")."""
    scope = expr.Scope(df.schema)
    out = []
    for name, (spec, kind) in specs.items():
        v = expr.value(spec, scope)
        out.append((v.num if kind == "n" else F.when(v.tag.isNotNull(), v.text)).alias(name))
    return df.select(*keep, *out)


@query("""SELECT event_id, value * 0.514444::double AS mps, value * 0.3048::double AS metres, value * (0.3048::double / 60.0::double) AS climb,
  value * (1.0::double / 3.6::double) AS kmh, value * 1852.0::double AS nm, value * 0.5::double + 3.0::double AS scaled,
  floor(value * 10.0::double + 0.5::double) / 10.0::double AS rounded, (value * 7.0::double) % 360.0::double AS wrapped FROM events""")
def expr_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit, scale, offset, round and wrap transforms."""
    t = lambda *names: ({"path": "value", "transforms": list(names)}, "n")
    return _specs(table(spark, sf_dir, "events"), ["event_id"], {"mps": t("knots_to_mps"), "metres": t("feet_to_m"), "climb": t("fpm_to_mps"), "kmh": t("kmh_to_mps"), "nm": t("nm_to_m"), "scaled": t("scale:0.5", "offset:3"), "rounded": t("round:1"), "wrapped": t("scale:7", "wrap360")})


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'touch' ELSE 'other' END AS named,
  CASE WHEN user_id BETWEEN 10 AND 20 THEN 'few' WHEN user_id BETWEEN 0 AND 60 THEN 'some' END AS banded,
  CASE WHEN user_id < 5 OR user_id > 90 THEN -1.0::double ELSE user_id::double END AS bounded,
  CASE WHEN user_id = 7 OR event_type = 'error' THEN 'n/a' ELSE event_type || '-' || user_id END AS tagged,
  CASE WHEN event_type <> 'error' THEN upper(event_type) ELSE 'FAULT' END AS coalesced FROM events""")
def expr_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, ranges, bounds, defaults, null_if, first and templates."""
    df = table(spark, sf_dir, "events")
    clean = {"path": "event_type", "null_if": ["error"]}
    df = df.withColumn("kind", F.nullif("event_type", F.lit("error"))).withColumn("who", F.nullif("user_id", F.lit(7)))
    return _specs(df, ["event_id"], {
        "named": ({"path": "event_type", "table": {"view": "look", "click": "touch"}, "table_default": "other"}, "s"),
        "banded": ({"path": "user_id", "ranges": [[0, 60, "some"], [10, 20, "few"]]}, "s"),
        "bounded": ({"path": "user_id", "range": [5, 90], "default": -1}, "n"),
        "tagged": ({"template": "{kind}-{who}", "default": "n/a"}, "s"),
        "coalesced": ({"first": [clean, {"const": "fault"}], "transforms": ["trim", "upper"]}, "s"),
    })


@query("""SELECT event_id, value + user_id::double AS added, value - user_id::double AS less, value * user_id::double AS times,
  CASE WHEN user_id % 5 <> 0 THEN value / (user_id % 5)::double END AS divided, least(value, user_id::double, 50.0::double) AS low, greatest(value, user_id::double) AS high,
  CASE WHEN event_type = 'view' THEN value WHEN user_id > 50 THEN 1.0::double ELSE 0.0::double END AS cased FROM events""")
def expr_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic folds and cases."""
    df = table(spark, sf_dir, "events").withColumn("m", F.col("user_id") % 5)
    a = lambda op, *args: ({"arith": op, "args": list(args)}, "n")
    return _specs(df, ["event_id"], {
        "added": a("add", "value", "user_id"), "less": a("sub", "value", "user_id"), "times": a("mul", "value", "user_id"), "divided": a("div", "value", "m"),
        "low": a("min", "value", "user_id", {"const": 50}), "high": a("max", "value", "user_id"),
        "cased": ({"cases": [{"when": {"path": "event_type", "eq": "view"}, "then": "value"}, {"when": {"path": "user_id", "gt": 50}, "then": {"const": 1}}], "default": 0}, "n"),
    })


@query("""SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS head, CASE WHEN len(string_split(o_orderpriority, '-')) >= 2 THEN string_split(o_orderpriority, '-')[-1] END AS tail,
  CASE WHEN regexp_matches(o_orderpriority, '^(\\d)-') THEN regexp_extract(o_orderpriority, '^(\\d)-', 1) END AS digit,
  replace(o_orderpriority, 'URGENT', 'NOW') AS swapped, (o_orderkey & 4) <> 0 AS flagged,
  strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS stamped FROM orders""")
def expr_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, regex, replace, bits_any and time transforms."""
    df = table(spark, sf_dir, "orders")
    t = lambda *names: {"path": "o_orderpriority", "transforms": list(names)}
    found = _specs(df, ["o_orderkey"], {"head": (t("split:-:0"), "s"), "tail": ({"cases": [{"when": {"path": "o_orderpriority", "contains": "-"}, "then": t("split:-:-1")}]}, "s"), "digit": (t(r"regex:^(\d)-"), "s"), "swapped": (t("replace:URGENT:NOW"), "s"), "flagged": ({"path": "o_orderkey", "transforms": ["bits_any:4"]}, "s"), "stamped": ({"path": "o_orderkey", "transforms": ["time_unix_s"]}, "s")})
    return found.withColumn("flagged", F.col("flagged") == "true")


@query("""WITH p AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS double) AS k, json_type(props, '$.k') AS kind FROM events)
  SELECT event_id, k, CASE WHEN k IS NOT NULL THEN (k::bigint)::varchar END AS as_text, coalesce(k > 50.0::double, false) AS big, kind IS NULL OR kind = 'NULL' AS absent FROM p""")
def expr_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into schemaless records and null semantics of conditions."""
    df = table(spark, sf_dir, "events").withColumn("record", F.try_parse_json("props"))
    scope = expr.Scope(df.schema)
    v = scope.get("record.k")
    big, absent = expr.condition({"path": "record.k", "gt": 50}, scope), expr.condition({"path": "record.k", "exists": False}, scope)
    return df.select("event_id", v.num.alias("k"), F.when(v.tag.isNotNull(), v.text).alias("as_text"), big.alias("big"), absent.alias("absent"))


@query("""SELECT event_id, event_type IN ('view', 'click') AND user_id <> 7 AS a, (user_id % 2 = 0 OR value >= 50.0::double) AND NOT (event_type = 'error') AS b,
  event_type LIKE 'p%' OR contains(event_type, 'ro') AS c, regexp_matches(event_type, '^(s|e)') AS d, (user_id & 3) <> 0 AS e, user_id NOT IN (1, 2, 3) AS f FROM events""")
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of every kind."""
    df = table(spark, sf_dir, "events").withColumn("odd", F.col("user_id") % 2)
    specs = {
        "a": {"all": [{"path": "event_type", "in": ["view", "click"]}, {"path": "user_id", "ne": "7"}]},
        "b": {"all": [{"any": [{"path": "odd", "eq": 0}, {"path": "value", "gte": 50}]}, {"not": {"path": "event_type", "eq": "error"}}]},
        "c": {"any": [{"path": "event_type", "starts_with": "p"}, {"path": "event_type", "contains": "ro"}]},
        "d": {"path": "event_type", "matches": "^(s|e)"}, "e": {"path": "user_id", "bits_any": 3}, "f": {"path": "user_id", "not_in": [1, "2", 3.0]},
    }
    scope = expr.Scope(df.schema)
    return df.select("event_id", *(expr.condition(c, scope).alias(n) for n, c in specs.items()))


# --- mapping and flow (B8-B12, M*) -----------------------------------------------------

_MAPPING = {
    "reject": [{"reason": "faulty", "when": {"path": "event_type", "eq": "error"}}, {"reason": "tiny", "when": {"path": "value", "lt": 1}}],
    "rules": [
        {"name": "all", "key": "user_id", "identifiers": [{"scheme": "uid", "value": {"path": "user_id", "null_if": [7]}}], "fields": {"kinematics.speed_mps": {"path": "value", "transforms": ["knots_to_mps"]}, "name": "event_type"}},
        {"name": "views", "kind": "static", "when": {"path": "event_type", "eq": "view"}, "let": {"_a": {"path": "value", "transforms": ["scale:2"]}, "_b": {"arith": "add", "args": ["_a", {"const": 1}]}}, "key": {"template": "v{user_id}"}, "fields": {"kinematics.speed_mps": "_b"}},
    ],
}


@query("""WITH r AS (SELECT * FROM events WHERE event_type <> 'error' AND value >= 1.0::double)
  SELECT event_id, 'all' AS rule, 'observation' AS kind, user_id::varchar AS key, CASE WHEN user_id <> 7 THEN 1 ELSE 0 END AS n_ids, event_type AS name, value * 0.514444::double AS speed FROM r
  UNION ALL SELECT event_id, 'views', 'static', 'v' || user_id, 0, NULL, value * 2.0::double + 1.0::double FROM r WHERE event_type = 'view'""")
def map_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matching rule makes an observation; bindings see earlier ones (M1-M3)."""
    out = mapping.map_records(table(spark, sf_dir, "events"), _MAPPING, ("event_id",))
    return out.select("event_id", "rule", "kind", "key", F.size("identifiers").alias("n_ids"), "name", F.col("`kinematics.speed_mps`").alias("speed"))


@query("""SELECT coalesce(CASE WHEN event_type = 'error' THEN 'faulty' WHEN value < 1.0::double THEN 'tiny' END, 'kept') AS reason, count(*) AS n FROM events GROUP BY 1""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects counted by their first reason."""
    return mapping.reject(table(spark, sf_dir, "events"), _MAPPING["reject"]).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id, value FROM events WHERE user_id % 2 = 0 AND NOT (event_type = 'click' OR value > 90.0::double)""")
def filter_keep_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep_if, then drop_if."""
    df = table(spark, sf_dir, "events").withColumn("odd", F.col("user_id") % 2)
    out = mapping.keep_drop(df, {"keep_if": {"path": "odd", "eq": 0}, "drop_if": {"any": [{"path": "event_type", "eq": "click"}, {"path": "value", "gt": 90}]}})
    return out.select("event_id", "user_id", "value")


@query(f"""WITH {OBS_SQL} SELECT CASE WHEN lat >= 50.02::double AND lat <= 50.04::double AND lon >= -0.98::double AND lon <= -0.96::double THEN 'excluded area'
    WHEN NOT (lat >= 50.0::double AND lat <= 50.08::double AND (lon >= -0.995::double OR lon <= -179.0::double)) THEN 'outside areas'
    WHEN domain NOT IN ('air', 'surface', 'ground') THEN 'domain' WHEN confidence < 0.6::double THEN 'confidence' WHEN NOT speed > 2.0::double THEN 'rule' ELSE 'published' END AS reason, count(*) AS n FROM obs GROUP BY 1""")
def output_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why tracks are held back: areas (also across the antimeridian), lists, confidence, rule."""
    df = observations(spark, sf_dir)
    spec = {"exclude": [(50.02, -0.98, 50.04, -0.96)], "include": [(50.0, -0.995, 50.08, -179.0)], "domain": ["air", "surface", "ground"], "min_confidence": 0.6, "rule": {"path": "speed", "gt": 2}}
    return df.groupBy(F.coalesce(mapping.output_reason(df, spec), F.lit("published")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {OBS_SQL} SELECT event_id, CASE WHEN abs(lat * 1.797::double) > 90.0::double THEN 'latitude out of range' WHEN speed - 0.5::double < 0.0::double THEN 'negative speed'
  WHEN confidence > 0.95::double THEN 'confidence out of range' END AS reason FROM obs""")
def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid observations with their reason."""
    df = observations(spark, sf_dir)
    reason = mapping.invalid_reason(F.col("lat") * 1.797, F.col("lon"), F.col("course"), F.col("speed") - 0.5, F.when(F.col("confidence") > 0.95, 1.5).otherwise(F.col("confidence")))
    return df.select("event_id", reason.alias("reason"))


@query("""SELECT c_custkey, CASE WHEN n_name IN ('FRANCE', 'GERMANY') THEN 'friend' WHEN n_name = 'CHINA' THEN 'neutral' ELSE 'unknown' END AS affiliation
  FROM customer LEFT JOIN (SELECT n_nationkey, upper(n_name) AS n_name FROM nation) ON c_nationkey = n_nationkey""")
def affiliation_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affiliation by country lists (M9)."""
    df = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return df.select("c_custkey", mapping.affiliation(F.col("n_name"), {"friend": ["France", "Germany"], "neutral": ["China"]}, "unknown", "pending").alias("affiliation"))


@query("""SELECT event_id, user_id AS "ext.count", CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'view' END AS "ext.kind",
  CASE WHEN event_type NOT IN ('view', 'click') THEN 'kind: not enum' END AS ext_problem FROM events""")
def ext_schema_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension fields coerced, defaulted and checked (M6)."""
    df = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("ext.count"), F.col("event_type").alias("ext.kind"))
    return mapping.apply_extension(df, [{"name": "count", "type": "integer", "required": True}, {"name": "kind", "type": "enum", "values": ["view", "click"], "default": "view"}])


@query("""WITH r AS (SELECT * FROM events WHERE event_type <> 'error' AND value >= 1.0::double)
  SELECT 'fast' AS out, user_id::varchar AS key, count(*) AS n FROM r WHERE value * 0.514444::double > 20.0::double GROUP BY ALL
  UNION ALL SELECT 'all', user_id::varchar, count(*) FROM r GROUP BY ALL""")
def flow_tee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow graph with one map and two outputs."""
    only = {"mapping": _MAPPING | {"rules": _MAPPING["rules"][:1]}}
    flow = Flow({"nodes": [{"id": "in", "type": "input"}, {"id": "map", "type": "map", "config": only}, {"id": "fast", "type": "filter", "config": {"keep_if": {"path": '["kinematics.speed_mps"]', "gt": 20}}}, {"id": "out", "type": "output"}, {"id": "topic", "type": "topic"}],
                 "edges": [{"source": a, "target": b} for a, b in (("in", "map"), ("map", "fast"), ("fast", "topic"), ("map", "out"))]})
    outs = flow.outputs(table(spark, sf_dir, "events"))
    return outs["topic"].select(F.lit("fast").alias("out"), "key").union(outs["out"].select(F.lit("all"), "key")).groupBy("out", "key").agg(F.count("*").alias("n"))


# --- joins and kinematics (J*, K*) -----------------------------------------------------

MAX_AGE_US = 180_000_000


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return joins.grid_pairs(obs, obs, max_dt_us=MAX_AGE_US, earlier=True).where("a_source_id <> b_source_id and a_event_id <> b_event_id")


PAIRS_SQL = f"""{OBS_SQL}, cells AS (SELECT *, floor(lat / 0.05::double)::int AS cy, floor(lon / 0.05::double)::int AS cx FROM obs),
pairs AS (SELECT a.event_id AS a_id, b.event_id AS b_id, a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon, a.t_us AS a_t, b.t_us AS b_t, a.speed AS a_speed, b.speed AS b_speed,
    a.course AS a_course, b.course AS b_course, a.error_m AS a_error, b.error_m AS b_error, a.domain AS a_domain, b.domain AS b_domain, a.identity AS a_identity, b.identity AS b_identity, a.track_key AS a_key, a.source_id AS a_source, b.source_id AS b_source
  FROM cells a JOIN cells b ON a.t_us - b.t_us BETWEEN 0 AND {MAX_AGE_US} AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 AND a.source_id <> b.source_id AND a.event_id <> b.event_id)"""


@query(f"""WITH {PAIRS_SQL} SELECT a_id, b_id, {rsql(hav('a_lat', 'a_lon', 'b_lat', 'b_lon'), 3)} AS distance_m FROM pairs""")
def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-source neighbours in space and time, with great-circle distances."""
    d = geo.distance_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return _pairs(spark, sf_dir).select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), rnd(d).alias("distance_m"))


@query(f"""WITH {PAIRS_SQL}, d AS (SELECT *, {hav('a_lat', 'a_lon', 'b_lat', 'b_lon')} AS dist FROM pairs)
  SELECT a_id, count(*) AS n, count(*) FILTER (dist <= 500.0::double) AS near, {rsql("count(*) FILTER (dist <= 500.0::double) / (pi() * 0.25::double)", 6)} AS per_km2 FROM d GROUP BY a_id""")
def local_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other sources' reports within 500 m, per square kilometre."""
    d = geo.distance_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    near = F.count_if(d <= 500.0)
    return _pairs(spark, sf_dir).groupBy(F.col("a_event_id").alias("a_id")).agg(F.count("*").alias("n"), near.alias("near"), rnd(near / (F.pi() * 0.25), 6).alias("per_km2"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report against each nearby view of another source, the view carried to its time."""
    pairs = _pairs(spark, sf_dir)
    view = kinematics.predict(correlate.state_of("b"), (F.col("a_t_us") - F.col("b_t_us")) / 1e6)
    return kinematics.compared(pairs, correlate.state_of("a"), view)


_VMAX = "CASE {d} WHEN 'surface' THEN 40.0::double WHEN 'subsurface' THEN 40.0::double WHEN 'ground' THEN 70.0::double WHEN 'space' THEN 8000.0::double ELSE 400.0::double END"
KIN_SQL = f"""{PAIRS_SQL}, st AS (SELECT *, (a_t - b_t) / 1e6::double AS dt, (a_error / 1.1774::double) * (a_error / 1.1774::double) AS pa0, (b_error / 1.1774::double) * (b_error / 1.1774::double) AS pb0,
    a_speed * cos(radians(a_course)) AS avn, a_speed * sin(radians(a_course)) AS ave, b_speed * cos(radians(b_course)) AS bvn, b_speed * sin(radians(b_course)) AS bve, b_speed <= 1.0::double AS still FROM pairs),
pr AS (SELECT *, greatest(pa0, 25.0::double) AS pa, greatest(pb0, 25.0::double) + dt * dt + CASE WHEN still THEN 0.25::double * dt * dt ELSE 0.09::double * dt * dt * dt * dt / 4.0::double END AS pb,
    dt + CASE WHEN still THEN 0.0::double ELSE 0.09::double * dt * dt * dt / 2.0::double END AS c, 1.0::double + CASE WHEN still THEN 0.0::double ELSE 0.09::double * dt * dt END AS vb,
    b_lat + degrees(bvn * dt / 6371008.8::double) AS plat, b_lon + degrees(bve * dt / (6371008.8::double * greatest(cos(radians(b_lat)), 1e-6::double))) AS plon FROM st),
df AS (SELECT *, radians(a_lat - plat) * 6371008.8::double AS dn, radians(a_lon - plon) * 6371008.8::double * cos(radians(plat)) AS de, pa + pb AS s, 1.0::double + vb AS v FROM pr),
ch AS (SELECT *, sqrt(s) AS l, c / sqrt(s) AS k FROM df), fin AS (SELECT *, sqrt(v - k * k) AS m FROM ch),
dd AS (SELECT *, (dn / l) * (dn / l) + (de / l) * (de / l) + ((avn - bvn - k * dn / l) / m) * ((avn - bvn - k * dn / l) / m) + ((ave - bve - k * de / l) / m) * ((ave - bve - k * de / l) / m) AS d2,
    2.0::double * (2.0::double * ln(l) + 2.0::double * ln(m)) AS lndet, CASE WHEN a_domain = 'air' OR b_domain = 'air' THEN 60.0::double ELSE 15.0::double END AS spread FROM fin),
lr0 AS (SELECT *, -0.5::double * d2 - 2.0::double * ln(2.0::double * pi()) - 0.5::double * lndet - (ln(1e-6::double) - ln(pi() * spread * spread)) AS raw, d2 <= {geo.chi2_quantile(0.99, 4)!r}::double AS pass FROM dd),
lr AS (SELECT *, greatest(CASE WHEN pass THEN raw ELSE least(raw, ln(0.01::double)) END, -50.0::double) AS ln_lr FROM lr0)"""


@query(f"""WITH {KIN_SQL} SELECT a_id, b_id, {rsql('least(d2, 1e9::double)', 2)} AS d2, pass, {rsql('ln_lr', 3)} AS ln_lr FROM lr""")
def kin_log_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mahalanobis distance, gate and log likelihood ratio of every nearby pair (K6-K9)."""
    return _compared(spark, sf_dir).select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), rnd(F.col("d2"), 2).alias("d2"), F.col("pass"), rnd(F.col("ln_lr"), 3).alias("ln_lr"))


@query(f"""WITH {KIN_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY floor(ln_lr * 1000.0::double + 0.5::double) DESC, b_id) AS r FROM lr WHERE pass)
  SELECT a_id AS event_id, a_key AS track_key, b_id AS best, {rsql('1.0::double / (1.0::double + exp(-(ln(0.01::double / 0.99::double) + ln_lr)))', 6)} AS probability FROM ranked WHERE r = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: for each report the most probable other-source track nearby."""
    order = F.struct((-F.floor(F.col("ln_lr") * 1000.0 + 0.5)).alias("l"), "b_event_id")
    # The gate is judged inside the aggregate: as a filter it would be pushed below the
    # steps of the comparison and be written out with all of them.
    best = F.min_by(F.struct("b_event_id", "ln_lr"), F.when(F.col("pass"), order)).alias("b")
    found = _compared(spark, sf_dir).groupBy("a_event_id").agg(F.first("a_track_key").alias("track_key"), best).where("b is not null")
    return found.select(F.col("a_event_id").alias("event_id"), "track_key", F.col("b.b_event_id").alias("best"), rnd(kinematics.posterior(F.col("b.ln_lr")), 6).alias("probability"))


@query(f"""WITH {OBS_SQL} SELECT event_id, {rsql('lat + degrees(speed * 60.0::double * cos(radians(course)) / 6371008.8::double)', 7)} AS lat,
  {rsql('lon + degrees(speed * 60.0::double * sin(radians(course)) / (6371008.8::double * greatest(cos(radians(lat)), 1e-6::double)))', 7)} AS lon FROM obs""")
def dead_reckon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions two minutes on, extrapolated for one at most (K3)."""
    lat, lon = geo.dead_reckon(F.col("lat"), F.col("lon"), F.col("course"), F.col("speed"), F.lit(120.0), 60.0)
    return observations(spark, sf_dir).select("event_id", rnd(lat, 7).alias("lat"), rnd(lon, 7).alias("lon"))


def _same_kind(weight: float):
    """A scorer by kind of object: it knows nothing of every 13th report and cannot read every 997th."""

    def judge(pairs):
        if (pairs["b_event_id"] % 997 == 0).any():
            raise ValueError("unreadable")
        same = pairs["a_event_id"] % 3 == pairs["b_event_id"] % 3
        ratio = same.map({True: weight, False: -weight}).where(pairs["b_event_id"] % 13 != 0)
        return pairs[["pass"]].assign(ln_lr=ratio, evidence=same.map({True: "same", False: "unlike"})).assign(**{"pass": same})

    return judge


plugins.register("scorer", "same_kind", "1.0", _same_kind, {"weight": float})


@query(f"""WITH {KIN_SQL}, s AS (SELECT a_id, b_id, lr.pass, ln_lr, a_id % 3 = b_id % 3 AS same, b_id % 997 = 0 AS broken, b_id % 13 = 0 AS silent FROM lr)
  SELECT a_id, b_id, CASE WHEN broken OR silent THEN s.pass ELSE same END AS pass, CASE WHEN broken OR silent THEN {rsql('ln_lr', 3)} WHEN same THEN 2.5::double ELSE -2.5::double END AS ln_lr,
    CASE WHEN NOT broken THEN 'same_kind-1.0' END AS scorer, CASE WHEN broken THEN NULL WHEN same THEN 'same' ELSE 'unlike' END AS evidence FROM s""")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearby pairs judged by a scorer by name, the kinematics where it fails or says nothing (T27, section 2.11)."""
    pairs = _compared(spark, sf_dir).select(F.col("a_event_id"), F.col("b_event_id"), "pass", "ln_lr")
    found = plugins.score(pairs, "same_kind", weight=2.5)
    return found.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), "pass", rnd(F.col("ln_lr"), 3).alias("ln_lr"), "scorer", "evidence")


@query(f"""WITH {OBS_SQL}, p AS (SELECT *, lag(t_us) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM obs WINDOW w AS (PARTITION BY track_key ORDER BY t_us, event_id))
  SELECT event_id, {hav('lat', 'lon', 'lat0', 'lon0')} <= 10000.0::double + {_VMAX.format(d='domain')} * ((t_us - t0) / 1e6::double) AS possible FROM p WHERE t0 IS NOT NULL""")
def sanity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether successive reports under one identity can be one object (K4)."""
    w = Window.partitionBy("track_key").orderBy("t_us", "event_id")
    df = observations(spark, sf_dir).withColumns({f"{c}0": F.lag(c).over(w) for c in ("t_us", "lat", "lon")}).where("t_us0 is not null")
    d = geo.distance_m(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return df.select("event_id", kinematics.sanity_gate(d, (F.col("t_us") - F.col("t_us0")) / 1e6, F.col("domain")).alias("possible"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT event_id, error_m * error_m * cos(radians(course)) * cos(radians(course)) + 9.0::double * sin(radians(course)) * sin(radians(course)) AS nn,
    (error_m * error_m - 9.0::double) * sin(radians(course)) * cos(radians(course)) AS ne, error_m * error_m * sin(radians(course)) * sin(radians(course)) + 9.0::double * cos(radians(course)) * cos(radians(course)) AS ee, error_m FROM obs)
  SELECT event_id, {rsql('sqrt((nn + ee) / 2.0::double + sqrt(((nn - ee) / 2.0::double) * ((nn - ee) / 2.0::double) + ne * ne))', 6)} AS major, {rsql('nn', 6)} AS nn, {rsql('0.59::double * (error_m + 3.0::double)', 6)} AS cep,
    CASE WHEN error_m <= 10.0::double THEN 15 ELSE greatest(15 - ceil(log2(error_m / 10.0::double)), 0)::int END AS quality FROM c""")
def ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error ellipses to covariances and back, circular errors and quality grades."""
    df = observations(spark, sf_dir)
    nn, ne, ee = geo.ellipse_covariance(F.col("error_m"), F.lit(3.0), F.col("course"))
    major, _, _ = geo.covariance_ellipse(nn, ne, ee)
    return df.select("event_id", rnd(major, 6).alias("major"), rnd(nn, 6).alias("nn"), rnd(geo.circular_error(F.col("error_m"), F.lit(3.0)), 6).alias("cep"), geo.track_quality(F.col("error_m")).alias("quality"))


@query(f"""WITH {OBS_SQL} SELECT event_id, (lat - 49.99995::double) / 0.10035::double + (lon + 1.00005::double) / 0.10005::double < 1.0::double AS inside FROM obs""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ray casting in a triangle, on whose sides no position lies; the SQL states its third side."""
    corners = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((49.99995, -1.00005), (50.1003, -1.00005), (49.99995, -0.9))))
    return observations(spark, sf_dir).select("event_id", geo.inside_polygon(F.col("lat"), F.col("lon"), corners).alias("inside"))


@query("""WITH RECURSIVE m AS (SELECT o_orderkey AS t, 'a' || (o_orderkey // 4) AS i FROM orders WHERE o_orderkey % 4 < 3 UNION SELECT o_orderkey, 'b' || ((o_orderkey + 2) // 4) FROM orders WHERE o_orderkey % 20 > 6),
  r AS (SELECT t, t AS other FROM m UNION SELECT r.t, b.t FROM r JOIN m a ON a.t = r.other JOIN m b ON b.i = a.i)
  SELECT o_orderkey::varchar AS track, coalesce(min(lpad(r.other::varchar, 12, '0')), lpad(o_orderkey::varchar, 12, '0')) AS component FROM orders LEFT JOIN r ON r.t = o_orderkey GROUP BY o_orderkey""")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that share identities, through chains of others, are one object."""
    k = F.col("o_orderkey")
    name = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    ids = F.array_compact(F.array(F.when(k % 4 < 3, name("a", F.expr("o_orderkey div 4"))), F.when(k % 20 > 6, name("b", F.expr("(o_orderkey + 2) div 4")))))
    rows = table(spark, sf_dir, "orders").select(F.lpad(k.cast("string"), 12, "0").alias("track"), F.explode_outer(ids).alias("identity"))
    return joins.identity_components(rows).select(F.col("track").cast("long").cast("string").alias("track"), "component")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held FROM events""")
def static_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest static value of a key carried to its later reports."""
    df = table(spark, sf_dir, "events").withColumn("held", F.when(F.col("event_type") == "signup", F.col("value")))
    return joins.last_known(df, ["user_id"], ["ts", "event_id"], ["held"]).select("event_id", "held")


# --- registry (M10-M12, A5, A18, A19) --------------------------------------------------


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer")
    entities = customers.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("H-0"), F.col("c_custkey").cast("string"))).alias("hull"), F.when(F.col("c_custkey") % 7 == 0, "a-f-S-C").alias("cot_type"))
    ids = customers.select(F.col("c_custkey").alias("entity_id"), F.lit("uid").alias("scheme"), (F.col("c_custkey") % 400).cast("string").alias("value"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("expected_name"))
    return entities, ids


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'ship ' || c_custkey WHEN 2 THEN 'warship' ELSE NULL END AS live, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey),
  g AS (SELECT o_orderkey, CASE WHEN live IS NULL THEN 'stale' WHEN c_custkey % 3 = 0 AND upper(live) = upper(c_name) THEN 'exact'
    WHEN c_custkey % 5 = 0 AND (o_orderkey % 4 = 1 AND c_custkey > 0 OR (o_orderkey % 4 = 0 AND regexp_extract(c_name, '(\\d+)$', 1) IN ('0' || c_custkey, c_custkey::varchar))) THEN 'hull'
    WHEN o_orderkey % 4 = 0 THEN 'name' WHEN o_orderkey % 4 = 1 THEN 'stale' WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'generic' ELSE 'stale' END AS grade FROM o) SELECT grade, count(*) AS n FROM g GROUP BY grade""")
def registry_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadcast names graded against their entities."""
    entities, ids = _registry(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").join(entities, F.col("o_custkey") == F.col("entity_id")).join(ids.select("entity_id", "expected_name"), "entity_id")
    live = F.when(F.col("o_orderkey") % 4 == 0, F.col("entity_name")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("ship "), F.col("entity_id").cast("string"))).when(F.col("o_orderkey") % 4 == 2, "warship")
    grade = registry.grade(live, F.col("expected_name"), F.col("entity_name"), F.col("hull"), F.col("cot_type"), generic=("SHIP", "WARSHIP"), markers=("WARSHIP",), military_cot="^a-f-S")
    return orders.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT user_id FROM events), m AS (SELECT user_id, c_custkey, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN c_custkey % 3 = 0 AND c_custkey = user_id THEN 1 ELSE 5 END, c_custkey) AS r
    FROM e LEFT JOIN customer ON c_custkey % 400 = user_id) SELECT user_id, c_custkey AS entity_id, CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey % 3 = 0 AND c_custkey = user_id THEN 'exact' ELSE 'stale' END AS grade FROM m WHERE r = 1""")
def registry_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's entity by identifier, the strongest grade first."""
    entities, ids = _registry(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("said"))
    users = table(spark, sf_dir, "events").select("user_id").distinct().join(customers, "user_id", "left").withColumn("key", F.concat(F.lit("uid:"), F.col("user_id").cast("string")))
    keys = ids.select(F.concat("scheme", F.lit(":"), "value").alias("key"), "entity_id", "expected_name")
    plain = entities.withColumns({"hull": F.lit(None).cast("string"), "entity_name": F.lit("")})
    return registry.link(users, keys, plain, row="user_id", key="key", name="said").select("user_id", "entity_id", "grade")


#: Reports of orders linked to customers; of these every tenth is saved with another name, every twentieth without one.
@query("""WITH s AS (SELECT o_orderkey AS track, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN c_name ELSE 'SHIP ' || o_orderkey END AS said, c_custkey AS e, c_name AS old, o_orderkey % 4 > 0 AS sure FROM orders JOIN customer ON o_custkey = c_custkey),
  a AS (SELECT *, CASE WHEN sure THEN old ELSE said END AS was, sure AND coalesce(said <> old, false) AS over FROM s), n AS (SELECT *, CASE WHEN over THEN said ELSE was END AS back, CASE WHEN e % 20 > 0 THEN 'RENAMED ' || e END AS new FROM a WHERE e % 10 = 0),
  z AS (SELECT *, CASE WHEN sure AND new IS NOT NULL THEN new ELSE back END AS name, CASE WHEN sure AND coalesce(back <> new, false) THEN back END AS reported FROM n)
  SELECT track, name, reported FROM z WHERE name IS DISTINCT FROM was OR reported IS DISTINCT FROM CASE WHEN over THEN said END OR (reported IS NOT NULL AND new IS DISTINCT FROM old)""")
def entity_reapplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edit of entities changes in the reports linked to them."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == c)
    said = F.when(k % 3 == 1, F.col("c_name")).when(k % 3 == 2, F.concat(F.lit("SHIP "), k.cast("string")))
    state = registry.apply_entity(both.select(k.alias("track"), said.alias("name"), c.alias("entity_id"), F.col("c_name").alias("entity_name"), (k % 4 > 0).alias("sure")), {"name": "entity_name"}, "sure").drop("entity_name")
    saved = table(spark, sf_dir, "customer").where(c % 10 == 0).select(c.alias("entity_id"), F.when(c % 20 > 0, F.concat(F.lit("RENAMED "), c.cast("string"))).alias("entity_name"))
    out = registry.reapplied(state, saved, {"name": "entity_name"}, "sure")
    return out.select("track", "name", F.get("overrides", 0)["reported"].alias("reported"))


_SHEET = """r AS (SELECT c_custkey AS row, CASE c_custkey % 4 WHEN 0 THEN 'E' || c_custkey % 700 WHEN 1 THEN CASE WHEN c_custkey % 5 = 0 THEN 'no id' END END AS given, CASE WHEN c_custkey % 6 = 0 THEN ['mmsi:' || c_custkey % 500, 'imo:' || c_custkey % 450] ELSE ['mmsi:' || c_custkey % 500] END AS keys FROM customer),
  i AS (SELECT 'mmsi:' || c_custkey AS key, 'E' || c_custkey AS holder FROM customer WHERE c_custkey < 300 UNION ALL SELECT 'imo:' || c_custkey, 'E' || c_custkey FROM customer WHERE c_custkey < 200 AND c_custkey % 2 = 0),
  x AS (SELECT row, unnest(keys) AS key FROM r), h AS (SELECT x.*, holder FROM x LEFT JOIN i USING (key)),
  o AS (SELECT row, list_sort(list(DISTINCT holder) FILTER (holder IS NOT NULL)) AS owners FROM h GROUP BY row),
  w AS (SELECT r.*, owners, CASE WHEN given IS NULL THEN CASE WHEN len(owners) = 1 THEN owners[1] END WHEN given <> 'no id' THEN given END AS wanted FROM r LEFT JOIN o USING (row)),
  p AS (SELECT w.*, e.c_custkey IS NOT NULL AS known, CASE WHEN e.c_custkey IS NOT NULL THEN wanted ELSE coalesce(given, 'new-' || row) END AS target FROM w LEFT JOIN customer e ON e.c_custkey < 600 AND wanted = 'E' || e.c_custkey)"""


@query(f"""WITH {_SHEET} SELECT row, target, known FROM p""")
def sheet_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity that each row of an imported sheet goes to."""
    return registry.matched_sheet(*_imported(spark, sf_dir))[0]


@query(f"""WITH {_SHEET} SELECT row, 'entity_id' AS kind, given AS detail FROM p WHERE given = 'no id' UNION ALL SELECT row, 'different_entities', array_to_string(owners, ',') FROM p WHERE given IS NULL AND len(owners) > 1
  UNION ALL SELECT row, 'held', key || ' by ' || holder FROM h JOIN p USING (row) WHERE holder <> target
  UNION ALL SELECT row, 'entity_again', target || ' in row ' || b FROM (SELECT row, target, lag(row) OVER (PARTITION BY target ORDER BY row) AS b FROM p) WHERE b IS NOT NULL
  UNION ALL SELECT row, 'identifier_again', key || ' in row ' || b FROM (SELECT row, key, lag(row) OVER (PARTITION BY key ORDER BY row) AS b FROM x) WHERE b IS NOT NULL""")
def sheet_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps rows of an imported sheet from being taken."""
    return registry.matched_sheet(*_imported(spark, sf_dir))[1]


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    of = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    given = F.when(k % 4 == 0, of("E", k % 700)).when((k % 4 == 1) & (k % 5 == 0), "no id")
    keys = F.when(k % 6 == 0, F.array(of("mmsi:", k % 500), of("imo:", k % 450))).otherwise(F.array(of("mmsi:", k % 500)))
    rows = c.select(k.alias("row"), given.alias("entity_id"), keys.alias("keys"))
    ids = c.where(k < 300).select(of("mmsi:", k).alias("key"), of("E", k).alias("entity_id")).union(c.where((k < 200) & (k % 2 == 0)).select(of("imo:", k), of("E", k)))
    return rows, ids, c.where(k < 600).select(of("E", k).alias("entity_id"))


@query("""WITH f AS (SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '11') OR contains(c_custkey::varchar, '11') OR contains((c_custkey % 400)::varchar, '11'))
  SELECT c_custkey AS entity_id, c_name AS entity_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY c_name, c_custkey LIMIT 20 OFFSET 5""")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search over names, ids and identifiers, with the total."""
    entities, ids = _registry(spark, sf_dir)
    return registry.search(entities, ids, "11", limit=20, offset=5).select("entity_id", "entity_name", "total")


@query("""SELECT c_custkey AS entity_id, string_agg(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, '; ' ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS "id:F",
    string_agg(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, '; ' ORDER BY CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS "id:O" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def registry_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet form of the registry: a column for each scheme."""
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderstatus").alias("scheme"), F.col("o_orderpriority").alias("value"))
    return registry.sheet(entities, ids, ["F", "O"])


# --- fusion (K15-K25) ------------------------------------------------------------------


@query(f"""WITH {OBS_SQL}, latest AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY track_key, source_id ORDER BY t_us DESC, event_id DESC) = 1),
  c AS (SELECT *, max(t_us) OVER (PARTITION BY track_key) - t_us <= 3600000000 AS fresh, CASE source_id WHEN 'view' THEN 200 ELSE 100 END AS priority, identity IS NOT NULL AND event_id % 2 = 0 AS corroborated FROM latest),
  p AS (SELECT * FROM c WHERE fresh QUALIFY row_number() OVER (PARTITION BY track_key ORDER BY error_m, priority DESC, t_us DESC, source_id) = 1),
  n AS (SELECT track_key, identity FROM c WHERE identity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_key ORDER BY corroborated DESC, priority DESC, t_us DESC, source_id) = 1)
  SELECT p.track_key, p.event_id AS position_event, p.source_id AS position_from, n.identity AS name, (SELECT count(*) FROM c WHERE c.track_key = p.track_key) AS contributors FROM p LEFT JOIN n USING (track_key)""")
def best_view_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best view of each track over its sources' latest reports."""
    obs = observations(spark, sf_dir)
    latest = obs.groupBy("track_key", "source_id").agg(F.max(F.struct("t_us", "event_id", *(c for c in obs.columns if c not in ("t_us", "event_id", "track_key", "source_id")))).alias("r")).select("track_key", F.col("source_id").alias("source"), "r.*")
    rows = latest.withColumns({"priority": F.when(F.col("source") == "view", 200).otherwise(100), "corroborated": F.col("identity").isNotNull() & (F.col("event_id") % 2 == 0), "cot_type": F.lit("a-f-S"), "name": F.col("identity")})
    view = fusion.best_view(rows, track="track_key", window_us=3_600_000_000)
    ids = latest.select("track_key", F.col("source").alias("position_from"), F.col("event_id").alias("position_event"))
    return view.join(ids, ["track_key", "position_from"]).select("track_key", "position_event", "position_from", "name", "contributors")


@query(f"""WITH {OBS_SQL} SELECT track_key, {rsql('1.0::double - exp(sum(ln(1.0::double - 0.9::double * c)))', 6)} AS confidence FROM (SELECT track_key, source_id, max(confidence) AS c FROM obs GROUP BY ALL) GROUP BY track_key""")
def track_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a track from its contributors' (K18)."""
    per = observations(spark, sf_dir).groupBy("track_key", "source_id").agg(F.max("confidence").alias("c"))
    return per.groupBy("track_key").agg(F.array_sort(F.collect_list(0.9 * F.col("c"))).alias("x")).select("track_key", rnd(fusion.track_confidence(F.col("x")), 6).alias("confidence"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'UNCLASSIFIED' WHEN 1 THEN 'RESTRICTED' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'SECRET' END AS c, o_orderkey % 4 AS r FROM orders)
  SELECT o_custkey, arg_max(c, r) AS label, string_agg(DISTINCT o_orderstatus, '/' ORDER BY o_orderstatus) AS restrictions FROM l JOIN orders USING (o_custkey, o_orderkey) GROUP BY o_custkey""")
def label_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security labels combined: the highest class, every restriction."""
    df = table(spark, sf_dir, "orders")
    label = F.element_at(F.array(*map(F.lit, fusion.CLASSES[:4])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = df.select("o_custkey", label.alias("label"), F.array("o_orderstatus").alias("restrictions"), F.array(F.lit("NATO")).alias("sharing"))
    return fusion.combine_labels(rows, ["o_custkey"], "label", "restrictions", "sharing").select("o_custkey", "label", F.array_join("restrictions", "/").alias("restrictions"))


@query(f"""WITH {OBS_SQL} SELECT event_id, 'a-' || CASE event_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'h' ELSE 'u' END || '-' || CASE domain WHEN 'air' THEN 'A' WHEN 'surface' THEN 'S' WHEN 'ground' THEN 'G' ELSE 'U' END AS cot,
  domain AS back FROM obs""")
def cot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CoT types from affiliation and domain, and back."""
    affiliation = F.when(F.col("event_id") % 3 == 0, "friend").when(F.col("event_id") % 3 == 1, "hostile").otherwise("unknown")
    cot = fusion.cot_type(affiliation, F.col("domain"))
    return observations(spark, sf_dir).select("event_id", cot.alias("cot"), fusion.cot_parts(cot)[1].alias("back"))


@query(f"""WITH {OBS_SQL}, g AS (SELECT *, track_key::bigint % 50 AS g FROM obs), m AS (SELECT g, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z, count(*) AS members FROM g GROUP BY g),
  d AS (SELECT g, domain, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, domain) AS r FROM g GROUP BY g, domain)
  SELECT g, {rsql('degrees(atan2(z, sqrt(x * x + y * y)))', 5)} AS lat, {rsql('degrees(atan2(y, x))', 5)} AS lon, d.domain, members FROM m JOIN d USING (g) WHERE r = 1""")
def group_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tracks: spherical centroid and most common domain."""
    df = observations(spark, sf_dir).withColumn("g", F.col("track_key").cast("long") % 50)
    return fusion.group_view(df, "g").select("g", rnd(F.col("lat"), 5).alias("lat"), rnd(F.col("lon"), 5).alias("lon"), "domain", "members")


# --- folds (T*) ------------------------------------------------------------------------

_OUT = "event_id long, source_id string, track_key string, t_us long, lat double, lon double, speed double, course double, error_m double, domain string"
_IN = ("event_id", "source_id", "track_key", "t_us", "lat", "lon", "speed", "course", "error_m", "domain")


@query(f"""WITH RECURSIVE {OBS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY track_key ORDER BY t_us, event_id) AS r FROM obs),
  f AS (SELECT track_key, r, t_us AS last, true AS kept, event_id FROM o WHERE r = 1 UNION ALL
    SELECT o.track_key, o.r, CASE WHEN o.t_us - f.last >= 7200000000 THEN o.t_us ELSE f.last END, o.t_us - f.last >= 7200000000, o.event_id FROM f JOIN o ON o.track_key = f.track_key AND o.r = f.r + 1)
  SELECT event_id, track_key FROM f WHERE kept""")
def throttle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports let through at least two hours apart."""
    fold = folds.throttle(_OUT, min_interval_us=7_200_000_000)
    return folds.run(observations(spark, sf_dir).select(*_IN), fold, ["track_key"], ["t_us", "event_id"]).select("event_id", "track_key")


@query(f"""WITH RECURSIVE {OBS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY track_key ORDER BY t_us, event_id) AS r FROM obs),
  f AS (SELECT track_key, r, t_us AS last, event_id, event_id AS first FROM o WHERE r = 1 UNION ALL
    SELECT o.track_key, o.r, CASE WHEN o.t_us = f.last OR o.t_us - f.last >= 3600000000 THEN o.t_us ELSE f.last END, CASE WHEN o.t_us = f.last OR o.t_us - f.last >= 3600000000 THEN o.event_id ELSE f.event_id END, 0 FROM f JOIN o ON o.track_key = f.track_key AND o.r = f.r + 1)
  SELECT track_key, last AS t_us, arg_max(event_id, r) AS event_id FROM f GROUP BY track_key, last""")
def history_gap_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History points an hour apart at least; a point of the same time replaces."""
    fold = folds.gap_filter(_OUT, least_us=3_600_000_000)
    return folds.run(observations(spark, sf_dir).select(*_IN), fold, ["track_key"], ["t_us", "event_id"]).select("track_key", "t_us", "event_id")


@query(f"""WITH {OBS_SQL}, p AS (SELECT track_key AS track, t_us, event_id, lag(t_us) OVER w AS t0,
    CASE lag(domain) OVER w WHEN 'air' THEN 60 WHEN 'surface' THEN 900 WHEN 'subsurface' THEN 1800 ELSE 900 END * 1000000 AS quiet FROM obs WINDOW w AS (PARTITION BY track_key ORDER BY t_us, event_id)),
  g AS (SELECT *, coalesce(t_us - t0 >= quiet, false) AS lost, coalesce(t_us - t0 >= 21600000000, false) AS gone, sum((coalesce(t_us - t0 >= 21600000000, false))::int) OVER (PARTITION BY track ORDER BY t_us, event_id) AS life FROM p),
  n AS (SELECT *, row_number() OVER (PARTITION BY track, life ORDER BY t_us, event_id) >= 3 AS sure FROM g),
  c AS (SELECT *, lag(sure) OVER (PARTITION BY track ORDER BY t_us, event_id) AS was FROM n)
  SELECT track, t0 + quiet AS t_us, 'lost' AS state FROM c WHERE lost UNION ALL SELECT track, t0 + 21600000000, 'dropped' FROM c WHERE gone
  UNION ALL SELECT track, t_us, CASE WHEN sure THEN 'confirmed' ELSE 'tentative' END FROM c WHERE lost OR gone OR was IS NULL OR was <> sure""")
def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tentative, confirmed, lost and dropped, in event time."""
    rows = observations(spark, sf_dir).select("t_us", "event_id", "domain", F.col("track_key").alias("track"))
    return folds.lifecycle_changes(rows)


@query(f"""WITH RECURSIVE {OBS_SQL}, o AS (SELECT track_key, t_us, event_id + 1 AS event_id, event_id % 10 = 9 AS urgent, row_number() OVER (PARTITION BY track_key ORDER BY t_us, event_id) AS r FROM obs),
  f AS (SELECT track_key, r, t_us AS last, 0::bigint AS held, 0::bigint AS out_id, 0::bigint AS out_t, false AS out_urgent, 0::bigint AS out_at, event_id AS now_id, t_us AS now_t, urgent AS now_urgent, 0::bigint AS held_t, false AS held_urgent FROM o WHERE r = 1
    UNION ALL SELECT track_key, r, CASE WHEN goes THEN t_us WHEN due THEN last + gap ELSE last END, CASE WHEN goes THEN 0 ELSE event_id END,
      CASE WHEN due THEN held ELSE 0 END, held_t, held_urgent, last + gap, CASE WHEN goes THEN event_id ELSE 0 END, t_us, urgent, CASE WHEN goes THEN 0 ELSE t_us END, CASE WHEN goes THEN false ELSE urgent END
    FROM (SELECT *, urgent OR t_us >= CASE WHEN due THEN last + 2 * gap ELSE last + gap END AS goes FROM (
      SELECT f.track_key, o.r, o.t_us, o.event_id, o.urgent, f.last, f.held, f.held_t, f.held_urgent, f.held > 0 AND o.t_us >= f.last + 3600000000 AS due, 3600000000 AS gap FROM f JOIN o ON o.track_key = f.track_key AND o.r = f.r + 1) x) y)
  SELECT track_key, now_t AS t_us, now_id AS event_id, now_urgent AS urgent, now_t AS published_us FROM f WHERE now_id > 0
  UNION ALL SELECT track_key, out_t, out_id, out_urgent, out_at FROM f WHERE out_id > 0
  UNION ALL SELECT track_key, held_t, held, held_urgent, last + 3600000000 FROM f WHERE held > 0 AND r = (SELECT max(r) FROM o WHERE o.track_key = f.track_key)""")
def writer_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one message in an hour for each track, urgent ones at once."""
    rows = observations(spark, sf_dir).select("track_key", "t_us", (F.col("event_id") + 1).alias("event_id"), (F.col("event_id") % 10 == 9).alias("urgent"))
    return folds.run(rows, folds.coalesce_writes("track_key string, t_us long, event_id long, urgent boolean, published_us long", gap_us=3_600_000_000), ["track_key"], ["t_us", "event_id"])


_STATE = "CASE WHEN event_id % 40 = 0 THEN 'lost' ELSE 'confirmed' END"
_EARTH = "6371008.8::double"


@query(f"""WITH RECURSIVE {OBS_SQL}, o AS (SELECT *, {_STATE} AS state, row_number() OVER (PARTITION BY track_key ORDER BY t_us, event_id) AS r FROM obs),
  f AS (SELECT track_key, r, event_id, true AS sent, t_us, lat, lon, course, speed, state FROM o WHERE r = 1 UNION ALL
    SELECT track_key, r, event_id, due, CASE WHEN due THEN t_us ELSE t0 END, CASE WHEN due THEN lat ELSE lat0 END, CASE WHEN due THEN lon ELSE lon0 END, CASE WHEN due THEN course ELSE course0 END, CASE WHEN due THEN speed ELSE speed0 END, CASE WHEN due THEN state ELSE state0 END
    FROM (SELECT *, state <> state0 OR t_us - t0 >= 36000000000 OR {_EARTH} * sqrt(n * n + e * e) > greatest(CASE WHEN domain IN ('air', 'space') THEN 200.0::double ELSE 50.0::double END, error_m) AS due
      FROM (SELECT *, radians(lat) - plat AS n, (radians(lon) - plon) * cos((radians(lat) + plat) / 2.0::double) AS e
        FROM (SELECT *, radians(lat0) + way * cos(radians(course0)) AS plat, radians(lon0) + way * sin(radians(course0)) / greatest(cos(radians(lat0)), 1e-6::double) AS plon
          FROM (SELECT o.*, f.t_us AS t0, f.lat AS lat0, f.lon AS lon0, f.course AS course0, f.speed AS speed0, f.state AS state0, f.speed * ((o.t_us - f.t_us) / 1e6::double) / {_EARTH} AS way
            FROM f JOIN o ON o.track_key = f.track_key AND o.r = f.r + 1) a) b) c) d)
  SELECT o.event_id, o.track_key, o.t_us FROM f JOIN o USING (track_key, r) WHERE f.sent""")
def send_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that peers need because their dead reckoning is off."""
    rows = observations(spark, sf_dir).select(*_IN, F.when(F.col("event_id") % 40 == 0, "lost").otherwise("confirmed").alias("state"))
    return folds.run(rows, folds.send_rule("event_id long, track_key string, t_us long", heartbeat_us=36_000_000_000), ["track_key"], ["t_us", "event_id"])


@query(f"""WITH RECURSIVE {KIN_SQL}, q AS (SELECT a_source || '/' || a_key || '+' || b_source || '/' || b_key AS pair, a_t AS t_us, b_t AS other_us, ln_lr, NOT pass AS outside, a_id, b_id FROM lr),
  z AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t_us, other_us, a_id, b_id) AS r FROM q),
  f AS (SELECT pair, r, t_us AS ua, other_us AS ub, [{{'t': t_us, 'v': ln_lr, 'o': outside}}] AS held, true AS counts, t_us FROM z WHERE r = 1 UNION ALL
    SELECT pair, r, CASE WHEN share > 0 THEN t_us ELSE ua END, CASE WHEN share > 0 THEN other_us ELSE ub END,
      CASE WHEN share > 0 THEN list_filter(list_append(held, {{'t': t_us, 'v': ln_lr * share, 'o': outside}})[-5:], lambda x: x.t >= t_us - 30000000) ELSE held END, share > 0, t_us
    FROM (SELECT z.pair, z.r, z.t_us, z.other_us, z.ln_lr, z.outside, f.ua, f.ub, f.held,
        CASE WHEN z.t_us - f.held[-1].t < 3000000 OR z.t_us <= f.ua THEN 0.0::double WHEN z.other_us > f.ub THEN 1.0::double WHEN z.t_us - f.held[-1].t >= 10000000 THEN 0.5::double ELSE 0.0::double END AS share
      FROM f JOIN z ON z.pair = f.pair AND z.r = f.r + 1) x)
  SELECT pair, t_us, {rsql('list_sum(list_transform(held, lambda x: x.v))', 2)} AS sum_ln_lr, len(held)::bigint AS comparisons, len(list_filter(held, lambda x: x.o))::bigint AS n_outside FROM f WHERE counts""".replace("b_domain, a.identity", "b_domain, b.track_key AS b_key, a.identity"))
def evidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for every pair of tracks summed over its last comparisons."""
    name = lambda side: F.concat(f"{side}_source_id", F.lit("/"), f"{side}_track_key")
    rows = _compared(spark, sf_dir).select(F.concat(name("a"), F.lit("+"), name("b")).alias("pair"), F.col("a_t_us").alias("t_us"), F.lit("a").alias("side"), F.col("b_t_us").alias("other_us"), "ln_lr", F.lit(0.5).alias("weight"), (~F.col("pass")).alias("outside"), "a_event_id", "b_event_id")
    out = folds.evidence(rows, ["pair"], ["t_us", "other_us", "a_event_id", "b_event_id"])
    return out.select("pair", "t_us", rnd(F.col("sum_ln_lr"), 2).alias("sum_ln_lr"), "comparisons", "n_outside")


def _plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymous plots of one radar for every four customers' ships, whose orders are its scans."""
    o = table(spark, sf_dir, "orders")
    ship, k = F.col("o_custkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    jitter = lambda n: (F.pmod(F.xxhash64("o_orderkey", F.lit(n)), F.lit(101)) - 50) * 1e-6
    at = o.select("o_orderkey", ship.alias("truth_id"), k.alias("k"))
    lat, lon = 54.0 + (F.col("truth_id") % 4) / 100.0 + F.col("k") * 1e-4, F.lit(3.0)
    return at.select(F.concat(F.lit("radar"), F.expr("truth_id div 4").cast("string")).alias("source_id"), (F.col("k") * 2_500_000).cast("long").alias("t_us"), (lat + jitter(1)).alias("lat"), (lon + jitter(2)).alias("lon"), F.lit(10.0).alias("error_m"), "truth_id", lat.alias("true_lat"), lon.alias("true_lon"))


@query()
def gnn_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from anonymous plots, one scan at a time."""
    return trackers.form_tracks(_plots(spark, sf_dir).select("source_id", "t_us", "lat", "lon", "error_m"))


@query()
def gnn_gospa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GOSPA of the tracks of a radar against where its ships are, scan by scan (Q3)."""
    seen = _plots(spark, sf_dir)
    tracks = trackers.form_tracks(seen.select("source_id", "t_us", "lat", "lon", "error_m")).where("state = 'confirmed'")
    moment = lambda df: df.withColumn("t_us", F.xxhash64("source_id", "t_us"))
    truth = moment(seen).select("t_us", "truth_id", F.col("true_lat").alias("lat"), F.col("true_lon").alias("lon"))
    return scoring.gospa(truth, moment(tracks).select("t_us", F.col("track_key").alias("track"), "lat", "lon"))


# --- analytics (A*, T24-T25, P2) -------------------------------------------------------


@query("""SELECT source_id, minute, n, tracks, CAST(total AS double) AS total FROM (SELECT event_type AS source_id, floor(epoch_us(ts) / 60000000)::bigint AS minute, count(*) AS n, count(DISTINCT user_id) AS tracks, floor(sum(value) * 100.0::double + 0.5::double) / 100.0::double AS total FROM events GROUP BY ALL)""")
def metrics_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every source and minute (A2)."""
    df = observations(spark, sf_dir).withColumn("value", F.lit(0.0)).drop("value").join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return analytics.per_minute(df, ["source_id"], {"n": F.count("*"), "tracks": F.count_distinct("track_key"), "total": rnd(F.sum("value"), 2)})


@query("""WITH b AS (SELECT min(floor(epoch_us(ts) / 60000000)::bigint) AS lo, max(floor(epoch_us(ts) / 60000000)::bigint) AS hi FROM events), c AS (SELECT event_type AS source_id, floor(epoch_us(ts) / 60000000)::bigint AS minute, count(*) AS n FROM events GROUP BY ALL)
  SELECT s.source_id, lo + i AS minute, coalesce(n, 0)::bigint AS n FROM (SELECT DISTINCT event_type AS source_id FROM events) s CROSS JOIN b, LATERAL range(0, hi - lo + 1) r(i) LEFT JOIN c ON c.source_id = s.source_id AND c.minute = lo + i WHERE lo + i <= hi""")
def metrics_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every minute from the first to the last for every source, absent ones zero (A2)."""
    counts = analytics.per_minute(observations(spark, sf_dir), ["source_id"], {"n": F.count("*")})
    first, last = counts.agg(F.min("minute"), F.max("minute")).first()
    return analytics.zero_filled(counts, ["source_id"], first, last, ["n"])


@query("""SELECT event_type AS source_id, floor(epoch_us(ts) / 60000000)::bigint AS minute, arg_max(value, (epoch_us(ts), event_id)) AS value FROM events GROUP BY ALL""")
def gauges_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value in each minute wins (A3)."""
    df = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "value")
    return analytics.last_gauge(df, ["source_id"], "value")


@query(f"""WITH {OBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY track_key ORDER BY t_us DESC, event_id DESC) AS k FROM obs) SELECT track_key, t_us, event_id, lat FROM r WHERE k <= 20""")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest points of each track, ascending."""
    return analytics.history(observations(spark, sf_dir), track="track_key", since=0, until=1 << 62, limit=20).select("track_key", "t_us", "event_id", "lat")


@query("""SELECT user_id::varchar AS track_key, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def compacted_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest message of each subject."""
    df = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("track_key"), "ts", "event_id", "value")
    return analytics.latest(df, "track_key", ["ts", "event_id"]).select("track_key", "event_id", "value")


@query("""WITH l AS (SELECT DISTINCT o_custkey % 20 AS site, o_orderkey AS seq FROM orders), g AS (SELECT site, seq, coalesce(lag(seq) OVER (PARTITION BY site ORDER BY seq), 0) AS b FROM l) SELECT site, b + 1 AS from_seq, seq - 1 AS to_seq FROM g WHERE seq > b + 1""")
def sync_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing ranges of each site's log."""
    return analytics.gaps(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("site"), F.col("o_orderkey").alias("seq")))


@query("""WITH l AS (SELECT o_orderkey, o_custkey AS subject, epoch_ms(o_orderdate) * 65536 + o_orderkey % 100 AS hlc, o_orderkey::varchar AS site FROM orders)
  SELECT o_orderkey, hlc, CASE WHEN row_number() OVER (PARTITION BY subject ORDER BY hlc DESC, site DESC) = 1 THEN 'applied' ELSE 'superseded' END AS status FROM l""")
def sync_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest command on a subject stands."""
    ms = F.expr("unix_millis(cast(o_orderdate as timestamp))")
    log = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), analytics.hlc(ms, F.col("o_orderkey") % 100).alias("hlc"), F.col("o_orderkey").cast("string").alias("site"))
    return analytics.judge(log).select("o_orderkey", "hlc", "status")


@query("""SELECT '$.k' AS path, count(*) AS n, count(*) AS numbers, 0::bigint AS strings, least(count(DISTINCT json_extract_string(props, '$.k')), 1000)::bigint AS n_distinct, min(json_extract_string(props, '$.k')::double) AS least, max(json_extract_string(props, '$.k')::double) AS most
  FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def probe_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records hold: types, presence, distinct values and ranges by path."""
    return analytics.probe(table(spark, sf_dir, "events"), "props").withColumn("n_distinct", F.col("n_distinct").cast("long"))


@query("""SELECT event_id, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 8 PRECEDING) AS median FROM events""")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a key's last nine values."""
    return analytics.running_median(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "median")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose hashes are those of its rows but for every 1000th, and which lacks every 777th."""
    own = lambda k: F.sha2(k.cast("string"), 256)
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("seq"), own(k - 1).alias("prev_hash"), F.col("o_orderstatus").alias("content"))
    rows = rows.withColumn("hash", F.sha2(F.concat("prev_hash", "content"), 256)).withColumn("hash", F.when(F.col("seq") % 1000 == 0, F.lit("x")).otherwise(F.col("hash")))
    return rows.where(F.col("seq") % 777 != 0)


@query("""WITH r AS (SELECT o_orderkey AS seq, sha256((o_orderkey - 1)::varchar) AS prev_hash, o_orderstatus AS content FROM orders WHERE o_orderkey % 777 <> 0),
  h AS (SELECT *, CASE WHEN seq % 1000 = 0 THEN 'x' ELSE sha256(prev_hash || content) END AS hash FROM r), w AS (SELECT *, lag(seq) OVER (ORDER BY seq) AS s0, lag(hash) OVER (ORDER BY seq) AS h0 FROM h)
  SELECT CASE WHEN seq <> s0 + 1 THEN 'gap' WHEN prev_hash <> h0 THEN 'link' WHEN hash <> sha256(prev_hash || content) THEN 'hash' END AS problem, count(*) AS n FROM w GROUP BY 1""")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash chain checked for gaps, broken links and changed rows."""
    return analytics.chained(_audit(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"))


# --- graph (A14, A16, commands) --------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from orders: contributions of customers to tracks, and merges of tracks."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    merge = k % 9 == 0
    return o.select(
        k.alias("edge_id"), F.when(merge, "MERGED_INTO").otherwise("CONTRIBUTES_TO").alias("kind"),
        F.when(merge, F.concat(F.lit("T"), (k % 300).cast("string"))).otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("src"),
        F.concat(F.lit("T"), F.when(merge, (k % 300).cast("long") / F.lit(2)).otherwise((k % 300).cast("double")).cast("long").cast("string")).alias("dst"),
        (k * 10).alias("valid_from"), F.when(k % 4 == 0, k * 10 + 5000).alias("valid_to"), (k % 1000).alias("decision_id"), F.when(k % 4 == 0, k % 77).alias("ended_by"),
    )


EDGES_SQL = """edges AS (SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 9 = 0 THEN 'MERGED_INTO' ELSE 'CONTRIBUTES_TO' END AS kind, CASE WHEN o_orderkey % 9 = 0 THEN 'T' || (o_orderkey % 300) ELSE 'C' || o_custkey END AS src,
  'T' || CASE WHEN o_orderkey % 9 = 0 THEN (o_orderkey % 300) // 2 ELSE o_orderkey % 300 END AS dst, o_orderkey * 10 AS valid_from, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 10 + 5000 END AS valid_to, o_orderkey % 1000 AS decision_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 77 END AS ended_by FROM orders)"""


@query(f"""WITH {EDGES_SQL} SELECT kind, dst, count(*) AS live FROM edges WHERE valid_from <= 60000 AND (valid_to IS NULL OR valid_to > 60000) GROUP BY ALL""")
def graph_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph at an instant."""
    return graph.as_of(_edges(spark, sf_dir), 60_000).groupBy("kind", "dst").agg(F.count("*").alias("live"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, roots AS (SELECT DISTINCT dst AS root FROM edges WHERE dst IN ('T1', 'T2', 'T5', 'T40')), fam AS (SELECT root, root AS id FROM roots UNION SELECT f.root, e.src FROM fam f JOIN edges e ON e.dst = f.id AND e.kind = 'MERGED_INTO')
  SELECT DISTINCT f.root, e.edge_id, e.decision_id FROM fam f JOIN edges e ON e.src = f.id OR e.dst = f.id""")
def graph_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of a track and of all that merged into it."""
    edges = _edges(spark, sf_dir)
    roots = edges.where(F.col("dst").isin("T1", "T2", "T5", "T40")).select(F.col("dst").alias("root")).distinct()
    decisions = edges.select("decision_id").distinct().withColumn("op", F.lit("merge"))
    return graph.explain(edges, decisions, roots).select("root", "edge_id", "decision_id")


@query(f"""WITH {EDGES_SQL} SELECT edge_id, valid_from, CASE WHEN decision_id = 11 AND valid_to IS NULL THEN 999999 ELSE valid_to END AS valid_to FROM edges WHERE decision_id = 11 OR ended_by = 11
  UNION ALL SELECT -edge_id, 999999, NULL FROM edges WHERE ended_by = 11""")
def undo_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision undone: its edges closed, those that it closed opened again (section 2.10)."""
    edges = _edges(spark, sf_dir)
    one = spark.createDataFrame([(11,)], "decision_id long")
    touched = F.expr("decision_id = 11 or ended_by = 11 or edge_id < 0")
    return graph.undo(edges, one, 999_999).where(touched).select("edge_id", "valid_from", "valid_to")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of commands from orders: customers that share tracks, with undos of what they did last or before."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    undoes = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lag("o_orderkey", 1).over(own)).otherwise(F.lag("o_orderkey", 2).over(own)))
    ops = F.array(*map(F.lit, ("merge", "split", "do_not_pair", "pair_tracks", "unpair_tracks", "group_members", "delete_track")))
    op = F.when(undoes.isNotNull(), "undo").otherwise(ops[(k % 7).cast("int")])
    rows = table(spark, sf_dir, "orders").select(k.alias("decision_id"), (k * 10).alias("at"), F.when(k % 5 == 0, "engine").otherwise(F.concat(F.lit("m"), (k % 3).cast("string"))).alias("actor"), op.alias("op"), undoes.alias("undoes"), c.alias("c"))
    source = F.col("op").isin("merge", "split", "delete_track")
    track = lambda n: F.concat(F.lit("T"), (F.expr("c div 6") + n).cast("string"))
    rows = rows.withColumns({"subjects": F.array(F.when(source, F.concat(F.lit("S"), F.col("c").cast("string"))).otherwise(track(0))), "object": track(1 + F.col("decision_id") % 2), "before": F.lag("op").over(Window.partitionBy("c").orderBy("decision_id")), "lead": F.lag("decision_id").over(Window.partitionBy("c").orderBy("decision_id"))})
    return rows.withColumn("with_decision", F.when((F.col("op") == "do_not_pair") & (F.col("before") == "split"), F.col("lead"))).drop("c", "before", "lead")


_COMMANDS_SQL = """b AS (SELECT o_orderkey AS id, o_custkey AS c, lag(o_orderkey, 1) OVER w AS l1, lag(o_orderkey, 2) OVER w AS l2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  b2 AS (SELECT id, c, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN l1 ELSE l2 END END AS undoes FROM b),
  b3 AS (SELECT *, CASE WHEN undoes IS NOT NULL THEN 'undo' ELSE ['merge', 'split', 'do_not_pair', 'pair_tracks', 'unpair_tracks', 'group_members', 'delete_track'][id % 7 + 1] END AS op, id % 5 = 0 AS own FROM b2),
  com AS (SELECT *, CASE WHEN op = 'do_not_pair' AND lag(op) OVER w = 'split' THEN lag(id) OVER w END AS lead,
    CASE WHEN op IN ('merge', 'split', 'delete_track') THEN 'S' || c ELSE 'T' || c // 6 END AS a, 'T' || (c // 6 + 1 + id % 2) AS o FROM b3 WINDOW w AS (PARTITION BY c ORDER BY id)),
  eff AS (SELECT id, own, CASE WHEN op IN ('merge', 'split', 'delete_track') THEN 'REPORTS_FOR' WHEN op = 'do_not_pair' THEN 'DO_NOT_PAIR' WHEN op = 'group_members' THEN 'MEMBER_OF' ELSE 'PAIRED_WITH' END AS kind,
    CASE WHEN op IN ('do_not_pair', 'pair_tracks', 'unpair_tracks') THEN least(a, o) ELSE a END AS src, CASE WHEN op IN ('do_not_pair', 'pair_tracks', 'unpair_tracks') THEN greatest(a, o) ELSE o END AS dst, op NOT IN ('delete_track', 'unpair_tracks') AS opens FROM com WHERE op <> 'undo'),
  und AS (SELECT u.id AS u, u.undoes AS d, CASE WHEN d.op IS NULL THEN 'unknown' WHEN d.op = 'undo' OR d.own THEN 'not undoable' END AS v FROM com u LEFT JOIN com d ON d.id = u.undoes WHERE u.op = 'undo'),
  cov AS (SELECT und.u, x.id AS x FROM und JOIN com x ON (x.id = und.d OR x.lead = und.d) AND x.op <> 'undo' AND x.id < und.u),
  tou AS (SELECT id AS x, own, src AS node FROM eff UNION SELECT id, own, dst FROM eff),
  nod AS (SELECT DISTINCT und.u, und.d, t.node FROM und JOIN cov USING (u) JOIN tou t ON t.x = cov.x WHERE v IS NULL),
  std AS (SELECT DISTINCT n.u, t.x, false AS target FROM nod n JOIN tou t ON t.node = n.node AND NOT t.own AND t.x > n.d AND t.x < n.u AND NOT EXISTS (SELECT 1 FROM cov k WHERE k.u = n.u AND k.x = t.x)
    UNION ALL SELECT u, d, true FROM und WHERE v IS NULL),
  wai AS (SELECT s.u, s.x, s.target, k.u AS by_u FROM std s LEFT JOIN cov k ON k.x = s.x AND k.u < s.u),
  r AS (SELECT 0 AS n, u, v, NULL::bigint AS blocker FROM und UNION ALL
    SELECT r.n + 1, r.u, coalesce(r.v, q.v), coalesce(r.blocker, q.blocker) FROM r LEFT JOIN
      (SELECT u, CASE WHEN bool_or(pending) THEN NULL WHEN bool_or(target AND gone) THEN 'undone already' WHEN bool_or(NOT target AND NOT gone) THEN 'changed since' ELSE 'undone' END AS v,
         CASE WHEN NOT bool_or(pending) AND NOT bool_or(target AND gone) THEN min(CASE WHEN NOT target AND NOT gone THEN x END) END AS blocker
       FROM (SELECT w.u, w.x, w.target, bool_or(w.by_u IS NOT NULL AND z.v IS NULL) AS pending, coalesce(bool_or(z.v = 'undone'), false) AS gone FROM wai w LEFT JOIN r z ON z.u = w.by_u GROUP BY ALL) GROUP BY u) q ON q.u = r.u
    WHERE EXISTS (SELECT 1 FROM r WHERE v IS NULL)),
  ver AS (SELECT u, v, blocker FROM r WHERE n = (SELECT max(n) FROM r))"""


@query(f"""WITH RECURSIVE {_COMMANDS_SQL} SELECT und.u AS decision_id, und.d AS undoes, ver.v AS verdict, ver.blocker FROM ver JOIN und USING (u)""")
def command_undos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which undos of a log hold, and what stands in the way of the others (section 2.10)."""
    return commands.undo_verdicts(_commands(spark, sf_dir))


_COMMAND_EDGES_SQL = _COMMANDS_SQL + """,
  fir AS (SELECT cov.x, min(cov.u) AS u FROM cov JOIN ver ON ver.u = cov.u AND ver.v = 'undone' GROUP BY cov.x),
  evs AS (SELECT kind, src, CASE WHEN kind = 'REPORTS_FOR' THEN '' ELSE dst END AS too, id, own, CASE WHEN opens THEN dst END AS val, NULL::bigint AS target FROM eff),
  als AS (SELECT * FROM evs UNION ALL SELECT kind, src, too, fir.u, false, NULL, min(fir.x) FROM evs JOIN fir ON fir.x = evs.id GROUP BY ALL),
  pre AS (SELECT *, lag(id) OVER w AS prev FROM als WINDOW w AS (PARTITION BY kind, src, too ORDER BY id)),
  pts AS (SELECT p.kind, p.src, p.too, p.id, coalesce(t.prev, (SELECT max(e.id) FROM evs e WHERE e.own AND e.kind = p.kind AND e.src = p.src AND e.too = p.too AND e.id < p.id AND e.id > p.target)) AS ptr
    FROM pre p JOIN pre t ON t.kind = p.kind AND t.src = p.src AND t.too = p.too AND t.id = p.target AND t.target IS NULL WHERE p.target IS NOT NULL),
  hop AS (SELECT kind, src, too, id, ptr FROM pts UNION ALL SELECT h.kind, h.src, h.too, h.id, p.ptr FROM hop h JOIN pts p ON p.kind = h.kind AND p.src = h.src AND p.too = h.too AND p.id = h.ptr),
  giv AS (SELECT h.kind, h.src, h.too, h.id, e.val FROM hop h JOIN evs e ON e.kind = h.kind AND e.src = h.src AND e.too = h.too AND e.id = h.ptr),
  ful AS (SELECT a.kind, a.src, a.too, a.id, CASE WHEN a.target IS NULL THEN a.val ELSE g.val END AS val FROM als a LEFT JOIN giv g USING (kind, src, too, id)),
  chg AS (SELECT *, lag(val) OVER (PARTITION BY kind, src, too ORDER BY id) AS was FROM ful),
  fin AS (SELECT *, lead(id) OVER (PARTITION BY kind, src, too ORDER BY id) AS ended FROM chg WHERE val IS DISTINCT FROM was)"""


@query(f"""WITH RECURSIVE {_COMMAND_EDGES_SQL} SELECT kind, src, val AS dst, id * 10 AS valid_from, ended * 10 AS valid_to, id AS decision_id, ended AS ended_by FROM fin WHERE val IS NOT NULL""")
def command_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that a log of commands and its undos leave, with who opened and ended them (section 2.10)."""
    log = _commands(spark, sf_dir)
    return commands.edges(log, commands.undo_verdicts(log))


@query(f"""WITH RECURSIVE {_COMMAND_EDGES_SQL} SELECT val AS track, count(*) FILTER (WHERE ended IS NULL) AS sources, CASE WHEN count(*) FILTER (WHERE ended IS NULL) = 0 THEN max(ended) * 10 END AS retired_at FROM fin WHERE val IS NOT NULL AND kind = 'REPORTS_FOR' GROUP BY val""")
def command_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by the sources that commands leave them: live, or retired and when (section 2.10)."""
    log = _commands(spark, sf_dir)
    return commands.track_states(commands.edges(log, commands.undo_verdicts(log)))


# --- scoring (Q*) ----------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of truth and track over time: users are truths, event types tracks."""
    return observations(spark, sf_dir).select("t_us", F.col("track_key").alias("truth_id"), F.col("source_id").alias("track"), "error_m", "event_id")


@query(f"""WITH {OBS_SQL}, pl AS (SELECT t_us, lat, lon FROM obs WHERE event_id % 4 = 0)
  SELECT event_id AS point_id, event_id % 5 <> 0 AND EXISTS (SELECT 1 FROM pl WHERE pl.t_us >= o.t_us - 3600000000 AND pl.t_us < o.t_us + 3600000000 AND {hav('o.lat', 'o.lon', 'pl.lat', 'pl.lon')} <= 2000.0::double) AS scored FROM obs o WHERE event_id % 4 <> 0""")
def detected_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth counts only where a plot came near in place and time (Q10): of four events one is a plot."""
    o = observations(spark, sf_dir)
    truth = o.where("event_id % 4 <> 0").select(F.col("event_id").alias("point_id"), "t_us", "lat", "lon", (F.col("event_id") % 5 != 0).alias("scored"))
    found = scoring.require_detection(truth, o.where("event_id % 4 = 0"), within_m=2000.0, window_us=3_600_000_000)
    return found.select("point_id", "scored")


@query("""WITH s AS (SELECT ['autoferry-', 'solent-', 'alpine-'][o_orderkey % 3 + 1] || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '-fusion' ELSE '-radar' END AS scenario, o_custkey AS r, o_orderkey % 11 AS w, o_orderkey % 17 AS m FROM orders)
  SELECT sum(r)::bigint AS pairs_right, sum(w)::bigint AS pairs_wrong, floor(sum(w) / (sum(r) + sum(w))::double * 10000.0::double + 0.5::double) / 10000.0::double AS wrong, floor(sum(r) / (sum(r) + sum(m))::double * 10000.0::double + 0.5::double) / 10000.0::double AS recall
  FROM s WHERE (scenario LIKE 'autoferry-%' OR scenario LIKE 'solent-%') AND scenario LIKE '%-fusion'""")
def harbour_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong pairings and recall pooled over the harbour scenarios (Q9), a run for each order."""
    k = F.col("o_orderkey")
    place = F.array(F.lit("autoferry-"), F.lit("solent-"), F.lit("alpine-"))[(k % 3).cast("int")]
    name = F.concat(place, k.cast("string"), F.when(k % 2 == 0, "-fusion").otherwise("-radar"))
    return scoring.pooled_gate(table(spark, sf_dir, "orders").select(name.alias("scenario"), F.col("o_custkey").alias("pairs_right"), (k % 11).alias("pairs_wrong"), (k % 17).alias("pairings_missed")))


@query(f"""WITH {OBS_SQL}, p AS (SELECT track_key AS truth_id, source_id AS track, t_us, lag(t_us) OVER w AS t0, lag(source_id) OVER w AS s0 FROM obs WINDOW w AS (PARTITION BY track_key ORDER BY t_us, event_id)),
  m AS (SELECT *, (s0 IS NOT NULL AND s0 <> track)::bigint AS sw, coalesce((t_us - t0 > 86400000000)::bigint, 0) AS gap FROM p)
  SELECT truth_id, sum(sw)::bigint AS id_switches, sum(gap)::bigint AS fragments, min(t_us) AS first_us FROM m GROUP BY truth_id""")
def id_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity switches, fragments and first times of every truth (Q5)."""
    rows = _scored(spark, sf_dir)
    return scoring.continuity(rows, most_gap_us=86_400_000_000).select("truth_id", "id_switches", "fragments", "first_us")


@query(f"""WITH {OBS_SQL}, c AS (SELECT track_key, source_id, count(*) AS n FROM obs GROUP BY ALL), b AS (SELECT track_key, max(n) AS most, sum(n)::bigint AS total, max(struct_pack(n := n, s := source_id)).s AS best FROM c GROUP BY track_key)
  SELECT track_key AS truth_id, CASE WHEN most >= 0.3::double * total THEN best END AS track, most, total FROM b""")
def label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label by vote, if it has enough of them (Q7)."""
    return scoring.vote(_scored(spark, sf_dir), "truth_id", "track", 0.3)


@query("""WITH r AS (SELECT o_orderkey % 100 AS t_us, o_custkey % 40 AS uid, o_orderstatus AS truth_id FROM orders), b AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS x FROM (SELECT count(*) AS n FROM r GROUP BY t_us, uid, truth_id)),
  j AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS x FROM (SELECT count(*) AS n FROM r GROUP BY t_us, uid)), s AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS x FROM (SELECT count(*) AS n FROM r GROUP BY t_us, truth_id))
  SELECT b.x::bigint AS "right", j.x::bigint AS made, s.x::bigint AS "true", b.x::double / j.x::double AS precision, b.x::double / s.x::double AS recall FROM b, j, s""")
def pairing_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of putting source tracks together (Q8)."""
    o = table(spark, sf_dir, "orders")
    contributors = o.select((F.col("o_orderkey") % 100).alias("t_us"), (F.col("o_custkey") % 40).alias("uid"), F.col("o_orderkey").alias("source_track"))
    return scoring.pairing(contributors, o.select(F.col("o_orderkey").alias("source_track"), F.col("o_orderstatus").alias("truth_id")))


@query(f"""WITH {OBS_SQL}, s AS (SELECT track_key, t_us AS t0, lat AS y0, lead(t_us) OVER w AS t1, lead(lat) OVER w AS y1 FROM obs WINDOW w AS (PARTITION BY track_key ORDER BY t_us)), m AS (SELECT DISTINCT (t_us // 3600000000) * 3600000000 AS t_us FROM obs)
  SELECT track_key, m.t_us, {rsql('y0 + (y1 - y0) * ((m.t_us - t0)::double / (t1 - t0)::double)', 6)} AS lat FROM m JOIN s ON m.t_us >= t0 AND m.t_us < t1 AND t1 - t0 <= 43200000000""")
def truth_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth interpolated at whole hours, not across long gaps (Q1)."""
    obs = observations(spark, sf_dir)
    moments = obs.select((F.expr("t_us div 3600000000") * 3_600_000_000).alias("t_us")).distinct()
    out = scoring.interpolate(obs.select("track_key", "t_us", "lat", "lon"), moments, key="track_key", most_gap_us=43_200_000_000)
    return out.select("track_key", "t_us", rnd(F.col("lat"), 6).alias("lat"))


@query("""WITH r AS (SELECT o_orderkey % 200 AS t_us, o_custkey % 10 AS truth_id, o_orderpriority AS uid FROM orders), p AS (SELECT t_us, truth_id, count(DISTINCT uid) AS n FROM r GROUP BY ALL)
  SELECT t_us, count(*) AS targets, count(*) FILTER (n = 1) AS one_number, sum(n - 1)::bigint AS duplicates FROM p GROUP BY t_us""")
def swarm_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with one number only, and duplicates (Q12)."""
    return scoring.swarm(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 200).alias("t_us"), (F.col("o_custkey") % 10).alias("truth_id"), F.col("o_orderpriority").alias("uid")))


@query()
def gospa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GOSPA of jittered copies of the reports, by hour (Q3)."""
    hour = (F.expr("t_us div 3600000000") * 3_600_000_000).alias("t_us")
    truth = observations(spark, sf_dir).select(hour, F.col("event_id").alias("truth_id"), "lat", "lon")
    tracks = observations(spark, sf_dir).where("event_id % 10 <> 3").select(hour, F.col("event_id").alias("track"), (F.col("lat") + (F.col("event_id") % 7) * 1e-4).alias("lat"), "lon")
    return scoring.gospa(truth, tracks)


# --- frames and codecs (F*, C*, O8) -----------------------------------------------------


def _chunks(df: DataFrame, stream: str, text: str, size: int) -> DataFrame:
    """The bytes of a text as they may arrive on a connection: rows (stream, seq, bytes)."""
    data = F.col(text).cast("binary")
    seq = F.explode(F.sequence(F.lit(0), F.expr(f"(octet_length({text}) - 1) div {size}")))
    return df.where(f"octet_length({text}) > 0").withColumn("seq", seq).select(F.col(stream).alias("stream"), "seq", F.substring(data, F.col("seq") * size + 1, F.lit(size)).alias("bytes"))


@query("""SELECT page_id::varchar AS stream, (len(html) - len(replace(html, '</p>', ''))) // 4 AS n FROM pages WHERE contains(html, '</p>')""")
def end_tag_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by end tag from chunks of each page."""
    return framing.framed(_chunks(table(spark, sf_dir, "pages"), "page_id", "html", 1000), {"type": "end_tag", "tag": "</p>"}).groupBy("stream").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, CASE WHEN ends_with(line, chr(13)) THEN line[:-2] ELSE line END AS line FROM l)
  SELECT doc_id::varchar AS stream, count(*) AS n, sum(strlen(line))::bigint AS bytes FROM c WHERE trim(line, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) <> '' GROUP BY doc_id""")
def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from chunks of each document; blank ones are none (F2)."""
    out = framing.framed(_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 777), {"type": "lines"})
    return out.groupBy("stream").agg(F.count("*").alias("n"), F.sum(F.octet_length("frame")).cast("long").alias("bytes"))


@query("""WITH p AS (SELECT doc_id, string_split(text, '. ') AS parts FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(parts[:-2]) AS part FROM p)
  SELECT doc_id::varchar AS stream, count(*) AS n, sum(strlen(part))::bigint AS bytes FROM l WHERE part <> '' GROUP BY doc_id""")
def delimiter_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by delimiter from chunks of each document; an unfinished one is none."""
    out = framing.framed(_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 777), {"type": "delimiter", "delimiter": ". "})
    return out.groupBy("stream").agg(F.count("*").alias("n"), F.sum(F.octet_length("frame")).cast("long").alias("bytes"))


@query("""SELECT kind, user_id::varchar AS stream, row_number() OVER (PARTITION BY kind, user_id ORDER BY event_id) - 1 AS frame_no, event_type AS body FROM events CROSS JOIN (VALUES ('u8'), ('u16'), ('varint'), ('length_field'), ('message')) k(kind)""")
def counted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their lengths before or in them, across chunks, and datagrams."""
    events, n, body = table(spark, sf_dir, "events"), F.length("event_type"), F.col("event_type").cast("binary")
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    kinds = {
        "u8": ({"type": "length_prefixed", "width": "u8"}, F.concat(byte(n), body)), "u16": ({"type": "length_prefixed", "width": "u16"}, F.concat(byte(F.lit(0)), byte(n), body)),
        "varint": ({"type": "length_prefixed", "width": "varint"}, F.concat(byte(n), body)), "length_field": ({"type": "length_field", "offset": 1, "width": 1}, F.concat(byte(F.lit(126)), byte(n + 2), body)), "message": ({"type": "message"}, body),
    }
    out = None
    for kind, (how, data) in kinds.items():
        # Each frame comes in two chunks, but for datagrams, which come whole.
        cuts = [(0, data)] if kind == "message" else [(0, F.substring(data, 1, 3)), (1, F.substring(data, 4, 99))]
        chunks = events.withColumn("c", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), d.alias("d")) for i, d in cuts)))).select(F.col("user_id").alias("stream"), (F.col("event_id") * 2 + F.col("c.i")).alias("seq"), F.col("c.d").alias("bytes"))
        text = F.col("frame").cast("string")
        found = framing.framed(chunks, how).select(F.lit(kind).alias("kind"), "stream", "frame_no", (F.substring(text, 3, 99) if kind == "length_field" else text).alias("body"))
        out = found if out is None else out.union(found)
    return out


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON frames as records, with context of the frame beside them."""
    frames = table(spark, sf_dir, "events").select(F.format_string('{"n": %d, "list": [{"p": %s}]}', "event_id", "props").alias("frame"))
    out = framing.records_at(framing.as_json(frames), "list", ("n",))
    return out.select(F.col("n").cast("long").alias("event_id"), F.try_variant_get("record", "$.p.k", "string").alias("k"))


@query("""SELECT n_nationkey::varchar AS id, n_name AS name, n_regionkey::bigint AS region FROM nation""")
def xml_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML frames by schema: attributes and children."""
    text = F.format_string('<nation id="%s"><name>%s</name><region>%s</region></nation>', F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    out = framing.xml_records(table(spark, sf_dir, "nation").select(text.alias("frame")), "frame", "`@id` string, name string, region long")
    return out.select(F.col("record.`@id`").alias("id"), "record.name", "record.region")


@query(f"""WITH {OBS_SQL} SELECT 'AAA' AS site, event_id AS number, t_us // 1000000 * 1000000 AS t_us, {rsql('lat', 7)} AS lat, {rsql('lon', 7)} AS lon, course, floor(speed * 10.0::double) / 10.0::double AS speed, error_m, domain FROM obs""")
def report_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports packed to 32 bytes and back."""
    out = framing.unpacked(framing.packed(observations(spark, sf_dir).select(F.lit("AAA").alias("site"), F.col("event_id").alias("number"), "t_us", "lat", "lon", "course", (F.floor(F.col("speed") * 10.0) / 10.0).alias("speed"), "error_m", "domain")))
    return out.select("site", "number", "t_us", rnd(F.col("lat"), 7).alias("lat"), rnd(F.col("lon"), 7).alias("lon"), "course", "speed", "error_m", "domain")


# --- from source tracks to messages (T10-T18, O*) --------------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two sensors on each customer's ship: orders are moments of a straight course,
    seen by one sensor with an identity for some and by the other a second later."""
    o = table(spark, sf_dir, "orders")
    ship, k = F.col("o_custkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    at = o.select("o_orderkey", ship.alias("ship"), k.alias("k"))
    row = lambda source, late, shift: at.select(
        (F.col("o_orderkey") * 2 + late).alias("event_id"), F.lit(source).alias("source_id"), F.col("ship").cast("string").alias("track_key"), ((F.col("k") * 10 + late) * 1_000_000).cast("long").alias("t_us"),
        (50.0 + (F.col("ship") % 100) / 5.0 + F.col("k") * 1e-4 + shift * F.pmod(F.col("o_orderkey"), F.lit(7)) * 1e-5).alias("lat"), (-1.0 + F.expr("ship div 100") / 5.0).alias("lon"),
        F.lit(0.0).alias("course"), F.lit(1.1132).alias("speed"), F.lit(10.0 + 5.0 * late).alias("error_m"),
        F.when((F.lit(late) == 0) & (F.col("ship") % 4 == 0), F.concat(F.lit("mmsi:"), F.col("ship").cast("string"))).alias("identity"), F.lit(0.9).alias("confidence"), F.lit("surface").alias("domain"),
    )
    return row("ais", 0, 0).union(row("radar", 1, 1))


#: Ships with enough comparisons pair; a number follows the first sight, ties in order of the track.
_SHIPS = """s AS (SELECT o_custkey AS ship, count(*) AS n FROM orders GROUP BY 1),
  t AS (SELECT 'ais/' || ship AS track, ship, n, 10000000 AS first_us, CASE WHEN ship % 4 = 0 THEN 'mmsi:' || ship END AS identity FROM s UNION ALL SELECT 'radar/' || ship, ship, n, 11000000, NULL FROM s),
  c AS (SELECT *, CASE WHEN n >= 3 THEN 'ais/' || ship ELSE track END AS head FROM t),
  u AS (SELECT head, 'AAA' || lpad((row_number() OVER (ORDER BY min(first_us), min_by(track, (first_us, track))))::varchar, 9, '0') AS uid FROM c GROUP BY head)"""


@query(f"""WITH {_SHIPS} SELECT track, uid, first_us::bigint AS first_us, identity, n AS reports FROM c JOIN u USING (head)""")
def system_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source tracks of two sensors correlated into numbered system tracks."""
    return correlate.system_tracks(_reports(spark, sf_dir))


def _parting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sensors' reports of each customer's ship, five seconds apart: they agree on the first
    five; from the sixth on what the second one follows is two kilometres to the east."""
    o = table(spark, sf_dir, "orders")
    ship, k = F.col("o_custkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    at = o.select("o_orderkey", ship.alias("ship"), k.alias("k"))
    row = lambda source, late: at.select(
        (F.col("o_orderkey") * 2 + late).alias("event_id"), F.lit(source).alias("source_id"), F.col("ship").cast("string").alias("track_key"), ((F.col("k") * 5 + late) * 1_000_000).cast("long").alias("t_us"),
        (50.0 + (F.col("ship") % 100) / 5.0 + F.col("k") * 5e-5).alias("lat"), (-1.0 + F.expr("ship div 100") / 5.0 + F.when((F.col("k") > 5) & (F.lit(late) == 1), 0.03).otherwise(0.0)).alias("lon"),
        F.lit(0.0).alias("course"), F.lit(1.1132).alias("speed"), F.lit(10.0).alias("error_m"), F.lit(None).cast("string").alias("identity"), F.lit(0.9).alias("confidence"), F.lit("surface").alias("domain"),
    )
    return row("ais", 0).union(row("radar", 1))


#: Created as they are seen, merged at the third comparison, split at the fifth of the last five that disagrees.
_PARTING = """s AS (SELECT o_custkey AS ship, count(*) AS n FROM orders GROUP BY 1),
  born AS (SELECT ship, 'create' AS op, 'ais/' || ship AS track, 5000000 AS t_us FROM s UNION ALL SELECT ship, 'create', 'radar/' || ship, 6000000 FROM s UNION ALL SELECT ship, 'split', 'radar/' || ship, 51000000 FROM s WHERE n >= 10),
  u AS (SELECT *, 'AAA' || lpad((row_number() OVER (ORDER BY t_us, track))::varchar, 9, '0') AS uid FROM born)"""


@query(f"""WITH {_PARTING} SELECT t_us::bigint AS t_us, op, uid, NULL::varchar AS other, track FROM u WHERE op = 'create'
  UNION ALL SELECT 16000000, 'merge', a.uid, r.uid, r.track FROM s JOIN u a ON a.ship = s.ship AND a.track LIKE 'ais%' JOIN u r ON r.ship = s.ship AND r.track LIKE 'radar%' AND r.op = 'create' WHERE n >= 3
  UNION ALL SELECT p.t_us, 'split', p.uid, a.uid, p.track FROM u p JOIN u a ON a.ship = p.ship AND a.track LIKE 'ais%' WHERE p.op = 'split'""")
def track_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to system tracks whose sources first agree and then part."""
    return maintenance.operations(_parting(spark, sf_dir)).select("t_us", "op", "uid", "other", "track")


@query(f"""WITH {_PARTING}, a AS (SELECT ship, uid FROM u WHERE track LIKE 'ais%'), r AS (SELECT ship, uid, track FROM u WHERE op = 'create' AND track LIKE 'radar%'), x AS (SELECT ship, uid FROM u WHERE op = 'split')
  SELECT track, uid, t_us::bigint AS since_us, NULL::bigint AS until_us FROM u WHERE track LIKE 'ais%'
  UNION ALL SELECT track, uid, 6000000, CASE WHEN n >= 3 THEN 16000000 END FROM r JOIN s USING (ship)
  UNION ALL SELECT track, a.uid, 16000000, CASE WHEN n >= 10 THEN 51000000 END FROM r JOIN s USING (ship) JOIN a USING (ship) WHERE n >= 3
  UNION ALL SELECT track, x.uid, 51000000, NULL FROM r JOIN x USING (ship)""")
def track_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which system track each source track belonged to, and when."""
    return maintenance.memberships(maintenance.operations(_parting(spark, sf_dir)))


@query(f"""WITH {_SHIPS}, v AS (SELECT uid, count(*) AS contributors, sum(n)::bigint AS reports, max(identity) AS identity FROM c JOIN u USING (head) GROUP BY uid)
  SELECT uid, contributors, reports, identity, CASE WHEN reports >= 3 THEN 'confirmed' ELSE 'tentative' END AS state, reports >= 3 AS published FROM v""")
def fused_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every system track its contributors, identity and state."""
    reports = _reports(spark, sf_dir)
    return correlate.fused(reports, correlate.system_tracks(reports)).select("uid", "contributors", "reports", "identity", "state", "published")


@query(f"""WITH {_SHIPS}, v AS (SELECT uid, count(*) AS members, sum(n) AS reports FROM c JOIN u USING (head) GROUP BY uid) SELECT 'track.' || uid AS subject, 'tms-' || uid AS track_id, 'upsert' AS type, members FROM v WHERE reports >= 3""")
def published_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert messages of the system tracks (O1)."""
    reports = _reports(spark, sf_dir)
    out = sinks.upserts(correlate.fused(reports, correlate.system_tracks(reports)))
    of = lambda path: F.get_json_object("message", path)
    return out.select("subject", of("$.track_id").alias("track_id"), of("$.type").alias("type"), F.size(F.from_json(of("$.members"), "array<string>")).cast("long").alias("members"))


@query("""SELECT event_id, '<event version="2.0" uid="tms-' || event_id || '" type="a-u-G"' AS head, contains('x', 'x') AS closed FROM events""")
def cot_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CoT events of the reports; the SQL states how each begins."""
    rows = observations(spark, sf_dir).withColumns({"uid": F.col("event_id").cast("string"), "cot_type": F.lit(None).cast("string")})
    out = sinks.cot_events(rows)
    return out.select(F.col("uid").cast("long").alias("event_id"), F.regexp_extract("event", '^(<event version="2.0" uid="[^"]*" type="[^"]*")', 1).alias("head"), F.col("event").endswith("</detail></event>").alias("closed"))


@query("""SELECT c_custkey AS "window", CASE WHEN c_custkey % 2 = 0 THEN 'e' || c_custkey END AS emitter, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END AS lines,
  500000 + (c_custkey % 50) * 1000 + c_custkey * 7 % 99 * 10 - 495 AS lat, (c_custkey // 50 % 100) * 1000 + c_custkey * 11 % 99 * 10 - 495 AS lon FROM customer""")
def crossfix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of emitters that three sensors hear, known by kind or not (J9, T19): an emitter for
    each customer, heard once; the lines meet where it is."""
    c = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(c, (50.0 + (c % 50) / 10.0).alias("y"), (F.expr("c_custkey div 50 % 100") / 10.0).alias("x"))
    sensor = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(e).alias("e")) for i, (n, e) in enumerate(((0.0, 0.2), (0.2, -0.1), (-0.2, -0.1))))))
    rows = at.withColumn("s", sensor)
    north, east = (c * 7 % 99 - 49.5) / 1000.0 - F.col("s.n"), (c * 11 % 99 - 49.5) / 1000.0 - F.col("s.e")
    line = F.pmod(F.degrees(F.atan2(east * F.cos(F.radians("y")), north)), F.lit(360.0))
    lines = rows.select((c * 3 + F.col("s.i")).alias("line_id"), F.concat(F.lit("s"), F.col("s.i").cast("string")).alias("sensor"), (c * 10_000_000).alias("t_us"), (F.col("y") + F.col("s.n")).alias("lat"), (F.col("x") + F.col("s.e")).alias("lon"), line.alias("bearing"), F.lit(0.5).alias("sigma"), F.when(c % 2 == 0, F.concat(F.lit("e"), c.cast("string"))).alias("emitter"))
    whole = lambda x: F.floor(F.col(x) * 10_000 + 0.5).cast("long").alias(x)
    return bearings.cross_fixes(lines).select("window", "emitter", F.size("lines").alias("lines"), whole("lat"), whole("lon"))


@query("""SELECT c_custkey::varchar AS sensor_track, CASE WHEN c_custkey % 2 = 0 THEN 'moving' ELSE 'fixed' END AS model, 50 + c_custkey % 7 AS north_100m, 120 + c_custkey % 11 AS east_100m, CASE WHEN c_custkey % 2 = 0 THEN -12 ELSE 0 END AS v_north, CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE 0 END AS v_east, 31 AS lines FROM customer""")
def emitter_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitters at rest and under way by one sensor's bearings (T19): one for each customer, heard 31
    times by a sensor that flies north, then east; they are found where the lines were made to."""
    c, east_of = F.col("c_custkey"), geo.METRES_PER_DEGREE * math.cos(math.radians(50.0))
    t = (F.col("i") * 10 - 300).cast("double")
    rows = table(spark, sf_dir, "customer").select(c, F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i"))
    north, east = 100.0 * F.least(t + 150.0, F.lit(0.0)), 100.0 * F.greatest(t + 150.0, F.lit(0.0))
    at = lambda base, v: base + F.when(c % 2 == 0, v * t).otherwise(0.0)
    to_n, to_e = at((50 + c % 7) * 100.0, -12.0) - north, at((120 + c % 11) * 100.0, 9.0) - east
    bearing = F.pmod(F.degrees(F.atan2(to_e, to_n)), F.lit(360.0))
    lines = rows.select(c.cast("string").alias("sensor_track"), F.col("i").cast("long").alias("line_id"), ((t + 1000.0) * 1_000_000).cast("long").alias("t_us"), (50.0 + north / geo.METRES_PER_DEGREE).alias("lat"), (east / east_of).alias("lon"), bearing.alias("bearing"), F.lit(0.02).alias("sigma"), F.lit(60_000.0).alias("range_m"), F.lit(False).alias("moving"))
    whole = lambda x, unit: F.floor(x / unit + 0.5).cast("long")
    found = motion.locate(lines)
    return found.select("sensor_track", "model", whole((F.col("lat") - 50.0) * geo.METRES_PER_DEGREE, 100.0).alias("north_100m"), whole(F.col("lon") * east_of, 100.0).alias("east_100m"), whole(F.col("v_north"), 1.0).alias("v_north"), whole(F.col("v_east"), 1.0).alias("v_east"), "lines")


@query()
def mht_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from anonymous plots by hypotheses over several scans."""
    return mht.form_tracks(_plots(spark, sf_dir).select("source_id", "t_us", "lat", "lon", "error_m"))


# --- between sites, live counts (T23-T31, A1, A5, A6) ----------------------------------


@query("""SELECT o_orderpriority AS state, o_orderstatus AS domain, count(*) AS n, count(*) FILTER (o_custkey % 3 = 0) AS with_entity FROM orders GROUP BY ALL""")
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks counted by state and domain, and those with an entity."""
    tracks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("state"), F.col("o_orderstatus").alias("domain"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("entity_id"))
    return analytics.live(tracks, ["state", "domain"])


@query("""SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key ORDER BY n DESC, key""")
def attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute keys with how often they occur."""
    return analytics.attribute_keys(table(spark, sf_dir, "events"), "props")


@query("""WITH r AS (SELECT o_orderkey AS track, o_orderkey % 50 AS tick, CASE WHEN o_orderkey % 97 = 0 THEN 1e300::double ELSE o_totalprice END AS urgency, 43 + o_orderkey % 7 AS size FROM orders),
  u AS (SELECT *, sum(size) OVER (PARTITION BY tick ORDER BY urgency DESC, track ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT tick, count(*) FILTER (urgency > 1e299::double OR used <= 5000) AS sent, count(*) AS offered FROM u GROUP BY tick""")
def link_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each tick's reports a thin link carries."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("track"), (F.col("o_orderkey") % 50).alias("tick"), F.when(F.col("o_orderkey") % 97 == 0, float("inf")).otherwise(F.col("o_totalprice")).alias("urgency"), (43 + F.col("o_orderkey") % 7).alias("size"))
    return peers.within_budget(rows, "tick", "size", "urgency", 5000.0).groupBy("tick").agg(F.count_if("sent").alias("sent"), F.count("*").alias("offered"))


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS track, (o_custkey % 5)::bigint AS link, (o_orderkey // 400 + o_orderkey // 2000)::bigint AS t, CASE WHEN o_orderkey % 97 = 0 THEN 'infinity'::double ELSE o_totalprice::double END AS urgency, 43 + o_orderkey % 7 AS size FROM orders),
  n AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY t, urgency DESC, track) AS i FROM r),
  s(link, i, t, track, left_, sent) AS (SELECT link, 0::bigint, min(t), NULL::bigint, 0::double, false FROM r GROUP BY link UNION ALL
    SELECT n.link, n.i, n.t, n.track, CASE WHEN goes THEN have - n.size ELSE have END, goes FROM s JOIN n ON n.link = s.link AND n.i = s.i + 1,
      LATERAL (SELECT CASE WHEN n.t <> s.t THEN least(left_ + (n.t - s.t)::double * 500.0::double, 1000.0::double) ELSE left_ END AS have), LATERAL (SELECT urgency = 'infinity'::double OR have >= n.size AS goes))
  SELECT track, sent FROM s WHERE i > 0""")
def link_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What thin links carry with an allowance that quiet ticks fill."""
    k = F.col("o_orderkey")
    t = F.expr("(o_orderkey div 400 + o_orderkey div 2000) * 1000000")
    rows = table(spark, sf_dir, "orders").select(k.alias("track"), (F.col("o_custkey") % 5).alias("link"), t.alias("t_us"), F.when(k % 97 == 0, float("inf")).otherwise(F.col("o_totalprice").cast("double")).alias("urgency"), (43 + k % 7).alias("size"))
    return peers.token_bucket(rows, ["link"], "t_us", "size", "urgency", 500.0).select("track", "sent")


#: Dwells: five streams, three jobs each, four dwells a revisit, now and then a jump; times in 50 ms.
_DWELLS = """d AS (SELECT event_type AS stream, event_id AS seq, (user_id % 3)::bigint AS job, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS k, event_id * 50 + (event_id * 37 % 11) AS t_ms FROM events),
  w AS (SELECT *, (65530 + (k - 1) // 4 + CASE WHEN k % 97 < 4 THEN 9 ELSE 0 END) % 65536 AS revisit FROM d),
  n AS (SELECT *, lag(revisit) OVER j AS was, coalesce(lag(revisit) OVER j <> revisit, true) AS new FROM w WINDOW j AS (PARTITION BY stream, job ORDER BY seq)),
  b AS (SELECT *, last_value(CASE WHEN new THEN t_ms END IGNORE NULLS) OVER (PARTITION BY stream, job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begun FROM n),
  p AS (SELECT *, CASE WHEN new AND (was + 1) % 65536 = revisit AND t_ms > begun THEN t_ms - begun END AS took FROM b),
  a AS (SELECT *, list(took) FILTER (took IS NOT NULL) OVER (PARTITION BY stream, job ORDER BY seq) AS every FROM p),
  m AS (SELECT *, CASE WHEN len(every) > 0 THEN list_sort(every[-9:])[least(len(every), 9) // 2 + 1]::double / 1000.0::double END AS measured FROM a),
  x AS (SELECT stream, seq, t_ms, job, coalesce(measured, CASE WHEN job > 0 THEN job * 2.5::double END) AS period, measured IS NOT NULL AS known FROM m)"""


@query(f"""WITH {_DWELLS} SELECT stream, seq, job, period AS period_s, known AS measured FROM x""")
def revisit_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisit periods of jobs: the median of their last nine revisits."""
    return timing.revisits(_dwells(spark, sf_dir)).select("stream", "seq", "job", "period_s", "measured")


@query(f"""WITH RECURSIVE {_DWELLS}, o AS (SELECT DISTINCT stream, job AS other FROM x),
  y AS (SELECT x.stream, seq, x.t_ms, other, last_value(CASE WHEN job = other THEN {{'t': t_ms, 'p': period, 'k': known}} END IGNORE NULLS) OVER (PARTITION BY x.stream, other ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM x JOIN o ON o.stream = x.stream),
  g AS (SELECT stream, seq, max(CASE WHEN s.p IS NOT NULL AND abs(t_ms - s.t) <= greatest(60000, floor(s.p * 3000.0::double)) THEN {{'p': s.p, 'j': -other, 'k': s.k}} END) AS b FROM y GROUP BY stream, seq),
  r AS (SELECT stream, seq, b.p AS p, b.k AS k, row_number() OVER (PARTITION BY stream ORDER BY seq) AS i FROM g),
  f(stream, i, seq, p, k) AS (SELECT DISTINCT stream, 0::bigint, NULL::bigint, NULL::double, NULL::boolean FROM r UNION ALL
    SELECT r.stream, r.i, r.seq, CASE WHEN takes THEN r.p ELSE f.p END, CASE WHEN takes THEN r.k ELSE f.k END FROM f JOIN r ON r.stream = f.stream AND r.i = f.i + 1,
      LATERAL (SELECT coalesce(r.p > 0, false) AND (f.p IS NULL OR f.k <> r.k OR abs(f.p - r.p) > 0.05::double * f.p) AS takes))
  SELECT stream, seq, p AS revisit_s, CASE WHEN p IS NOT NULL THEN greatest(p * 3.5::double, 20.0::double) END AS confirm_within_s, CASE WHEN p IS NOT NULL THEN greatest(p * 1.3::double, 8.0::double) END AS drop_tentative_s,
    CASE WHEN p IS NOT NULL THEN greatest(p * 2.5::double, 30.0::double) END AS drop_confirmed_s FROM f WHERE i > 0""")
def auto_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker windows that follow the sensor's revisits, but not their jitter."""
    return timing.windows(timing.governing(timing.revisits(_dwells(spark, sf_dir))))


def _dwells(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), i.alias("seq"), (F.col("user_id") % 3).cast("long").alias("job"), (i * 50 + i * 37 % 11).alias("t_ms"))
    k = F.row_number().over(Window.partitionBy("stream", "job").orderBy("seq"))
    rows = rows.withColumn("k", k).withColumn("revisit", F.expr("(65530 + (k - 1) div 4 + CASE WHEN k % 97 < 4 THEN 9 ELSE 0 END) % 65536"))
    return rows.withColumn("nominal_s", F.when(F.col("job") > 0, F.col("job") * 2.5)).drop("k")


#: Codes of customers in the three standards; identities and dimensions by key.
_CODES = """c AS (SELECT c_custkey AS id, ['pending','unknown','assumed_friend','friend','neutral','suspect','hostile','joker','faker'][c_custkey % 9 + 1] AS aff, ['air','surface','subsurface','ground','space'][c_custkey % 5 + 1] AS dom,
    'puafnshjk'[c_custkey % 9 + 1] AS letter, 'ASUGP'[c_custkey % 5 + 1] AS dim, '012345656'[(c_custkey % 9) + 1] AS _d, ['01','30','35','11','05'][c_custkey % 5 + 1] AS ss FROM customer),
  k AS (SELECT *, ['0','1','2','3','4','5','6','5','6'][id % 9 + 1] AS digit, CASE WHEN id % 9 > 6 THEN '1' ELSE '0' END AS ctx FROM c),
  z AS (SELECT id, aff, dom, letter, dim, 'mil2525c' AS kind, ' s' || letter || lower(dim) || 'puci' || CASE WHEN id % 2 = 0 THEN '***' ELSE '---' END || ' ' AS raw, 'a-' || letter || '-' || dim || '-U-C-I' AS cot FROM k
    UNION ALL SELECT id, aff, dom, letter, dim, 'mil2525d', '10' || ctx || digit || ss || '00001211000000', 'a-' || letter || '-' || dim FROM k
    UNION ALL SELECT id, aff, dom, letter, dim, 'cot', 'a-' || letter || '-' || dim || '-X', 'a-' || letter || '-' || dim || '-X' FROM k)"""


@query(f"""WITH {_CODES} SELECT id, kind, aff AS affiliation, dom AS domain, cot AS cot_type, CASE kind WHEN 'mil2525c' THEN 'SH' || dim || 'PUCI--------' WHEN 'cot' THEN 'a-h-' || dim || '-X' ELSE raw[1:3] || '6' || raw[5:] END AS hostile,
  CASE dom WHEN 'surface' THEN [8, 30, 16, 9, 18, 17, 7, 17, 7] WHEN 'subsurface' THEN [5, 29, 13, 6, 15, 14, 4, 14, 4] WHEN 'ground' THEN [26, 31, 23, 22, 27, 25, 24, 25, 24] ELSE [2, 28, 10, 3, 12, 11, 1, 11, 1] END[id % 9 + 1] AS force FROM z""")
def symbol_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol codes in three standards: what they say, their CoT type, another identity, force codes."""
    i = F.col("c_custkey")
    of = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (i % n + 1).cast("int"))
    aff = ["pending", "unknown", "assumed_friend", "friend", "neutral", "suspect", "hostile", "joker", "faker"]
    letter, dim = of([symbols.LETTERS[a] for a in aff], 9), of("ASUGP", 5)
    c = F.concat(F.lit(" s"), letter, F.lower(dim), F.lit("puci"), F.when(i % 2 == 0, "***").otherwise("---"), F.lit(" "))
    d = F.concat(F.lit("10"), F.when(i % 9 > 6, "1").otherwise("0"), of("012345656", 9), of(["01", "30", "35", "11", "05"], 5), F.lit("00001211000000"))
    cot = F.concat(F.lit("a-"), letter, F.lit("-"), dim, F.lit("-X"))
    codes = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("raw")) for k, x in (("mil2525c", c), ("mil2525d", d), ("cot", cot)))))
    rows = table(spark, sf_dir, "customer").withColumn("c", codes).select(i.alias("id"), "c.kind", "c.raw")
    raw = F.col("raw")
    return rows.select("id", "kind", symbols.affiliation(raw).alias("affiliation"), symbols.domain(raw).alias("domain"), symbols.cot_type(raw).alias("cot_type"), symbols.with_affiliation(raw, F.lit("hostile")).alias("hostile"), symbols.force_code(symbols.domain(raw), symbols.affiliation(raw)).alias("force"))


@query("""WITH m AS (SELECT o_orderkey, 'S' || (o_custkey % 5) AS site, o_custkey AS sig, o_orderkey % 11 <> 0 AS signed, CASE WHEN o_orderkey % 13 = 0 THEN 400000000 ELSE 0 END AS late FROM orders)
  SELECT coalesce(CASE WHEN site = 'S0' THEN 'own site' WHEN site NOT IN ('S1', 'S2', 'S3') THEN 'not trusted' WHEN NOT signed THEN 'bad signature' WHEN late > 300000000 THEN 'clock'
    WHEN row_number() OVER (PARTITION BY sig ORDER BY o_orderkey + late, site) > 1 THEN 'replay' END, 'let in') AS refused, count(*) AS n FROM m GROUP BY ALL""".replace("SELECT coalesce(CASE", "SELECT refused, count(*) AS n FROM (SELECT coalesce(CASE").replace("AS refused, count(*) AS n FROM m GROUP BY ALL", "AS refused FROM m) GROUP BY refused"))
def peer_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer messages let in or refused, with the reason."""
    k = F.col("o_orderkey")
    late = F.when(k % 13 == 0, 400_000_000).otherwise(0)
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("site"), F.col("o_custkey").alias("signature"), (k % 11 != 0).alias("signed"), k.alias("sent_us"), (k + late).alias("received_us"))
    return peers.admitted(rows, me="S0", trusted=["S1", "S2", "S3"]).groupBy(F.coalesce("refused", F.lit("let in")).alias("refused")).agg(F.count("*").alias("n"))


#: Event by event: the rival (site, quality, time) that stands, the last release, the own view, and who reports.
@query(f"""WITH RECURSIVE {OBS_SQL}, e AS (SELECT track_key AS track, t_us, event_id, CASE WHEN event_id % 3 = 0 THEN 'heard' WHEN event_id % 41 = 0 THEN 'released' ELSE 'own' END AS kind, 'S' || (event_id % 4) AS site,
    CASE WHEN event_id % 3 = 0 OR event_id % 41 = 0 OR event_id % 7 > 0 THEN (event_id % 16)::int END AS q, row_number() OVER (PARTITION BY track_key ORDER BY t_us, event_id) AS n FROM obs),
  s(track, n, event_id, rs, rq, rt, ls, lt, mine, reporting) AS (
    SELECT DISTINCT track, 0::bigint, NULL::bigint, NULL::varchar, NULL::int, NULL::bigint, NULL::varchar, NULL::bigint, NULL::int, false FROM e
    UNION ALL
    SELECT e.track, e.n, e.event_id, CASE WHEN takes THEN e.site WHEN frees THEN NULL ELSE rs END, CASE WHEN takes THEN e.q WHEN frees THEN NULL ELSE rq END, CASE WHEN takes THEN e.t_us WHEN frees THEN NULL ELSE rt END,
      CASE WHEN kind = 'released' THEN e.site ELSE ls END, CASE WHEN kind = 'released' THEN e.t_us ELSE lt END, CASE WHEN kind = 'own' THEN e.q ELSE mine END,
      CASE WHEN counts AND (mine IS NULL OR e.q > mine OR (e.q = mine AND e.site < 'S2')) THEN false WHEN kind <> 'own' THEN reporting WHEN e.q IS NULL THEN false WHEN NOT live THEN true
        WHEN reporting THEN NOT (rq > e.q OR (rq = e.q AND rs < 'S2')) ELSE e.q >= rq + 2 END
    FROM s JOIN e ON e.track = s.track AND e.n = s.n + 1,
      LATERAL (SELECT coalesce(e.t_us - rt < 21600000000, false) AS live, kind = 'heard' AND NOT coalesce(ls = e.site AND e.t_us - lt < 21600000000, false) AS counts, kind = 'released' AND coalesce(rs = e.site, false) AS frees),
      LATERAL (SELECT counts AND (NOT live OR rs = e.site OR e.q > rq OR (e.q = rq AND e.site < rs)) AS takes))
  SELECT track, event_id, reporting FROM s WHERE n > 0""")
def responsibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who reports each track, as one site decides it from what it hears."""
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "heard").when(i % 41 == 0, "released").otherwise("own")
    quality = F.when((kind != "own") | (i % 7 > 0), (i % 16).cast("int"))
    rows = observations(spark, sf_dir).select(F.col("track_key").alias("track"), "t_us", "event_id", kind.alias("kind"), F.concat(F.lit("S"), (i % 4).cast("string")).alias("site"), quality.alias("quality"))
    return peers.responsibility(rows, "S2", take_over_us=21_600_000_000).select("track", "event_id", "reporting")


# --- identities, messages and scores that are told in plain SQL -------------------------


@query(f"""WITH {OBS_SQL} SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN domain END IGNORE NULLS) OVER (PARTITION BY track_key ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS name FROM obs""")
def sticky_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track keeps its name where a report has none."""
    rows = observations(spark, sf_dir).select("event_id", "track_key", "t_us", F.when(F.col("event_id") % 3 == 0, F.col("domain")).alias("name"))
    return fusion.sticky(rows, ["track_key"], ["t_us", "event_id"], ["name"]).select("event_id", "name")


@query("""SELECT lpad((o_orderkey // 5 * 5)::varchar, 9, '0') AS uid, o_custkey AS entity_id FROM orders""")
def carried_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities pinned to tracks follow chains of merges to the track that goes on."""
    o = table(spark, sf_dir, "orders")
    uid = lambda c: F.lpad(c.cast("string"), 9, "0")
    k = F.col("o_orderkey")
    merges = spark.range(5).crossJoin(o.select(F.expr("o_orderkey div 5 * 5").alias("first")).distinct()).where("id > 0").select(uid(F.col("first") + F.col("id")).alias("gone"), uid(F.col("first") + F.col("id") - 1).alias("kept"))
    return correlate.carried_pins(o.select(uid(k).alias("uid"), F.col("o_custkey").alias("entity_id")), merges)


@query("""SELECT 'tms-SIA' || lpad(o_orderkey::varchar, 9, '0') AS track_id, 'delete' AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'tms-SIA' || lpad((o_orderkey + 1)::varchar, 9, '0') END AS merged_into FROM orders""")
def delete_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete messages; a merge names the track that goes on (O2)."""
    k = F.col("o_orderkey")
    uid = lambda c: F.concat(F.lit("SIA"), F.lpad(c.cast("string"), 9, "0"))
    reason = F.when(k % 2 == 0, F.concat(F.lit("merged into "), F.when(k % 4 == 0, "tms-").otherwise(""), uid(k + 1))).otherwise("lost")
    of = lambda path: F.get_json_object("message", path)
    out = sinks.deletes(table(spark, sf_dir, "orders").select(uid(k).alias("uid"), F.lit(0).cast("long").alias("t_us"), reason.alias("reason")))
    return out.select(of("$.track_id").alias("track_id"), of("$.type").alias("type"), of("$.merged_into").alias("merged_into"))


@query("""WITH m AS (SELECT CASE max(CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'MACHINERY' THEN 2 ELSE 1 END) WHEN 4 THEN 'SECRET' WHEN 2 THEN 'RESTRICTED' ELSE 'UNCLASSIFIED' END AS label FROM customer)
  SELECT label || '//' || (SELECT string_agg(DISTINCT 'R' || (c_custkey % 3), '/' ORDER BY 'R' || (c_custkey % 3)) FROM customer) || '//REL TO A, B' AS marking FROM m""")
def output_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined marking of a whole output."""
    c = table(spark, sf_dir, "customer")
    label = F.when(F.col("c_mktsegment") == "BUILDING", "SECRET").when(F.col("c_mktsegment") == "MACHINERY", "RESTRICTED").otherwise("UNCLASSIFIED")
    sharing = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("B"), F.lit("A")))
    return sinks.marked(c.select(label.alias("label"), F.array(F.concat(F.lit("R"), (F.col("c_custkey") % 3).cast("string"))).alias("restrictions"), sharing.alias("sharing")))


@query(f"""WITH {OBS_SQL} SELECT event_id, 'Feature' AS type, lon, lat, domain FROM obs""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as GeoJSON features."""
    of = lambda path: F.get_json_object("feature", path)
    out = sinks.geojson(observations(spark, sf_dir).select("event_id", "lat", "lon", "domain"))
    at = F.from_json(of("$.geometry.coordinates"), "array<double>")
    return out.select(of("$.properties.event_id").cast("long").alias("event_id"), of("$.type").alias("type"), at[0].alias("lon"), at[1].alias("lat"), of("$.properties.domain").alias("domain"))


@query("""WITH t AS (SELECT 'seen AAA' || lpad(o_orderkey::varchar, 9, '0') || ' and BBB' || lpad((o_orderkey * 2)::varchar, 9, '0') AS x FROM orders) SELECT max(regexp_extract(x, 'AAA(\\d{9})', 1)::bigint) AS highest FROM t""")
def highest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest number of a site named in any text, from which numbering goes on."""
    k = F.col("o_orderkey")
    return analytics.highest_uid(table(spark, sf_dir, "orders").select(F.concat(F.lit("seen AAA"), F.lpad(k.cast("string"), 9, "0"), F.lit(" and BBB"), F.lpad((k * 2).cast("string"), 9, "0")).alias("x")), "x", "AAA")


@query("""SELECT 'track.' || o_orderkey AS subject FROM orders WHERE o_orderkey % 7 = 0""")
def stale_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published subjects whose track no longer lives."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("uid"))
    return correlate.stale_subjects(o.withColumn("subject", F.concat(F.lit("track."), "uid")), o.where("uid % 7 <> 0")).select("subject")


@query(f"""WITH {OBS_SQL}, e AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN domain || event_id END AS said FROM obs),
  h AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY source_id, track_key ORDER BY t_us, CASE WHEN said IS NULL THEN 1 ELSE 0 END, event_id ROWS UNBOUNDED PRECEDING) AS name FROM e)
  SELECT 'peer:' || source_id AS source_id, track_key, t_us, name FROM h WHERE said IS NULL""")
def peer_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers' reports with the identity known before."""
    obs = observations(spark, sf_dir).select(F.col("source_id").alias("site"), F.col("track_key").alias("uid"), "t_us", "lat", "lon", "event_id", "domain")
    names = obs.where("event_id % 4 = 0").select("site", "uid", "t_us", F.concat("domain", F.col("event_id").cast("string")).alias("name"))
    return peers.peer_observations(obs.where("event_id % 4 <> 0").drop("event_id", "domain"), names).select("source_id", "track_key", "t_us", "name")


@query(f"""WITH {OBS_SQL} SELECT event_id FROM obs WHERE source_id <> 'click'""")
def own_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local view is fused from what peers did not send."""
    peer = F.when(F.col("source_id") == "click", F.concat(F.lit("peer:"), "source_id")).otherwise(F.col("source_id"))
    return peers.own_sources(observations(spark, sf_dir).withColumn("source_id", peer)).select("event_id")


@query("""SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY o_custkey""")
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new rows of a store, the newest of each key."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return joins.upsert(rows.where("v % 2 = 0"), rows.where("v % 2 = 1"), ["k"], "v")


@query(f"""WITH {OBS_SQL}, e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN speed END AS s FROM obs),
  h AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN {{'t': t_us, 'v': s}} END IGNORE NULLS) OVER (PARTITION BY track_key ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS held FROM e)
  SELECT event_id, coalesce(s, CASE WHEN t_us - held.t <= 7200000000 THEN held.v END) AS speed FROM h""")
def static_ttl_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a key carried to later reports for two hours at most (M8)."""
    rows = observations(spark, sf_dir).withColumn("speed", F.when(F.col("event_id") % 3 == 0, F.col("speed")))
    return joins.last_known(rows, ["track_key"], ["t_us", "event_id"], ["speed"], "t_us", 7_200_000_000).select("event_id", "speed")


@query("""WITH p AS (SELECT o_orderkey % 300 AS t_us, o_custkey % 20 AS truth_id, (o_orderkey % 50)::double AS d FROM orders), m AS (SELECT t_us, truth_id, count(*) AS n, sum(d * d) AS sq FROM p GROUP BY ALL)
  SELECT count(*) / (SELECT count(*) FROM events) AS completeness, sum(n) / count(*) AS ambiguity, ((SELECT count(*) FROM lineitem) - sum(n)) / (SELECT count(*) FROM lineitem) AS spuriousness, floor(sqrt(sum(sq) / sum(n)) * 1e6 + 0.5::double) / 1e6 AS rms_m FROM m""")
def siap_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, ambiguity, spuriousness and RMS of pairs (Q4)."""
    pairs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 300).alias("t_us"), (F.col("o_custkey") % 20).alias("truth_id"), (F.col("o_orderkey") % 50).cast("double").alias("distance_m"))
    return scoring.siap(pairs, table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem")).withColumn("rms_m", rnd(F.col("rms_m"), 6))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_nationkey::bigint AS n FROM customer) SELECT coalesce(a.k, b.k) AS k, a.n AS n_before, b.n AS n_after, b.n - a.n AS n_delta FROM a FULL JOIN b ON a.k = b.k""")
def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' measures side by side (Q11)."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return scoring.deltas(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n")), "k", ["n"])


@query(f"""WITH {OBS_SQL}, d AS (SELECT uid, t_us, on_, coalesce(lag(on_) OVER (PARTITION BY uid ORDER BY t_us), false) AS was FROM (
    SELECT track_key AS uid, t_us * 100000 + event_id AS t_us, CASE WHEN event_id % 11 = 0 THEN event_id % 2 = 0 ELSE confidence > 0.6::double END AS on_ FROM obs))
  SELECT uid, t_us, CASE WHEN on_ THEN 'publish' ELSE 'withdraw' END AS op FROM d WHERE on_ <> was""".replace("t_us * 100000 + event_id", "t_us // 1000000 * 1000000 + event_id"))
def publish_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks published and withdrawn, operators' overrides before the policy."""
    i = F.col("event_id")
    rows = observations(spark, sf_dir).select(F.col("track_key").alias("uid"), (F.expr("t_us div 1000000 * 1000000") + i).alias("t_us"), F.when(i % 11 == 0, i % 2 == 0).alias("override"), (F.col("confidence") > 0.6).alias("wanted"))
    return correlate.publish_changes(rows)


@query("""WITH RECURSIVE p AS (SELECT o_orderkey % 500 AS scan, o_custkey % 7 AS plot, o_orderkey // 500 % 5 AS track, min(o_totalprice) AS d2 FROM orders GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY d2, plot, track) AS k FROM p),
  g AS (SELECT scan, k, plot, track, d2, true AS kept, [plot] AS plots, [track] AS tracks FROM r WHERE k = 1 UNION ALL
    SELECT scan, k, plot, track, d2, free, CASE WHEN free THEN list_append(plots, plot) ELSE plots END, CASE WHEN free THEN list_append(tracks, track) ELSE tracks END
    FROM (SELECT r.*, g.plots, g.tracks, NOT list_contains(g.plots, r.plot) AND NOT list_contains(g.tracks, r.track) AS free FROM g JOIN r ON r.scan = g.scan AND r.k = g.k + 1) x)
  SELECT scan, plot, track, d2 FROM g WHERE kept""")
def detection_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots put to tracks, nearest first, one to one in each scan."""
    pairs = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 500).alias("scan"), (F.col("o_custkey") % 7).alias("plot"), F.expr("o_orderkey div 500 % 5").alias("track")).agg(F.min("o_totalprice").alias("d2"))
    return correlate.associate(pairs, ["scan"])


#: Squared distance of a plot and a view of seven or more seconds: position errors, speed error and acceleration grown.
_GATED = """p AS (SELECT o_orderkey AS plot, o_custkey AS ship, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
  pos AS (SELECT *, 50.0::double + (ship // 4 % 100)::double / 5.0::double + (ship % 4)::double * 0.0003::double AS lat, -1.0::double + (ship // 400)::double / 5.0::double AS lon FROM p),
  d AS (SELECT plot, k, lat + k::double * 0.0001::double + ((plot % 7)::double - 3.0::double) * 0.0002::double AS lat, lon, k * 10000000 + 3000000 AS t_us FROM pos),
  v AS (SELECT ship, k, lat + k::double * 0.0001::double AS lat, lon, k * 10000000 AS t_us FROM pos),
  n AS (SELECT plot, d.t_us, ship, d.lat - v.lat AS dlat, (d.t_us - v.t_us)::double / 1e6::double AS dt FROM d JOIN v ON abs(d.lat - v.lat) < 0.02 AND d.lon = v.lon AND d.t_us >= v.t_us AND d.t_us - v.t_us <= 180000000
    QUALIFY row_number() OVER (PARTITION BY plot, ship ORDER BY v.t_us DESC) = 1),
  g AS (SELECT plot, t_us, ship, pow(radians(dlat - degrees(1.1132::double * dt / 6371008.8::double)) * 6371008.8::double, 2) / (pow(30.0::double / 1.1774::double, 2) + greatest(pow(5.0::double / 1.1774::double, 2), 25.0::double) + dt * dt + 0.09::double * pow(dt, 4) / 4.0::double) AS d2 FROM n),
  q AS (SELECT *, row_number() OVER (PARTITION BY t_us ORDER BY d2, plot, ship::varchar) AS i FROM g WHERE d2 <= 9.210340371976182::double)"""


@query(f"""WITH RECURSIVE {_GATED}, r(t_us, i, plot, ship, free, plots, ships) AS (SELECT t_us, i, plot, ship, true, [plot], [ship] FROM q WHERE i = 1 UNION ALL
    SELECT t_us, i, plot, ship, free, CASE WHEN free THEN list_append(plots, plot) ELSE plots END, CASE WHEN free THEN list_append(ships, ship) ELSE ships END
    FROM (SELECT q.*, r.plots, r.ships, NOT list_contains(r.plots, q.plot) AND NOT list_contains(r.ships, q.ship) AS free FROM r JOIN q ON q.t_us = r.t_us AND q.i = r.i + 1) x)
  SELECT d.plot, d.t_us::bigint AS t_us, ship::varchar AS uid FROM d LEFT JOIN (SELECT * FROM r WHERE free) USING (plot)""")
def detections_to_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots of scans put to tracks by innovation: four ships abreast, plots between them."""
    o = table(spark, sf_dir, "orders")
    ship, k = F.col("o_custkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    lat = 50.0 + F.expr("ship div 4 % 100").cast("double") / 5.0 + (F.col("ship") % 4) * 0.0003
    at = o.select(F.col("o_orderkey").alias("plot"), ship.alias("ship"), k.alias("k")).withColumns({"lat": lat, "lon": -1.0 + F.expr("ship div 400") / 5.0, "domain": F.lit("surface")})
    along = F.col("lat") + F.col("k") * 1e-4
    views = at.select(F.col("ship").cast("string").alias("uid"), F.lit("ais").alias("source_id"), F.col("plot").alias("event_id"), (F.col("k") * 10_000_000).cast("long").alias("t_us"), along.alias("lat"), "lon", F.lit(0.0).alias("course"), F.lit(1.1132).alias("speed"), F.lit(5.0).alias("error_m"), "domain")
    plots = at.select(F.lit("lidar").alias("source_id"), "plot", (F.col("k") * 10_000_000 + 3_000_000).cast("long").alias("t_us"), (along + (F.col("plot") % 7 - 3) * 2e-4).alias("lat"), "lon", F.lit(30.0).alias("error_m"), "domain")
    return correlate.detections_to_tracks(plots, views).select("plot", "t_us", "uid")


@query(f"""WITH {OBS_SQL} SELECT event_id, CASE WHEN error_m / 1.1774::double * sqrt(2.0::double) * 100.0::double > 2000.0::double THEN {rsql('error_m / 1.1774::double * 100.0::double', 4)} END AS axis_m,
  ln(10.0::double) * CASE WHEN event_id % 6 IN (0, 1, 3) THEN 1 ELSE 0 END AS bonus FROM obs""")
def areas_and_emitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of a position that is less than a point (K23), and the weight of a shared emitter."""
    sigma = F.col("error_m") / geo.CEP_OF_SIGMA * 100.0
    area = geo.area_of(sigma * sigma, F.lit(0.0), sigma * sigma)
    i = F.col("event_id")
    emitters = lambda n: F.when(i % n == 0, F.array(F.lit("e1"))).otherwise(F.array(F.concat(F.lit("x"), (i % n).cast("string")), F.lit("e1" if n == 2 else "e3")))
    return observations(spark, sf_dir).select("event_id", rnd(area["semi_major_m"], 4).alias("axis_m"), kinematics.emitter_bonus(emitters(2), emitters(3)).alias("bonus"))
