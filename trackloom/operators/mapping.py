"""Records to observations: reject rules, mapping rules, finishing touches."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import expr, geo

#: Numeric targets; all others but times are text (fixed values).
NUMBERS = {
    "position.latitude", "position.longitude", "position.altitude_hae_m", "uncertainty.circular_error_m", "uncertainty.vertical_error_m",
    "kinematics.course_deg", "kinematics.speed_mps", "kinematics.heading_deg", "kinematics.vertical_rate_mps", "provenance.confidence",
}
TIMES = {"observed_at", "received_at", "origin"}
DOMAINS = ("air", "surface", "subsurface", "ground", "space")
AFFILIATIONS = ("pending", "unknown", "assumed_friend", "friend", "neutral", "suspect", "hostile", "joker", "faker", "exercise_friend")


def coerce(target: str, v: expr.Val) -> Column:
    """A mapped value in the type of its target; what cannot be coerced is null."""
    if target in NUMBERS:
        return v.num
    if target in TIMES:
        return expr.timestamp_of(v)
    if target.startswith(("ext.", "entity.")):
        return F.when(v.tag.isNotNull(), v.text)
    text = F.when(v.tag.isNotNull(), F.nullif(F.trim(v.text), F.lit("")))
    if target == "classification.domain":
        return F.when(F.lower(text).isin(*DOMAINS), F.lower(text))
    if target == "classification.affiliation":
        return F.when(F.lower(text).isin(*AFFILIATIONS), F.lower(text))
    return text


def reject(df: DataFrame, rules: list[dict], reason_col: str = "reject_reason") -> DataFrame:
    """The reason of the first rule that holds, else null."""
    scope = expr.Scope(df.schema)
    reason = F.lit(None).cast("string")
    for rule in reversed(rules):
        reason = F.when(expr.condition(rule["when"], scope), rule["reason"]).otherwise(reason)
    return df.withColumn(reason_col, reason)


def map_records(df: DataFrame, spec: dict[str, Any], keep: tuple[str, ...] = ()) -> DataFrame:
    """Every rule whose ``when`` holds makes a row (fan-out from none to all rules).

    Columns: ``keep``, rule, kind, key, identifiers, and one for each target of any rule,
    named like it.  ``let`` bindings are evaluated in key order; later ones see earlier
    ones.  Blank keys make no row.
    """
    df = reject(df, spec.get("reject", [])).where("reject_reason is null")
    targets = sorted({t for rule in spec["rules"] for t in rule["fields"]})
    rows = []
    for rule in spec["rules"]:
        scope = expr.Scope(df.schema)
        for name in sorted(rule.get("let", {})):
            scope.bound[name] = expr.value(rule["let"][name], scope)
        key = expr.value(rule["key"], scope)
        holds = ~key.is_blank
        if "when" in rule:
            # As in a record-by-record run, ``when`` is judged before the bindings.
            holds = holds & expr.condition(rule["when"], expr.Scope(df.schema))
        ids = []
        for each in rule.get("identifiers", []):
            v = expr.value(each["value"], scope)
            ids.append(F.when(~v.is_blank, F.struct(F.lit(each["scheme"]).alias("scheme"), F.trim(v.text).alias("value"))))
        ids_col = F.array_compact(F.array(*ids)) if ids else F.array().cast("array<struct<scheme:string,value:string>>")
        fields = [(coerce(t, expr.value(rule["fields"][t], scope)) if t in rule["fields"] else F.lit(None)).cast(_type(t)).alias(t) for t in targets]
        made = F.struct(F.lit(rule["name"]).alias("rule"), F.lit(rule.get("kind", "observation")).alias("kind"), F.trim(key.text).alias("key"), ids_col.alias("identifiers"), *fields)
        rows.append(F.when(holds, made))
    mapped = df.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("m"))
    return mapped.select(*keep, *(F.col("m").getField(n).alias(n) for n in ["rule", "kind", "key", "identifiers", *targets]))


def _type(target: str) -> str:
    return "double" if target in NUMBERS else "timestamp" if target in TIMES else "string"


def invalid_reason(lat: Column, lon: Column, course: Column, speed: Column, confidence: Column, major: Column | None = None, minor: Column | None = None) -> Column:
    """Why an observation is not valid, else null."""
    tests = [
        (lat.isNull() | lon.isNull(), "no position"), (F.abs(lat) > 90.0, "latitude out of range"), (F.abs(lon) > 180.0, "longitude out of range"),
        ((course < 0.0) | (course >= 360.0), "course out of range"), (speed < 0.0, "negative speed"), ((confidence < 0.0) | (confidence > 1.0), "confidence out of range"),
    ]
    if major is not None and minor is not None:
        tests.append((minor > major, "ellipse axes swapped"))
    return F.coalesce(*(F.when(test, why) for test, why in tests))


def keep_drop(df: DataFrame, spec: dict) -> DataFrame:
    """A filter step: first ``keep_if``, then ``drop_if``."""
    scope = expr.Scope(df.schema)
    if spec.get("keep_if"):
        df = df.where(expr.condition(spec["keep_if"], scope))
    if spec.get("drop_if"):
        df = df.where(~expr.condition(spec["drop_if"], scope))
    return df


def output_reason(df: DataFrame, spec: dict) -> Column:
    """Why the output filter holds a track back, else null (B10): areas are boxes
    (south, west, north, east), lists name what is let through."""
    within = lambda boxes: reduce(lambda a, b: a | b, (geo.in_box(F.col("lat"), F.col("lon"), *box) for box in boxes), F.lit(False))
    tests = [(within(spec.get("exclude", [])), "excluded area")]
    if spec.get("include"):
        tests.append((~within(spec["include"]), "outside areas"))
    for name in ("affiliation", "domain", "track_type"):
        if spec.get(name):
            tests.append((~F.coalesce(F.col(name).isin(*spec[name]), F.lit(False)), name))
    if spec.get("min_confidence") is not None:
        tests.append((F.coalesce(F.col("confidence") < spec["min_confidence"], F.lit(True)), "confidence"))
    if spec.get("rule"):
        tests.append((~expr.condition(spec["rule"], expr.Scope(df.schema)), "rule"))
    return F.coalesce(*(F.when(test, why) for test, why in tests))


def affiliation(country: Column, lists: dict[str, list[str]], otherwise: str | None, unknown: str | None, already: Column | None = None) -> Column:
    """An affiliation by country; ``otherwise`` for unlisted, ``unknown`` for absent ones (M9)."""
    out = F.lit(otherwise).cast("string")
    for name, countries in reversed(list(lists.items())):
        out = F.when(F.upper(country).isin(*(c.upper() for c in countries)), name).otherwise(out)
    out = F.when(country.isNull() | (F.trim(country) == ""), F.lit(unknown).cast("string")).otherwise(out)
    return out if already is None else F.coalesce(already, out)


#: Spark types of extension fields.
EXTENSION_TYPES = {"string": "string", "enum": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "timestamp": "timestamp"}


def apply_extension(df: DataFrame, schema: list[dict], prefix: str = "ext.") -> DataFrame:
    """Extension fields coerced, defaulted and checked; the first problem in ``ext_problem`` (M6)."""
    problems, columns = [], {}
    for f in schema:
        name = prefix + f["name"]
        v = expr.of_column(F.col(f"`{name}`"), df.schema[name].dataType) if name in df.columns else expr.null()
        kind = f["type"]
        match kind:
            case "integer":
                got = F.when(v.num == F.floor(v.num), v.num.try_cast("bigint"))
            case "number":
                got = v.num
            case "boolean":
                got = expr.transform(v, "bool").num == 1.0
            case "timestamp":
                got = expr.timestamp_of(v)
            case "enum":
                got = F.when(v.text.isin(*f["values"]), v.text)
            case _:
                got = F.when(v.tag.isNotNull(), v.text)
        problems.append(F.when(v.tag.isNotNull() & got.isNull(), f"{f['name']}: not {kind}"))
        if f.get("default") is not None:
            got = F.coalesce(got, F.lit(f["default"]).cast(EXTENSION_TYPES[kind]))
        if f.get("required"):
            problems.append(F.when(got.isNull(), f"{f['name']}: missing"))
        columns[name] = got
    return df.withColumns({**columns, "ext_problem": F.coalesce(*problems, F.lit(None).cast("string"))})


def observation_type() -> T.StructType:
    """The observation after the mapping, with typed columns."""
    struct = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])
    d, s, t = T.DoubleType(), T.StringType(), T.TimestampType()
    return struct(
        source_id=s, source_track_key=s, identifiers=T.ArrayType(struct(scheme=s, value=s)), name=s, callsign=s, observed_at=t, received_at=t,
        position=struct(latitude=d, longitude=d, altitude_hae_m=d), kinematics=struct(course_deg=d, speed_mps=d, heading_deg=d, vertical_rate_mps=d),
        classification=struct(cot_type=s, domain=s, affiliation=s, sidc=s), provenance=struct(sensor_code=s, source_code=s, confidence=d, tracker=s),
        state=s, track_type=s, ext=T.MapType(s, T.VariantType()),
    )
