"""Expressions, flows, folds, trackers, framing and graph commands on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import expr, geo
from trackloom.functions.paths import json_path, parse_path
from trackloom.operators import analytics, folds, fusion, graph, joins, mapping, registry, scoring, trackers
from trackloom.plans.flow import Flow
from trackloom.sources import framing, simulate


def value_of(spark, spec, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    v = expr.value(spec, expr.Scope(df.schema))
    got = df.select(v.tag.alias("tag"), v.num.alias("num"), v.text.alias("text")).first()
    return None if got.tag is None else got.num if got.tag == "n" else got.text == "true" if got.tag == "b" else got.text


def test_paths():
    assert parse_path('$.a.b[2]["c.d"]') == ["a", "b", 2, "c.d"] and parse_path("$") == []
    assert json_path(["a", 0, "b c"]) == "$['a'][0]['b c']"
    with pytest.raises(ValueError):
        parse_path("a[")


@pytest.mark.parametrize(
    "spec,row,want",
    [
        ({"path": "x", "null_if": [511]}, {"x": 511.0}, None), ({"path": "x", "null_if": ["511"]}, {"x": 511.0}, None), ({"path": "x", "transforms": ["trim", "nonempty"]}, {"x": "  "}, None),
        ({"first": ["x", "y"]}, {"x": " ", "y": "b"}, "b"), ({"template": "{x}-{y}"}, {"x": "a", "y": ""}, None), ({"template": "{x}/{y}"}, {"x": "a", "y": 3}, "a/3"), ({"template": "open {x"}, {"x": "a"}, "open {x"),
        ({"path": "x", "transforms": ["number"]}, {"x": " 12.5 "}, 12.5), ({"path": "x", "transforms": ["number"]}, {"x": "0x1p3"}, None), ({"path": "x", "transforms": ["number"]}, {"x": "NaN"}, None), ({"path": "x", "transforms": ["number"]}, {"x": "1d"}, None),
        ({"path": "x", "transforms": ["round:1"]}, {"x": -2.25}, -2.3), ({"path": "x", "transforms": ["wrap360"]}, {"x": -10.0}, 350.0), ({"path": "x", "transforms": ["hex"]}, {"x": "0xA1"}, 161.0), ({"path": "x", "transforms": ["hex"]}, {"x": "xyz"}, None),
        ({"path": "x", "transforms": ["split:-:-1"]}, {"x": "a-b-c"}, "c"), ({"path": "x", "transforms": ["split:-:5"]}, {"x": "a-b"}, None), ({"path": "x", "transforms": [r"regex:^(\d+)|([a-z]+)$"]}, {"x": "7up"}, "7"), ({"path": "x", "transforms": ["regex:b+"]}, {"x": "abbc"}, "bb"),
        ({"path": "x", "transforms": ["bool"]}, {"x": "Yes"}, True), ({"path": "x", "transforms": ["bool"]}, {"x": ""}, False), ({"path": "x", "transforms": ["bool"]}, {"x": "maybe"}, None), ({"path": "x", "transforms": ["bits_any:6"]}, {"x": 4}, True),
        ({"path": "x", "ranges": [[0, 100, "wide"], [10, 20, "narrow"]]}, {"x": 15.0}, "narrow"), ({"path": "x", "ranges": [[0, 1, "a"]]}, {"x": 5.0}, None), ({"path": "x", "range": [0, 10]}, {"x": 11.0}, None), ({"path": "x", "range": [0, 10]}, {"x": "abc"}, "abc"),
        ({"arith": "div", "args": ["x", {"const": 0}]}, {"x": 4.0}, None), ({"arith": "min", "args": ["x", "y"]}, {"x": 4.0, "y": "q"}, None), ({"path": "x", "default": "d"}, {"x": ""}, ""), ({"path": "gone", "default": "d"}, {"x": ""}, "d"),
        ({"path": "x", "transforms": ["time"]}, {"x": "2026-09-24 12:00:00.123456789 +0000 UTC"}, "2026-09-24T12:00:00.123Z"), ({"path": "x", "transforms": ["time"]}, {"x": "2026-01-02T03:04:05+02:00"}, "2026-01-02T01:04:05.000Z"),
        ({"path": "x", "transforms": ["time"]}, {"x": 1_700_000_000_000}, "2023-11-14T22:13:20.000Z"), ({"path": "x", "transforms": ["time"]}, {"x": "soon"}, None), ({"path": "x", "table": {"1": "one"}, "table_default": "?"}, {"x": 1.0}, "one"), ({"path": "x", "transforms": ["upper"]}, {"x": 3.0}, 3.0),
    ],
)
def test_value_specs(spark, spec, row, want):
    assert value_of(spark, spec, **row) == want


@pytest.mark.parametrize(
    "cond,want",
    [
        ({"path": "gone", "ne": 1}, True), ({"path": "gone", "not_in": [1]}, True), ({"path": "gone", "eq": None}, True), ({"path": "gone", "gt": 1}, False), ({"not": {"path": "gone", "gt": 1}}, True), ({"path": "x", "eq": "1"}, True),
        ({"path": "s", "eq": "1.0"}, False), ({"path": "s", "eq": 1}, True), ({"path": "gone", "exists": False}, True), ({"path": "s", "matches": r"^\d$"}, True), ({"all": []}, True), ({"any": []}, False), ({"path": "x", "gte": 1, "lt": 1}, False),
    ],
)
def test_conditions(spark, cond, want):
    df = spark.createDataFrame([(1.0, "1")], "x double, s string")
    assert df.select(expr.condition(cond, expr.Scope(df.schema)).alias("c")).first().c is want


def test_paths_in_specs():
    assert expr.paths_in({"cases": [{"when": {"path": "a", "eq": 1}, "then": {"template": "{b}-{c}"}}], "default": 1}) == {"a", "b", "c"}


def test_flow_problems():
    bad = Flow({"nodes": [{"id": "a", "type": "input"}, {"id": "b", "type": "filter"}, {"id": "c", "type": "output"}], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "c"}]})
    assert ("invalid", "b does not take what a gives") in bad.problems()
    loop = Flow({"nodes": [{"id": "a", "type": "input"}, {"id": "b", "type": "filter"}, {"id": "c", "type": "filter"}], "edges": [{"source": "b", "target": "c"}, {"source": "c", "target": "b"}]})
    assert ("invalid", "the flow has a loop") in loop.problems() and ("incomplete", "nothing leaves the flow") in loop.problems()


def test_flow_line_counts_and_traces(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double")
    spec = {"mapping": {"rules": [{"name": "r", "key": "id", "fields": {"kinematics.speed_mps": "v"}}]}}
    flow = Flow.line([("reject", [{"reason": "zero", "when": {"path": "v", "eq": 0}}]), ("map", spec), ("filter", {"keep_if": {"path": '["kinematics.speed_mps"]', "gte": 5}}), ("output", None)])
    assert flow.problems() == []
    assert {r.step: r.passed for r in flow.counts(df).collect()} == {"0-input": 10, "1-reject": 9, "2-map": 9, "3-filter": 5, "4-output": 5}
    assert flow.dry_run(df, 3)["2-map"].count() <= 3


def test_grades(spark):
    rows = [("Blue Whale", "blue whale", "x", None, None, "exact"), ("Unit 12", None, "x", "F012", None, "hull"), ("BLUE WHALE", None, "the blue whale two", None, None, "name"), ("abc", None, "abc", None, None, "stale"), ("Warship", None, "x", "F1", None, "generic"), ("warship", None, "x", None, "a-f-S-C", "generic"), ("warship", None, "x", None, "a-n-S", "stale"), (None, "x", "x", None, None, "stale")]
    df = spark.createDataFrame(rows, "live string, expected string, name string, hull string, cot string, want string")
    got = registry.grade(F.col("live"), F.col("expected"), F.col("name"), F.col("hull"), F.col("cot"), generic=("WARSHIP", "UNIT"), markers=("WARSHIP",), military_cot="^a-f")
    assert [r for r in df.withColumn("got", got).collect() if r.got != r.want] == []


def test_sheet_round_trip(spark):
    ids = spark.createDataFrame([(1, "mmsi", "5"), (1, "mmsi", "7"), (2, "imo", "9")], "entity_id long, scheme string, value string")
    wide = registry.sheet(spark.range(1, 4).withColumnRenamed("id", "entity_id"), ids, ["mmsi", "imo"])
    assert sorted(map(tuple, registry.unsheet(wide, ["mmsi", "imo"]).collect())) == sorted(map(tuple, ids.collect()))


def test_polygons_and_boxes(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.5, -0.1)], "lat double, lon double")
    square = F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))))
    assert [r.i for r in df.select(geo.inside_polygon(F.col("lat"), F.col("lon"), square).alias("i")).collect()] == [True, False, False]
    assert df.limit(1).select(geo.in_box(F.lit(0.0), F.lit(179.9), -1, 170, 1, -170).alias("b")).first().b
    assert [round(geo.chi2_quantile(0.99, d), 2) for d in (2, 4)] == [9.21, 13.28]


def test_track_quality(spark):
    errors = (3.0, 10.0, 11.0, 20.0, 80.0, 1000.0, 500_000.0, float("inf"), None)
    df = spark.createDataFrame([(e,) for e in errors], "e double")
    assert [r.q for r in df.select(geo.track_quality(F.col("e")).alias("q")).collect()] == [15, 15, 14, 14, 12, 8, 0, 0, 0]


def test_components_of_long_chains(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300) if i != 150]
    got = {r.id: r.component for r in joins.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(c == ("0000" if int(i) <= 150 else "0151") for i, c in got.items()) and len(got) == 301


def test_labels_combine(spark):
    rows = [("t", "SECRET", ["X"], ["A", "B"]), ("t", "RESTRICTED", ["Y"], ["B", "C"]), ("u", "UNCLASSIFIED", [], None)]
    df = spark.createDataFrame(rows, "t string, label string, restrictions array<string>, sharing array<string>")
    out = {r.t: r for r in fusion.combine_labels(df, ["t"], "label", "restrictions", "sharing").withColumn("m", fusion.marking(F.col("label"), F.col("restrictions"), F.col("sharing"))).collect()}
    assert (out["t"].label, out["t"].sharing, out["t"].m) == ("SECRET", ["B"], "SECRET//X/Y//REL TO B") and out["u"].m == "UNCLASSIFIED"


def test_cot_affiliation(spark):
    got = spark.range(1).select(fusion.with_affiliation(F.lit("a-u-S-C-L"), F.lit("hostile")).alias("c")).first().c
    assert got == "a-h-S-C-L"


def fold_rows(fold, rows):
    state, out = fold.init(), []
    for r in rows:
        state, made = fold.step(state, r)
        out += made
    return out + (fold.end(state) if fold.end else [])


def test_throttle_releases_after_a_change():
    at = lambda t, **k: {"t_us": t, "lat": 0.0, "lon": 0.0, **k}
    fold = folds.throttle("t_us long", min_interval_us=10, heartbeat_us=100, min_move_m=50.0, changes=("changed",))
    assert [r["t_us"] for r in fold_rows(fold, [at(0), at(20), at(25, changed=True), at(30), at(35), at(130)])] == [0, 25, 130]


def test_lifecycle():
    s = 1_000_000
    at = lambda t: {"track": "a", "domain": "air", "t_us": t * s}
    got = fold_rows(folds.lifecycle(), [at(0), at(10), at(20), at(5), at(200), at(200 + 7 * 3600)])
    assert [(r["t_us"] // s, r["state"]) for r in got] == [(0, "tentative"), (20, "confirmed"), (80, "lost"), (200, "confirmed"), (260, "lost"), (200 + 21600, "dropped"), (200 + 7 * 3600, "tentative")]


def test_coalesced_writes():
    at = lambda t, urgent=False: {"t_us": t, "urgent": urgent}
    fold = folds.coalesce_writes("t_us long", gap_us=10)
    got = fold_rows(fold, [at(0), at(3), at(6), at(12), at(14, True), at(15)])
    assert [(r["t_us"], r["published_us"]) for r in got] == [(0, 0), (6, 10), (14, 14), (15, 24)]


def test_lifecycle_as_a_plan_equals_the_fold(spark):
    rows = simulate.load(spark, tracks=9, seconds=40).selectExpr("track_key as track", "t_us * (1 + xxhash64(track_key, t_us) % 5 * 400) as t_us", "event_id", "element_at(array('air', 'surface', 'ground'), cast(pmod(xxhash64(track_key), 3) as int) + 1) as domain").where("t_us >= 0")
    want = folds.run(rows, folds.lifecycle(), ["track"], ["t_us", "event_id"]).collect()
    got = folds.lifecycle_changes(rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.state for r in got}) == 4


def test_send_rule_allows_the_greater_of_threshold_and_error():
    at = lambda t, metres, error=0.0, state="confirmed", domain="surface": {"t_us": t * 1_000_000, "lat": 50.0 + metres / 111_194.9, "lon": 1.0, "course": 0.0, "speed": 0.0, "error_m": error, "domain": domain, "state": state}
    sent = lambda *rows: [r["t_us"] // 1_000_000 for r in fold_rows(folds.send_rule(""), list(rows))]
    assert sent(at(0, 0), at(1, 70, 40.0)) == [0, 1]
    assert sent(at(0, 0), at(1, 45, 40.0), at(2, 70, 80.0), at(3, 81, 80.0), at(4, 81)) == [0, 3]
    assert sent(at(0, 0, domain="air"), at(1, 190, domain="air"), at(2, 210, domain="air"), at(3, 210, state="lost", domain="air"), at(14, 210, state="lost", domain="air"), at(15, 210, state="lost", domain="air")) == [0, 2, 3, 15]


def test_evidence_weighs_reused_reports(spark):
    row = lambda t, other, lr: ("p", t * 1_000_000, "a", other * 1_000_000, lr, 0.5, False)
    df = spark.createDataFrame([row(0, 0, 2.0), row(1, 1, 2.0), row(5, 5, 2.0), row(20, 5, 2.0), row(22, 22, 9.0), row(60, 60, 1.0)], "pair string, t_us long, side string, other_us long, ln_lr double, weight double, outside boolean")
    got = folds.evidence(df, ["pair"], ["t_us"]).orderBy("t_us").collect()
    assert [(r["sum_ln_lr"], r["comparisons"]) for r in got] == [(2.0, 1), (4.0, 2), (5.0, 3), (1.0, 1)]


def test_folds_do_not_depend_on_partitions(spark):
    df = simulate.load(spark, tracks=20, seconds=30)
    fold = folds.gap_filter("track_key string, t_us long, event_id long", least_us=4_000_000)
    a = folds.run(df.repartition(1), fold, ["track_key"], ["t_us"]).collect()
    b = folds.run(df.repartition(9), fold, ["track_key"], ["t_us"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 20 * 8


def test_stream_equals_batch(spark, tmp_path):
    from trackloom.streaming.folds import stream

    df = simulate.load(spark, tracks=6, seconds=40).withColumn("ts", F.timestamp_micros(F.col("t_us") + 86_400_000_000)).select("track_key", "t_us", "event_id", "lat", "lon", "ts")
    for n, part in enumerate((0, 13, 27)):
        df.where(f"t_us >= {part} * 1000000 and t_us < {(13, 27, 40)[n]} * 1000000").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    fold = folds.throttle("track_key string, t_us long, event_id long", min_interval_us=5_000_000)
    want = folds.run(df, fold, ["track_key"], ["t_us"]).collect()
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = stream(source, fold, ["track_key"], ["t_us"], event_time="ts")
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, want))


def test_assignment_against_enumeration():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        cost = rng.random((n, m))
        best = min(sum(cost[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
        assert abs(sum(cost[i, j] for i, j in trackers.assign(cost)) - best) < 1e-12


def test_tracker_follows_crossing_targets(spark):
    tracks = trackers.form_tracks(simulate.plots(spark, targets=8, radars=1, scans=50)).where("state = 'confirmed'")
    score = scoring.gospa(simulate.truth(spark, targets=8, scans=50), tracks.select("t_us", F.col("track_key").alias("track"), "lat", "lon")).where("t_us > 25000000").agg(F.avg("pairs").alias("p"), F.avg("false").alias("f")).first()
    assert score.p > 6.5 and score.f < 300


def test_clusters():
    z, var, first = trackers.clustered(np.array([[0.0, 0.0], [1.0, 0.0], [50.0, 0.0]]), np.array([4.0, 1.0, 9.0]), 5.0)
    assert first == [0, 2] and z.tolist() == [[0.5, 0.0], [50.0, 0.0]] and var.tolist() == [1.0, 9.0]


@pytest.mark.parametrize(
    "spec,data,want",
    [
        ({"type": "lines"}, b"a\r\n\n b\nc", [b"a", b" b", b"c"]), ({"type": "delimiter", "delimiter": "|"}, b"a|b||c|", [b"a", b"b", b"c"]), ({"type": "length_prefix", "width": "u16"}, b"\x00\x02hi\x00\x01x\x00\x09", [b"hi", b"x"]),
        ({"type": "length_prefix", "width": "varint"}, b"\x02hi\x80\x01" + b"z" * 128, [b"hi", b"z" * 128]), ({"type": "length_field", "offset": 1, "width": 1, "adjust": 0}, b"T\x04abT\x03c", [b"T\x04ab", b"T\x03c"]),
        ({"type": "end_tag", "tag": "</e>"}, b"noise<e>1</e> <e>2</e><e>", [b"<e>1</e>", b"<e>2</e>"]), ({"type": "lines", "max_len": 3}, b"abcdef\nxy\n", [None]),
    ],
)
def test_framing_across_chunks(spark, spec, data, want):
    for size in (1, 3, 1000):
        chunks = [("s", i, bytearray(data[i : i + size])) for i in range(0, len(data), size)]
        if spec.get("max_len") and size < 1000:
            continue
        got = framing.framed(spark.createDataFrame(chunks, "stream string, seq long, bytes binary"), spec).orderBy("frame_no").collect()
        assert [None if r.frame is None else bytes(r.frame) for r in got] == want


#: Chunks and what comes of them, errors by name: as the framing rules say, case by case.
FRAMES = [
    ({"type": "lines", "max_len": 100}, [b'{"a":1}\r\n{"b"', b':2}\n\n  \n{"c":3}'], [b'{"a":1}', b'{"b":2}']),
    ({"type": "end_tag", "tag": "</event>", "max_len": 1000}, [b'\n<event uid="a"/></eve', b'nt>  <event uid="b"></event>'], [b'<event uid="a"/></event>', b'<event uid="b"></event>']),
    ({"type": "delimiter", "delimiter": "\\x03", "max_len": 100}, [b"one\x03two\x03\x03thr", b"ee\x03"], [b"one", b"two", b"three"]),
    ({"type": "delimiter", "delimiter": "\\n"}, [b"a\nb\n"], [b"a", b"b"]),
    ({"type": "delimiter", "delimiter": "\\xFF\\x80"}, [b"a\xffb\xff\x80c"], [b"a\xffb"]),
    ({"type": "delimiter", "delimiter": "→"}, ["x→y→".encode()], [b"x", b"y"]),
    ({"type": "delimiter", "delimiter": "\\q\\xZ1"}, [b"a\\q\\xZ1b"], [b"a"]),
    ({"type": "length_prefix", "width": "u16", "endian": "big", "max_len": 100}, [b"\x00\x03ab", b"c\x00\x02de"], [b"abc", b"de"]),
    ({"type": "length_prefix", "width": "u32", "endian": "little", "max_len": 100}, [b"\x02\x00\x00\x00hi"], [b"hi"]),
    ({"type": "length_prefix", "width": "varint", "max_len": 1000}, [b"\xac\x02" + b"x" * 300], [b"x" * 300]),
    ({"type": "length_prefix", "width": "u8"}, [b"\x00\x01a"], [b"", b"a"]),
    ({"type": "length_prefix", "width": "varint"}, [b"\xff" * 9, b"\xff", b"\x01a"], ["bad_varint", b"a"]),
    ({"type": "lines", "max_len": 4}, [b"toolong\nnot seen\n", b"ok\n"], ["too_long", b"ok"]),
    ({"type": "length_field", "offset": 2, "width": "u32", "max_len": 1000}, [b"30\x00\x00\x00", b"\x08ab30\x00", b"\x00\x00\x07c", b"30\x00\x00\x00\x02", b"30\x00\x00\x00\x06"], [b"30\x00\x00\x00\x08ab", b"30\x00\x00\x00\x07c", "bad_length", b"30\x00\x00\x00\x06"]),
    ({"type": "length_field", "offset": 1, "width": 1}, [b"\x09\x00\x09\x03\x07"], ["bad_length"]),
    ({"type": "message"}, [b"a\nb", b"c"], [b"a\nb", b"c"]),
]


@pytest.mark.parametrize("spec,chunks,want", FRAMES)
def test_frames_case_by_case(spec, chunks, want):
    got, rest = [], b""
    for chunk in chunks:
        frames, rest = framing.cut(spec, rest + chunk)
        got += [frame if error is None else error for frame, error in frames]
    assert got == want


def test_delimiters_are_not_empty():
    for spec in ({"type": "delimiter", "delimiter": ""}, {"type": "end_tag", "tag": ""}):
        with pytest.raises(ValueError):
            framing.cut(spec, b"abc")


def test_framing_never_fails_on_noise():
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(60)))
        for spec in ({"type": "length_prefix", "width": "u8"}, {"type": "length_prefix", "width": "varint"}, {"type": "length_field", "offset": 0, "width": 2, "max_len": 50}, {"type": "end_tag", "tag": "</x>"}, {"type": "lines", "max_len": 9}, {"type": "delimiter", "delimiter": "\\x00"}):
            frames, rest = framing.cut(spec, data)
            assert len(rest) <= len(data) and all((f is None) == (e is not None) for f, e in frames)


def test_report_round_trip():
    row = {"site": "ABC", "number": 7, "t_us": 5_000_000, "lat": 51.1234567, "lon": -1.5, "alt": 12.0, "course": 123.45, "speed": 9.5, "error_m": 30.0, "domain": "air"}
    (data,) = framing.pack_reports([row])
    assert len(data) == 32 and framing.unpack_report(data) == row
    assert framing.unpack_report(data[:-1]) is None


def test_json_records(spark):
    frames = spark.createDataFrame([(bytearray(b'{"now": 5, "ac": [{"hex": "a1"}, {"hex": "b2"}]}'),), (bytearray(b"{"),)], "frame binary")
    made = framing.as_json(frames)
    assert [r.error for r in made.collect()] == [None, "not json"]
    got = framing.records_at(made.where("error is null"), "ac", ("now",)).select("now", F.try_variant_get("record", "$.hex", "string").alias("hex")).collect()
    assert sorted((r.now, r.hex) for r in got) == [("5", "a1"), ("5", "b2")]


def test_graph_merge_and_explain(spark):
    edges = spark.createDataFrame([(1, "CONTRIBUTES_TO", "c1", "T1", 0, None, 1, None), (2, "CONTRIBUTES_TO", "c2", "T2", 0, None, 2, None)], "edge_id long, kind string, src string, dst string, valid_from long, valid_to long, decision_id long, ended_by long")
    after = graph.merge(edges, "T1", "T2", 9, 2000, 100)
    live = {(r.src, r.dst) for r in graph.as_of(after, 3000).where("kind = 'CONTRIBUTES_TO'").collect()}
    assert live == {("c1", "T1"), ("c2", "T1")} and {(r.src, r.dst) for r in graph.as_of(after, 1000).collect()} == {("c1", "T1"), ("c2", "T2")}
    told = graph.explain(after, spark.createDataFrame([(9, "merge")], "decision_id long, op string"), spark.createDataFrame([("T1",)], "root string")).collect()
    assert len(told) == 4
    undone = graph.undo(after, spark.createDataFrame([(9,)], "decision_id long"), 5000)
    assert {(r.src, r.dst) for r in graph.as_of(undone, 6000).where("kind = 'CONTRIBUTES_TO'").collect()} == {("c1", "T1"), ("c2", "T2")}


def test_upsert_and_gaps(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, v long, x string")
    new = spark.createDataFrame([(1, 5, "c"), (2, 4, "d"), (3, 1, "e")], "k long, v long, x string")
    assert sorted((r.k, r.x) for r in joins.upsert(old, new, ["k"], "v").collect()) == [(1, "c"), (2, "b"), (3, "e")]
    log = spark.createDataFrame([("s", 2), ("s", 3), ("s", 6)], "site string, seq long")
    assert sorted((r.from_seq, r.to_seq) for r in analytics.gaps(log).collect()) == [(1, 1), (4, 5)]


def test_scores(spark):
    pairs = spark.createDataFrame([("t", "a", 0), ("t", "a", 1), ("t", "b", 2), ("t", "b", 30)], "truth_id string, track string, t_us long")
    got = scoring.continuity(pairs, most_gap_us=10).first()
    assert (got.id_switches, got.fragments, got.first_us) == (1, 1, 0)
    near = spark.createDataFrame([("t", "a", i) for i in range(5)] + [("t", "b", 9)], "truth_id string, track string, t_us long")
    assert [r.smoothed for r in scoring.smoothed(near, "truth_id", "track", reach=2).orderBy("t_us").collect()] == ["a"] * 6
    assert scoring.idf1(pairs, 4, 4) == {"idp": 0.5, "idr": 0.5, "idf1": 0.5}


def test_reject_and_extension(spark):
    df = spark.createDataFrame([("5", "x"), ("a", None)], "`ext.n` string, `ext.e` string")
    got = mapping.apply_extension(df, [{"name": "n", "type": "integer"}, {"name": "e", "type": "string", "required": True}]).collect()
    assert [(r["ext.n"], r.ext_problem) for r in got] == [(5, None), (None, "n: not integer")]


def test_two_sensors_become_one_track_each(spark):
    from trackloom.operators import correlate
    from trackloom.sources import sinks

    seen = simulate.load(spark, tracks=20, seconds=40).withColumns({"identity": F.lit(None).cast("string"), "confidence": F.lit(0.9)})
    reports = seen.union(seen.withColumns({"source_id": F.lit("other"), "event_id": F.col("event_id") + 10**6, "t_us": F.col("t_us") + 500_000}))
    assigned = correlate.system_tracks(reports).collect()
    groups = {}
    for r in assigned:
        groups.setdefault(r.uid, set()).add(r.track.split("/")[1])
    assert len(assigned) == 40 and all(len(g) == 1 for g in groups.values()) and len(groups) == 20
    again = correlate.system_tracks(reports.repartition(7)).collect()
    assert sorted(map(tuple, assigned)) == sorted(map(tuple, again))
    gone = spark.createDataFrame([("AAA000000002", 5, "merged into tms-AAA000000001"), ("AAA000000003", 5, "lost")], "uid string, t_us long, reason string")
    bodies = [r.message for r in sinks.deletes(gone).orderBy("subject").collect()]
    assert '"merged_into":"tms-AAA000000001"' in bodies[0] and "merged_into" not in bodies[1]


def test_veto_and_pins(spark):
    from trackloom.operators import correlate

    df = spark.createDataFrame([("mmsi:1", "mmsi:2"), ("mmsi:1", "mmsi:1"), ("mmsi:1", "imo:2"), (None, "mmsi:2")], "a string, b string")
    assert [r.v for r in df.select(correlate.vetoed(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, False, False]
    pins = spark.createDataFrame([("T3", "e1"), ("T9", "e2")], "uid string, entity_id string")
    merges = spark.createDataFrame([("T3", "T2"), ("T2", "T1")], "gone string, kept string")
    assert sorted(map(tuple, correlate.carried_pins(pins, merges).collect())) == [("T1", "e1"), ("T9", "e2")]


def test_probe_proposes_a_mapping(spark):
    import json

    from trackloom.operators import probing

    frames = spark.createDataFrame([(json.dumps({"now": 1, "ac": [{"hex": f"a{i}{j}", "lat": 50.0 + i, "lon": 1.0, "gs": 7, "track": 12.5, "t": "2026-01-01T00:00:00Z"} for j in range(3)]}),) for i in range(8)], "text string")
    assert probing.record_path(frames, "text") == "ac"
    records = spark.createDataFrame([(json.dumps({"hex": f"a{i}", "lat": 50.0 + i, "lon": 1.0, "gs": 7, "track": 12.5, "t": "2026-01-01T00:00:00Z", "kind": "x"}),) for i in range(30)], "text string")
    rule = probing.propose(records, "text")["rules"][0]
    assert rule["key"] == "hex" and rule["fields"]["position.latitude"] == "lat" and rule["fields"]["kinematics.course_deg"] == "track" and rule["fields"]["observed_at"]["path"] == "t"


def test_cross_fixes_are_where_the_emitters_are(spark):
    from trackloom.operators import bearings

    lines = simulate.bearings(spark, targets=4, sensors=4, scans=6).cache()
    truth = {r.line_id: r.truth_id for r in lines.collect()}
    where = {(r.truth_id, r.t_us): (r.lat, r.lon) for r in simulate.truth(spark, targets=4, scans=6, radar=5).collect()}
    known = [f for f in bearings.cross_fixes(lines, window_us=5_000_000).collect() if f.emitter]
    assert known and all(len({truth[i] for i in f.lines}) == 1 for f in known)
    near = 0
    for f in known:
        t = truth[f.lines[0]]
        near += min(abs(lat - f.lat) * 111_320 + abs(lon - f.lon) * 65_000 for (k, _), (lat, lon) in where.items() if k == t) < 1500
    assert near >= 0.9 * len(known)
    got = bearings.associate(lines, simulate.truth(spark, targets=4, scans=6, radar=5).select(F.col("truth_id").cast("string").alias("uid"), "t_us", "lat", "lon"), window_us=1_000_000)
    own = got.join(lines.select("line_id", "truth_id"), "line_id").where("uid = truth_id").select("line_id").distinct().count()
    assert own >= 0.95 * len(truth)


def test_best_set_against_enumeration():
    from trackloom.operators import mht

    rng = random.Random(2)
    for _ in range(200):
        leaves = [(rng.randrange(4), mht.Leaf(None, rng.random(), tuple({(1, rng.randrange(4)), (2, rng.randrange(4))}), 1)) for _ in range(rng.randrange(1, 8))]
        keys = [{("t", t), *leaf.plots} for t, leaf in leaves]
        sets = (s for n in range(len(leaves) + 1) for s in itertools.combinations(range(len(leaves)), n))
        best = max(sum(leaves[i][1].score for i in s) for s in sets if sum(len(keys[i]) for i in s) == len(set().union(*(keys[i] for i in s))))
        assert abs(sum(leaves[i][1].score for i in mht.best_set(leaves)) - best) < 1e-12


def test_mht_follows_targets(spark):
    from trackloom.operators import mht

    tracks = mht.form_tracks(simulate.plots(spark, targets=5, radars=1, scans=30, clutter=2))
    score = scoring.gospa(simulate.truth(spark, targets=5, scans=30), tracks.select("t_us", F.col("track_key").alias("track"), "lat", "lon")).where("t_us > 25000000").agg(F.avg("pairs").alias("p"), F.avg("false").alias("f")).first()
    assert score.p > 4 and score.f < 300


def test_responsibility_claims_and_yields(spark):
    from trackloom.operators import peers

    s = 1_000_000
    row = lambda t, kind, site=None, q=None: ("a", t * s, t, kind, site, q)
    df = spark.createDataFrame([row(0, "own", q=10), row(1, "heard", "C", 10), row(2, "own", q=10), row(3, "heard", "A", 10), row(4, "own", q=11), row(5, "own", q=12), row(6, "released", "A"), row(7, "heard", "A", 15), row(8, "own", q=1), row(9, "own", q=None), row(40, "own", q=3), row(41, "heard", "C", 4), row(50, "own", q=5), row(66, "own", q=5)], "track string, t_us long, event_id long, kind string, site string, quality int")
    got = peers.responsibility(df, "B").orderBy("t_us").collect()
    assert [r["reporting"] for r in got] == [True, True, True, False, False, True, True, True, True, False, True, False, False, True]


#: Site, events (seconds, kind, site, quality) and whether the site reports after each.
REPORTERS = [
    ("BBB", [(0, "own", None, 3)], [True]), ("BBB", [(0, "own", None, None)], [False]),
    ("BBB", [(0, "heard", "AAA", 9), (1, "own", None, 10), (2, "own", None, 11)], [False, False, True]),
    ("AAA", [(0, "own", None, 9), (1, "heard", "BBB", 9), (2, "own", None, 9), (3, "heard", "BBB", 10)], [True, True, True, False]),
    ("BBB", [(0, "own", None, 9), (1, "heard", "AAA", 9), (2, "own", None, 9)], [True, False, False]),
    ("BBB", [(0, "heard", "AAA", 12), (12, "own", None, 5), (24, "own", None, 5)], [False, False, True]),
    ("BBB", [(0, "heard", "AAA", 12), (1, "released", "AAA", None), (2, "heard", "AAA", 12), (3, "own", None, 5)], [False, False, False, True]),
    ("BBB", [(0, "own", None, 5), (1, "own", None, None)], [True, False]),
    # A lower site does not take a better one's place; the better one's own next report does, even a worse one.
    ("S2", [(0, "heard", "S1", 15), (1, "heard", "S3", 3), (2, "own", None, 6)], [False, False, False]),
    ("S2", [(0, "heard", "S1", 15), (1, "heard", "S1", 3), (2, "own", None, 6)], [False, False, True]),
    # The better one falls silent; what was heard of others meanwhile is not kept.
    ("S2", [(0, "heard", "S1", 15), (20, "heard", "S3", 9), (25, "own", None, 6), (26, "heard", "S3", 9)], [False, False, True, False]),
    # Only the last release counts.
    ("S2", [(0, "released", "S1", None), (1, "released", "S3", None), (2, "heard", "S1", 9), (3, "own", None, 6)], [False, False, False, False]),
]


def test_reporters_case_by_case(spark):
    from trackloom.operators import peers

    for me in {m for m, _, _ in REPORTERS}:
        cases = [(i, e, w) for i, (m, e, w) in enumerate(REPORTERS) if m == me]
        rows = [(str(i), t * 1_000_000, n, kind, site, q) for i, events, _ in cases for n, (t, kind, site, q) in enumerate(events)]
        df = spark.createDataFrame(rows, "track string, t_us long, event_id long, kind string, site string, quality int")
        got = {(r.track, r.event_id): r.reporting for r in peers.responsibility(df, me).collect()}
        assert got == {(str(i), n): x for i, _, want in cases for n, x in enumerate(want)}


def test_peer_reports_take_the_identity_known_before(spark):
    from trackloom.operators import peers

    reports = spark.createDataFrame([("A", "u", 1, 1.0, 2.0), ("A", "u", 5, 1.0, 2.0)], "site string, uid string, t_us long, lat double, lon double")
    names = spark.createDataFrame([("A", "u", 3, "x"), ("B", "u", 0, "y")], "site string, uid string, t_us long, name string")
    assert [(r.t_us, r.name) for r in peers.peer_observations(reports, names).orderBy("t_us").collect()] == [(1, None), (5, "x")]
    clock = peers.tick(spark.createDataFrame([("n", 1, 5), ("n", 2, 3), ("n", 3, 9)], "node string, i long, ms long"), ["node"], ["i"], "ms")
    assert [r.hlc for r in clock.orderBy("i").collect()] == [5 << 16, 5 << 16 | 1, 9 << 16]


def gmti_packet(*segments):
    import struct

    body = b"".join(struct.pack(">BI", kind, len(data) + 5) + data for kind, data in segments)
    return b"31" + struct.pack(">I", 32 + len(body)) + b"XX\x05XX\x00\x00\x00" + b"PLATFORM  " + struct.pack(">II", 7, 9) + body


def gmti_dwell(targets):
    import struct

    places = [0, 1, 2, 3, 4, 5, 6, 7, 30, 31, 32, 35, 36]
    mask = sum(1 << (63 - p) for p in places)
    ang = lambda lat, lon: struct.pack(">iI", round(lat * 2**32 / 180), round(lon % 360 * 2**32 / 360))
    out = struct.pack(">QHHBHI", mask, 3, 1, 0, len(targets), 3_600_000) + ang(50.0, -1.0) + struct.pack(">i", 900_000)
    return out + b"".join(struct.pack(">H", i) + ang(lat, lon) + struct.pack(">hh", 12, -250) for i, (lat, lon) in enumerate(targets))


def test_gmti_targets(spark):
    import struct

    from trackloom.sources import gmti

    mission = b" " * 35 + struct.pack(">HBB", 2026, 5, 4)
    packet = gmti_packet((1, mission), (2, gmti_dwell([(51.5, -0.25), (-10.0, 179.5)])))
    frames = spark.createDataFrame([(1, bytearray(packet)), (2, bytearray(packet[:-3])), (3, bytearray(b"x"))], "seq long, frame binary")
    rows = gmti.packets(frames)
    good = gmti.dated(rows.where("seq = 1")).withColumn("us", F.unix_micros("observed_at")).orderBy("lat").collect()
    assert [(round(r.lat, 6), round(r.lon, 6), r.height_m, r.radial_mps) for r in good] == [(-10.0, 179.5, 12.0, -2.5), (51.5, -0.25, 12.0, -2.5)]
    assert good[0].us == 1_777_856_400_000_000 and round(good[0].sensor_lon, 6) == -1.0
    assert {r.error for r in rows.where("kind = 'error'").collect()} == {"packet ends early", "segment ends early", "no header"}


def test_gmti_never_fails_on_noise():
    from trackloom.sources import gmti

    rng = random.Random(5)
    packet = gmti_packet((2, gmti_dwell([(1.0, 2.0)])))
    for _ in range(500):
        data = bytearray(packet[: rng.randrange(len(packet) + 1)])
        for _ in range(rng.randrange(4)):
            if data:
                data[rng.randrange(len(data))] = rng.randrange(256)
        list(gmti.decode(bytes(data)))


def test_protobuf_records(spark):
    descriptor_pb2 = pytest.importorskip("google.protobuf.descriptor_pb2")
    from trackloom.sources import protobuf

    files = descriptor_pb2.FileDescriptorSet()
    f = files.file.add(name="t.proto", package="t", syntax="proto3")
    m = f.message_type.add(name="Track")
    m.field.add(name="track_id", number=1, type=9, label=1)
    m.field.add(name="speed", number=2, type=1, label=1)
    batch = f.message_type.add(name="Batch")
    batch.field.add(name="tracks", number=1, type=11, label=3, type_name=".t.Track")
    made = protobuf.message_class(files.SerializeToString(), "t.Batch")(tracks=[{"track_id": "a", "speed": 2.5}, {"track_id": "b"}])
    frames = spark.createDataFrame([(bytearray(made.SerializeToString()),), (bytearray(b"\xff\xff"),)], "frame binary")
    got = protobuf.records(frames, files.SerializeToString(), "t.Batch", "tracks").collect()
    import json

    assert [json.loads(r.json)["track_id"] for r in got if r.json] == ["a", "b"] and [r.error for r in got] == [None, None, "not a t.Batch"]


def test_links_that_join_unlike_identities_go(spark):
    """A chain puts A and C of unlike ships together: its weakest link goes, others stay."""
    from trackloom.operators import correlate

    links = spark.createDataFrame([("A", "B", 0.99), ("B", "C", 0.9), ("C", "D", 0.95), ("X", "Y", 0.9)], "a string, b string, probability double")
    tracks = spark.createDataFrame([("A", "mmsi:1"), ("B", None), ("C", None), ("D", "mmsi:2"), ("X", "mmsi:3"), ("Y", "icao:4")], "track string, identity string")
    of = {r.id: r.component for r in correlate.components_without_conflicts(links, tracks).collect()}
    assert of == {"A": "A", "B": "A", "C": "C", "D": "C", "X": "X", "Y": "X"}


def test_latest_pairs_hold_the_latest_of_each_track(spark):
    """Against all pairs: of each track in reach the newest report is among the candidates."""
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), str(rng.randrange(4)), rng.randrange(0, 400) * 1_000_000, 50.0 + rng.randrange(3) * 0.01, 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, source_id string, track_key string, t_us long, lat double, lon double").repartition(3)
    met = joins.latest_pairs(df, df, ["source_id", "track_key"], max_dt_us=60_000_000).collect()
    best = {}
    for r in met:
        key = r.a_event_id, r.b_source_id, r.b_track_key
        best[key] = max(best.get(key, (-1, -1)), (r.b_t_us, r.b_event_id))
    want = {}
    for a in rows:
        for b in rows:
            if 0 <= a[3] - b[3] <= 60_000_000:
                want[a[0], b[1], b[2]] = max(want.get((a[0], b[1], b[2]), (-1, -1)), (b[3], b[0]))
    assert best == want and len(met) < sum(0 <= a[3] - b[3] <= 60_000_000 for a in rows for b in rows)


def test_audit_chain_finds_gaps_links_and_hashes(spark):
    import hashlib

    from trackloom.operators import analytics

    rows, before = [], "0"
    for i in range(3, 40):
        own = hashlib.sha256((before + f"c{i}").encode()).hexdigest()
        rows.append([i, before, own, f"c{i}"])
        before = own
    del rows[10]
    rows[20][2], rows[30][3] = "x", "changed"
    df = spark.createDataFrame([tuple(r) for r in rows], "seq long, prev_hash string, hash string, content string").repartition(5)
    assert sorted((r.seq, r.problem) for r in analytics.chained(df).collect() if r.problem) == [(14, "gap"), (24, "hash"), (25, "link"), (34, "hash")]


def test_numbers_follow_the_order(spark):
    from trackloom.operators import joins

    rows = joins.numbered(spark.range(1000).selectExpr("id * 7 % 1000 as x").repartition(7), ["x"]).collect()
    assert all(r.number == r.x + 1 for r in rows) and len(rows) == 1000


def test_splits_and_pairs_kept_apart(spark):
    """Two tracks of one identity that drive apart are two; so are near ones that an operator keeps apart."""
    from trackloom.operators import correlate

    def rows(source, key, lat, identity, late=0):
        return [(i * 2 + late, source, key, (i * 5 + late) * 1_000_000, lat + i * 1e-4, 1.0, 0.0, 2.2264, 10.0, identity, 0.9, "surface") for i in range(12)]

    schema = "event_id long, source_id string, track_key string, t_us long, lat double, lon double, course double, speed double, error_m double, identity string, confidence double, domain string"
    same = spark.createDataFrame(rows("x", "1", 50.0, "mmsi:1") + rows("y", "2", 50.02, "mmsi:1", 1), schema)
    assert len({r.uid for r in correlate.system_tracks(same).collect()}) == 2
    near = spark.createDataFrame(rows("x", "1", 50.0, None) + rows("y", "2", 50.0, None, 1), schema)
    apart = spark.createDataFrame([("y/2", "x/1")], "a string, b string")
    assert len({r.uid for r in correlate.system_tracks(near).collect()}) == 1
    assert len({r.uid for r in correlate.system_tracks(near, apart=apart).collect()}) == 2


def test_detections_go_to_the_nearest_track_once(spark):
    from trackloom.operators import correlate

    pairs = spark.createDataFrame([(1, 1, "a", 2.0), (1, 1, "b", 1.0), (1, 2, "b", 1.0), (1, 2, "a", 3.0), (2, 1, "a", 5.0)], "scan long, plot long, track string, d2 double")
    assert sorted(map(tuple, correlate.associate(pairs, ["scan"]).collect())) == [(1, 1, "b", 1.0), (1, 2, "a", 3.0), (2, 1, "a", 5.0)]
