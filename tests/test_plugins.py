"""Extensions by name: what they say, what they fail on, and what is left as it was."""

import json

import pandas as pd
import pytest

from trackloom.plans import plugins


def _kind(weight=1.0):
    def judge(pairs):
        if (pairs["id"] % 5 == 0).any():
            raise RuntimeError("five")
        ratio = pairs["ln_lr"] + weight
        return pd.DataFrame({"ln_lr": ratio.where(pairs["id"] % 7 != 0), "pass": True, "evidence": "e" + pairs["id"].astype(str)})

    return judge


def test_a_scorer_that_fails_on_some_pairs(spark):
    plugins.register("scorer", "kind", "1.2", _kind, {"weight": float})
    df = spark.range(100).selectExpr("id", "double(id) AS ln_lr", "false AS pass").repartition(3)
    got = {r.id: (r.ln_lr, r["pass"], r.scorer, r.evidence) for r in plugins.score(df, "kind", weight=2).collect()}
    want = lambda i: (float(i), False, None, None) if i % 5 == 0 else (float(i), False, "kind-1.2", f"e{i}") if i % 7 == 0 else (i + 2.0, True, "kind-1.2", f"e{i}")
    assert got == {i: want(i) for i in range(100)}
    assert {r.scorer for r in plugins.score(df, "other").collect()} == {None} and plugins.score(df.limit(0), "kind").collect() == []
    assert plugins.problems("scorer", "kind", {"weight": "x", "more": 1}) == ["more: not an option of kind", "weight: float expected"]
    with pytest.raises(ValueError, match="float expected"):
        plugins.score(df, "kind", weight="x")
    assert ("scorer", "kind", "1.2") in plugins.installed()
    plugins.unregister("scorer", "kind")
    assert plugins.problems("scorer", "kind", {}) == ["no scorer 'kind'"]


def test_a_scorer_with_too_few_results_is_asked_again(spark):
    plugins.register("scorer", "short", "0", lambda: lambda pairs: pd.DataFrame({"ln_lr": [9.0], "pass": [True]}))
    got = plugins.score(spark.range(9).selectExpr("id", "0D AS ln_lr", "false AS pass"), "short").collect()
    assert [r.ln_lr for r in got] == [9.0] * 9 and {r.evidence for r in got} == {None}


def test_a_codec_and_a_tracker(spark):
    plugins.register("codec", "lines", "1", lambda sep=",": lambda frames: [[{"v": int(x)} for x in f.split(sep) if x] for f in frames], {"sep": str})
    rows = [(1, "1;2"), (2, ""), (3, "4;x"), (4, "7")]
    got = plugins.decode(spark.createDataFrame(rows, "id long, frame string").coalesce(1), "lines", sep=";").selectExpr("id", "to_json(message) AS m", "at", "fault").collect()
    assert [(r.id, r.m and json.loads(r.m)["v"], r.at) for r in got] == [(1, 1, 0), (1, 2, 1), (3, None, None), (4, 7, 0)]
    assert "invalid literal" in got[2].fault

    def steps(gap=10):
        return lambda plots: pd.DataFrame({"source_id": plots["source_id"], "t_us": plots["t_us"], "track": (plots["t_us"].diff() > gap).cumsum()})

    plugins.register("tracker", "gaps", "1", steps, {"gap": int})
    plots = spark.createDataFrame([("a", 30), ("a", 1), ("b", 5), ("a", 35)], "source_id string, t_us long")
    tracks = plugins.track(plots, "gaps", "source_id string, t_us long, track long", gap=20).collect()
    assert {(r.source_id, r.t_us, r.track) for r in tracks} == {("a", 1, 0), ("a", 30, 1), ("a", 35, 1), ("b", 5, 0)}


def test_the_correlation_takes_the_scorers_evidence(spark):
    from trackloom.operators import correlate

    plugins.register("scorer", "never", "1", lambda: lambda pairs: pd.DataFrame({"ln_lr": [-5.0] * len(pairs), "pass": False}))
    rows = [(source, f"{source}{k}", i, 1_000_000 * i, 50.0, 1.0, 0.0, 0.0, 30.0, "surface", None) for i, (source, k) in enumerate((s, 0) for _ in range(4) for s in "ab")]
    reports = spark.createDataFrame(rows, "source_id string, track_key string, event_id long, t_us long, lat double, lon double, course double, speed double, error_m double, domain string, identity string")
    plain, scored = correlate.comparisons(reports), correlate.comparisons(reports, correlate.Policy(scorer="never"))
    assert plain.count() == scored.count() > 0 and plain.where("pass").count() > 0
    assert {(r.ln_lr, r["pass"], r.scorer) for r in scored.collect()} == {(-5.0, False, "never-1")}
