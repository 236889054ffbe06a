"""Entities applied to reports, put back and applied anew; rows of a sheet and what holds them back."""

from trackloom.operators import registry


def test_overrides_are_kept_and_put_back(spark):
    rows = [("a", "live", 5, "e1", "Entity", None, True), ("b", None, None, "e1", "Entity", 7, True), ("c", "live", 5, "e1", "Entity", 7, False), ("d", "Entity", 5, "e1", "Entity", 6, True), ("e", "live", 1, "e2", "Other", 2, True)]
    df = spark.createDataFrame(rows, "track string, name string, length int, entity_id string, entity_name string, entity_length int, sure boolean")
    links = {"name": "entity_name", "length": "entity_length"}
    state = registry.apply_entity(df, links, "sure").drop("entity_name", "entity_length")
    got = {r.track: (r.name, r.length, [tuple(o) for o in r.overrides]) for r in state.collect()}
    assert got["a"] == ("Entity", 5, [("name", "live", "Entity")]) and got["b"] == ("Entity", 7, []) and got["c"] == ("live", 5, [])
    assert got["d"] == ("Entity", 6, [("length", "5", "6")])
    saved = spark.createDataFrame([("e1", None, 9)], "entity_id string, entity_name string, entity_length int")
    now = {r.track: (r.name, r.length, [tuple(o) for o in r.overrides]) for r in registry.reapplied(state, saved, links, "sure").collect()}
    # The feed's own name is back; what it never reported stays as the entity gave it; others' tracks are not touched.
    assert now == {"a": ("live", 9, [("length", "5", "9")]), "b": ("Entity", 9, [("length", "7", "9")]), "d": ("Entity", 9, [("length", "5", "9")])}
    same = spark.createDataFrame([("e1", "Entity", None)], "entity_id string, entity_name string, entity_length int")
    assert "a" not in {r.track for r in registry.reapplied(state, same, links, "sure").collect()}


def test_rows_of_a_sheet(spark):
    rows = spark.createDataFrame(
        [(2, "e1", ["mmsi:1"]), (3, None, ["mmsi:2", "imo:2"]), (4, " ", ["mmsi:1", "mmsi:2"]), (5, None, ["mmsi:9", "mmsi:9"]), (6, "bad id!", None), (7, "e2", ["mmsi:1", "mmsi:9"]), (8, "fresh", [])],
        "row int, entity_id string, keys array<string>",
    )
    ids = spark.createDataFrame([("mmsi:1", "e1"), ("mmsi:2", "e2"), ("imo:2", "e2")], "key string, entity_id string")
    plan, conflicts = registry.matched_sheet(rows, ids, spark.createDataFrame([("e1",), ("e2",)], "entity_id string"))
    assert {r.row: (r.target, r.known) for r in plan.collect()} == {2: ("e1", True), 3: ("e2", True), 4: ("new-4", False), 5: ("new-5", False), 6: ("bad id!", False), 7: ("e2", True), 8: ("fresh", False)}
    assert {tuple(r) for r in conflicts.collect()} == {
        (4, "different_entities", "e1,e2"), (4, "held", "mmsi:1 by e1"), (4, "held", "mmsi:2 by e2"), (4, "identifier_again", "mmsi:1 in row 2"), (4, "identifier_again", "mmsi:2 in row 3"),
        (6, "entity_id", "bad id!"), (7, "held", "mmsi:1 by e1"), (7, "entity_again", "e2 in row 3"), (7, "identifier_again", "mmsi:1 in row 4"), (7, "identifier_again", "mmsi:9 in row 5"),
    }
    assert [registry.matched_sheet(rows.where("false"), ids, ids.select("entity_id"))[i].collect() for i in (0, 1)] == [[], []]
