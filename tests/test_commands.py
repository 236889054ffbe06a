"""Commands and undos against a plain replay of the log."""

import random

from trackloom.operators import commands

SCHEMA = "decision_id long, at long, actor string, op string, subjects array<string>, object string, undoes long, with_decision long"


def _slots(row):
    kind, opens = commands.EFFECTS[row[3]]
    for s in row[4] or ():
        if s is None or row[5] is None:
            continue
        a, b = sorted((s, row[5])) if kind in ("PAIRED_WITH", "DO_NOT_PAIR") else (s, row[5])
        yield (kind, a, "" if kind == "REPORTS_FOR" else b), b if opens else None, {a, b}


def replay(log):
    """One command after the other, with the graph as it stands then."""
    by_id, undone, state, verdicts, edges, history = {r[0]: r for r in log}, {}, {}, {}, [], {}

    def put(slot, value, row):
        held = state.get(slot)
        if (held[0] if held else None) == value:
            return
        if held and held[0] is not None:
            edges.append((slot[0], slot[1], held[0], held[1], row[1], held[2], row[0]))
        state[slot] = (value, row[1], row[0])

    for row in sorted(log):
        if row[3] in commands.EFFECTS:
            for slot, value, _ in _slots(row):
                had = slot in history
                history.setdefault(slot, []).append((row[0], state.get(slot, (None,))[0], had, value, row[2] in commands.AUTOMATIC))
                put(slot, value, row)
        elif row[3] == "undo":
            d = by_id.get(row[6])
            if d is None or d[0] >= row[0]:
                verdicts[row[0]] = ("unknown", None)
                continue
            if d[3] not in commands.UNDOABLE or d[2] in commands.AUTOMATIC:
                verdicts[row[0]] = ("not undoable", None)
                continue
            if d[0] in undone:
                verdicts[row[0]] = ("undone already", None)
                continue
            ours = [r for r in log if r[0] < row[0] and r[3] != "undo" and (r[0] == d[0] or r[7] == d[0])]
            nodes = {n for r in ours if r[3] in commands.EFFECTS for _, _, some in _slots(r) for n in some}
            stand = [r[0] for r in log if d[0] < r[0] < row[0] and r not in ours and r[3] in commands.EFFECTS and r[2] not in commands.AUTOMATIC and r[0] not in undone and any(nodes & some for _, _, some in _slots(r))]
            if stand:
                verdicts[row[0]] = ("changed since", min(stand))
                continue
            verdicts[row[0]] = ("undone", None)
            fresh = [r for r in ours if r[0] not in undone]
            undone.update(dict.fromkeys((r[0] for r in fresh), row[0]))
            back = {}
            for r in sorted(fresh):
                for slot, _, _ in _slots(r) if r[3] in commands.EFFECTS else ():
                    back.setdefault(slot, r[0])
            for slot, x in back.items():
                _, value, had, _, _ = next(h for h in history[slot] if h[0] == x)
                if not had:
                    own = [h for h in history[slot] if h[0] > x and h[4]]
                    value = own[-1][3] if own else None
                history[slot].append((row[0], None, True, None, False))
                put(slot, value, row)
    edges += [(slot[0], slot[1], v, t, None, i, None) for slot, (v, t, i) in state.items() if v is not None]
    return verdicts, edges


def _run(spark, log):
    df = spark.createDataFrame(log, SCHEMA).repartition(3)
    verdicts = commands.undo_verdicts(df)
    found = commands.edges(df, verdicts)
    return {r.decision_id: (r.verdict, r.blocker) for r in verdicts.collect()}, found


def test_undo_of_a_split_takes_its_companion_and_waits_for_later_decisions(spark):
    log = [
        (1, 10, "engine", "merge", ["S1", "S2"], "T1", None, None), (2, 20, "ann", "split", ["S2"], "T2", None, None), (3, 20, "ann", "do_not_pair", ["T2"], "T1", None, 2),
        (4, 30, "bob", "pair_tracks", ["T2"], "T9", None, None), (5, 40, "ann", "undo", None, None, 2, None), (6, 50, "bob", "undo", None, None, 4, None),
        (7, 60, "ann", "undo", None, None, 2, None), (8, 70, "ann", "undo", None, None, 2, None), (9, 80, "ann", "undo", None, None, 1, None), (10, 90, "ann", "undo", None, None, 77, None),
        (11, 95, None, None, None, None, None, None), (12, 96, "ann", "pair_tracks", [None], "T1", None, None),
    ]
    verdicts, found = _run(spark, log)
    assert verdicts == {5: ("changed since", 4), 6: ("undone", None), 7: ("undone", None), 8: ("undone already", None), 9: ("not undoable", None), 10: ("unknown", None)}
    live = {(r.kind, r.src, r.dst) for r in found.where("valid_to is null").collect()}
    assert live == {("REPORTS_FOR", "S1", "T1"), ("REPORTS_FOR", "S2", "T1")}
    assert {r.track: (r.sources, r.retired_at) for r in commands.track_states(found).collect()} == {"T1": (2, None), "T2": (0, 60)}
    assert commands.undo_verdicts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_random_logs_equal_a_replay(spark):
    rng = random.Random(5)
    log = []
    for i in range(1, 1500):
        world = rng.randrange(60)
        op = rng.choice(["undo"] * 5 + sorted(commands.EFFECTS))
        actor = rng.choice(["ann", "bob", "cy", "engine"])
        if op == "undo":
            log.append((i, i, actor, op, None, None, max(i - rng.randrange(1, 150), 0), None))
            continue
        source = commands.EFFECTS[op][0] == "REPORTS_FOR"
        subjects = [f"{'S' if source else 'T'}{world}-{rng.randrange(2)}" for _ in range(rng.randrange(1, 3))]
        lead = next((r[0] for r in reversed(log) if r[3] == "split" and r[0] > i - 30), None) if op == "do_not_pair" else None
        log.append((i, i, actor, op, subjects, f"T{world}-{rng.randrange(2, 4)}", None, lead))
    want, edges = replay(log)
    got, found = _run(spark, log)
    assert got == want and {v for v, _ in want.values()} == {"unknown", "not undoable", "undone already", "changed since", "undone"}
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in found.collect()) == order(edges)
