"""Operator 13 against brute force: trees of random conversations, in blocks of all sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from trackloom.llm.trie import Borders, conversations_of, nearest_smaller, prefix_trie, rebuilt

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                kids[v[: d - 1]].add(v[:d])

    def below(p):
        leaves, saved = (0, 0) if kids[p] else (1, 0)
        for k in kids[p]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)

    out = []
    for p, m in list(members.items()):
        leaves, saved = below(p)
        ends = ",".join(str(c) for c in sorted(c for c in m if made[c] == p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **sizes):
    got = prefix_trie(rebuilt(conversations_of(spark.createDataFrame(rows, ROWS).repartition(3))), **sizes)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def conversations(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(-30, 330)
        for t in range(rng.randrange(0, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", "𝄞 a", "b", "b"])))
    return rows + rows[:9]


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_random_conversations(spark, block):
    rows = conversations(block)
    assert found(spark, rows, block_convs=block) == brute(rows)


def test_copies_fill_several_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(6)] + [(c, 0, "user", "turn 0") for c in range(200, 240)] + [(c, 0, "user", "other") for c in range(300, 310)]
    rows += [(c, t, "user", f"turn {t}") for c in range(400, 404) for t in range(9)]
    for block in (3, 7, 50):
        assert found(spark, rows, block_convs=block) == brute(rows)


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "nobody's")]) == []
    for rows in ([(100, 0, None, None)], [(105, 0, "user", "a")], [(7, None, "user", "long " * 50_000), (7, None, "user", "tie"), (7, None, "user", "tie")]):
        assert found(spark, rows) == brute(rows)
    clash = spark.createDataFrame([(5, 0, "user", "hello", 1, "x", 2)], ROWS + ", depth int, turns string, block int")
    assert len(prefix_trie(rebuilt(conversations_of(clash))).collect()) >= 1


def test_nearest_smaller_values():
    rng = random.Random(1)
    for _ in range(50):
        v = [-1] + [rng.randrange(5) for _ in range(rng.randrange(1, 40))] + [-1]
        left, right, same = nearest_smaller(__import__("numpy").array(v))
        for i in range(1, len(v) - 1):
            a, b = max(j for j in range(i) if v[j] < v[i]), min(j for j in range(i + 1, len(v)) if v[j] < v[i])
            assert (left[i], right[i], same[i]) == (a, b, next(j for j in range(a + 1, b) if v[j] == v[i]))


def test_block_minima():
    import numpy as np

    rng = random.Random(2)
    least = np.array([-1] + [rng.randrange(6) for _ in range(40)])
    borders = Borders(*[least] * 6)
    for at in range(1, 41):
        for depth in range(7):
            assert borders.start(np.array([at]), np.array([depth]))[0] == max(s for s in range(at) if least[s] < depth)
