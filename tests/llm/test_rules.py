"""Operator 11 against brute force: base measures, the model's numbers, both ways to score, bands."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from trackloom.llm.rules import BASE, UNIT, bands, fit, judge, kept_documents, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def measured(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def stream(text):
    w = WORD.findall(text or "")
    return b"\n\n\n\n" + " ".join(w).encode() + b"\n" if w else b""


def kneser_ney(texts):
    """p(gram) of all orders for one language, by the definition."""
    counts = {5: Counter(s[i : i + 5] for s in map(stream, texts) for i in range(len(s) - 4))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = {b"": 1 / 256}
    for k in (1, 2, 3, 4, 5):
        t = Counter(counts[k].values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] and t[2] else None
        d = {i: i / 2 if y is None or not t[i] else min(max(i - (i + 1) * y * t[i + 1] / t[i], 0), i) for i in (1, 2, 3)}
        ctx = defaultdict(list)
        for g, n in counts[k].items():
            ctx[g[:-1]].append(n)
        for g, n in counts[k].items():
            every = ctx[g[:-1]]
            off = sum(d[min(x, 3)] for x in every)
            p[g] = (n - d[min(n, 3)]) / sum(every) + off / sum(every) * p[g[1:]]
    return p


def test_base_measures(spark, make, texts):
    rows = [*texts, (200, "# a b\n# a b\n\n \n a b\n"), (201, "x y z x y z x y"), (202, "é𝄞 | <>é")]
    got = {}
    for r in judge(make(rows)).collect():
        got.setdefault(r.doc_id, []).append((*(r[c] for c in BASE), r.base_failed))
    for d, t in rows:
        m = measured(t)
        assert (*m, m[0] < 50 or 100 * m[4] > 50 * m[0]) in got[d]
    assert sum(map(len, got.values())) == len(rows)


def test_model_and_both_ways_to_score(spark, texts):
    rows = [(i, t, "en" if i % 2 else None) for i, (_, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = fit(docs)
    p = {g: kneser_ney([t for _, t, x in rows if x == g]) for g in ("en", None)}
    told = {(r.lang, r.k, r.gram): r.cost for r in model.collect()}
    assert len(told) == sum(len(x) - 1 for x in p.values())
    for g, own in p.items():
        for gram, x in own.items():
            if gram:
                assert abs(told[g or "und", len(gram), int.from_bytes(gram, "big")] + math.log2(x) * UNIT) <= 1
        for k in (2, 5):  # probabilities after a context sum to one with what unseen bytes get
            assert all(0 < x <= 1 for gram, x in own.items() if len(gram) == k)
    here = score(docs, model).collect()
    for r in here:
        s = stream(rows[r.id][1])
        want = sum(-math.log2(p[rows[r.id][2]][s[i : i + 5]]) for i in range(len(s) - 4))
        assert r.grams == max(0, len(s) - 4) and abs(r.cost / UNIT - want) < 1e-3 * (1 + r.grams)
    # Other texts, whose grams the model lacks in part, and a language that it lacks.
    other = spark.createDataFrame([(1, "zebra Ω quartz w1 the of", "en"), (2, "the of", "xx"), (3, None, "en")], "doc_id long, text string, lang string")
    for table in (docs, other):
        a, b = (sorted(map(tuple, score(table, model, most_entries=n).collect())) for n in (1 << 22, 0))
        assert a == b
    zebra, alien = sorted(score(other, model).collect())[:2]
    assert zebra.cost / zebra.grams > 3 * UNIT and alien.cost == 8 * UNIT * alien.grams


def test_bands_and_odd_tables(spark, make):
    rows = [("en", i * UNIT, 1) for i in range(1, 101)] + [("en", 50 * UNIT, 1)] * 500 + [("de", 2 * UNIT, 1)]
    got = {r.lang: (r.low, r.high) for r in bands(spark.createDataFrame(rows, "lang string, cost long, grams long"), reach=(1, 1), least=(0.5, 0.5)).collect()}
    assert got["en"] == pytest.approx((0, 100)) and got["de"] == pytest.approx((1.5, 2.5))
    assert judge(make([]).where("false")).collect() == []
    rows = [(1, "a b"), (1, "a b"), (None, None)]
    clash = make(rows).selectExpr("*", "1 AS id", "2 AS cost", "'x' AS low", "map(1, 2) AS kept", "0 AS mark")
    assert {(r.doc_id, r.n_words, r.kept) for r in judge(clash).collect()} == {(1, 2, False), (None, 0, False)}
    assert kept_documents(clash).columns == clash.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_junk_goes_and_prose_stays(spark):
    docs, labels = (spark.read.parquet(f"{DATA[:-3]}01/{t}.parquet") for t in ("documents", "labels"))
    rng = random.Random(3)
    junk = [(-i, " ".join("".join(rng.choice("bcdfghjkqxzw") for _ in range(6)) for _ in range(80)), "en", "s", 560) for i in range(1, 6)]
    docs = docs.union(spark.createDataFrame(junk, docs.schema))
    got = judge(docs)
    assert got.where("doc_id < 0 AND (kept OR base_failed)").count() == 0
    good = [r.kept for r in got.where("NOT base_failed").join(labels.where("quality = 1"), "doc_id").collect()]
    assert sum(good) >= 0.995 * len(good)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
