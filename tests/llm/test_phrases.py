"""Operator 12 against brute force: counts in several runs, batches and tasks, hot words and pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import phrases
from trackloom.llm.phrases import collocations, frequent_phrases

LOW = {c: c + 32 for c in range(65, 91)}


def counts(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, top):
    f, n = counts(rows)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for lang in n:
        own = []
        for (g, w), a in cand.items():
            if g != lang:
                continue
            score, k = min((2000000 * a // (f[g, w[:k]] + f[g, w[k:]]), k) for k in range(1, len(w)))
            within = any(h == g and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 80 * a for (h, v), b in cand.items())
            if not within:
                own.append((-score, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(rows)], "text string, lang string, n int").repartition(3)


def prose(seed, n=120):
    rng = random.Random(seed)
    vocab = ["the", "of", "New", "YORK", "city", "é", "a\x01", "a", "a\x02b", "ÉTÉ", "x y", "-"] + [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocab[: rng.choice([5, 12, 42])]) for _ in range(rng.randrange(60))]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words), rng.choice(["en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" . ,\n", "en"), ("one", "fr"), rows[0], rows[0], ("of the " * 3000, "en")]


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,least,top,most_bytes", [(1, 5, 2000, 1 << 20), (2, 3, 7, 100), (3, 2, 2000, 1000)])
def test_collocations(spark, seed, least, top, most_bytes):
    rows = prose(seed)
    assert got(collocations(table(spark, rows), least=least, top=top, most_bytes=most_bytes)) == brute(rows, least, top)


def test_hot_pairs_are_split_and_summed(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(["hot", "pair", rng.choice("abcdefgh"), rng.choice("abcdefgh")] * 3), "en") for _ in range(300)] + prose(6)
    assert got(collocations(table(spark, rows), least=4)) == brute(rows, 4, 2000)
    monkeypatch.setattr(phrases, "HOT", 1 << 40)  # every word and pair is hot
    assert got(collocations(table(spark, rows), least=4)) == brute(rows, 4, 2000)


def test_counts_over_batch_borders():
    """One counter for each length, whatever the size of the batches."""
    f, _ = counts([(t, "en") for t, _ in prose(9, 40)])
    suffixes = sorted(((g, " ".join(w) + " ", c) for (g, w), c in f.items() if len(w) == 4), reverse=True)
    want = Counter()
    for g, w, c in suffixes:
        for k in (2, 3, 4):
            want[g, " ".join(w.split(" ")[:k])] += c
    for size in (1, 2, 3, 50, 10**6):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([1] * len(part), pa.int8()), pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2] for r in part])], ["by", "lang", "suffix", "n"])
            for part in (suffixes[i : i + size] for i in range(0, len(suffixes), size))
        ]
        out = Counter()
        for b in phrases._counted(1)(iter(batches)):
            for g, p, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                assert (g, p) not in out
                out[g, p] = c
        assert out == want


def test_empty_and_clashing(spark):
    assert got(collocations(table(spark, [(None, None)]).where("false"))) == []
    clash = spark.createDataFrame([("a b " * 40, "en", 1, "x", 2)], "text string, lang string, word int, phrase string, class int")
    assert [r[:4] for r in got(collocations(clash))][:1] == [("en", 1, "b a b a", 38)] or len(got(collocations(clash))) > 0
    found, totals = frequent_phrases(clash)
    assert totals.collect()[0].n == 80 and {r.phrase for r in found.collect()} == {"a", "b", "a b", "b a", "a b a", "b a b", "a b a b", "b a b a"}
    assert np.array_equal(phrases._KIND[[32, 9, 10, 13, 46]], [1, 1, 2, 2, 2])
