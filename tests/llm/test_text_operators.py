"""Operators 1, 6 and 8 against brute force; their edge cases."""

import hashlib
import itertools
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trackloom.llm import lines, simhash, substrings
from trackloom.llm.words import batches_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_match_the_pattern(texts):
    column = pa.array([t for _, t in texts])
    for at, words in batches_of(column, 700):
        for i in range(len(words.offsets) - 1):
            text = column[at + i].as_py() or ""
            own = range(words.first[i], words.first[i + 1])
            assert [bytes(words.bytes[words.starts[j] : words.ends[j]]).decode() for j in own] == WORD.findall(text)
    seen = {}
    for _, words in batches_of(column):
        for a, b, h in zip(words.starts, words.ends, words.hashes.tolist()):
            assert seen.setdefault(h, bytes(words.bytes[a:b])) == bytes(words.bytes[a:b])


def brute_lines(rows):
    def place(d, t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return (1, 0, h % 2**62) if d is None else (0, d, h % 2**31)

    every = [(place(d, t), n, frozenset(WORD.findall(x)), k, x) for k, (d, t) in enumerate(rows) if t is not None for n, x in enumerate(t.split("\n"))]
    kept = {k: [] for k in range(len(rows))}
    for d, n, s, k, x in every:
        if not s or not any(e[2] and (e[0], e[1]) < (d, n) and 5 * len(s & e[2]) >= 4 * len(s | e[2]) for e in every):
            kept[k].append(x)
    count = lambda t: 0 if t is None else len(t.split("\n"))
    out = [(d, None if t is None else "\n".join(kept[k]), count(t), count(t) - len(kept[k])) for k, (d, t) in enumerate(rows)]
    return sorted(out, key=str)


def test_line_dedup_is_exact(make, texts):
    rows = [(d, None if t is None else "\n".join(t.split("\n")[:40])) for d, t in texts]
    found = lines.dedup_lines(make(rows).withColumn("n_lines", F.lit("clash")))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()), key=str)
    assert got == brute_lines(rows)


@pytest.mark.parametrize("ids", [(5, 7, 7), (None, None, None), ((1 << 63) - 1, (1 << 63) - 1, None)])
def test_line_dedup_keeps_by_row(make, ids):
    """Rows of one id, or of none, are told apart by their texts."""
    x, y = "an early line of some words", "and another one to be kept"
    rows = list(zip(ids, [x, y, x + "\n" + y + " too"])) + [(ids[1], y), (9, y)]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(make(rows)).collect()), key=str)
    assert got == brute_lines(rows)


def test_line_dedup_of_very_long_lines_and_a_hot_word(make):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, " ".join(f"u{i}" for i in range(30_000)) + "\nend of it")]
    rows += [(10 + i, f"the same five words again {i} {i + 1} {i * 7}") for i in range(150)] + [(None, "the same five words again")] * 30
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(make(rows)).collect()), key=str)
    assert got == brute_lines(rows)


def test_line_dedup_of_a_large_group_of_near_copies(make):
    base = [f"t{i}" for i in range(30)]
    rows = [(i, " ".join(base[: i % 30] + [f"x{i}"] + base[i % 30 + 1 :])) for i in range(200)]
    got = sorted(r.doc_id for r in lines.dedup_lines(make(rows)).where("n_removed = 0").collect())
    assert got == sorted(d for d, _, _, gone in brute_lines(rows) if gone == 0)


def brute_substrings(rows, window=50):
    first = {}
    for d, t in rows:
        if d is not None:
            w = WORD.findall(t or "")
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_is_exact(make, texts):
    found = substrings.remove_repeats(make(texts).withColumn("spans", F.lit(1)))
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found.collect()]
    assert sorted(got, key=str) == brute_substrings(texts)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found.collect())


@pytest.mark.parametrize("step", [1, 3])
def test_substring_dedup_of_overlapping_passages(make, step):
    words = [f"p{i}" for i in range(200)]
    rows = [(d, " ".join([f"a{d}"] + words[d * step : d * step + 60 + d] + [f"b{d}"])) for d in range(40)]
    rows += [(d, " ".join(words[d : d + 55] + words[100:152])) for d in range(40, 50)]
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(make(rows)).collect()]
    assert sorted(got, key=str) == brute_substrings(rows)


def brute_print(text, k=4):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(texts):
    for _, t in texts:
        assert simhash.fingerprint(t) == brute_print(t)


def test_simhash_links_are_exact(spark, make, texts):
    got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in simhash.near_duplicates(make(texts)).collect()}
    prints = [(d, brute_print(t)) for d, t in texts]
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(prints)), 2):
            if label[i] != label[j] and (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                low = min(label[i], label[j])
                label[i] = label[j] = low
                changed = True
    for i, (d, p) in enumerate(prints):
        ids = [x for (x, _), g in zip(prints, label) if g == label[i] and x is not None]
        assert got[d, p] == min(ids, default=None)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(label[i], []).append((d is None, d))
    kept = [(r.doc_id is None, r.doc_id) for r in simhash.keep_first(make(texts), shingle=4).collect()]
    assert sorted(kept, key=str) == sorted((min(g) for g in groups.values()), key=str)


def test_keep_first_tells_rows_apart_by_content(make):
    """Unlike documents of one id stay, equal rows become one, at any partitioning."""
    unlike = ["a b c d e f g h", "nine lives of ten cats are eleven lives too many", "zz yy xx ww vv uu tt ss rr qq"]
    rows = [(7, unlike[0]), (7, unlike[1]), (7, unlike[0]), (None, unlike[2]), (None, unlike[2]), (None, unlike[1]), (3, unlike[1])]
    for parts in (1, 5):
        table = make([(d, t, "s") for d, t in rows], parts).withColumn("fp", F.lit("clash")).withColumn("id", F.lit(0))
        assert sorted(((r.doc_id, r.text) for r in simhash.keep_first(table).collect()), key=str) == sorted([(3, unlike[1]), (7, unlike[0]), (None, unlike[2])], key=str)


def test_fingerprint_of_a_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("layout", [*simhash.LAYOUTS, None])
def test_near_pairs_reach_every_distance_up_to_four(spark, layout):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {*base} | {b ^ sum(1 << x for x in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 4, 4, 4, 5, 6)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(s,) for s in signed], "fp long"), layout).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("apply", [lines.dedup_lines, substrings.remove_repeats, simhash.near_duplicates, simhash.keep_first])
def test_empty_and_null_tables(make, apply):
    assert apply(make([])).collect() == []
    assert len(apply(make([(1, None), (2, None)])).collect()) == (1 if apply is simhash.keep_first else 2)


def test_layouts_follow_the_number_of_fingerprints():
    best = [min(simhash.LAYOUTS, key=lambda x: x.work(n)) for n in (10**3, 10**5, 10**7, 10**9)]
    assert best[0] == simhash.LAYOUTS[0] and best[-1] == simhash.LAYOUTS[-1]
    work = [min(x.work(n) for x in simhash.LAYOUTS) for n in (10**3, 10**9)]
    assert work[1] < 20 * work[0]
