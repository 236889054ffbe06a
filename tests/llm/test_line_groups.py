"""Operator 1: which lines meet a first line before the join, and prefixes longer than places are told apart."""

from trackloom.llm import lines


def _lines(make, rows):
    return lines.distinct_lines(make(rows), 4, 5, "doc_id", "text")


def test_only_large_groups_are_settled_before_the_join(make):
    near = lambda g, i: " ".join(f"g{g}w{k}" for k in range(40)) + f" g{g}x{i}"
    some = [(g * 10 + i, near(g, i)) for g in range(20) for i in range(3)]
    assert lines.first_candidates(_lines(make, some), 4, 5).count() == 0
    many = [(1000 + i, near(99, i)) for i in range(60)]
    every = _lines(make, some + many)
    pairs = lines.first_candidates(every, 4, 5)
    docs = {r.id: r.doc for r in every.collect()}
    met = {(docs[r.id], docs[r.first]) for r in pairs.collect()}
    assert all(a > b >= 1000 for a, b in met) and len({a for a, _ in met}) >= 50
    got = sorted(r.doc_id for r in lines.dedup_lines(make(some + many)).where("n_removed = 0").collect())
    assert got == [g * 10 for g in range(20)] + [1000]


def test_lines_that_first_share_a_word_far_into_their_prefixes(make):
    whole = [f"w{k}" for k in range(10_000)]
    rows = [(d, " ".join(whole[own:] + [f"d{d}own{k}" for k in range(own)])) for d, own in ((1, 1100), (2, 1100), (3, 1300))]
    rows += [(10 + d, " ".join(whole[k : k + 100])) for d, k in enumerate(range(0, 10_000, 100))]  # own words are rarer
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(make(rows)).collect()}
    assert [d for d, n in got.items() if n] == [2]  # 8900 of 11,100 words are shared; with document 3 8700 of 11,300
