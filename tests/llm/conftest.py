import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table, in several partitions, of (doc_id, text[, source]) rows."""

    def of(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"s{i % 3}", None if r[1] is None else len(r[1])) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return of


@pytest.fixture(scope="session")
def texts():
    """Rows (doc_id, text): prose with exact and near copies, shared passages, repeated
    lines, odd white space, very long and empty texts, nulls, ties and repeated rows."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "é", "ÉTÉ", "Straße"] * 20
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = line(70)
    rows = []
    for i in range(60):
        lines = [line(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 8))]
        if i % 5 == 0:
            lines.insert(0, "read more about this")
        if i % 7 == 0:
            lines.append(line(3) + " " + passage + " " + line(4))
        rows.append((i, "\n".join(lines)))
    for i in range(60, 90):
        words = rows[i - 60][1].split(" ")
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [
        (90, None), (91, ""), (92, "   \n\t "), (93, "one"), (94, "   word\x0bword\r\nword \n\n end "),
        (95, "\n".join(line(30) for _ in range(900))), (96, rows[3][1] + "\n" + passage), (97, ("again " * 400).strip()),
        (98, ("again " * 400).strip()), (5, rows[5][1]), (None, rows[7][1]), (None, None), (-3, rows[9][1]),
    ]
    return rows
