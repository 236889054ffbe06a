"""Operator 4 on content longer than a chunk, on layers of escapes, and mixes that ignore further columns."""

import base64
import bz2
import gzip
import random

import pytest

from trackloom.llm import secrets
from trackloom.llm.mixing import mix
from trackloom.llm.secrets import find_secrets
from trackloom.llm.simhash import keep_first

SECRET = "password = hunter2hunter2"
rng = random.Random(1)
NOISE = bytes(rng.randrange(32, 127) for _ in range(36_000))
FILLER = ("lorem ipsum dolor sit amet " * 45_000).encode()


def b64(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("offset", [500_000, 1_010_000, 1_025_000, 1_048_570, 1_048_576])
@pytest.mark.parametrize("inner", ["token", "wrapped", "spaces", "utf16", "twice"])
def test_what_stands_across_chunks(offset, inner):
    token = b64(gzip.compress(NOISE + SECRET.encode()))
    assert len(token) > 40_000
    if inner == "wrapped":
        token = "\n".join(token[i : i + 76] for i in range(0, len(token), 76))
    elif inner == "spaces":
        token = "password " + " " * 40_000 + "= hunter2hunter2"
    elif inner == "twice":
        token = b64(bz2.compress(FILLER[:1_020_000] + b" " + token.encode()))
    content = FILLER[:offset] + b" " + token.encode() + b" " + FILLER[:1000]
    if inner == "utf16":
        content = content.decode().encode("utf-16-le")
    text = "see " + b64(gzip.compress(content)) + " there"
    assert [(a, b, k) for a, b, k in find_secrets(text)[1] if k == "assign"] == [(4, len(text) - 6, "assign")]
    assert find_secrets(text)[0] == []


def test_every_layer_of_escapes_is_scanned(monkeypatch):
    deep = lambda text, n: "%" + "25" * n + "".join(f"{ord(c):02x}" for c in text[:1]) + text[1:]
    for n in (1, 15, 16, 17, 40, 400):
        text = "x " + deep("AKIA" + "B" * 16, n) + " y"
        assert (2, len(text) - 2, "access") in find_secrets(text)[1]
    # A secret that only a layer in the middle has as such: the next unescapes into it.
    text = "%25" * 1 + "25" * 20 + "41 secret=abcdefgh%" + "25" * 30 + "41 end"
    every = find_secrets(text)[1]
    monkeypatch.setattr(secrets, "LAYERED", 0)
    fewer = find_secrets(text)[1]
    assert set(fewer) <= set(every)
    assert all(any(a <= c and d <= b and k == j for a, b, k in fewer) for c, d, j in every)


def test_long_chains_end():
    text = "%" + "25" * 20_000 + "41KIA" + "B" * 16
    assert (0, len(text), "access") in find_secrets(text)[1]


def test_further_columns_change_nothing(make, texts):
    docs = make(texts)
    key = lambda df: sorted((repr(r.doc_id), r.size, r.taken) for r in df.collect())
    other = docs.selectExpr("*", "map('a', n_chars) AS m", "1 AS content", "array(map(1, 2)) AS bucket")
    assert key(mix(docs)) == key(mix(other))
    kept = keep_first(other)
    assert kept.columns == other.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (r.doc_id for r in keep_first(docs).collect())))
