"""The registered queries themselves: against DuckDB, or against brute force over the given tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from trackloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def rows(pdf):
    def plain(v):
        v = v.item() if isinstance(v, np.generic) else v
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    names = sorted(pdf.columns)
    return names, sorted((tuple(map(plain, r)) for r in pdf[names].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_fingerprints_and_components(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op8_simhash"](spark, DATA).collect()}
    prints = {}
    for d, t, _ in docs:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints.items():
            for b, y in prints.items():
                if label[b] < label[a] and (x ^ y).bit_count() <= 4:
                    label[a], changed = label[b], True
    assert {d: r.component_id for d, r in got.items()} == label


def test_secrets_hold_the_base_spans(spark, docs):
    from trackloom.llm.secrets import find_secrets

    for r in QUERIES["op4_secrets"](spark, DATA).collect():
        base, spans = find_secrets(dict((d, t) for d, t, _ in docs)[r.doc_id])
        said = lambda some: ",".join(f"{k}:{a}:{b}" for a, b, k in some)
        assert set(base) <= set(spans) and r.spans == said(spans) and r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest()


def test_mix_meets_its_targets(spark, docs):
    got = QUERIES["op2_mixing"](spark, DATA).toPandas()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    assert dict(zip(got["doc_id"], got["size"])) == size and (got["taken"] <= 3 * got["size"]).all()
    for target, taken in got.assign(source=got["doc_id"].map({d: s for d, _, s in docs})).groupby("source").agg({"target": "max", "taken": "sum"}).itertuples(index=False):
        assert abs(taken - target) <= 2


def test_packing_covers_every_document(spark, docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op10_packing"](spark, DATA).toPandas()
    want = Counter()
    for d, t, _ in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((d, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    placed = got.sort_values(["sequence_id", "offset"])
    ends = (placed["offset"] + placed["length"]).groupby(placed["sequence_id"])
    assert (ends.shift(fill_value=0) == placed["offset"]).all() and ends.max().max() <= 2048
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 2048) + 2
