"""The pipeline, stage by stage, each against a brute-force version on its own input."""

import importlib.util
import os
import pathlib
import re
import sys
from collections import Counter

import pytest

HERE = pathlib.Path(__file__).parent
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(name):
    spec = importlib.util.spec_from_file_location(f"brute_{name}", HERE / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    spec.loader.exec_module(module)
    return module


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline

    text, other = brute("test_text_operators"), brute("test_other_operators")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{i}")
        made[name] = before, spark.read.parquet(f"{tmp_path}/{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = made[name][1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}

    before, out = made["quality classifier"]
    kept = {r.doc_id for r in out.collect()}
    right = [(i in kept) == bool(labels[i]) for i, *_ in before if i in labels]
    assert sum(right) >= 0.95 * len(right) and {i for i in kept} <= {i for i, *_ in before}

    before, out = made["line dedup"]
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted(((d, t, len(t)) for d, t, *_ in text.brute_lines([b[:2] for b in before])), key=str)

    before, out = made["SimHash near-dedup"]
    prints = [(d, text.brute_print(t, 5)) for d, t, _ in before]
    group = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if group[b] < group[a] and (x ^ y).bit_count() <= 4:
                    group[a], changed = group[b], True
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(group.values()))

    before, out = made["mixing"]
    size, taken = Counter(), Counter()
    for _, t, s in before:
        size[s] += len(WORD.findall(t or ""))
    for r in out.collect():
        taken[r.source] += len(WORD.findall(r.text))
    for s, target in other.brute_targets(size).items():
        assert abs(taken[s] - target) <= max(2, 0.01 * target)

    before, out = made["packing"]
    rows = out.toPandas().sort_values(["sequence_id", "offset"])
    ends = (rows["offset"] + rows["length"]).groupby(rows["sequence_id"])
    assert (ends.shift(fill_value=0) == rows["offset"]).all() and ends.max().max() <= 2048
    assert (rows["piece"] == 0).sum() == len(before)
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 2048) + 2


def test_run_handles_odd_documents(spark, make, tmp_path):
    """Nulls in every column, repeated ids and rows, very long and empty texts, extra columns with clashing names."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from trackloom.llm import common

    text = brute("test_text_operators")
    prose = [" ".join(f"w{(i * 37 + j * j) % 211}" for j in range(20 + i)) for i in range(30)]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(prose)] + [(3, prose[3], "a"), (3, prose[9] + " unlike", None), (None, prose[4], "b"), (None, None, None), (50, "", "a"), (51, None, "b"), (52, "long " + " ".join(f"v{i}" for i in range(60_000)), "c")]
    docs = make(rows).withColumn("uid", F.lit("clash")).withColumn("kept", F.col("doc_id")).withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    first = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert (first["length"] <= 2048).all() and len(first) and first.groupby("row_id")["start"].min().max() == 0
    before = len(common._MADE)
    again = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, first[key].values.tolist())) == sorted(map(str, again[key].values.tolist())) and len(common._MADE) - before <= 2
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == [] and text
