"""Operator 8: SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint falls into segments of equal width; their bit counts are a vector whose
Manhattan distance never exceeds the Hamming distance.  The segments form groups, each with
a radius, so that of two fingerprints that differ in at most 4 bits some group lies within
its radius (were all beyond, they would differ in more bits).  So a grid join whose cells
are the count vectors of a group, over the cells within the radius, finds every pair; each
is then verified on the fingerprints themselves.

Narrower segments and wider groups make more and smaller cells at the price of more rows
for each fingerprint.  The layout is the one of least work for the number of distinct
fingerprints; all layouts find the same pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, UPPER, components, free_name, materialize, read_table, row_hash

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
MAX_BITS = 4


@dataclass(frozen=True)
class Layout:
    """Segments of ``width`` bits; groups (first segment, segments, radius)."""

    width: int
    groups: tuple[tuple[int, int, int], ...]

    def work(self, n: int) -> float:
        """About the rows that each of ``n`` fingerprints sends to cells and meets in them."""
        # Chances that the counts of two segments are equal and that they lie one or two apart.
        same, one, two = (0.5, 0.5, 0.0) if self.width == 1 else (0.375, 0.5, 0.125)
        sent = met = 0.0
        for _, k, radius in self.groups:
            near = [1.0, k * one / same, k * (k - 1) / 2 * (one / same) ** 2 + k * two / same]
            met += same**k * sum(near[: radius + 1])
            sent += 2 + (0, k / 2 if self.width == 1 else 0.75 * k, (2 if self.width == 1 else 3) * k)[radius]
        return sent + met * n / 2


#: For 4 bits: radii 1, 1 and 0 (beyond all of them lie 2 + 2 + 1 bits), or 2 and 2 (3 + 3 bits).
LAYOUTS = (
    Layout(2, ((0, 11, 1), (11, 11, 1), (22, 10, 0))),
    Layout(1, ((0, 22, 1), (22, 21, 1), (43, 21, 0))),
    Layout(1, ((0, 32, 2), (32, 32, 2))),
)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a whole text: 0 without words; fewer words than a shingle are one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype="<u8", count=len(words) - k + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # memory stays bounded in very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (doc_id, fp long), one for each row of ``docs``."""

    def work(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(work, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def _cells(prints: np.ndarray, layout: Layout, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells of fingerprints as (cell, row).

    Radius 1: probes also reach the cells one step up; of two vectors one step apart, one
    lies above the other, so one of them finds it.  Radius 2: either side reaches the cells
    one step up or down; of two vectors two steps apart, both reach one between them.
    """
    cells, rows = [], []
    index, base = np.arange(len(prints)), layout.width + 1
    for g, (first, n, radius) in enumerate(layout.groups):
        bits = prints[:, None] >> (layout.width * np.arange(first, first + n, dtype=np.uint64))
        counts = sum((bits >> np.uint64(i)) & np.uint64(1) for i in range(layout.width)).astype(np.int64)
        power = base ** np.arange(n, dtype=np.int64)
        own = counts @ power + g * (1 << 60)
        cells.append(own)
        rows.append(index)
        for step, reach in ((1, radius == 2 or probe and radius), (-1, radius == 2)):
            if reach:
                row, at = np.nonzero(counts < layout.width if step == 1 else counts > 0)
                cells.append(own[row] + step * power[at])
                rows.append(row)
    return np.concatenate(cells), np.concatenate(rows)


def near_pairs(prints: DataFrame, layout: Layout | None = None) -> DataFrame:
    """All pairs (a, b) of the distinct ``prints`` (fp) that differ in 1 to 4 bits."""
    if layout is None:
        n = prints.count()
        layout = min(LAYOUTS, key=lambda x: x.work(n))

    def emit(probe: bool):
        def work(batches):
            for batch in batches:
                every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(every), 2048):
                    own = every[at : at + 2048]
                    cells, rows = _cells(own, layout, probe)
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(own[rows].view(np.int64))], ["cell", "x"])

        return work

    index = prints.mapInArrow(emit(False), "cell long, x long").withColumnRenamed("x", "b")
    probes = prints.mapInArrow(emit(True), "cell long, x long").withColumnRenamed("x", "a")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    met = probes.join(index, (probes.cell == index.cell) & (F.col("a") != F.col("b")) & close)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _components_of(rows: DataFrame, first: Column) -> DataFrame:
    """Rows (fp, component_id): of each fingerprint of ``rows`` the least ``first`` that links reach."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("least")))
    linked = components(near_pairs(distinct.select("fp")))
    smallest = distinct.join(linked, distinct.fp == linked.id, "left").withColumn("component", F.coalesce("component", "fp"))
    roots = materialize(smallest.groupBy("component").agg(F.min("least").alias("component_id")))
    return materialize(smallest.select("fp", "component").join(roots, "component").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs``.

    component_id is the smallest doc_id that links reach.  Null and empty texts share
    fingerprint zero, which links like any other; a null doc_id never is the smallest,
    so component_id is null only where no linked row has an id; copies share one entry
    in the join.  Further columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    return rows.join(_components_of(rows, F.col("doc_id")), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that of smallest doc_id,
    nulls last, of several such rows that of least hash.

    Rows are told apart by their content, never by their id alone: unlike documents that
    share an id, or have none, stay if nothing links them; of equal rows one stays.
    """
    # 128 bits of all columns name a row, wherever it lies.
    h1, h2 = free_name(docs, "h1"), free_name(docs, "h2")
    named = docs.select("*", *(row_hash(docs, i).alias(h) for i, h in enumerate((h1, h2))))

    def work(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64))], ["id", "h1", "h2", "fp"])

    slim = named.select(text_col, id_col, h1, h2)
    rows = materialize(slim.mapInArrow(work, f"id {dict(docs.dtypes)[id_col]}, h1 long, h2 long, fp long"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")
    kept = _components_of(rows, first).select(F.col("component_id.h1").alias(h1), F.col("component_id.h2").alias(h2)).distinct()
    # Equal rows have met in one task by then, so dropping all but one needs no shuffle of its own.
    return named.join(kept, [h1, h2], "left_semi").dropDuplicates([h1, h2]).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
