"""Operator 5: near-duplicate embeddings by a random-projection tree forest.

Every tree splits the vectors of a label at random directions; a band around each split
goes to both sides (spill).  Cells that are too large for a task are split by Spark jobs,
level by level; the rest of a tree is grown inside the task of its cell, down to leaves.
All vectors of a leaf are compared, pairs are verified in double precision, and the pairs
of all trees are united.  Equal vectors of a label are one entry throughout.

Splits inside a dense group would part its pairs at random.  So a cell in which a sample
of pairs links at a rate of ``DENSE`` or more is split no further, however large: all its
vectors are compared, in blocks, which costs a bounded multiple of the links it yields.
Each two blocks of a dense cell are a task; it gives a count for each vector and what the
links connect, not the links, which are as many as the square of a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.common import components, materialize, read_table

SPILL = 0.1
LEAF = 256
CELL_ROWS = 16_384
#: The rate of linked pairs from which a cell is compared whole, and how many vectors a sample of it has.
DENSE, SAMPLE = 1 / 16, 128
BLOCK = 1024
#: Cells of up to so many vectors are leaves without a test of their density.
FEW = 16
#: The kinds of rows that tasks return: a linked pair, a link of a component, a vector of a dense cell, a count of links.
PAIR, STAR, MEMBER, COUNT = range(4)


def _direction(seed: int, tree: int, cell: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, cell & (2**63 - 1), dim]).standard_normal(dim)


def _is_dense(unit: np.ndarray, threshold: float) -> bool:
    some = unit[np.linspace(0, len(unit) - 1, min(len(unit), SAMPLE)).astype(int)]
    k = len(some)
    return k > 1 and int((some @ some.T >= threshold).sum()) - k >= DENSE * k * (k - 1)


def _split_large(cells: DataFrame, seed: int, most: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Split cells (tree, cell, ...) of over ``most`` rows until none is larger but dense ones,
    or until splitting no longer makes the largest smaller.  Returns the cells of at most
    ``most`` rows, and the others, which are to be compared whole, with their row count ``rows``."""

    def density(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        dense = _is_dense(x / np.linalg.norm(x, axis=1, keepdims=True), threshold)
        return pd.DataFrame({"tree": [key[0]], "cell": [key[1]], "dense": [dense]})

    @F.pandas_udf(T.DoubleType())
    def projected(tree: pd.Series, cell: pd.Series, v: pd.Series) -> pd.Series:
        out = np.empty(len(v))
        for key, at in pd.DataFrame({"t": tree, "c": cell}).reset_index(drop=True).groupby(["t", "c"]).indices.items():
            x = np.stack(v.to_numpy()[at]).astype(float)
            out[at] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ _direction(seed, int(key[0]), int(key[1]), x.shape[1])
        return pd.Series(out)

    before, whole = None, cells.withColumn("rows", F.lit(0).cast("long")).limit(0)
    while True:
        sizes = cells.groupBy("tree", "cell").agg(F.count("*").alias("rows"))
        large = materialize(sizes.where(F.col("rows") > most))
        largest = large.agg(F.max("rows")).first()[0]
        if largest is None:
            return cells, whole
        small = cells.join(large, ["tree", "cell"], "left_anti")
        if before is not None and largest >= before:
            return materialize(small), materialize(whole.unionByName(cells.join(large, ["tree", "cell"])))
        before = largest
        sample = cells.join(large, ["tree", "cell"]).where(F.pmod(F.xxhash64("uid", F.lit(seed)), F.col("rows")) < SAMPLE)
        dense = materialize(sample.groupBy("tree", "cell").applyInPandas(density, "tree int, cell long, dense boolean").where("dense").drop("dense"))
        whole = materialize(whole.unionByName(cells.join(large.join(dense, ["tree", "cell"], "left_semi"), ["tree", "cell"])))
        large = large.join(dense, ["tree", "cell"], "left_anti").select("tree", "cell")
        cut = materialize(cells.join(large, ["tree", "cell"], "left_semi").withColumn("p", projected("tree", "cell", "v")))
        bounds = materialize(cut.groupBy("tree", "cell").agg(F.percentile_approx("p", [0.5 - SPILL, 0.5 + SPILL]).alias("q")))
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("q")[1], 0), F.when(F.col("p") >= F.col("q")[0], 1)))
        split = cut.join(bounds, ["tree", "cell"]).withColumn("side", F.explode(sides)).withColumn("cell", F.xxhash64("cell", "side"))
        cells = materialize(small.unionByName(split.select(*cells.columns)))


class _Vectors:
    """The vectors of a group of rows (uid, n, v), and the pairs of them that link."""

    def __init__(self, pdf: pd.DataFrame, threshold: float) -> None:
        self.uid, self.n, self.threshold = pdf["uid"].to_numpy(), pdf["n"].to_numpy(), threshold
        self.raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        self.norms = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.unit = self.raw / self.norms[:, None]
        self.label = np.arange(len(self.raw))

    def linked(self, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places (i, j) of the linked pairs of ``rows`` x ``others``, of equal ones only i before j."""
        close = self.unit[rows] @ self.unit[others].T >= self.threshold - 1e-9
        i, j = np.nonzero(np.triu(close, 1) if rows is others else close)
        i, j = rows[i], others[j]
        sure = (self.raw[i] * self.raw[j]).sum(axis=1) / (self.norms[i] * self.norms[j]) >= self.threshold
        return i[sure], j[sure]

    def blocks(self, rows: np.ndarray, others: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All linked pairs of ``rows``, or of ``rows`` x ``others``, block by block."""
        cut = lambda x: [x[a : a + BLOCK] for a in range(0, len(x), BLOCK)]
        left = cut(rows)
        right = left if others is None else cut(others)
        for at, x in enumerate(left):
            for y in right[at:] if others is None else right:
                yield self.linked(x, y)

    def connect(self, i: np.ndarray, j: np.ndarray) -> None:
        """Each vector's label becomes the least that its links reach."""
        while len(i):
            x, y = self.label[i], self.label[j]
            apart = x != y
            i, j, low, high = i[apart], j[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(self.label, high, low)
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]

    def pairs(self, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        uid, n = self.uid, self.n
        i, j = np.where(uid[i] < uid[j], i, j), np.where(uid[i] < uid[j], j, i)
        return pd.DataFrame({"kind": PAIR, "a": uid[i], "b": uid[j], "na": n[i], "nb": n[j]})

    def stars(self) -> pd.DataFrame:
        """What the links connect, as a row for each vector instead of one for each link."""
        v = np.flatnonzero(self.label != np.arange(len(self.label)))
        return pd.DataFrame({"kind": STAR, "a": self.uid[self.label[v]], "b": self.uid[v], "na": 0, "nb": 0})


def _grow(seed: int, threshold: float):
    """Grows the rest of a tree in a cell: the pairs of its leaves, and who is in which dense cell."""

    def work(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _Vectors(pd.concat(parts, ignore_index=True).sort_values("uid"), threshold)
        total = len(x.raw)
        rng = np.random.default_rng([seed, int(key[0]), int(key[1]) & (2**63 - 1)])
        stack, codes = [(np.arange(total), 1)], []
        while stack:
            rows, path = stack.pop()
            if len(rows) > FEW and _is_dense(x.unit[rows], threshold):
                name = xxhash.xxh64_intdigest(f"{key[0]}/{key[1]}/{path}") >> 1
                yield pd.DataFrame({"kind": MEMBER, "a": x.uid[rows], "b": name, "na": 0, "nb": 0})
            elif len(rows) > LEAF:
                order = rows[np.argsort(x.unit[rows] @ rng.standard_normal(x.raw.shape[1]), kind="stable")]
                half, band = len(rows) // 2, int(len(rows) * SPILL)
                stack += [(order[: half + band], 2 * path), (order[half - band :], 2 * path + 1)]
            else:
                i, j = x.linked(rows, rows)
                codes.append(np.unique(np.minimum(i, j) * total + np.maximum(i, j)))
        found = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *codes]))
        x.connect(found // total, found % total)
        yield x.pairs(found // total, found % total)
        yield x.stars()

    return work


def _meet(threshold: float):
    """Compares two blocks of a dense cell.  A pair that dense cells share counts in the
    least of them, so that each vector's count is one number a task, and no pair is a row."""

    def work(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True)
        x, block = _Vectors(pdf, threshold), pdf["block"].to_numpy()
        row, less = np.repeat(np.arange(len(pdf)), pdf["cells"].map(len)), np.concatenate(pdf["cells"].to_numpy())
        row, less = row[less < key[0]], less[less < key[0]]
        names, column = np.unique(less, return_inverse=True)
        inside = np.zeros((len(pdf), len(names)), dtype=bool)
        inside[row, column] = True
        inside = np.packbits(inside[:, inside.sum(axis=0) > 1], axis=1)
        left, right = np.nonzero(block == key[1])[0], np.nonzero(block == key[2])[0]
        others = np.zeros(len(pdf), dtype=np.int64)
        for i, j in x.blocks(left, None if key[1] == key[2] else right):
            x.connect(i, j)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                first = ~(inside[p] & inside[q]).any(axis=1)
                np.add.at(others, p[first], x.n[q[first]])
                np.add.at(others, q[first], x.n[p[first]])
        some = np.flatnonzero(others)
        yield pd.DataFrame({"kind": COUNT, "a": x.uid[some], "b": 0, "na": 0, "nb": others[some]})
        yield x.stars()

    return work


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, trees: int = 6, seed: int = 11, cell_rows: int = CELL_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``.

    Rows link if labels and lengths are equal, labels are not null and the cosine is at
    least ``threshold``.  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing: no links, component of their own.  Repeated ids are
    rows of their own; a null id never is the smallest.  Equal vectors and those of equal
    cosines need no order, as links do not depend on one.  Further columns are not read, and
    those named like the results are no part of it.  The forest may miss pairs (recall
    is measured in the tests); it never links one below the threshold.
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    fine = F.col(label_col).isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda c: c != 0)
    rows = materialize(vectors.select(F.col(id_col).alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.when(fine, F.col(label_col)).alias("label"), F.when(fine, x).alias("v")))
    usable = rows.where("v is not null")
    reps = materialize(usable.groupBy("label", "v").agg(F.min(F.struct("vec_id", "row")).alias("first"), F.count("*").alias("n")).select("label", "v", "n", F.col("first.row").alias("uid")))

    cells = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("cell", F.xxhash64("label", F.size("v"))).select("tree", "cell", "uid", "n", "v")
    cells, whole = _split_large(cells, seed, cell_rows, threshold)
    made = "kind int, a long, b long, na long, nb long"
    found = materialize(cells.groupBy("tree", "cell").applyInPandas(_grow(seed, threshold), made))
    members = materialize(found.where(F.col("kind") == MEMBER).select(F.col("a").alias("uid"), F.col("b").alias("dense")).union(whole.select("uid", F.shiftrightunsigned(F.xxhash64("tree", "cell"), 1))).distinct())
    pairs = found.where(F.col("kind") == PAIR).select("a", "b", "na", "nb").distinct()
    stars = found.where(F.col("kind") == STAR).select("a", "b")
    links = lambda pairs: pairs.select(F.col("a").alias("uid"), F.col("nb").alias("others")).union(pairs.select("b", "na"))
    if members.isEmpty():
        counts = links(materialize(pairs))
    else:
        # A vector is in a few dense cells of each tree.  Block i of a cell meets the blocks from i on:
        # every row goes to as many tasks as there are blocks.
        lists = materialize(members.groupBy("uid").agg(F.collect_list("dense").alias("cells")))
        sizes = members.groupBy("dense").agg(F.ceil(F.count("*") * 2 / cell_rows).alias("blocks"))
        dealt = members.join(sizes, "dense").withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed), F.lit(1)), "blocks"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.join(lists, "uid").join(reps.select("uid", "n", "v"), "uid")
        dealt = dealt.select("dense", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "n", "v", "cells")
        met = materialize(dealt.groupBy("dense", "i", "j").applyInPandas(_meet(threshold), made))
        # Pairs of leaves that a dense cell holds too are counted there.
        ends = pairs.join(lists.toDF("a", "of_a"), "a", "left").join(lists.toDF("b", "of_b"), "b", "left")
        counts = links(materialize(ends.where(~F.coalesce(F.arrays_overlap("of_a", "of_b"), F.lit(False)))))
        counts = counts.union(met.where(F.col("kind") == COUNT).select("a", "nb"))
        stars = stars.union(met.where(F.col("kind") == STAR).select("a", "b"))

    links = counts.groupBy("uid").agg(F.sum("others").alias("others"))
    # Components grow from the stars: in a dense group links are as many as the square of its size.
    linked = components(stars).select(F.col("id").alias("uid"), "component")
    classes = reps.join(links, "uid", "left").join(linked, "uid", "left")
    classes = materialize(classes.select("label", "v", F.coalesce("component", "uid").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    placed = materialize(usable.join(classes, ["label", "v"]).select("vec_id", "component", "n_links"))
    least = materialize(placed.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    placed = placed.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: What the contract asks.  The query equals it where no label has more than LEAF vectors, as all are compared then.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))
    / (sqrt(list_sum(list_transform(a.x, lambda c: c * c))) * sqrt(list_sum(list_transform(b.x, lambda c: c * c)))) >= 0.93::double),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
