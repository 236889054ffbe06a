"""Operator 9: exact top-k search by inner product over KD-trees, one per shard.

The upper levels of a KD-tree, fitted on a sample, part the space into regions, and these
are dealt to shards; each shard's task splits its vectors on at medians, with a tight
bounding box around every node.  A query walks a tree best first: the box gives an upper
bound of the inner product, and nodes whose bound is below the query's kth score so far
are never opened.  The kth score is propagated: queries first search their home shard;
regions whose box cannot reach the score found there are not asked, and the shards of the
others start from it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, read_table

LEAF = 256
#: Rows of the sample that the regions are fitted on, and how many of it a region holds at least.
SAMPLE, REGION = 4096, 32
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_OUT = "query long, quid long, vec_id long, score long, beyond string"


def _floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of rows of doubles: doubles where all inner products are exact in
    them, else Python's integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * float(scale))
    if np.abs(v).max(initial=0) <= _exact(x.shape[1]):
        return v
    whole = [[int(s) if math.isfinite(s) else int(c) * scale for s, c in zip(*both, strict=True)] for both in zip(v.tolist(), x.tolist(), strict=True)]
    return np.array(whole, dtype=object).reshape(x.shape)


def _exact(dim: int) -> int:
    """Components up to this give sums of ``dim`` products that doubles hold exactly."""
    return math.isqrt((1 << 53) // max(dim, 1))


def _beyond(score: int) -> str:
    """Orders scores that a long cannot hold; empty for the others."""
    if _LOW < score <= _HIGH:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


class Tree:
    """A KD-tree of integer vectors: per node its box, children and, in leaves, its rows."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, lows, highs, self.children, self.rows = vectors, [], [], [], []
        stack = [(np.arange(len(vectors)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            own, node = vectors[rows], len(self.rows)
            low, high = own.min(axis=0), own.max(axis=0)
            lows.append(low)
            highs.append(high)
            self.children.append([-1, -1])
            self.rows.append(None)
            if parent >= 0:
                self.children[parent][side] = node
            if len(rows) <= LEAF or (low == high).all():
                self.rows[node] = rows
                continue
            order = np.argsort(own[:, np.argmax(high - low)], kind="stable")
            stack += [(rows[order[: len(rows) // 2]], node, 0), (rows[order[len(rows) // 2 :]], node, 1)]
        self.lows, self.highs = np.array(lows), np.array(highs)

    def whole(self) -> Tree:
        """The same tree in Python's integers."""
        if self.vectors.dtype != object:
            of = lambda x: x.astype(np.int64).astype(object)
            self.vectors, self.lows, self.highs = of(self.vectors), of(self.lows), of(self.highs)
        return self

    def search(self, query: np.ndarray, best: list[tuple[int, int, int]], k: int, floor: int | None, own: int, ids: np.ndarray, uids: np.ndarray) -> None:
        """Adds to ``best``, a heap of the best k (score, -vec_id, -uid), none below ``floor``."""
        plus, minus = np.maximum(query, 0), np.minimum(query, 0)
        bounds = self.highs @ plus + self.lows @ minus
        work = [(-int(bounds[0]), 0)]
        while work:
            bound, node = heapq.heappop(work)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -bound < least:
                break
            rows = self.rows[node]
            if rows is None:
                for child in self.children[node]:
                    heapq.heappush(work, (-int(bounds[child]), child))
                continue
            rows = rows[uids[rows] != own]
            scores = self.vectors[rows] @ query
            if least is not None:
                rows, scores = rows[scores >= least], scores[scores >= least]
            if len(rows) > k:  # ties at the kth place stay
                kth = np.sort(scores)[len(scores) - k]
                rows, scores = rows[scores >= kth], scores[scores >= kth]
            for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
                item = (int(score), -int(ids[row]), -int(uids[row]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def _search(k: int, scale: int):
    def work(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(shard):
            x, asked = (np.stack(t["v"].to_numpy()).astype(float) for t in (shard, queries))
            with np.errstate(over="ignore"):
                small, plain = ((np.abs(np.floor(t * float(scale))) <= _exact(t.shape[1])).all(axis=1) for t in (x, asked))
            ids, uids = shard["id"].to_numpy(), shard["uid"].to_numpy()
            # Vectors of large components have a tree of their own, in Python's integers.
            trees = [(Tree(_floors(x[rows], scale)), ids[rows], uids[rows]) for rows in (small, ~small) if rows.any()]
            qids, quids, floors = (queries[c].tolist() for c in ("id", "uid", "floor"))
            for i in np.argsort(~plain, kind="stable"):  # queries of large components come last
                query, best = _floors(asked[i : i + 1], scale)[0], []
                for tree, own_ids, own_uids in trees:
                    exact = plain[i] and tree.vectors.dtype != object
                    fits = query if exact else np.array([int(c) for c in query], dtype=object)
                    (tree if exact else tree.whole()).search(fits, best, k, None if floors[i] == _LOW else floors[i], quids[i], own_ids, own_uids)
                found += [(qids[i], quids[i], -c, min(max(s, _LOW), _HIGH), _beyond(s)) for s, c, _ in best]
        return pd.DataFrame(found, columns=["query", "quid", "vec_id", "score", "beyond"])

    return work


class Regions:
    """The upper levels of the KD-tree, fitted on a bounded sample: medians of the widest
    dimension, down to ``least`` rows of the sample.  One set for each length of vectors."""

    def __init__(self, sample: pd.DataFrame, least: int):
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        for dim, part in sample.groupby(sample["v"].map(len)) if len(sample) else ():
            if dim:
                self.of[int(dim)] = self._split(np.stack(part["v"].to_numpy()).astype(float), least)

    @staticmethod
    def _split(x: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        axis, cut, child, stack = [], [], [], [(x, -1, 0)]
        while stack:
            own, parent, side = stack.pop()
            if parent >= 0:
                child[parent][side] = len(axis)
            low, high = own.min(axis=0) / 2, own.max(axis=0) / 2
            wide = int(np.argmax(high - low))
            at = float(np.median(own[:, wide]))
            left = own[:, wide] < at
            ends = len(own) < 2 * least or not left.any()
            axis.append(-1 if ends else wide)
            cut.append(at)
            child.append([0, 0])
            if not ends:
                stack += [(own[left], len(axis) - 1, 0), (own[~left], len(axis) - 1, 1)]
        return np.array(axis), np.array(cut), np.array(child)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The region of each row of ``x``."""
        node = np.zeros(len(x), dtype=np.int64)
        if x.shape[1] in self.of:
            axis, cut, child = self.of[x.shape[1]]
            while (inner := axis[node] >= 0).any():
                at = node[inner]
                node[inner] = child[at, (x[inner, axis[at]] >= cut[at]).astype(int)]
        return node


def _place_rows(regions: Regions, names: list[str]):
    """Rows (dim and v among them) with their ``region``."""

    def work(batches):
        for pdf in batches:
            pdf["region"] = 0
            for _, at in pdf.reset_index(drop=True).groupby("dim").indices.items():
                pdf.iloc[at, pdf.columns.get_loc("region")] = regions.place(np.stack(pdf["v"].to_numpy()[at]).astype(float).reshape(len(at), -1))
            yield pdf[names]

    return work


def _boxes(batches):
    for pdf in batches:
        for (dim, region), part in pdf.groupby(["dim", "region"]):
            x = np.stack(part["v"].to_numpy()).astype(float).reshape(len(part), -1)
            yield pd.DataFrame({"dim": [dim], "region": [region], "n": [len(part)], "low": [x.min(axis=0)], "high": [x.max(axis=0)]})


def _one_box(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    low, high = (np.stack(pdf[c].to_numpy()) for c in ("low", "high"))
    return pd.DataFrame({"dim": [key[0]], "region": [key[1]], "n": [pdf["n"].sum()], "low": [low.min(axis=0)], "high": [high.max(axis=0)]})


def _reached(boxes: dict[int, tuple[np.ndarray, ...]], scale: int):
    """Queries with ``reach``: the regions whose box may hold a score of at least ``floor``;
    null where the length of the vector has no boxes, so that all regions are meant."""

    def work(batches):
        for pdf in batches:
            reach: list = []
            for v, floor in zip(pdf["v"], pdf["floor"], strict=True):
                box = boxes.get(len(v))
                if box is None:
                    reach.append(None)
                    continue
                region, low, high = box
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(np.asarray(v, dtype=float) * float(scale))
                    a, b = np.floor(low * float(scale)), np.floor(high * float(scale))
                    bound = np.maximum(a * q, b * q).sum(axis=1)
                    slack = 1e-9 * np.maximum(np.abs(a * q), np.abs(b * q)).sum(axis=1)  # of rounding, in large values
                    out = bound + slack < (-np.inf if floor == _LOW else float(floor))
                reach.append(region[~out].tolist())
            yield pdf.assign(reach=pd.Series(reach, index=pdf.index, dtype=object))

    return work


def top_k(vectors: DataFrame, *, k: int = 5, query_step: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = 32_768, block_rows: int = 32_768) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its ``k`` best candidates.

    Components become floor(scale * x); the score is their inner product, ties go to the
    smaller vec_id.  Queries are the rows whose id is divisible by ``query_step``; every
    other row of as many components is a candidate.  Vectors that are null or hold null
    or non-finite components take no part, nor do rows without an id.  Repeated ids are
    rows of their own: each such query row is answered, and only the row itself is left
    out.  Any finite component counts in full: ranks follow the whole integers, and scores
    that a long cannot hold are given as the least or the largest long.

    The corpus is dealt to the regions of a KD-tree fitted on a sample of ``SAMPLE`` rows,
    and these to shards of about ``shard_rows``.  A shard meets ``block_rows`` queries at a
    time, so that its tree is built once for as many; smaller tables make smaller shards,
    so that every core has some.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = materialize(vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), x.cast("array<double>").alias("v"), F.size(x).alias("dim")))
    n = rows.count()
    blocks = max(1, -(-n // (query_step * block_rows)))
    shard_rows = min(shard_rows, max(1024, n // (2 * spark.sparkContext.defaultParallelism)))

    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").toPandas()
    regions = Regions(sample, max(REGION, -(-len(sample) * shard_rows // max(n, 1))))
    placed = materialize(rows.mapInPandas(_place_rows(regions, [*rows.columns, "region"]), "id long, uid long, v array<double>, dim int, region long"))
    boxed = placed.select("dim", "region", "v").mapInPandas(_boxes, "dim int, region long, n long, low array<double>, high array<double>")
    boxed = materialize(boxed.groupBy("dim", "region").applyInPandas(_one_box, "dim int, region long, n long, low array<double>, high array<double>"))
    # Boxes of lengths that the sample holds: fewer than its rows.
    known = boxed.where(F.col("dim").isin(*regions.of)).select("dim", "region", "low", "high").toPandas() if regions.of else pd.DataFrame({"dim": []})
    boxes = {int(d): (t["region"].to_numpy(), np.stack(t["low"].to_numpy()), np.stack(t["high"].to_numpy())) for d, t in known.groupby("dim")}

    counts = boxed.select("dim", "region", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))
    deal = F.pmod(F.xxhash64("uid"), F.col("shards")).cast("int")
    shard = materialize(placed.join(counts, ["dim", "region"]).withColumn("shard", deal).select("dim", "region", "shard", "shards", "id", "uid", "v"))
    queries = shard.where(F.col("id") % query_step == 0).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(blocks)).cast("int"))
    asked_as = ["dim", "region", "shard", "block", "id", "uid", "v", "floor"]

    def run(asked: DataFrame) -> DataFrame:
        """asked: queries with ``shard`` and ``floor``; each meets all of that shard."""
        keys = ["dim", "region", "shard"]
        met = asked.select(*keys, "block").distinct()
        keyed = shard.select(*keys, "id", "uid", "v").toDF(*keys, "id", "uid", "v").join(met.toDF(*keys, "block"), keys)
        return asked.select(*asked_as).groupBy(*keys, "block").cogroup(keyed.groupBy(*keys, "block")).applyInPandas(_search(k, scale), _OUT)

    # First each query's own shard, then the shards of all regions that may hold better ones.
    home = materialize(run(queries.withColumn("floor", F.lit(_LOW))))
    floors = home.groupBy(F.col("quid").alias("uid")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    away = queries.drop("shards").join(floors, "uid", "left").withColumnsRenamed({"region": "home_region", "shard": "home"})
    away = away.withColumn("floor", F.coalesce("least", F.lit(_LOW)))  # a long without nulls stays one in pandas
    kept = ["dim", "home_region", "home", "id", "uid", "v", "block", "floor"]
    away = materialize(away.select(*kept).mapInPandas(_reached(boxes, scale), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in away.select(*kept).schema) + ", reach array<long>"))
    told = away.where("reach is not null").withColumn("region", F.explode("reach")).join(counts, ["dim", "region"])
    rest = away.where("reach is null").join(counts, "dim").select(*told.columns)
    away = told.union(rest).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("shard <> home or region <> home_region")
    best = home.union(run(away))
    place = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 5
"""
