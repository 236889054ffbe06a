"""Operator 3: a quality classifier by co-training of two views.

One classifier sees a document's text (its words and pairs of words, their shapes,
repetition, layout), the other its metadata (source, language, stated length).  Both start
from a bounded sample of labelled documents.  In every round one job scores all other
documents with both views; each view labels those of which it is confident, and the other
view learns from all of them.  How confident a view must be is set on held-out labels, per
class, so that a view that cannot be right often enough labels nothing.  At last the views'
scores are calibrated and combined on held-out labels, and the combination scores every
document.

What a view learns from pseudo-labels are the mean documents of ``GROUPS`` groups of each
class, dealt by a hash, as further rows of its fit.  They are sums over all documents that
the other view labelled, so none is sampled or brought to the driver.  Either class of them
weighs no more than that class of the labels, however many there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import read_table
from trackloom.llm.words import Words, batches_of, distinct, mixed, span_hash, sums

#: Bytes by kind: lower-case letter, capital, digit, full stop, comma, other sentence marks, bar, rest.
_KIND = np.full(256, 7, dtype=np.int64)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b";:!?\"'()-", b"|")):
    _KIND[list(_chars)] = _kind
_KIND[0x80:] = 0
_SHAPES = 8 * 8 * 4
_WORDS, _PAIRS = 256, 128
TEXT_FEATURES = _SHAPES + 10 + _WORDS + _PAIRS
META_FEATURES = 2 * 64 + 3


def text_features(words: Words) -> np.ndarray:
    """A row for each text of the batch: shares of word shapes (first and last byte's kind,
    length), then layout and repetition, then square roots of the shares of hashed words
    and pairs of words."""
    n_texts = len(words.offsets) - 1
    out = np.zeros((n_texts, TEXT_FEATURES), dtype=np.float32)
    if not len(words):
        return out
    kinds = _KIND[words.bytes]
    length = words.ends - words.starts
    shape = kinds[words.starts] * 32 + kinds[words.ends - 1] * 4 + np.searchsorted([2, 5, 9], length)
    counts = np.bincount(words.text * _SHAPES + shape, minlength=n_texts * _SHAPES).reshape(n_texts, _SHAPES)
    n = np.maximum(np.diff(words.first), 1)
    out[:, :_SHAPES] = counts / n[:, None]

    per = lambda flags: np.bincount(words.text, weights=flags, minlength=n_texts) / n
    inside = lambda kind: np.concatenate([[0], np.cumsum(kinds == kind)])
    of = lambda run: run[words.ends] - run[words.starts]
    capitals, small, odd = of(inside(1)), of(inside(0)), of(inside(7)) + of(inside(5))
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
    key = distinct(words.text.astype(np.uint64) << np.uint64(40) | words.hashes >> np.uint64(24))
    kinds_of_words = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n_texts)
    lines = np.add.reduceat(np.append(words.bytes == 10, False), np.minimum(words.offsets[:-1], len(words.bytes))) + 1
    more = (
        per((capitals > 1) & (small == 0)), per(capitals > 0), per(odd > 0), per(odd > 1), per(again),
        kinds_of_words / n, per(length == 1), per(length) / 10, np.log1p(n) / 10, lines / n,
    )
    out[:, _SHAPES : _SHAPES + 10] = np.stack(more, axis=1)
    low = _SHAPES + 10
    place = words.text * _WORDS + (words.hashes & np.uint64(_WORDS - 1)).astype(np.int64)
    out[:, low : low + _WORDS] = np.sqrt(np.bincount(place, minlength=n_texts * _WORDS).reshape(n_texts, _WORDS) / n[:, None])
    same = np.flatnonzero(words.text[1:] == words.text[:-1])
    pair = mixed(words.hashes[same] * np.uint64(3) + words.hashes[same + 1]) & np.uint64(_PAIRS - 1)
    place = words.text[same] * _PAIRS + pair.astype(np.int64)
    out[:, low + _WORDS :] = np.sqrt(np.bincount(place, minlength=n_texts * _PAIRS).reshape(n_texts, _PAIRS) / n[:, None])
    return out


def meta_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """A row for each document: hashed source and language, stated length, nulls marked."""
    rows = len(source)
    out = np.zeros((rows, META_FEATURES), dtype=np.float32)
    for block, column in enumerate((source, lang)):
        text = column.cast(pa.string()).fill_null("")
        for first, words in batches_of(text):
            whole = span_hash(sums(words.bytes + np.uint8(1)), words.offsets[:-1], words.offsets[1:])
            out[np.arange(first, first + len(whole)), 64 * block + (mixed(whole) & np.uint64(63)).astype(np.int64)] = 1
    size = n_chars.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    out[:, 128] = np.log1p(np.maximum(size, 0)) / 10
    out[:, 129] = size < 100
    out[:, 130] = n_chars.is_null().to_numpy(zero_copy_only=False)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12, balanced: bool = True, told: np.ndarray | None = None) -> Linear:
        """Newton's method; ``balanced``: both classes weigh the same, else as often as they
        occur.  ``told``: what ``taught`` gives; its rows of a class weigh as much as as many
        labelled ones, but together no more than all of these."""
        x = x.astype(np.float64)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        share = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)) if balanced else np.ones(len(y))
        for label in (0, 1) if told is not None else ():
            n, sums = told[label, :, 0], told[label, :, 1:]
            some, own = n > 0, share[y == label]
            if some.any() and len(own):
                x = np.vstack([x, sums[some] / n[some, None]])
                y = np.append(y, np.full(some.sum(), label))
                share = np.append(share, n[some] * own.mean() * min(1.0, len(own) / n.sum()))
        z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ w)
            curve = share * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * curve[:, None]).T @ z + np.diag(penalty), z.T @ (share * (p - y)) + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)


def confident(logit: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """The lowest logit from which on labels are 1, and the highest up to which they are 0,
    with at least ``precision`` on held-out rows; infinite where no level reaches it."""
    order = np.argsort(-logit, kind="stable")
    up, down = np.inf, -np.inf
    good = np.cumsum(y[order] == 1) / np.arange(1, len(y) + 1)
    if len(at := np.flatnonzero(good >= precision)):
        up = logit[order[at[-1]]]
    bad = np.cumsum(y[order[::-1]] == 0) / np.arange(1, len(y) + 1)
    if len(at := np.flatnonzero(bad >= precision)):
        down = logit[order[::-1][at[-1]]]
    return up, down


@dataclass
class CoTrained:
    """Two views and how they combine."""

    text: Linear
    meta: Linear
    mix: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.mix[0] + self.mix[1] * a + self.mix[2] * b)


Levels = list[tuple[float, float]]


GROUPS = 16


def taught(text: np.ndarray, meta: np.ndarray, models: list[Linear], levels: Levels) -> list[np.ndarray]:
    """Of unlabelled rows what each view is told by the other: by label and group the number
    of rows and the sums of their features.  Rows of which both views are confident but not
    of one mind teach nothing."""
    views, said = (text, meta), []
    for view, model, (up, down) in zip(views, models, levels, strict=True):
        logit = model.logit(view)
        said.append(np.where(logit >= up, 1, np.where(logit <= down, 0, -1)))
    at_odds = (said[0] >= 0) & (said[1] >= 0) & (said[0] != said[1])
    group = np.fromiter((zlib.crc32(row.tobytes()) % GROUPS for row in text), dtype=np.int64, count=len(text))
    out = []
    for view, other in zip(views, reversed(said), strict=True):
        sums = np.zeros((2 * GROUPS, 1 + view.shape[1]))
        rows = np.flatnonzero((other >= 0) & ~at_odds)
        np.add.at(sums, other[rows] * GROUPS + group[rows], np.hstack([np.ones((len(rows), 1)), view[rows]]))
        out.append(sums.reshape(2, GROUPS, -1))
    return out


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, tell: Callable[[list[Linear], Levels], list[np.ndarray]], *, rounds: int = 3, precision: float = 0.98) -> CoTrained:
    """``y``: 1 or 0 of the labelled rows; those of ``fold`` 0 are held out: half of them set
    the confidence levels, half calibrate and combine the views.  ``tell``: what ``taught``
    gives over all unlabelled rows."""
    known, held = fold != 0, fold == 0
    half = np.cumsum(held) % 2 == 0
    levels, combine = held & half, held & ~half
    views = [text, meta]
    models = [Linear.fit(x[known], y[known]) for x in views]
    for _ in range(rounds if levels.any() else 0):
        sure = [confident(model.logit(x[levels]), y[levels], precision) for model, x in zip(models, views, strict=True)]
        if not np.isfinite(sure).any():
            break
        models = [Linear.fit(x[known], y[known], told=told) for x, told in zip(views, tell(models, sure), strict=True)]
    both = np.stack([models[0].logit(text[combine]), models[1].logit(meta[combine])], axis=1)
    if len(set(y[combine])) < 2:
        return CoTrained(models[0], models[1], np.array([0.0, 1.0, 0.0]))
    last = Linear.fit(both, y[combine].astype(np.float64), ridge=0.1, balanced=False)
    slope = last.weights[1:] / last.scale
    return CoTrained(models[0], models[1], np.array([last.weights[0] - (slope * last.mean).sum(), *slope]))


def _features(docs: DataFrame) -> DataFrame:
    """Rows (id, text_x, meta_x binary of 32-bit floats) of docs (id, text, source, lang, n_chars)."""

    def work(batches):
        for batch in batches:
            meta = meta_features(*(batch.column(i) for i in (2, 3, 4)))
            for row, words in batches_of(batch.column(1)):
                text = text_features(words)
                n = len(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta[row : row + n]], pa.binary())], ["id", "text_x", "meta_x"])

    return docs.mapInArrow(work, "id long, text_x binary, meta_x binary")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(chars_col).cast("double").alias("n_chars"))


def _told_by_all(rest: DataFrame, models: list[Linear], levels: Levels) -> list[np.ndarray]:
    """``taught`` over all rows (text, source, lang, n_chars) of ``rest``."""
    shared = rest.sparkSession.sparkContext.broadcast((models, levels))

    def each(batches):
        models, levels = shared.value
        sums = None
        for batch in batches:
            meta = meta_features(*(batch.column(c) for c in ("source", "lang", "n_chars")))
            for row, words in batches_of(batch.column("text")):
                text = text_features(words)
                made = taught(text, meta[row : row + len(text)], models, levels)
                sums = made if sums is None else [a + b for a, b in zip(sums, made, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(sums[0].tobytes())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], ["part", "text_sums", "meta_sums"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        added = {c: [sum(np.frombuffer(x) for x in pdf[c]).tobytes()] for c in ("text_sums", "meta_sums")}
        return pd.DataFrame({"part": pdf["part"].iloc[:1], **added})

    # One row of some 200 kB of each task is added up in two steps; 16 rows come to the driver.
    schema = "part long, text_sums binary, meta_sums binary"
    rows = rest.mapInArrow(each, schema)
    for parts in (1024, 16):
        rows = rows.withColumn("part", F.col("part") % parts).groupBy("part").applyInPandas(together, schema)
    found = rows.collect()
    shapes = [(2, GROUPS, len(m.weights)) for m in models]
    return [sum((np.frombuffer(r[c]).reshape(shape) for r in found), np.zeros(shape)) for c, shape in zip(("text_sums", "meta_sums"), shapes, strict=True)]


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", most_labelled: int = 8192, **options) -> CoTrained | None:
    """Fit on at most ``most_labelled`` labelled documents, those of least hash of their id,
    and on all others without their labels; None where the labels do not hold both classes."""
    slim = _slim(docs, id_col, text_col, source_col, lang_col, chars_col)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    present = slim.where("id is not null").select(F.col("id").cast("long").alias("id")).distinct()
    # At most most_labelled rows of two numbers: safe to broadcast.
    chosen = marks.join(present, "id").orderBy(F.xxhash64("id"), "id").limit(most_labelled).toPandas()
    if {0, 1} - set(chosen["y"]):
        return None
    spark = docs.sparkSession
    picks = F.broadcast(spark.createDataFrame(chosen[["id"]]))
    slim = slim.withColumn("id", F.col("id").cast("long"))
    # Of rows with one id the one of least hash is meant.
    row = F.struct("text", "source", "lang", "n_chars")
    labelled = slim.join(picks, "id", "left_semi").groupBy("id").agg(F.min_by(row, F.xxhash64("text", "source", "lang", "n_chars")).alias("row")).select("id", "row.*")
    table = _features(labelled).toPandas().merge(chosen, on="id").sort_values("id", ignore_index=True)
    text, meta = (np.stack([np.frombuffer(x, dtype=np.float32) for x in table[c]]) for c in ("text_x", "meta_x"))
    fold = (mixed(table["id"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(3)).astype(np.int64)
    rest = slim.join(picks, "id", "left_anti").select("text", "source", "lang", "n_chars")
    return co_train(text, meta, table["y"].to_numpy(), fold, lambda models, levels: _told_by_all(rest, models, levels), **options)


def score_quality(docs: DataFrame, model: CoTrained | None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars") -> DataFrame:
    """Every row of ``docs`` with text_score, meta_score and score, the probability of good
    quality (double; 1 without a model, as nothing then speaks against a document)."""
    names = [c for c in docs.columns if c not in ("text_score", "meta_score", "score")]
    row = F.struct(*names).alias("row")
    used = docs.select(row, F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(chars_col).cast("double").alias("n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                found = [np.ones(batch.num_rows)] * 3
            else:
                meta = meta_features(*(batch.column(c) for c in ("source", "lang", "n_chars")))
                text = np.concatenate([text_features(words) for _, words in batches_of(batch.column("text"))])
                found = model.scores(text, meta)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(np.asarray(x, dtype=np.float64)) for x in found)], ["row", "text_score", "meta_score", "score"])

    kind = used.schema["row"].dataType.simpleString()
    done = used.mapInArrow(work, f"row {kind}, text_score double, meta_score double, score double")
    return done.select(*(F.col("row")[c].alias(c) for c in names), "text_score", "meta_score", "score")


def classify_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """Every row of ``docs`` with text_score, meta_score, score and kept (score >= threshold).

    Labels are rows (doc_id, quality 0 or 1); other values and null ids are left out, and
    of conflicting labels of an id the larger counts.  Without labels of both classes
    there is no model: scores are 1 and all rows are kept.  Null and empty texts have no
    words and are scored as such; null metadata is a value of its own; equal rows get
    equal scores; an empty table gives no rows; columns of ``docs`` pass through, those
    named like the results are replaced.
    """
    columns = {k: v for k, v in options.items() if k in ("id_col", "text_col", "source_col", "lang_col", "chars_col")}
    model = fit_quality(docs, labels, **options)
    return score_quality(docs, model, **columns).withColumn("kept", F.col("score") >= threshold)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "text_score", "meta_score", "score", "kept")
