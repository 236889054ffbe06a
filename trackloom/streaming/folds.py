"""Folds over streams: one state per key, kept by Spark between micro-batches.

``stream`` runs a fold of ``operators.folds`` with ``applyInPandasWithState``; rows of a
micro-batch are taken in order of ``order``.  States time out by event time, so a key that
falls silent leaves nothing behind.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.folds import Fold


def stream(df: DataFrame, fold: Fold, keys: list[str], order: list[str], *, event_time: str, late: str = "10 minutes", idle_ms: int = 6 * 3_600_000) -> DataFrame:
    """``df`` (a stream with a timestamp column ``event_time``) through ``fold``, key by key."""
    schema = T._parse_datatype_string(fold.schema)
    names = [f.name for f in schema.fields]

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = pickle.loads(state.get[0])
            state.remove()
            rest = fold.end(held) if fold.end else []
        else:
            held = pickle.loads(state.get[0]) if state.exists else fold.init()
            rest = []
            rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
            for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
                held, made = fold.step(held, row)
                rest += made
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows[event_time].max().timestamp() * 1000)) + idle_ms)
        if rest:
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rest], columns=names)

    marked = df.withWatermark(event_time, late)
    return marked.groupBy(*keys).applyInPandasWithState(work, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def minute_counts(df: DataFrame, keys: list[str], *, event_time: str, late: str = "10 minutes") -> DataFrame:
    """Counters in tumbling minutes; a minute is final once the watermark has passed it (A2)."""
    counted = df.withWatermark(event_time, late).groupBy(*keys, F.window(event_time, "1 minute")).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("window.start").alias("minute"), "n")


def unique_messages(df: DataFrame, ids: list[str], *, event_time: str, late: str = "10 minutes") -> DataFrame:
    """Each message once, however often it is delivered."""
    return df.withWatermark(event_time, late).dropDuplicatesWithinWatermark(ids)


def to_tables(df: DataFrame, tag: str, folder: str, checkpoint: str):
    """Rows by their tag to one Parquet table each; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(tag).parquet(f"{folder}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
