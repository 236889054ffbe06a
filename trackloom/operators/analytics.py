"""Metrics, history, audit, replicated log and probe."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000


def minute(t_us: Column) -> Column:
    return F.floor(t_us / MINUTE_US).cast("long")


def per_minute(df: DataFrame, keys: list[str], counters: dict[str, Column], time: str = "t_us") -> DataFrame:
    """Counters in tumbling minutes (A2)."""
    return df.groupBy(*keys, minute(F.col(time)).alias("minute")).agg(*(c.alias(n) for n, c in counters.items()))


def zero_filled(counts: DataFrame, keys: list[str], first: int, last: int, values: list[str]) -> DataFrame:
    """Every minute from first to last for every key, absent ones zero (A2)."""
    grid = counts.select(*keys).distinct().withColumn("minute", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    return grid.join(counts, [*keys, "minute"], "left").fillna(0, values)


def last_gauge(df: DataFrame, keys: list[str], value: str, time: str = "t_us", tie: str = "event_id") -> DataFrame:
    """The last value in each minute (A3)."""
    return df.groupBy(*keys, minute(F.col(time)).alias("minute")).agg(F.max_by(value, F.struct(time, tie)).alias(value))


def rate(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The difference to the key's row before, per unit of ``order`` (A3)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rate", (F.col(value) - F.lag(value).over(w)) / (F.col(order) - F.lag(order).over(w)))


def history(df: DataFrame, *, track: str, since: int, until: int, limit: int, time: str = "t_us") -> DataFrame:
    """The newest ``limit`` points of each track in [since, until], ascending."""
    rank = F.row_number().over(Window.partitionBy(track).orderBy(F.desc(time), F.desc("event_id")))
    return df.where(F.col(time).between(since, until)).withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r").orderBy(track, time, "event_id")


def gaps(log: DataFrame, site: str = "site", seq: str = "seq") -> DataFrame:
    """Missing ranges of sequence numbers for each site, from 1 on."""
    w = Window.partitionBy(site).orderBy(seq)
    before = F.coalesce(F.lag(seq).over(w), F.lit(0))
    return log.select(site, seq).distinct().withColumn("_b", before).where(F.col(seq) > F.col("_b") + 1).select(site, (F.col("_b") + 1).alias("from_seq"), (F.col(seq) - 1).alias("to_seq"))


def judge(log: DataFrame, subject: str = "subject", hlc: str = "hlc") -> DataFrame:
    """Of the commands on one subject the latest by clock, then by site, stands."""
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc(hlc), F.desc("site")))
    return log.withColumn("status", F.when(rank == 1, "applied").otherwise("superseded"))


def hlc(ms: Column, counter: Column) -> Column:
    """A hybrid logical clock: 48 bits of milliseconds, 16 of a counter."""
    return F.shiftleft(ms.cast("long"), 16).bitwiseOR(counter.cast("long"))


def chained(rows: DataFrame, seq: str = "seq", prev: str = "prev_hash", own: str = "hash", content: str = "content") -> DataFrame:
    """The audit chain checked row by row (A10): problem is gap, link or hash, else null.

    A row's hash is SHA-256 of the hash before it and its content.  Each row meets the one
    before by its number, so the log is as many tasks as any join; the first row alone has
    none before it without a gap.
    """
    before = rows.select((F.col(seq) + 1).alias(seq), F.col(own).alias("_before"), F.lit(True).alias("_met"))
    first = rows.agg(F.min(seq).alias("_first"))
    recomputed = F.sha2(F.concat(F.col(prev), F.col(content)), 256)
    met = rows.join(before, seq, "left").crossJoin(F.broadcast(first))  # one row
    problem = F.when(F.col("_met").isNull() & (F.col(seq) > F.col("_first")), "gap").when(F.col(prev) != F.col("_before"), "link").when(F.col(own) != recomputed, "hash")
    return met.select(*rows.columns, problem.alias("problem"))


def json_paths(docs: DataFrame, text: str) -> DataFrame:
    """Rows (path, kind, value): every leaf of JSON objects, array places as [*]."""

    def leaves(value: object, path: str):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{path}.{k}")
        elif isinstance(value, list):
            for v in value:
                yield from leaves(v, f"{path}[*]")
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"
            yield path, kind, None if value is None else value if isinstance(value, str) else json.dumps(value)

    def work(batches):
        for batch in batches:
            found: list[tuple] = []
            for line in batch.column(0).to_pylist():
                try:
                    found += leaves(json.loads(line or ""), "$")
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], ["path", "kind", "value"])

    return docs.select(text).mapInArrow(work, "path string, kind string, value string")


def probe(docs: DataFrame, text: str, most_distinct: int = 1000) -> DataFrame:
    """Of each JSON path: how often, with which types, how many distinct values (to a cap), least and most."""
    paths = json_paths(docs, text)
    return paths.groupBy("path").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("kind") == "number").alias("numbers"),
        F.count_if(F.col("kind") == "string").alias("strings"),
        F.least(F.count_distinct("value"), F.lit(most_distinct)).alias("n_distinct"),
        F.min(F.col("value").try_cast("double")).alias("least"),
        F.max(F.col("value").try_cast("double")).alias("most"),
    )


def running_median(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 9) -> DataFrame:
    """The median of the last ``rows`` values."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, as a compacted stream has it."""
    cols = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return newest.select(key, *(F.col("_r")[c].alias(c) for c in cols))


def highest_uid(texts: DataFrame, column: str, site: str) -> DataFrame:
    """The highest track number of a site named anywhere in a text."""
    found = F.explode(F.regexp_extract_all(column, F.lit(rf"{site}(\d{{9}})")))
    return texts.select(found.alias("n")).agg(F.max(F.col("n").cast("long")).alias("highest"))


def live(tracks: DataFrame, keys: list[str], entity: str = "entity_id") -> DataFrame:
    """Tracks by state, domain or the like, and how many have an entity."""
    return tracks.groupBy(*keys).agg(F.count("*").alias("n"), F.count(entity).alias("with_entity"))


def attribute_keys(df: DataFrame, text: str) -> DataFrame:
    """The keys of JSON objects with how often they occur (A5)."""
    keys = F.explode(F.json_object_keys(text)).alias("key")
    return df.select(keys).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")
