"""What several operators share: shared-folder tables, components, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that part words, in every operator: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, whichever no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of all columns of a row; maps and variants, which have no hash, by their JSON."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.MapType | T.VariantType):
            return False
        inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
        return all(map(plain, inner))

    return F.xxhash64(F.lit(seed), *(F.col(f"`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application: under ``spark.checkpoint.dir`` if the
    cluster names one; only where it is unset (tests, local mode) a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir() + "/checkpoints"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.  The
    shuffle files behind ``df`` are not needed any more; Spark deletes them once the
    driver's JVM has collected the plan, which a long driver may not do for half an hour.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


#: Where the tables are that ``materialize`` returned, as long as someone holds them, and all that were made.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_MADE: list[str] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """At the end of the block deletes the tables that ``materialize`` wrote in it, but for
    those put on the list that it gives.  For work whose result is written within the block."""
    begin, kept = len(_MADE), []
    yield kept
    stay = {_PATHS[table] for table in kept}
    for path in [path for path in _MADE[begin:] if path not in stay]:
        _MADE.remove(path)
        _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that no later plan reads."""
    for table in tables:
        path = _PATHS.pop(table)
        _MADE.remove(path)
        _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote in this application."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (id, component) for
    every id in an edge, where component is the smallest id that links reach.

    Alternating large-star and small-star steps until the edges no longer change; the
    number of rounds grows with the logarithm of the component size.  The minima are
    written before they are joined back, so that both inputs of each join are plain
    exchanges that adaptive execution can split at a hot centre.
    """
    big = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = materialize(edges.where("a <> b").select(*big).distinct())
    before = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        both = current.union(current.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        current = materialize(small.select("b", "m").toDF("a", "b").union(small.select("a", "m").toDF("a", "b")).where("a <> b").distinct())
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(current.select("b", "b").distinct()).distinct()


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of every word (UTF-8), each distinct word hashed once per batch."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    each = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(x) for x in each), dtype=np.uint64, count=len(each))
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each text and, per text, where its words begin and end (n + 1 offsets).

    ``ascii_split_whitespace`` leaves empty strings at either end; they are taken out.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(offsets)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, ends = flat.filter(pa.array(full)), kept[ends]
    return flat, np.concatenate([[0], ends]).astype(np.int64)
