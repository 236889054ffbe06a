"""The joins of the correlation: grid, identity, as-of and static."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geo


def written(df: DataFrame) -> DataFrame:
    """``df`` by way of a Parquet table in the checkpoint folder, so that a loop's plan stays
    short: a checkpoint would keep what the optimiser has inferred of its columns, which grows
    with every join of a loop.  Only under a local master, as in tests, may
    ``spark.checkpoint.dir`` be unset: a temporary folder is taken."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        import tempfile

        folder = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{folder.rstrip('/')}/{context.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grid_pairs(reports: DataFrame, others: DataFrame, *, max_dt_us: int, cell_deg: float = 0.05, time_col: str = "t_us", earlier: bool = False) -> DataFrame:
    """Pairs of rows in neighbouring cells and within ``max_dt_us``, columns prefixed a_ and b_;
    ``earlier``: only those of which b is no later than a, which need fewer slices.

    An equi-join: the left side is in its own block of two by two cells and its time slice, the
    right side is listed in the four blocks that its nine cells touch and the two or three slices
    it can reach.  There is no wrap at the antimeridian.  Hot blocks are plain join keys, which
    adaptive execution splits.  The join is by merging: Spark takes a listed side for as small as
    the table that it is made of, and would broadcast it.
    """
    left = reports.select(*(F.col(c).alias(f"a_{c}") for c in reports.columns))
    right = others.select(*(F.col(c).alias(f"b_{c}") for c in others.columns))
    ay, ax = geo.cell(F.col("a_lat"), F.col("a_lon"), cell_deg)
    by, bx = geo.cell(F.col("b_lat"), F.col("b_lon"), cell_deg)
    slice_of = lambda c: F.floor(c / F.lit(float(max_dt_us))).cast("long")
    block = lambda c: F.floor(c / 2.0).cast("long")
    left = left.withColumns({"_ay": ay, "_ax": ax}).withColumns({"cy": block(F.col("_ay")), "cx": block(F.col("_ax")), "ct": slice_of(F.col(f"a_{time_col}"))})
    # Of three cells in a row the outer two are always in different blocks.
    listed = lambda c: F.explode(F.array(block(c - 1), block(c + 1)))
    right = right.withColumns({"_by": by, "_bx": bx}).withColumn("cy", listed(F.col("_by"))).withColumn("cx", listed(F.col("_bx")))
    right = right.withColumn("ct", F.explode(F.transform(F.array(*map(F.lit, (0, 1) if earlier else (-1, 0, 1))), lambda d: slice_of(F.col(f"b_{time_col}")) + d)))
    apart = F.col(f"a_{time_col}") - F.col(f"b_{time_col}")
    near = apart.between(0, max_dt_us) if earlier else F.abs(apart) <= max_dt_us
    beside = (F.abs(F.col("_ay") - F.col("_by")) <= 1) & (F.abs(F.col("_ax") - F.col("_bx")) <= 1)
    return left.join(right.hint("merge"), ["cy", "cx", "ct"]).where(near & beside).drop("cy", "cx", "ct", "_ay", "_ax", "_by", "_bx")


def latest_pairs(reports: DataFrame, others: DataFrame, keys: list[str], *, max_dt_us: int, cell_deg: float = 0.05, slice_us: int = 10_000_000, time_col: str = "t_us", order: str = "event_id") -> DataFrame:
    """Each report with candidates for the latest report of every track (``keys``) of ``others``
    nearby, no later than itself and within ``max_dt_us``; columns prefixed a_ and b_.

    The equi-join of ``grid_pairs``, by blocks of two by two cells, but a track's report is listed in its own slice of time and,
    if it is the last of its slice, in those up to its track's next report.  So a report meets
    what a track reported in its own slice and one report from before it, however long the
    limit is.  The caller takes the newest of each.
    """
    left = reports.select(*(F.col(c).alias(f"a_{c}") for c in reports.columns))
    ay, ax = geo.cell(F.col("a_lat"), F.col("a_lon"), cell_deg)
    slice_of = lambda c: F.floor(c / F.lit(float(slice_us))).cast("long")
    block = lambda c: F.floor(c / 2.0).cast("long")
    left = left.withColumns({"_ay": ay, "_ax": ax}).withColumns({"cy": block(F.col("_ay")), "cx": block(F.col("_ax")), "ct": slice_of(F.col(f"a_{time_col}"))})

    own = slice_of(F.col(time_col))
    upcoming = F.lead(own).over(Window.partitionBy(*keys).orderBy(time_col, order))
    reach = slice_of(F.col(time_col) + max_dt_us)
    until = F.when(F.coalesce(upcoming > own, F.lit(True)), F.least(F.coalesce(upcoming, reach), reach)).otherwise(own)
    right = others.withColumn("_until", until).select(*(F.col(c).alias(f"b_{c}") for c in others.columns), F.explode(F.sequence(own, F.greatest("_until", own))).alias("ct"))
    by, bx = geo.cell(F.col("b_lat"), F.col("b_lon"), cell_deg)
    # Of three cells in a row the outer two are always in different blocks.
    listed = lambda c: F.explode(F.array(block(c - 1), block(c + 1)))
    right = right.withColumns({"_by": by, "_bx": bx}).withColumn("cy", listed(F.col("_by"))).withColumn("cx", listed(F.col("_bx")))
    apart = F.col(f"a_{time_col}") - F.col(f"b_{time_col}")
    beside = (F.abs(F.col("_ay") - F.col("_by")) <= 1) & (F.abs(F.col("_ax") - F.col("_bx")) <= 1)
    return left.join(right.hint("merge"), ["cy", "cx", "ct"]).where(apart.between(0, max_dt_us) & beside).drop("cy", "cx", "ct", "_ay", "_ax", "_by", "_bx")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component): the smallest id that edges reach, for each id in an edge.

    Each round every id takes the smallest label among its neighbours and then the label of
    its label, so that rounds grow with the logarithm of the longest chain.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(both.union(both.select("y", "x")).where("x <> y").distinct())
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "id"))
    while True:
        seen = both.join(labels.toDF("y", "near"), "y").groupBy("x").agg(F.min("near").alias("near"))
        lower = labels.join(seen, F.col("id") == F.col("x")).select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("of"), F.col("label").alias("far"))
        moved = written(lower.join(jump, F.col("new") == F.col("of"), "left").select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        done = not moved.where("new <> label").limit(1).count()
        labels = moved.select("id", F.col("new").alias("label"))
        if done:
            return labels.withColumnRenamed("label", "component")


def identity_components(tracks: DataFrame, key: str = "track", identity: str = "identity") -> DataFrame:
    """Tracks that share identity keys, transitively: rows (key, component).

    Tracks meet at their identity value, so a value that a third of all tracks share costs
    one edge for each of them, not all pairs.
    """
    edges = tracks.where(F.col(identity).isNotNull()).select(F.concat(F.lit("t|"), key).alias("a"), F.concat(F.lit("z|"), identity).alias("b")).distinct()
    found = connected(edges).where(F.col("id").startswith("t|"))
    named = found.select(F.substring("id", 3, 1 << 20).alias(key), F.substring("component", 3, 1 << 20).alias("component"))
    return tracks.select(key).distinct().join(named, key, "left").withColumn("component", F.coalesce("component", key))


def last_known(df: DataFrame, keys: list[str], order: list[str], fields: list[str], time_col: str | None = None, ttl: int | None = None) -> DataFrame:
    """Each row's missing ``fields`` from the key's latest earlier row that has them (as-of join).

    ``ttl``: values older than that, by ``time_col``, are not used.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def filled(field: str) -> Column:
        if ttl is None:
            return F.last(field, ignorenulls=True).over(upto)
        held = F.last(F.when(F.col(field).isNotNull(), F.struct(F.col(time_col).alias("t"), F.col(field).alias("v"))), ignorenulls=True).over(upto)
        return F.when(F.col(time_col) - held["t"] <= ttl, held["v"])

    return df.withColumns({f: F.coalesce(F.col(f), filled(f)) for f in fields})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the newest of each key by ``version``; ``new`` wins ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with its rows' numbers from 1 on in ``order``: by ranges, each a task, and the counts of those before."""
    placed = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count("*").alias("n"))
    # One row for each range.
    before = counts.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(before), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")
