"""Operator 2: mixing sources to target weights, in DataFrame functions only.

The words of each source form one stream, cut into blocks of ``block_words``.  Every
output shard draws source counts; each drawn slot is the next number of its source,
which a pseudorandom permutation of the source's block numbers (one per pass over the
source) maps to a block; blocks are joined by number.

The counts of a shard are multinomial draws conditioned on the totals, that is, draws
without replacement: the slots of all shards together hit each source as often as its
target needs, and a keyed permutation deals them to the shards.  So sums meet the targets
and no source is used beyond ``most`` passes, which independent multinomial draws would
only meet on average.

Rows are placed by their id and the hash of all their columns, so that the mix does not
depend on how the table is partitioned; equal rows are interchangeable.

Permutations are swap-or-not shuffles: each round either keeps x or swaps it with
K - x (mod n), as a hash of the larger of the two decides.  Every round is its own
inverse, so this is a permutation of any [0, n) without tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import WORD, free_name, materialize, read_table

ROUNDS = 24


def permuted(x: Column, n: Column, seed: Column, back: bool = False) -> Column:
    """The place of ``x`` in a permutation of [0, n); ``back``: the inverse."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, i, F.lit(1)), n) - at, n)
        return F.when(F.xxhash64(seed, i, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), step)


def before(df: DataFrame, by: str, order: str, value: str, block: int = 1024) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same ``by`` and a lower
    ``order`` (long).  Sums of blocks of orders come first, so that a long ``by`` is many tasks."""
    cut = df.withColumn("block", F.expr(f"{order} div {block}"))
    blocks = cut.groupBy(by, "block").agg(F.sum(value).alias("all"))
    blocks = blocks.select(F.col(by).alias("of"), F.col("block").alias("at"), (F.sum("all").over(Window.partitionBy(by).orderBy("block")) - F.col("all")).alias("earlier"))
    within = F.sum(value).over(Window.partitionBy(by, "block").orderBy(order)) - F.col(value)
    met = cut.withColumn("within", within).join(blocks, (F.col(by) == F.col("of")) & (F.col("block") == F.col("at")))
    return met.select(*df.columns, (F.col("earlier") + F.col("within")).alias("before"))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sizes`` (source, source_size) with rank and target.

    Sources in code point order, null last, weigh ``weights``, repeating; targets share
    the total by weight but stop at ``most`` sizes, the excess being reshared.  This is
    one water level over the sources in order of most * size / weight.  The table has
    one row per source, and so may pass through one task.
    """
    by_rank = Window.orderBy(F.asc_nulls_last("source"))
    by_level = Window.orderBy("level", "rank")
    every = Window.partitionBy(F.lit(1))
    t = sizes.withColumn("rank", F.row_number().over(by_rank).cast("long"))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("rest", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("try", (F.sum("source_size").over(every) - F.col("capped")) / F.col("rest"))
    t = t.withColumn("water", F.min(F.when(F.col("try") <= F.col("level"), F.struct("level", "rank", "try"))).over(every)["try"])
    return t.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def draw(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 128, shard_slots: int = 1024, seed: int = 7, uid_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents placed in their sources' streams and what was drawn of them.

    The first has rows (uid, doc_id, size, source_size, target), one for each row of ``docs``;
    uid numbers the input rows, or is ``uid_col``, whose numbers do not change the mix.  The second has rows (shard, pass, block, uid, doc_id, a, b): the words
    a to b - 1 of a document that lie in a drawn block, once for each pass over its source
    in which a shard drew the block.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    content = F.xxhash64(text_col, source_col).alias("content")
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    base = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), content, uid.alias("uid")))
    buckets = max(256, base.count() // 4096)
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "content"), F.lit(buckets)))

    # Streams: documents in order of (bucket, doc_id, content); a hot source has as many buckets as any.
    by_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    plan = plan.withColumn("want", F.floor("target")).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    full, part = F.expr("cast(want div source_size as long)"), F.expr("want % source_size")
    slots = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(full * F.col("blocks") + F.when(part == 0, F.lit(0)).otherwise(F.least(F.col("blocks"), F.ceil(part / block_words) + 1)))
    plan = plan.withColumn("slots", slots.cast("long"))
    plan = materialize(plan.withColumn("first", F.sum("slots").over(Window.orderBy("rank")) - F.col("slots")))
    total = plan.agg(F.sum("slots")).first()[0] or 0

    starts = by_bucket.join(plan.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
    starts = before(starts.select("source", "bucket", "rank", "source_size", "target", "bucket_size"), "rank", "bucket", "bucket_size")
    starts = starts.select(F.col("source").alias("of"), F.col("bucket").alias("at"), "rank", "source_size", "target", F.col("before").alias("start"))
    within = base.withColumn("before", F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("doc_id", "content", "uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = within.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    placed = materialize(placed.select("uid", "doc_id", "size", "rank", "source_size", "target", (F.col("start") + F.col("before")).alias("begin")))

    # Draws: slot t of shard t / shard_slots hits one of `total` tickets, which the sources own in stretches.
    cell = max(1, -(-total // 4096))
    owners = plan.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"first div {cell}"), F.expr(f"(first + slots - 1) div {cell}")))).select("cell", "rank", "first", "slots")
    tickets = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), permuted(F.col("id"), F.lit(max(total, 1)), F.lit(seed)).alias("ticket"))
    drawn = tickets.withColumn("cell", F.expr(f"ticket div {cell}")).join(owners, "cell").where("ticket >= first and ticket < first + slots").groupBy("shard", "rank").agg(F.count("*").alias("n"))
    drawn = before(drawn, "rank", "shard", "n").withColumnRenamed("before", "base")

    # Slots to blocks, by the permutation of the source's pass.
    # A row becomes a shard's share of a source, dozens of slots, each of which is permuted: small as they
    # are, these rows are dealt to all tasks.
    spread = drawn.join(plan.select("rank", "source_size", "want", "blocks"), "rank").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "rank")
    per = spread.withColumn("j", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)))
    per = per.withColumn("pass", F.expr("j div blocks")).withColumn("q", F.expr("j % blocks"))
    key = F.xxhash64(F.lit(seed), F.col("rank"), F.col("pass"))
    per = per.withColumn("block", permuted(F.col("q"), F.col("blocks"), key)).withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), key, back=True))
    short = F.col("source_size") - (F.col("blocks") - 1) * block_words
    done = F.col("pass") * F.col("source_size") + F.col("q") * block_words - F.when(F.col("q") > F.col("short_at"), block_words - short).otherwise(0)
    per = per.select("shard", "pass", "rank", "block", F.least(F.when(F.col("block") == F.col("blocks") - 1, short).otherwise(F.lit(block_words)), F.col("want") - done).alias("take")).where("take > 0")

    # Blocks to documents.
    last = (F.col("begin") + F.col("size") - 1)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block_words}"), F.floor(last / block_words))))
    pieces = pieces.select("rank", "block", "uid", "doc_id", (F.col("block") * block_words - F.col("begin")).alias("shift"), F.greatest(F.col("begin") - F.col("block") * block_words, F.lit(0)).alias("a"), F.least(F.col("begin") + F.col("size") - F.col("block") * block_words, F.lit(block_words)).alias("b"))
    # By merging, whatever the tables weigh: Spark takes the pieces for as small as the rows that they are of, and would broadcast them.
    ranges = pieces.hint("merge").join(per, ["rank", "block"]).where("take > a")
    return placed, ranges.select("shard", "pass", "block", "uid", "doc_id", (F.col("shift") + F.col("a")).alias("a"), (F.col("shift") + F.least("b", "take")).alias("b"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Rows (uid, doc_id, size, source_size, target, taken), one for each row of ``docs``;
    options as of ``draw``, whose ranges add up to taken.

    uid numbers the input rows.  Null texts count no words; a null source is a source of
    its own; rows with equal ids are separate rows; documents without words take none;
    an empty table gives no rows.  Further columns of ``docs`` are not read.
    """
    placed, ranges = draw(docs, **options)
    taken = ranges.groupBy("uid").agg(F.sum(F.col("b") - F.col("a")).alias("taken"))
    return placed.join(taken, "uid", "left").select("uid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each stretch of a document's words that the blocks drawn
    in one pass over its source cover without a gap, with the white space between its words.
    A stretch of all words is the whole text.  Columns as in ``docs``; needs text, n_chars."""
    names, key, runs_col, size_col = docs.columns, free_name(docs, "uid"), free_name(docs, "runs"), free_name(docs, "size")
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    placed, ranges = draw(rows, uid_col=key, **options)
    in_order = Window.partitionBy("uid").orderBy("pass", "a")
    gap = F.when((F.lag("pass").over(in_order) == F.col("pass")) & (F.lag("b").over(in_order) == F.col("a")), 0).otherwise(1)
    runs = ranges.withColumn("gap", gap).withColumn("run", F.sum("gap").over(in_order)).groupBy("uid", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    runs = runs.groupBy(F.col("uid").alias(key)).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias(runs_col))
    rows = rows.join(runs, key).join(placed.select(F.col("uid").alias(key), F.col("size").alias(size_col)), key)
    whole = lambda r: (r["a"] == 0) & (r["b"] == F.col(size_col))
    # The words are bound once for all runs of a text; each has the white space before it.
    words = F.when(F.exists(runs_col, lambda r: ~whole(r)), F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{WORD})")))
    cut = lambda w, r: F.regexp_replace(F.array_join(F.slice(w, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")), ""), r"\A[\x20\x09-\x0D]+", "")
    texts = F.transform(F.array(words), lambda w: F.transform(runs_col, lambda r: F.when(whole(r), F.col("text")).otherwise(cut(w, r))))[0]
    rows = rows.withColumn("text", F.explode(texts)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("uid")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2_mixing what SQL can tell: per document its size, its source's and the target."""
    out = op2_mixing(spark, sf_dir)
    return out.select("doc_id", "size", "source_size", (F.floor(F.col("target") * 1000 + 0.5) / 1000).alias("target"))


TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::double AS size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM d GROUP BY source),
-- One more round for every source that stops at its limit: [sources that stopped].
r AS (SELECT 0 AS turn, []::varchar[] AS stopped UNION ALL
  SELECT turn + 1, now FROM (SELECT turn, stopped, (
    SELECT coalesce(list(coalesce(s.source, chr(0)) ORDER BY s.source), []) FROM s, (
      SELECT (sum(o.size) - coalesce(sum(3 * o.size) FILTER (list_contains(stopped, coalesce(o.source, chr(0)))), 0)) / sum(o.weight) FILTER (NOT list_contains(stopped, coalesce(o.source, chr(0)))) AS level FROM s o) y
    WHERE list_contains(stopped, coalesce(s.source, chr(0))) OR y.level * s.weight > 3 * s.size) AS now FROM r) z WHERE len(now) > len(stopped)),
last AS (SELECT stopped FROM r ORDER BY turn DESC LIMIT 1),
y AS (SELECT (sum(size) - coalesce(sum(3 * size) FILTER (list_contains(stopped, coalesce(source, chr(0)))), 0)) / sum(weight) FILTER (NOT list_contains(stopped, coalesce(source, chr(0)))) AS level FROM s, last),
t AS (SELECT source, size, CASE WHEN list_contains(stopped, coalesce(source, chr(0))) THEN 3 * size ELSE level * weight END AS target FROM s, last, y)
SELECT doc_id, d.size, t.size::bigint AS source_size, floor(target * 1000::double + 0.5::double) / 1000::double AS target
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
