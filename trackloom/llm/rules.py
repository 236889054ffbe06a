"""Operator 11: quality rules, the last of which is perplexity under an n-gram model.

The model is a modified Kneser-Ney one over the bytes of a text's words, joined by single
blanks, for each language by itself (five bytes; null languages are ``und``).  Spark counts
the grams of all documents; continuation counts, discounts and interpolated probabilities
follow by joins and by windows over contexts, which have 256 rows at most.  A gram of five
bytes is a hash of 40 bits without collisions, and a task looks grams up in sorted arrays of
these.  The arrays are broadcast while they have ``MOST_ENTRIES`` entries at most (16 bytes
each).  Beyond that each block of texts asks for its distinct grams by a join, and gets
their costs back in a cogroup; both ways give the same numbers.

Costs are whole numbers, 2^-16 bits, so that sums do not depend on their order.  Bands are
set for each language by the quartiles of all documents that pass the base rules; equal
costs and lengths (copies) count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import free_name, materialize, read_table
from trackloom.llm.words import Words, batches_of, mixed, span_hash, sums

ORDER = 5
MOST_ENTRIES = 1 << 22
UNIT = 1 << 16
#: Texts of a block that asks by a join.
BLOCK_BYTES = 1 << 25
_MASK = [(1 << 8 * k) - 1 for k in range(ORDER + 1)]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _by_text(words: Words, weights: np.ndarray) -> np.ndarray:
    return np.bincount(words.text, weights=weights, minlength=len(words.offsets) - 1).astype(np.int64)


def _again(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry whether an earlier one equals it, and whether any other does."""
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys]) if len(order) else np.zeros(0, bool)
    later, any_ = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return later, any_


def measures(words: Words) -> dict[str, np.ndarray]:
    """The base measures of each text of a run.  Lines and windows of three words are equal
    if their hashes of 64 bits are (within a text)."""
    data, n_texts = words.bytes, len(words.offsets) - 1
    running = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    points, symbols = running((data & 0xC0) != 0x80), running(_SYMBOL[data])

    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([words.offsets[:-1], newline + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends = ends - (data[ends - 1] == 10)
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[full], ends[full]
    text = np.searchsorted(words.offsets, starts, side="right") - 1
    later, _ = _again(span_hash(sums(data + np.uint8(1)), starts, ends), text)

    h, covered = words.hashes, np.zeros(len(words), dtype=bool)
    if len(words) > 2:
        inside = words.text[2:] == words.text[:-2]
        window = mixed(mixed(mixed(h[:-2] + np.uint64(1)) + h[1:-1]) + h[2:])[inside]
        at = np.flatnonzero(inside)
        _, twice = _again(window, words.text[at])
        for k in range(3):
            covered[at[twice] + k] = True
    return {
        "n_words": np.diff(words.first), "word_chars": _by_text(words, points[words.ends] - points[words.starts]), "n_symbols": symbols[words.offsets[1:]] - symbols[words.offsets[:-1]],
        "n_dup_lines": np.bincount(text[later], minlength=n_texts), "n_repeat_words": _by_text(words, covered),
    }


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a run and of each the text.  A text with words is preceded by four line
    feeds, its words are parted by blanks, and a line feed ends it; others have no gram."""
    some = np.flatnonzero(np.diff(words.first))
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lead = np.zeros(len(words), dtype=np.int64)
    lead[words.first[some]] = ORDER - 1
    size = words.ends - words.starts
    begin = np.cumsum(lead + size + 1) - size - 1
    last = words.first[some + 1] - 1
    out = np.full(begin[-1] + size[-1] + 1, 0x20, dtype=np.uint8)
    heads = begin[words.first[some]]
    for k in range(1, ORDER):
        out[heads - k] = 10
    out[begin[last] + size[last]] = 10
    fill = np.ones(len(out), dtype=bool)
    fill[begin + size] = False
    for k in range(1, ORDER):
        fill[heads - k] = False
    inside = (words.bytes != 0x20) & (words.bytes - np.uint8(0x09) > np.uint8(0x04))
    out[fill] = words.bytes[inside]
    wide = out.astype(np.uint64)
    key = wide[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        key |= wide[ORDER - 1 - k : len(wide) - k] << np.uint64(8 * k)
    ends = np.append(heads[1:] - (ORDER - 1), len(out))  # of each text's stretch
    many = ends - heads
    at = np.arange(many.sum()) + np.repeat(heads - (np.cumsum(many) - many), many) - (ORDER - 1)
    return key[at], np.repeat(some, many)


def _by_language(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[str, np.ndarray, Words]]:
    """(language, rows, words) of runs of the rows of a batch."""
    langs = langs.fill_null("und").dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        rows = np.flatnonzero(code == k)
        for first, words in batches_of(texts.take(pa.array(rows)).cast(pa.large_string()), most_bytes=1 << 20):
            yield lang, rows[first : first + len(words.offsets) - 1], words


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts


def count_grams(texts: DataFrame) -> DataFrame:
    """Rows (lang, gram, n) over all of ``texts`` (lang, text), counted once in each batch."""

    def work(batches):
        for batch in batches:
            held: dict[str, list] = {}
            for lang, _, words in _by_language(batch.column(0), batch.column(1)):
                keys = np.sort(grams(words)[0])
                begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                own = held.setdefault(lang, [])
                own.append((keys[begins], np.diff(np.append(begins, len(keys)))))
                if len(own) == 8:
                    own[:] = [_summed(*map(np.concatenate, zip(*own, strict=True)))]
            for lang, own in held.items():
                keys, counts = _summed(*map(np.concatenate, zip(*own, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    return texts.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The model of ``docs``: rows (lang, k, gram, cost, back), for each order k.

    cost: of the last byte of ``gram`` after those before it; back: of leaving its context
    for the next shorter one; both in 2^-16 bits.  Discounts are Chen and Goodman's, from
    the counts of counts of each order; where one of these is missing, a half of the count.
    """
    counts = materialize(count_grams(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))))
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # of shorter grams it counts how many bytes stand before them
        orders[k] = materialize(orders[k + 1].groupBy("lang", F.col("gram").bitwiseAND(_MASK[k]).alias("gram")).agg(F.count("*").alias("n")))
    lower, found = None, []
    for k in range(1, ORDER + 1):
        times = [F.count_if(F.col("n") == i).alias(f"t{i}") for i in (1, 2, 3, 4)]
        y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
        d = [F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.lit(i) - (i + 1) * y * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}")))), F.lit(i / 2)) for i in (1, 2, 3)]
        usable = (F.col("t1") > 0) & (F.col("t2") > 0)
        discounts = orders[k].groupBy("lang").agg(*times).select("lang", *(F.when(usable, x).otherwise(i / 2).alias(f"d{i}") for i, x in enumerate(d, 1)))
        context = Window.partitionBy("lang", F.shiftrightunsigned("gram", 8))
        rows = orders[k].select("*", F.sum("n").over(context).alias("all"), *(F.sum(F.when(F.least("n", F.lit(3)) == i, 1).otherwise(0)).over(context).alias(f"n{i}") for i in (1, 2, 3)))
        rows = rows.join(discounts, "lang").withColumns({
            "off": F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")),
            "gamma": (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("all"),
        })
        if k == 1:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(_MASK[k - 1])).join(lower, ["lang", "shorter"])
        whole = lambda p: F.round(-F.log2(p) * UNIT).cast("int")
        p = (F.col("n") - F.col("off")) / F.col("all") + F.col("gamma") * F.col("below")
        # A context without a discount is never left; 64 bits stand for that.
        back = F.when(F.col("gamma") > 2.0**-64, whole(F.col("gamma"))).otherwise(64 * UNIT)
        made = materialize(rows.select("lang", F.lit(k).alias("k"), "gram", p.alias("p"), whole(p).alias("cost"), back.alias("back")))
        lower = made.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
        found.append(made.drop("p"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class Arrays:
    """The model in a task: of each language and order sorted grams and their costs, and
    sorted contexts and the costs of leaving them."""

    def __init__(self, table: pa.Table):
        self.of: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
        langs = table.column("lang").combine_chunks().dictionary_encode()
        code, k = langs.indices.to_numpy(zero_copy_only=False), table.column("k").to_numpy()
        gram, cost, back = (table.column(c).to_numpy() for c in ("gram", "cost", "back"))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            for order in range(1, ORDER + 1):
                at = np.flatnonzero((code == i) & (k == order))
                if not len(at):
                    continue
                at = at[np.argsort(gram[at])]
                keys = gram[at].view(np.uint64)
                contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
                self.of[lang, order] = (keys, cost[at].astype(np.int32), contexts, back[at][first].astype(np.int32))

    def cost(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Costs of sorted grams; what the model lacks is told by shorter grams, at last by
        one of 256 bytes."""
        out, open_ = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            own = self.of.get((lang, k))
            if own is None or not len(open_):
                continue
            asked = keys[open_] & np.uint64(_MASK[k])
            at = np.minimum(np.searchsorted(own[0], asked), len(own[0]) - 1)
            known = own[0][at] == asked
            out[open_[known]] += own[1][at[known]]
            open_, asked = open_[~known], asked[~known] >> np.uint64(8)
            at = np.minimum(np.searchsorted(own[2], asked), len(own[2]) - 1)
            out[open_] += np.where(own[2][at] == asked, own[3][at], 0)
        out[open_] += 8 * UNIT
        return out


def _scored(batch: pa.RecordBatch, arrays: Arrays) -> list[pa.Array]:
    """Columns after (id, lang, text): the base measures, cost and number of grams."""
    n = batch.num_rows
    out = {c: np.zeros(n, dtype=np.int64) for c in (*BASE, "cost", "grams")}
    for lang, rows, words in _by_language(batch.column(1), batch.column(2)):
        for c, v in measures(words).items():
            out[c][rows] = v
        keys, text = grams(words)
        if not len(keys):
            continue
        both = np.sort(keys << np.uint64(24) | text.astype(np.uint64))  # a run has less than 2^20 texts
        keys, text = both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.int64)
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        each = np.repeat(arrays.cost(lang, keys[begins]), np.diff(np.append(begins, len(keys))))
        out["cost"][rows] = np.bincount(text, weights=each, minlength=len(rows)).astype(np.int64)  # below 2^53
        out["grams"][rows] = np.bincount(text, minlength=len(rows))
    return [batch.column(0), batch.column(1), *map(pa.array, out.values())]


def score(docs: DataFrame, model: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Rows (id, lang, base measures, cost, grams), one for each row of ``docs``, under ``model``."""
    names = ["id", "lang", *BASE, "cost", "grams"]
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, lang string, " + ", ".join(f"{c} long" for c in names[2:])
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    if model.count() <= most_entries:
        shared = docs.sparkSession.sparkContext.broadcast(Arrays(model.toArrow()))

        def work(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(_scored(batch, shared.value), names)

        return slim.mapInArrow(work, schema)

    def blocks(batches):
        block, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            of = block + (held + size) // BLOCK_BYTES
            held += int(size[-1]) if len(size) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of)], ["id", "lang", "text", "block"])

    def ask(batches):
        for batch in batches:
            block = batch.column(2).to_numpy()
            for b in np.unique(block):
                own = batch.filter(pa.array(block == b))
                for lang, _, words in _by_language(own.column(0), own.column(1)):
                    keys = np.unique(grams(words)[0])
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(keys), pa.int64()), pa.array([lang] * len(keys)), pa.array(keys.view(np.int64))], ["block", "lang", "gram"])

    def tell(texts: pa.Table, told: pa.Table) -> pa.Table:
        arrays = Arrays(told.append_column("k", pa.array([ORDER] * told.num_rows)).append_column("back", pa.array([0] * told.num_rows, pa.int32())))
        done = [pa.RecordBatch.from_arrays(_scored(b, arrays), names) for b in texts.select(["id", "lang", "text"]).combine_chunks().to_batches()]
        return pa.Table.from_batches(done, pa.schema([("id", texts.schema.field("id").type), ("lang", pa.string()), *((c, pa.int64()) for c in names[2:])]))

    tagged = materialize(slim.mapInArrow(blocks, f"id {kind}, lang string, text string, block long"))
    asked = tagged.select("lang", "text", "block").mapInArrow(ask, "block long, lang string, gram long").distinct()
    asked = asked.withColumns({"cost": F.lit(None).cast("long"), "way": F.lit(0).cast("long")})
    for k in range(ORDER, 0, -1):  # as in ``Arrays.cost``
        own = model.where(F.col("k") == k)
        key, above = F.col("gram").bitwiseAND(_MASK[k]), F.shiftrightunsigned(F.col("gram").bitwiseAND(_MASK[k]), 8)
        known = own.select("lang", F.col("gram").alias("key"), F.col("cost").alias("found"))
        asked = asked.withColumn("key", key).join(known, ["lang", "key"], "left").withColumn("cost", F.coalesce("cost", F.col("way") + F.col("found"))).drop("key", "found")
        left = own.groupBy("lang", F.shiftrightunsigned("gram", 8).alias("above")).agg(F.first("back").alias("leave"))
        asked = asked.withColumn("above", above).join(left, ["lang", "above"], "left").withColumn("way", F.col("way") + F.coalesce("leave", F.lit(0))).drop("above", "leave")
    told = asked.select("block", "lang", "gram", F.coalesce("cost", F.col("way") + 8 * UNIT).cast("int").alias("cost"))
    return tagged.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda key, texts, told: tell(texts, told.drop_columns(["block"])), schema)


def bands(scored: DataFrame, *, reach: tuple[float, float] = (7.0, 5.5), least: tuple[float, float] = (0.03, 0.02)) -> DataFrame:
    """Rows (lang, low, high) in bits a byte: the quartiles of each language, moved outwards by
    ``reach`` times their distance from the median (``least`` at least).

    Quartiles are of a histogram in steps of a thousandth of a bit, so they are exact to that
    step, and no more than 64,000 rows meet for a language.
    """
    step = F.floor(F.col("cost") * 1000 / (F.col("grams") * UNIT)).alias("step")
    bins = scored.select("lang", "cost", "grams").distinct().select("lang", step).groupBy("lang", "step").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang")
    share = bins.select("lang", "step", (F.sum("n").over(order.orderBy("step")) / F.sum("n").over(order)).alias("upto"))
    q = [F.min(F.when(F.col("upto") >= x, F.col("step"))).alias(c) for c, x in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    low = F.col("q1") / 1000 - reach[0] * F.greatest((F.col("q2") - F.col("q1")) / 1000, F.lit(least[0]))
    high = F.col("q3") / 1000 + reach[1] * F.greatest((F.col("q3") - F.col("q2")) / 1000, F.lit(least[1]))
    return share.groupBy("lang").agg(*q).select("lang", low.alias("low"), high.alias("high"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_entries: int = MOST_ENTRIES, reach: tuple[float, float] = (7.0, 5.5), least: tuple[float, float] = (0.03, 0.02)) -> DataFrame:
    """``id_col``, the base measures, base_failed, bits (a byte), low, high and kept, one row
    for each row of ``docs``.

    Null and empty texts have no words, so they fail; null languages are ``und``.  Texts are
    read whole, whatever their length.  Ids may be null or repeated; rows that are repeated
    are judged alike.  A document at the edge of a band stays.  An empty table gives an empty
    one.  Further columns are not read, whatever their names.
    """
    model = fit(docs, text_col=text_col, lang_col=lang_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = materialize(score(docs, model, id_col=id_col, text_col=text_col, lang_col=lang_col, most_entries=most_entries).withColumn("base_failed", failed).withColumn("lang", F.coalesce("lang", F.lit("und"))))
    limits = bands(rows.where(~F.col("base_failed")), reach=reach, least=least)
    bits = F.try_divide(F.col("cost"), F.col("grams") * UNIT)
    every = rows.join(F.broadcast(limits), "lang", "left") if limits.count() <= 1 << 16 else rows.join(limits, "lang", "left")
    kept = F.coalesce(~F.col("base_failed") & (bits >= F.col("low")) & (bits <= F.col("high")), F.lit(False))
    return every.select(F.col("id").alias(id_col), *BASE, "base_failed", bits.alias("bits"), "low", "high", kept.alias("kept"))


def kept_documents(docs: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    mark = free_name(docs, "mark")
    marked = materialize(docs.withColumn(mark, F.monotonically_increasing_id()))
    return marked.join(judge(marked, **{**names, "id_col": mark}).where("kept").select(mark), mark, "left_semi").drop(mark)


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *BASE, "base_failed", "kept")


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of operator 11: the base measures."""
    return op11_rules(spark, sf_dir).drop("kept")


BASE_SQL = """
WITH t AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents
), w AS (SELECT i, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t
), lines AS (
    SELECT i, count(*) - count(DISTINCT line) AS n FROM (SELECT i, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY i
), windows AS (SELECT i, p, w[p:p + 2] AS x FROM w, range(1, len(w) - 1) AS r(p)
), twice AS (SELECT i, p FROM windows QUALIFY count(*) OVER (PARTITION BY i, x) > 1
), covered AS (SELECT i, count(DISTINCT p + k) AS n FROM twice, range(0, 3) AS s(k) GROUP BY i
)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN lines USING (i) LEFT JOIN covered USING (i)
"""
