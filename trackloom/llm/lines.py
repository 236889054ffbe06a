"""Operator 1: line dedup by an exact set-similarity join.

A line is the set of its words.  Words are ordered from rare to frequent (a fixed-size
table of counts over all documents; ties by hash); only the first few words of a line
are its prefix, and two lines of Jaccard similarity at least t share a word of their
prefixes.  The join meets on prefix words under a length filter, a positional filter and
a bound from the lines' parity bitmaps, all exact bounds; what is left is verified on
the whole sets.  A line goes if any earlier line of the corpus matches it.

Rows are known by (doc, h): their id and a hash of their text, so that rows which share an
id, or have none, are told apart; rows of the same id and text share their fate.

Lines with the same set are one entry.  Before the join a cheap round compares each line
with the first line that shares its smallest word under a random order; where many lines
may match the same first one, they are verified, and those that this settles need no longer
look for a match themselves (others still meet them), so large groups of near copies do not
meet in all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import discard, materialize, read_table
from trackloom.llm.words import Words, batches_of, distinct, mixed

#: Entries of the table of word counts: 1 MB, whatever the size of the corpus.
BUCKETS = 1 << 20
#: Numbers of lines are below 2^LINE_BITS (a text has fewer bytes), hashes of texts have HASH_BITS, or NULL_BITS in rows without an id.
LINE_BITS, HASH_BITS, NULL_BITS = 31, 31, 62
_LAST = (1 << 63) - 1
#: So many keys of first lines are broadcast at most, some 50 bytes each.
MOST_HOT = 4096
#: First lines that fewer lines with the same smallest words may match are left to the join, where so small a group meets in all pairs.
LEAST_GROUP = 16
#: Places of words in a prefix have so many bits beside a line's id; later places count as the last, which only weakens a filter.
AT_BITS = 10
_SKETCH = tuple(f"s{k}" for k in range(8))
#: Ids and hashes of so many documents take some 40 MB as a broadcast table, the most that is ever sent.
MOST_BROADCAST_DOCS = 500_000
_ROUNDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def word_classes(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Of each bucket of word hashes, a class that grows with the words' count over all
    documents (in steps of a quarter of a doubling).  The array has ``BUCKETS`` bytes."""
    parts, each = 1024, BUCKETS // 1024

    def work(batches):
        counts, some = np.zeros(BUCKETS, dtype=np.int64), [np.zeros(0, dtype=np.int32)]

        def add() -> None:
            np.add(counts, np.bincount(np.concatenate(some), minlength=BUCKETS), out=counts)
            some[1:] = []

        for batch in batches:
            for _, words in batches_of(batch.column(0)):
                some.append((words.hashes & np.uint64(BUCKETS - 1)).astype(np.int32))
                if len(some) >= 64:
                    add()
        add()
        own = [x.tobytes() for x in counts.reshape(parts, each)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(own, pa.binary())], ["part", "counts"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.frombuffer(x, dtype=np.int64) for x in pdf["counts"])
        classes = np.minimum(255, np.ceil(4 * np.log2(np.maximum(n, 1)) + 1)).astype(np.uint8)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "classes": [classes.tobytes()]})

    # A task counts in an array of its own, so tasks follow the cores, not the splits.
    tasks = docs.select(text_col).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    rows = tasks.mapInArrow(work, "part int, counts binary").groupBy("part").applyInPandas(total, "part int, classes binary")
    out = np.zeros((parts, each), dtype=np.uint8)
    for row in rows.collect():  # 1024 rows of 1 kB
        out[row.part] = np.frombuffer(row.classes, dtype=np.uint8)
    return out.reshape(-1)


def line_numbers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its line, counted through the batch, and of each text its first line."""
    breaks = np.concatenate([[0], np.cumsum(words.bytes == 10)])
    texts = np.arange(len(words.offsets) - 1)
    return breaks[words.starts] + words.text, breaks[words.offsets[:-1]] + texts


def line_sets(words: Words, lines: np.ndarray, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word sets of lines that have words: (line, begin, words), words from rare to
    frequent by the classes in ``order`` (None: by hash alone)."""
    each, code = np.unique(words.hashes, return_inverse=True)
    if order is not None:
        by = np.argsort(order[(each & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")
        rank = np.empty(len(each), dtype=np.uint64)
        rank[by] = np.arange(len(each), dtype=np.uint64)
        each, code = each[by], rank[code]
    keys = distinct(lines.astype(np.uint64) << np.uint64(32) | code.astype(np.uint64))
    line = (keys >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    return line[begin], begin, each[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def signatures(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    return tuple(np.add.reduceat(mixed(sets, t), begin).view(np.int64) for t in (0x9FB21C651E98DF25, 0xD1342543DE82EF95))


def sketches(sets: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """512 parity bits of each set: sets that differ in d words differ in at most d of them."""
    place, bit = (sets >> np.uint64(49)) & np.uint64(7), np.uint64(1) << (sets >> np.uint64(58))
    return [np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), begin).view(np.int64) for k in range(len(_SKETCH))]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """The columns doc and h that name a row; rows without an id come last."""
    none, h = F.col(id_col).isNull(), F.xxhash64(text_col)
    bits = F.when(none, h.bitwiseAND(F.lit((1 << NULL_BITS) - 1))).otherwise(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), bits.alias("h")]


def _place() -> Column:
    """(doc, h, line) as one number in their order, which aggregates by hash; a struct would be sorted for."""
    return F.expr(f"cast(cast(cast(doc as decimal(20,0)) * {1 << HASH_BITS}BD + h as decimal(38,0)) * {1 << LINE_BITS}BD + line as decimal(38,0))")


def _placed(found: DataFrame) -> DataFrame:
    """``found`` with doc, h and line in place of ``place``."""
    unit, both, last = (f"{x}BD" for x in (1 << LINE_BITS, 1 << LINE_BITS + HASH_BITS, _LAST << LINE_BITS + HASH_BITS))
    # Hashes of rows without an id are wider than their part of the number; what lies above _LAST's is theirs.
    none = f"place >= {last}"
    found = found.withColumn("low", F.expr(f"if({none}, cast(pmod(place, {unit}) as long), cast(pmod(place, {both}) as long))"))
    found = found.withColumn("h", F.expr(f"if({none}, cast((place - {last} - low) / {unit} as long), shiftright(low, {LINE_BITS}))"))
    found = found.withColumn("doc", F.expr(f"if({none}, {_LAST}L, cast((place - low) / {both} as long))"))
    return found.withColumn("line", F.expr(f"low & {(1 << LINE_BITS) - 1}L")).drop("place", "low")


def distinct_lines(docs: DataFrame, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct word sets: id, first place (doc, h, line), size n, sig1, sig2, bitmap,
    prefix and the smallest words (m0, m1) under two random orders."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(word_classes(docs, text_col))

    def work(batches):
        for batch in batches:
            for row, words in batches_of(batch.column(2)):
                if not len(words):
                    continue
                lines, firsts = line_numbers(words)
                line, begin, sets = line_sets(words, lines, classes.value)
                n = np.diff(np.append(begin, len(sets)))
                sig1, sig2 = signatures(sets, begin)
                bitmap = np.bitwise_xor.reduceat(np.uint64(1) << (sets >> np.uint64(58)), begin).view(np.int64)
                small = [np.minimum.reduceat(mixed(sets, t) >> np.uint64(33), begin).astype(np.int32) for t in _ROUNDS]
                keep = n - (n * num + den - 1) // den + 1
                inside = np.arange(len(sets)) - np.repeat(begin, n) < np.repeat(keep, n)
                ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(sets[inside].astype(np.uint32).view(np.int32)))
                text = np.searchsorted(firsts, line, side="right") - 1
                named = [batch.column(c).slice(row).take(pa.array(text)) for c in (0, 1)]
                columns = [*named, pa.array(line - firsts[text], pa.int64()), pa.array(n.astype(np.int32)), *map(pa.array, (sig1, sig2, bitmap)), prefix, *map(pa.array, small)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "h", "line", "n", "sig1", "sig2", "bitmap", "prefix", "m0", "m1"])

    docs = docs.select(*row_key(id_col, text_col), text_col)
    each = docs.mapInArrow(work, "doc long, h long, line long, n int, sig1 long, sig2 long, bitmap long, prefix array<int>, m0 int, m1 int")
    same = ("sig1", "sig2", "n", "bitmap", "prefix", "m0", "m1")
    found = _placed(each.groupBy(*same).agg(F.min(_place()).alias("place")))
    return materialize(found.select("doc", "h", "line", *same).withColumn("id", F.monotonically_increasing_id()))


def first_candidates(lines: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (id, first): a line and the first line that shares a smallest word and about its
    length, where ``LEAST_GROUP`` lines or more may match that first one and share both
    smallest words with it, as near copies mostly do and lines with a frequent word do not.

    The lines of a key come sorted, so a task holds the first one only, however many there
    are.  Keys that a sample shows to hold more than 1 / ``MOST_HOT`` of all rows, of which
    there are at most ``MOST_HOT``, are not dealt to one task each: their first lines are
    aggregated and broadcast, and their other lines meet them where they are.
    """
    bucket = F.floor(F.log("n") / F.log(F.lit(den / num))).cast("int")
    keyed = lines.select("id", "doc", "h", "line", "n", "bitmap", F.hash("m0", "m1").alias("small"), F.posexplode(F.array("m0", "m1")).alias("k", "m"))
    keyed = keyed.select(F.xxhash64("k", "m", bucket).alias("key"), "doc", "h", "line", "n", "id", "bitmap", "small")
    some = materialize(keyed.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).groupBy("key").agg(F.count("*").alias("rows")))
    total = some.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(some.where(F.col("rows") > max(8, total // MOST_HOT)).select("key"))

    def work(batches):
        head = None
        for batch in batches:
            key, n, ids, bitmap, small = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(key):
                continue
            if head is not None:
                key, n, ids, bitmap, small = (np.append(h, x) for h, x in zip(head, (key, n, ids, bitmap, small), strict=True))
            first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            of = np.repeat(first, np.diff(np.append(first, len(key))))
            both, least, most = n.astype(np.int64) + n[of], np.minimum(n, n[of]), np.maximum(n, n[of])
            apart = np.bitwise_count((bitmap ^ bitmap[of]).view(np.uint64)).astype(np.int64)
            keep = (ids != ids[of]) & (least.astype(np.int64) * den >= most.astype(np.int64) * num) & ((both - apart) * (num + den) >= 2 * num * both)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[of][keep]), pa.array((small == small[of])[keep])], ["id", "first", "alike"])
            head = [x[of[-1] : of[-1] + 1] for x in (key, n, ids, bitmap, small)]

    cold = keyed.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "doc", "h", "line").select("key", "n", "id", "bitmap", "small")
    warm = keyed.join(hot, "key", "left_semi")
    heads = warm.groupBy("key").agg(F.min_by(F.struct("id", "n", "bitmap", "small"), F.struct("doc", "h", "line")).alias("head"))
    heads = heads.select("key", F.col("head.id").alias("first"), F.col("head.n").alias("m"), F.col("head.bitmap").alias("bits"), F.col("head.small").alias("its"))
    both = F.col("n") + F.col("m")
    apart = F.bit_count(F.col("bitmap").bitwiseXOR(F.col("bits")))
    close = (F.least("n", "m") * den >= F.greatest("n", "m") * num) & ((both - apart) * (num + den) >= 2 * num * both)
    met = warm.join(F.broadcast(heads), "key").where((F.col("id") != F.col("first")) & close).select("id", "first", (F.col("small") == F.col("its")).alias("alike"))
    found = materialize(cold.mapInArrow(work, "id long, first long, alike boolean").union(met).distinct())
    large = found.where("alike").groupBy("first").agg(F.count("*").alias("many")).where(F.col("many") >= LEAST_GROUP).select("first")
    pairs = materialize(found.join(large, "first").select("id", "first"))
    discard(some, found)
    return pairs


def _meet(num: int, den: int):
    """Pairs within each word of rows (key, rest, bitmap) sorted by key: word and n, id, at and open in one number each."""

    def filtered(i: np.ndarray, j: np.ndarray, c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, n, at, ids, bitmap, _ = c
        # At the first shared word nothing was shared before it, so at most what follows adds to it.
        left = n - at
        keep = np.minimum(left[i], left[j]) * (num + den) >= (n[i] + n[j]) * num
        i, j = i[keep], j[keep]
        both = n[i] + n[j]
        keep = (both - np.bitwise_count(bitmap[i] ^ bitmap[j])) * (num + den) >= 2 * num * both
        return i[keep], j[keep]

    def pairs(c: list[np.ndarray], done: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows from ``done`` on, each with the earlier ones of its word and length range."""
        word, n, open_ = c[0], c[1], c[5]
        key = np.concatenate([[0], np.cumsum(word[1:] != word[:-1])]) << 40
        low = key + (n * num + den - 1) // den
        key = key + n
        found = []
        rows = np.arange(done, len(word))
        for own, others in ((rows[open_[rows]], np.arange(len(word))), (rows[~open_[rows]], np.flatnonzero(open_))):
            first = np.searchsorted(key[others], low[own])
            last = np.searchsorted(others, own)
            many = np.maximum(last - first, 0)
            ends = np.cumsum(many)
            at = 0
            while at < len(own):
                # Blocks of a bounded number of pairs; a row with more is a block of its own.
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), side="right")))
                size = many[at:to]
                i = np.repeat(own[at:to], size)
                j = others[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[at:to], size)]
                found.append(filtered(i, j, c))
                at = to
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))

    def work(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            key, rest, bitmap = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(key):
                continue
            at = rest >> 1 & (1 << AT_BITS) - 1
            new = [key >> 32, key & 0xFFFFFFFF, at, rest >> AT_BITS + 1, bitmap.view(np.uint64), rest & 1 == 1]
            done = len(held[0]) if held else 0
            c = [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)] if held else new
            i, j = pairs(c, done)
            if len(i):
                a, b = c[3][i], c[3][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            # What later rows of the last word may still meet.
            stay = (c[0] == c[0][-1]) & (c[1] * den >= c[1][-1] * num)
            held = [x[stay] for x in c]

    return work


def prefix_candidates(lines: DataFrame, settled: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of an unsettled line and any other line that pass the filters.

    Rows of a word are sorted by length, so that a task holds only those of one word
    within the length filter of the row at hand.  Word and length are one number, by which
    Spark sorts without comparing rows.
    """
    flagged = lines.join(settled.select("id", F.lit(False).alias("open")), "id", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    rows = flagged.select("id", "n", "bitmap", "open", F.posexplode("prefix").alias("at", "word"))
    key, at = F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(F.col("n").cast("long")), F.least("at", F.lit((1 << AT_BITS) - 1))
    rest = F.shiftleft(F.shiftleft("id", AT_BITS).bitwiseOR(at.cast("long")), 1).bitwiseOR(F.col("open").cast("long"))
    rows = rows.select(key.alias("key"), rest.alias("rest"), "bitmap")
    return rows.repartition(F.shiftright("key", 32)).sortWithinPartitions("key").mapInArrow(_meet(num, den), "a long, b long").where("a <> b").distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, doc, h, line, words, sketch): the whole sets of the lines in ``wanted`` (doc,
    h, wanted), from their texts; an id may come twice where rows are repeated."""

    def work(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            some, ids, sigs, docs, hashes, places = [], [], [], [], [], []
            for text, wanted, doc, h in zip(texts, *(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                parts = (text or "").split("\n")
                for want in wanted:
                    if want["line"] < len(parts):
                        some.append(parts[want["line"]])
                        ids.append(want["id"])
                        sigs.append(want["sig1"])
                        docs.append(doc)
                        hashes.append(h)
                        places.append(want["line"])
            ids, sigs, docs, hashes, places = (np.array(x, dtype=np.int64) for x in (ids, sigs, docs, hashes, places))
            for row, words in batches_of(pa.array(some, pa.string())):
                line, begin, sets = line_sets(words, words.text, None)
                if not len(line):
                    continue
                ends = np.append(begin, len(sets))
                # Texts may share a hash: only the line that was meant counts.
                good = np.flatnonzero(signatures(sets, begin)[0] == sigs[row + line])
                size = np.diff(ends)[good]
                inside = np.zeros(len(sets) + 1, dtype=np.int64)
                np.add.at(inside, ends[good], 1)
                np.add.at(inside, ends[good + 1], -1)
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                own = sets[np.cumsum(inside[:-1]) > 0].view(np.int64)
                which = row + line[good]
                wide = [pa.array(x[good]) for x in sketches(sets, begin)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[which]) for x in (ids, docs, hashes, places)), pa.ListArray.from_arrays(pa.array(at), pa.array(own)), *wide], ["id", "doc", "h", "line", "words", *_SKETCH])

    texts = docs.select(*row_key(id_col, text_col), text_col)
    if wanted.count() <= MOST_BROADCAST_DOCS:
        # Few documents are wanted: the others' texts need not be shuffled.  Beyond that the join alone tells.
        texts = texts.join(F.broadcast(wanted.select("doc", "h")), ["doc", "h"], "left_semi")
    return texts.join(wanted, ["doc", "h"]).select(text_col, "wanted", "doc", "h").mapInArrow(work, "id long, doc long, h long, line long, words array<long>, " + ", ".join(f"{c} long" for c in _SKETCH))


def matched(pairs: DataFrame, docs: DataFrame, lines: DataFrame, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The later line (id) of each of the ``pairs`` (a, b) whose whole sets match."""
    pairs = materialize(pairs)
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("id"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = materialize(lines.join(ids, "id").groupBy("doc", "h").agg(F.collect_list(F.struct("id", "line", "sig1")).alias("wanted")))
    table = materialize(_sets_of(docs, wanted, id_col, text_col))
    sets = table.select("id", "words", F.struct("doc", "h", "line").alias("at"))
    left, right = sets.toDF("a", "wa", "pa"), sets.toDF("b", "wb", "pb")
    # The sketches bound the overlap; whole sets are only met where the bound allows a match.
    short = table.select("id", F.size("words").alias("n"), *_SKETCH).dropDuplicates(["id"])
    met = pairs.join(short.toDF("a", "na", *(f"a{c}" for c in _SKETCH)), "a").join(short.toDF("b", "nb", *(f"b{c}" for c in _SKETCH)), "b")
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in _SKETCH), F.lit(0))
    size = F.col("na") + F.col("nb")
    likely = materialize(met.where((size - apart) * (num + den) >= 2 * num * size).select("a", "b"))
    both = likely.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    sure = (shared * (num + den) >= (F.size("wa") + F.size("wb")) * num) & (F.col("pa") != F.col("pb"))
    found = materialize(both.where(sure).select(F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct())
    discard(pairs, wanted, table, likely)
    return found


def kept_lines(docs: DataFrame, *, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, h, line) of the lines with words that stay; the rest has an earlier match.

    ``num`` / ``den`` is the least Jaccard similarity.  Earlier is smaller (doc_id, hash of
    the text, line), null ids last; the hash is the text's XXH64 (seed 42), of which the low
    ``HASH_BITS`` count, ``NULL_BITS`` where the id is null.  Lines at the same place of equal
    rows are not earlier than each other.
    """
    lines = distinct_lines(docs, num, den, id_col, text_col)
    early = first_candidates(lines, num, den).select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()
    first = matched(early, docs, lines, num, den, id_col, text_col)
    more = matched(prefix_candidates(lines, first, num, den), docs, lines, num, den, id_col, text_col)
    return lines.join(first.union(more), "id", "left_anti").select("doc", "h", "line")


def dedup_lines(docs: DataFrame, *, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` without lines that an earlier line of the corpus matches: every row, with
    ``text`` replaced, and n_lines and n_removed (long).  ``chars_col``: a column of the
    text's length to be replaced too.

    Lines are parted by U+000A and joined again by it.  Lines without words match none and
    stay.  A null text stays null (0 lines), as does an empty one (1 line); documents may
    become empty; equal rows keep the same lines; columns of other names pass through,
    and names in ``docs`` that clash with n_lines or n_removed are replaced.
    """
    kept = kept_lines(docs, num=num, den=den, id_col=id_col, text_col=text_col)
    per_doc = kept.groupBy("doc", "h").agg(F.collect_list("line").alias("kept"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*(c for c in names if c != text_col)).alias("row"), F.col(text_col).isNull().alias("none"), *row_key(id_col, text_col), F.col(text_col).alias("text"))

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out, total, gone = [], [], []
            for text, none, stay in zip(texts, batch.column("none").to_pylist(), batch.column("kept").to_pylist(), strict=True):
                lines, stay = (text or "").split("\n"), set(stay or ())
                left = [x for i, x in enumerate(lines) if i in stay or not x.strip("\t\n\x0b\x0c\r ")]
                out.append(None if none else "\n".join(left))
                total.append(0 if none else len(lines))
                gone.append(0 if none else len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_removed"])

    row = rows.schema["row"].dataType.simpleString()
    done = rows.join(per_doc, ["doc", "h"], "left").mapInArrow(cut, f"row {row}, text string, n_lines long, n_removed long")
    changed = {text_col: F.col("text")}
    if chars_col:
        changed[chars_col] = F.length("text").cast(docs.schema[chars_col].dataType)
    return done.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in names), "n_lines", "n_removed")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its lines, of those removed, and a digest of what stays."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH one AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS n FROM one),
s AS (SELECT *, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
e AS (SELECT ws, min({'d': doc_id, 'n': n}) AS place, len(ws) AS size FROM s WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT place, size, ws, unnest(ws) AS word FROM e),
c AS (SELECT word, count(*) AS many FROM t GROUP BY word),
r AS (SELECT place, size, ws, word, row_number() OVER (PARTITION BY place, ws ORDER BY many, word) AS pos FROM t JOIN c USING (word)),
x AS (SELECT place, size, ws, word FROM r WHERE pos <= size - (4 * size + 4) // 5 + 1),
p AS (SELECT DISTINCT b.place AS place, a.ws AS aw, b.ws AS bw FROM x a JOIN x b ON a.word = b.word AND a.place < b.place AND 5 * a.size >= 4 * b.size AND 5 * b.size >= 4 * a.size),
gone AS (SELECT DISTINCT place FROM p WHERE 9 * len(list_intersect(aw, bw)) >= 4 * (len(aw) + len(bw))),
k AS (SELECT doc_id, count(*) AS stay, string_agg(line, chr(10) ORDER BY n) AS said
  FROM s LEFT JOIN e USING (ws) LEFT JOIN gone ON gone.place = e.place
  WHERE len(ws) = 0 OR (e.place = {'d': doc_id, 'n': n} AND gone.place IS NULL) GROUP BY doc_id)
SELECT doc_id, coalesce(len(parts), 0)::bigint AS n_lines, (coalesce(len(parts), 0) - coalesce(stay, 0))::bigint AS n_removed,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(said, '')) END AS kept_sha256
FROM one LEFT JOIN k USING (doc_id)
"""
