"""Operator 12: phrase collocations, counted by suffix-sigma.

Every place of a text begins a suffix of at most four words.  Suffixes are shuffled by
language and first word and sorted in reverse lexicographic order, where those that begin
alike lie side by side; so one pass with a counter for each length counts all phrases: a
row closes the counters of the lengths at which it differs from the row before.  Scores
then come from joins of the frequent phrases with their parts.

A phrase of two words or more is only as frequent as its words, so the words are counted
first, and suffixes end before a word that is too rare; suffixes of one word need not be
shuffled then.  Whether a word is frequent is looked up in a bitmap of fixed size
(``FREQUENT_BITS``), in which a rare word may share a bit with a frequent one; that costs
rows, not correctness.  Equal suffixes of a run of texts are one row with a count.

A first word, or first two words, with a large share of all rows is dealt to many tasks,
by the first two words or by the whole suffix.  What such a pair's tasks count are parts of
a sum and are added up afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, UPPER, materialize, read_table
from trackloom.llm.words import mixed, span_hash, sums

#: 2 MB, whatever the size of the corpus.
FREQUENT_BITS = 1 << 24
#: Classes of pairs of words that are counted to find hot ones; words and classes of more than
#: this share of all are hot, so at most ``HOT`` words are.
CLASSES, HOT = 1 << 12, 1 << 10
MAX_WORDS = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(UPPER.encode())] = list(LOWER.encode())
#: Bytes: 0 of words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_TOP = np.uint64(((1 << 20) - 1) << 44)


class Run:
    """Lower-cased words of the texts of one run: ``bytes`` holds each with a blank behind it,
    ``at`` where each begins, and the end; ``joined``: whether the next word follows in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind, n = _KIND[data], len(data)
        inside = kind == 0
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & ~(before & ~cut[:-1]))
        ends = np.flatnonzero(inside & ~(after & ~cut[1:])) + 1
        broken = np.cumsum(kind == 2, dtype=np.int64)
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        word = np.ones(self.at[-1], dtype=bool)
        word[self.at[1:] - 1] = False
        self.bytes = np.full(self.at[-1], 0x20, dtype=np.uint8)
        self.bytes[word] = _LOWER[data[inside]]
        self.joined = np.zeros(len(starts), dtype=bool)
        self.joined[:-1] = (self.text[1:] == self.text[:-1]) & (broken[starts[1:]] == broken[starts[:-1]])
        self.hashes = span_hash(sums(self.bytes + np.uint8(1)), self.at[:-1], self.at[1:] - 1)

    def __len__(self) -> int:
        return len(self.joined)

    def words(self) -> pa.Array:
        """Each word with the blank behind it."""
        return pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(self.at), pa.py_buffer(self.bytes)])


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches [start, end) of ``data``, which begin and end with characters, as strings."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(at[-1]) + np.repeat(starts - at[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[index])]).cast(pa.string())


def _runs(batch: pa.RecordBatch, most_bytes: int):
    """(language, its hash, run) of the rows of a batch (lang, text), a language at a time."""
    langs = batch.column(0).fill_null("und").dictionary_encode()
    texts = batch.column(1).fill_null("").cast(pa.large_string())
    code = langs.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = texts.take(pa.array(np.flatnonzero(code == k)))
        offsets = np.frombuffer(own.buffers()[1], dtype=np.int64)[: len(own) + 1]
        data = np.frombuffer(own.buffers()[2] or b"", dtype=np.uint8)
        said = np.frombuffer(lang.encode() + b"\n", dtype=np.uint8)
        salt = span_hash(sums(said), np.array([0]), np.array([len(said)]))[0]
        row = 0
        while row < len(own):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1)
            if (run := Run(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])) and len(run):
                yield lang, salt, run
            row = end


def _place(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Of each word of a language its bit among ``FREQUENT_BITS``."""
    return (mixed(hashes ^ salt) & np.uint64(FREQUENT_BITS - 1)).astype(np.int64)


def _pair(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """The hash of each word and the next; that of the last means nothing."""
    return mixed((hashes ^ salt) * np.uint64(3) + np.append(hashes[1:], np.uint64(0)))


def count_words(texts: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """Rows (lang, word, n, class): counts of words, and of classes of adjacent pairs
    (class not null), each once for every run at most."""

    def work(batches):
        pairs = np.zeros(CLASSES, dtype=np.int64)
        names = ["lang", "word", "n", "class"]
        for batch in batches:
            for lang, salt, run in _runs(batch, most_bytes):
                pairs += np.bincount((_pair(run.hashes, salt)[run.joined] & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                each = pc.value_counts(run.words())
                size = len(each)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), each.field("values").cast(pa.string()), each.field("counts"), pa.nulls(size, pa.int32())], names)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.string()), pa.array(pairs[some]), pa.array(some.astype(np.int32))], names)

    return texts.mapInArrow(work, "lang string, word string, n long, class int").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The bitmap of frequent words: ``FREQUENT_BITS`` bytes of 0 or 1, from at most so many bits."""

    def work(batches):
        for batch in batches:
            words = batch.column(1).cast(pa.large_string())
            if not len(words):
                continue
            langs = batch.column(0).dictionary_encode()
            offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
            data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
            said = [np.frombuffer(x.encode() + b"\n", dtype=np.uint8) for x in langs.dictionary.to_pylist()]
            salts = np.array([span_hash(sums(x), np.array([0]), np.array([len(x)]))[0] for x in said], dtype=np.uint64)
            hashes = span_hash(sums(data + np.uint8(1)), offsets[:-1], offsets[1:] - 1)
            bits = _place(hashes, salts[langs.indices.to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    out = np.zeros(FREQUENT_BITS // 64, dtype=np.int64)
    got = frequent.select("lang", "word").mapInArrow(work, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _suffixes(texts: DataFrame, frequent: np.ndarray, hot_words: np.ndarray, hot_pairs: np.ndarray, most_bytes: int) -> DataFrame:
    """Rows (by, lang, suffix, n): suffixes of two to four frequent words, each with a blank
    behind every word, once for every run; ``by``: words that deal it, 1, 2 of a hot word, or
    all of a hot pair.  Rows that begin alike lie together, which shuffles in fewer bytes."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(frequent))

    def work(batches):
        flags = np.unpackbits(shared.value)
        for batch in batches:
            for lang, salt, run in _runs(batch, most_bytes):
                known = flags[_place(run.hashes, salt)].astype(bool)
                link = run.joined & known
                link[:-1] &= known[1:]
                size = np.ones(len(link), dtype=np.int64)
                whole, more = run.hashes ^ salt, link.copy()
                for k in range(1, MAX_WORDS):
                    size += more
                    ahead, left = np.zeros(len(link), np.uint64), max(0, len(link) - k)
                    ahead[:left] = run.hashes[k:]
                    whole = np.where(more, mixed(whole + np.uint64(k) + ahead * np.uint64(0x9E3779B97F4A7C15)), whole)
                    more[:left] &= link[k:]
                    more[left:] = False
                at = np.flatnonzero(size > 1)
                if not len(at):
                    continue
                pair, word = _pair(run.hashes, salt), run.hashes ^ salt
                key = mixed(word[at]) & _TOP | (pair[at] >> np.uint64(42)) << np.uint64(22) | whole[at] >> np.uint64(42)
                order = at[np.argsort(key)]
                begins = np.flatnonzero(np.append(True, whole[order][1:] != whole[order][:-1]))
                one, count = order[begins], np.diff(np.append(begins, len(order)))
                # A hot word is dealt by pair; its phrases of two and more words still lie together.
                by = np.where(hot_pairs[(pair[one] & np.uint64(CLASSES - 1)).astype(np.int64)], MAX_WORDS, 1 + np.isin(word[one], hot_words))
                yield pa.RecordBatch.from_arrays([pa.array(by.astype(np.int8)), pa.array([lang] * len(one)), _slices(run.bytes, run.at[one], run.at[one + size[one]]), pa.array(count)], ["by", "lang", "suffix", "n"])

    return texts.mapInArrow(work, "by byte, lang string, suffix string, n long")


def _counted(least: int):
    """A task that counts the prefixes of sorted suffixes: of each length one counter is open,
    which closes at the first row that begins otherwise.  Counts below ``least`` go, unless
    they are parts of a sum."""

    def work(batches):
        before = None  # (lang, suffix, part) of the last row and its open counters
        for batch in batches:
            if not batch.num_rows:
                continue
            suffix, langs = batch.column(2).cast(pa.large_string()), batch.column(1)
            part, n = batch.column(0).to_numpy() == MAX_WORDS, batch.column(3).to_numpy()
            if before:  # stands before the batch, counts nothing itself
                suffix, langs = pa.concat_arrays([pa.array([before[1]], pa.large_string()), suffix]), pa.concat_arrays([pa.array([before[0]]), langs])
                part, n = np.append(before[2], part), np.append(0, n)
            offsets = np.frombuffer(suffix.buffers()[1], dtype=np.int64)[suffix.offset : suffix.offset + len(suffix) + 1]
            data = np.frombuffer(suffix.buffers()[2], dtype=np.uint8)
            code = langs.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            size = np.diff(offsets)
            # Bytes that a row shares with the one before.
            most = np.minimum(size[1:], size[:-1])
            into = np.cumsum(most) - most
            at = np.arange(into[-1] + most[-1] if len(most) else 0) - np.repeat(into, most)
            unlike = data[np.repeat(offsets[1:-1], most) + at] != data[np.repeat(offsets[:-2], most) + at]
            stop = np.append(np.where(unlike, at, 1 << 62), 1 << 62)
            shared = np.zeros(len(size), dtype=np.int64)
            if len(most):
                shared[1:] = np.where(code[1:] == code[:-1], np.minimum(np.minimum.reduceat(stop, into), most), 0)
            blanks = np.flatnonzero(data[: offsets[-1]] == 0x20)
            blanks = blanks[np.searchsorted(blanks, offsets[0]) :]
            first = np.searchsorted(blanks, offsets)
            words, open_ = np.diff(first), {}
            for k in range(2, MAX_WORDS + 1):
                rows = np.flatnonzero(words >= k)
                if not len(rows):
                    continue
                end = blanks[first[rows] + k - 1] + 1
                begins = np.flatnonzero(shared[rows] < end - offsets[rows])
                begins = begins if len(begins) and begins[0] == 0 else np.append(0, begins)
                total = np.add.reduceat(n[rows], begins)
                if before and rows[0] == 0:
                    total[0] += before[3][k]
                here, stays = rows[begins], np.ones(len(begins), dtype=bool)
                if rows[-1] == len(size) - 1:
                    open_[k], stays[-1] = int(total[-1]), False
                stays &= (total >= least) | part[here] & (k < MAX_WORDS)
                if stays.any():
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(here[stays])), _slices(data, offsets[here[stays]], end[begins[stays]] - 1), pa.array(total[stays])], ["lang", "phrase", "n"])
            before = (langs[-1].as_py(), suffix[-1].as_py(), bool(part[-1]), open_)
        if before:
            words = before[1].split(" ")
            got = [(before[0], " ".join(words[:k]), c) for k, c in before[3].items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.string()), pa.array([r[1] for r in got], pa.string()), pa.array([r[2] for r in got], pa.int64())], ["lang", "phrase", "n"])

    return work


def frequent_phrases(docs: DataFrame, *, least: int = 30, text_col: str = "text", lang_col: str = "lang", most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): rows (lang, phrase, n) of all phrases of one to four words that
    occur ``least`` times or more, and (lang, n) with the number of words of each language."""
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = materialize(count_words(texts, most_bytes))
    known = counts.where("word IS NOT NULL")
    totals = known.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = known.where(F.col("n") >= least).select("lang", F.rtrim("word").alias("phrase"), "n", "word")

    every = known.agg(F.sum("n")).first()[0] or 0
    common = known.where(F.col("n") * HOT > every).select("lang", "word").collect()  # fewer than HOT
    whole = lambda x: span_hash(sums(np.frombuffer(x, dtype=np.uint8)), np.array([0]), np.array([len(x)]))[0]
    word = lambda x: span_hash(sums(np.frombuffer(x, dtype=np.uint8) + np.uint8(1)), np.array([0]), np.array([len(x) - 1]))[0]
    hot_words = np.array([word(r.word.encode()) ^ whole(r.lang.encode() + b"\n") for r in common], dtype=np.uint64)
    hot_pairs = np.zeros(CLASSES, dtype=bool)
    for r in counts.where(F.col("class").isNotNull()).where(F.col("n") * HOT > every).select("class").collect():
        hot_pairs[r["class"]] = True

    rows = _suffixes(texts, _bitmap(frequent.select("lang", "word")), hot_words, hot_pairs, most_bytes)
    dealt = rows.repartition("lang", F.expr("substring_index(suffix, ' ', CAST(by AS INT))")).sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    counted = dealt.mapInArrow(_counted(least), "lang string, phrase string, n long")
    phrases = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return materialize(frequent.select("lang", "phrase", "n").unionByName(phrases)), totals


def _whole(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def collocations(docs: DataFrame, *, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang", most_bytes: int = 1 << 20) -> DataFrame:
    """Each language's best phrases of two to four words: (lang, rank, phrase, a, l, r, n, score).

    a, l and r are the counts of the phrase and of its parts at the cut of least score (ties to
    the shorter first part), n that of the language's words.  A phrase within a longer one that
    is nearly as frequent goes.  Null languages are ``und``, null texts empty; a repeated row
    counts again; texts of any length are read whole, in runs of ``most_bytes`` or one text.
    An empty table has no phrases.  Ties in score and count are ranked by the bytes of the
    phrase.  Equal suffixes of a run are told by 64 bits.  Further columns are not read.
    """
    phrases, totals = frequent_phrases(docs, least=least, text_col=text_col, lang_col=lang_col, most_bytes=most_bytes)
    words = F.split("phrase", " ")
    many = phrases.withColumn("w", words).where(F.size("w") > 1).select("lang", "phrase", F.col("n").alias("a"), "w")
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    k, size = F.col("k"), F.size("w")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "a", "k", piece(F.lit(1), k).alias("left"), piece(k + 1, size - k).alias("right"))
    of = lambda side, n: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    parts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("CAST(a AS DECIMAL(20,0)) * 2000000 DIV (CAST(l AS DECIMAL(20,0)) + r)").alias("score")
    least_cut = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")

    inner = many.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), size - 1)).alias("long"))
    inner = inner.select("lang", "a", "w", "long", F.explode(F.sequence(F.lit(1), size - F.col("long") + 1)).alias("start")).select("lang", piece(F.col("start"), F.col("long")).alias("phrase"), F.col("a").alias("longer"))
    within = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    apart = least_cut.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * 80))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = apart.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


#: All phrases, counted one by one.
OP12_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), f AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n
    FROM words, range(1, 5) AS s(k), range(1, len(w) - k + 2) AS p(i) GROUP BY ALL HAVING count(*) >= 30
), cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (
    SELECT c.lang, c.phrase, a, c.w, j, l.n AS l, r.n AS r, (2000000 * a::HUGEINT // (l.n::HUGEINT + r.n))::BIGINT AS score
    FROM cand c, range(1, c.k) AS g(j) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
), least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
    SELECT * FROM least x WHERE NOT EXISTS (
        SELECT 1 FROM cand y WHERE y.lang = x.lang AND y.k > len(x.w) AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a::HUGEINT >= 80 * x.a::HUGEINT)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
