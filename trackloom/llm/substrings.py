"""Operator 6: substring dedup on a compacted De Bruijn graph of the corpus.

Edges of the graph are the token k-mers of a window's length; an edge leads from the node
of its first window - 1 words to that of its last ones.  Windows in a row that have the same
anchor, the stretch of ``k`` words of least hash in them, are packed within the text already
and are one edge.  That is right where all windows of an anchor, wherever it occurs, are the
same; where texts part or join within them, the packed edge is opened into its windows.
Anchors of one document only are dropped, as no window of theirs repeats.

Each edge that repeats knows its source, its first place in the smallest document that has
it.  In- and out-degrees are counted by node; where a node has one edge in and one out, and
these adjoin in their source, they are linked by a join, and pointer doubling joins every
edge to the first one of its path.  Occurrences of edges of a path that adjoin become one
long span with its place in the source.  At last the words of every span are compared with
the words at that place of the source's text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, read_table
from trackloom.llm.words import Words, batches_of, mixed, span_hash, sums

K = 12


def _least_edge(words: Words, window: int, k: int) -> np.ndarray:
    """For each window start the word at which its edge of smallest hash begins, the
    leftmost of equals; -1 where no window of one text begins."""
    n = len(words)
    out = np.full(n, -1, dtype=np.int64)
    if n < window:
        return out
    at = np.arange(n - k + 1)
    low = np.uint64((1 << 24) - 1) if n < 1 << 24 else np.uint64((1 << 40) - 1)
    best = mixed(span_hash(sums(words.hashes), at, at + k)) & ~low | at.astype(np.uint64)
    span, width = window - k + 1, 1
    while 2 * width <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    rest = span - width
    if rest:
        best = np.minimum(best[: len(best) - rest], best[rest:])
    least = (best & low).astype(np.int64)
    whole = words.text[: n - window + 1] == words.text[window - 1 :]
    out[: n - window + 1][whole] = least[whole]
    return out


def paths_of(words: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """The packed edges of a batch: (text, hash of the anchor, first and last window start,
    two hashes of all words, hashes of the node at the beginning and at the end)."""
    edge = _least_edge(words, window, k)
    starts = np.flatnonzero((np.diff(edge, prepend=-1) != 0) & (edge >= 0))
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return (none,) * 8
    ends = np.flatnonzero((np.diff(edge, append=-1) != 0) & (edge >= 0))
    one, two = sums(words.hashes), sums(mixed(words.hashes), 1)
    at = edge[starts]
    key = span_hash(one, at, at + k).view(np.int64)
    h1, h2 = span_hash(one, starts, ends + window).view(np.int64), span_hash(two, starts, ends + window, 1).view(np.int64)
    return words.text[starts], key, starts, ends, h1, h2, *_nodes(one, starts, ends, window)


def _nodes(running: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes from which window ``first`` leads and to which window ``last`` does."""
    of = lambda at: span_hash(running, at, at + window - 1).view(np.int64)
    return of(first), of(last + 1)


def _paths(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Rows (doc, edge, h1, h2, s, t, lo, n): packed edges, n windows from word lo of the text on."""

    def work(batches):
        for batch in batches:
            for row, words in batches_of(batch.column(1)):
                text, edge, lo, hi, h1, h2, s, t = paths_of(words, window, k)
                if len(text):
                    first = words.first[text]
                    doc = batch.column(0).slice(row).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (edge, h1, h2, s, t, (lo - first).astype(np.int32), (hi - lo + 1).astype(np.int32)))], ["doc", "edge", "h1", "h2", "s", "t", "lo", "n"])

    return docs.select("doc", "text").mapInArrow(work, "doc long, edge long, h1 long, h2 long, s long, t long, lo int, n int")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Shorter batches, so that few texts are open at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with text compressed for a shuffle; null stays null."""

    def work(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in _slices(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else press.compress(t.encode()) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.binary()))

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, schema)


def _unpacked(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([None if p is None else press.decompress(p) for p in column.to_pylist()], pa.binary()).cast(pa.string())


def _windows(docs: DataFrame, open_paths: DataFrame, window: int) -> DataFrame:
    """Rows (doc, at, h1, h2, s, t): every window of the given packed edges (doc, lo, n)."""

    def work(batches):
        for batch in _slices(batches):
            wanted = batch.column(2).to_pylist()
            for row, words in batches_of(_unpacked(batch.column(1))):
                text, at = [], []
                for t in range(len(words.offsets) - 1):
                    n = words.first[t + 1] - words.first[t]
                    for x in wanted[row + t]:
                        if x["lo"] + x["n"] - 1 + window <= n:
                            at.append(np.arange(words.first[t] + x["lo"], words.first[t] + x["lo"] + x["n"]))
                            text.append(np.full(len(at[-1]), t))
                if not at:
                    continue
                at, text = np.concatenate(at), np.concatenate(text)
                running = sums(words.hashes)
                one = span_hash(running, at, at + window).view(np.int64)
                two = span_hash(sums(mixed(words.hashes), 1), at, at + window, 1).view(np.int64)
                doc = batch.column(0).slice(row).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([doc, *map(pa.array, ((at - words.first[text]).astype(np.int32), one, two, *_nodes(running, at, at, window)))], ["doc", "at", "h1", "h2", "s", "t"])

    per_doc = open_paths.select("doc", "lo", "n").distinct().groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("wanted"))
    met = _packed(docs.select("doc", "text")).join(per_doc, "doc").select("doc", "text", "wanted")
    return met.mapInArrow(work, "doc long, at int, h1 long, h2 long, s long, t long")


def compacted(edges: DataFrame) -> DataFrame:
    """Rows (id, head, off) of ``edges`` (id, s, t, source, at, n): the first edge of each
    edge's nonbranching path and how many windows lie between their beginnings.

    A node is passed where one edge leads to it and one from it, and both adjoin in their
    source.  So a path is a stretch of one document, and none is a cycle.
    """
    whole = F.struct("id", "source", "at", "n").alias("e")
    into = edges.groupBy(F.col("t").alias("node")).agg(F.count("*").alias("degree"), F.first(whole).alias("a")).where("degree = 1")
    out = edges.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("degree"), F.first(whole).alias("b")).where("degree = 1")
    links = into.select("node", "a").join(out.select("node", "b"), "node").where("a.source = b.source and a.at + a.n = b.at")
    links = links.select(F.col("b.id").alias("id"), F.col("a.id").alias("head"), F.col("a.n").cast("long").alias("off"))
    state = edges.select("id").join(links, "id", "left")
    state = materialize(state.select("id", F.coalesce("head", "id").alias("head"), F.coalesce("off", F.lit(0)).alias("off"), F.col("head").isNull().alias("done")))
    finished, going = state.where("done"), state.where("not done")
    while not going.isEmpty():
        # What an edge points to has moved as far again; who points to a first edge is done.
        ahead = finished.union(going).toDF("head", "next", "more", "last")
        state = materialize(going.drop("done").join(ahead, "head").select("id", F.col("next").alias("head"), (F.col("off") + F.col("more")).alias("off"), F.col("last").alias("done")))
        finished, going = finished.union(state.where("done")), state.where("not done")
    return finished.select("id", "head", "off")


def repeated_spans(docs: DataFrame, *, window: int = 50, k: int = K) -> DataFrame:
    """Rows (doc, start, words, source, at): stretches of ``docs`` (doc long, text) whose every
    window also begins in the smaller doc ``source``, there from word ``at`` on.  Stretches
    of a document may touch or overlap."""
    each = _paths(docs, window, k)
    anchors = each.groupBy("edge").agg(*(f(c).alias(f"{c}_{n}") for c in ("h1", "h2", "doc") for n, f in (("least", F.min), ("most", F.max))))
    same = (F.col("h1_least") == F.col("h1_most")) & (F.col("h2_least") == F.col("h2_most"))
    # Written before it is joined back, so that both inputs are plain exchanges, which adaptive execution splits at a hot anchor.
    shared = materialize(anchors.where("doc_least < doc_most").select("edge", same.alias("packed")))
    found = materialize(each.join(shared, "edge").drop("edge"))

    first = F.min(F.struct("doc", "lo")).alias("first")
    packed = materialize(found.groupBy("h1", "h2").agg(first, *(F.min(c).alias(c) for c in ("s", "t", "n", "packed"))))
    packed = packed.select("h1", "h2", "s", "t", "n", "packed", F.col("first.doc").alias("source"), F.col("first.lo").alias("at"))
    met = materialize(found.select("doc", "h1", "h2", "lo").join(packed.select("h1", "h2", "n", "packed", "source", "at"), ["h1", "h2"]))

    # Of equal edges that are opened, those of the smallest document stand for all.
    windows = materialize(_windows(docs, met.where("not packed and doc = source"), window))
    least = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("doc").alias("most"), F.min("s").alias("s"), F.min("t").alias("t")).where("first.doc < most")
    single = least.select("h1", "h2", "s", "t", F.lit(1).alias("n"), F.col("first.doc").alias("source"), F.col("first.at").alias("at"))
    edges = packed.where("packed").drop("packed").select("h1", "h2", "s", "t", "n", "source", "at").union(single)
    edges = materialize(edges.withColumn("id", F.monotonically_increasing_id()))

    # Every occurrence of an edge in a larger document, by its path and its distance from the path's beginning.
    ways = compacted(edges)
    heads = edges.select(F.col("id").alias("head"), F.col("at").alias("begin"))
    ways = materialize(edges.select("id", "h1", "h2", "n", "source").join(ways, "id").join(heads, "head").drop("id"))
    places = met.where("packed").select("doc", "h1", "h2", "lo").union(windows.select("doc", "h1", "h2", "at"))
    places = places.join(ways, ["h1", "h2"]).where("doc > source").select("doc", "source", "head", (F.col("lo") - F.col("off")).alias("shift"), F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("n")).cast("long").alias("hi"), "begin")
    in_order = Window.partitionBy("doc", "head", "shift").orderBy("lo")
    gap = F.coalesce((F.col("lo") > F.lag("hi").over(in_order)).cast("int"), F.lit(0))
    runs = places.distinct().withColumn("gap", gap).withColumn("run", F.sum("gap").over(in_order)).groupBy("doc", "source", "head", "shift", "run", "begin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    runs = runs.select("doc", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + window - 1).alias("words"), "source", (F.col("begin") + F.col("lo") - F.col("shift")).alias("at"))
    whole = met.where("not packed and doc > source").select("doc", F.col("lo").cast("long"), (F.col("n") + window - 1).cast("long"), "source", F.col("at").cast("long"))
    return runs.union(whole).distinct()


def _said(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (source, at, words, said): the words, joined by a space, at the places of the sources of ``spans``."""

    def work(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in _slices(batches):
            wanted = batch.column(2).to_pylist()
            for row, words in batches_of(_unpacked(batch.column(1)), 1 << 20):
                which, at, size, said = [], [], [], []
                starts, ends, data = words.starts, words.ends, words.bytes.tobytes()
                for t in range(len(words.offsets) - 1):
                    low, n = int(words.first[t]), int(words.first[t + 1] - words.first[t])
                    for x in wanted[row + t]:
                        if x["at"] + x["words"] <= n:
                            a, b = low + x["at"], low + x["at"] + x["words"]
                            said.append(press.compress(_joined(data, starts[a:b], ends[a:b])))
                            which.append(row + t)
                            at.append(x["at"])
                            size.append(x["words"])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(said, pa.binary())], ["source", "at", "words", "said"])

    wanted = spans.groupBy("source").agg(F.collect_set(F.struct("at", "words")).alias("wanted")).withColumnRenamed("source", "doc")
    return _packed(docs.select("doc", "text")).join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(work, "source long, at long, words long, said binary")


def _joined(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([data[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])


def remove_repeats(docs: DataFrame, *, window: int = 50, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, n_words, n_removed, kept (the words that
    stay, joined by one space) and spans (removed stretches of words, merged).

    A word goes if it lies in a window of ``window`` words whose words in order also begin
    in a document of smaller id, judged on the input.  Null texts have no words.  Rows
    without an id neither lose words nor cost others any.  Of rows with equal ids each is
    judged by its own words against smaller ids only.  Texts shorter than a window stay;
    empty tables give no rows; further columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ided = slim.where("id is not null").select(F.col("id").cast("long").alias("doc"), "text")
    spans = materialize(repeated_spans(ided, window=window, k=k))
    said = materialize(_said(ided, spans))
    told = spans.join(said, ["source", "at", "words"])
    per_doc = told.groupBy("doc").agg(F.collect_list(F.struct("start", "words", "said")).alias("spans"))

    def cut(batches):
        press = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            found = batch.column(2)
            for row, words in batches_of(_unpacked(batch.column(1)), 1 << 20):
                n = len(words.offsets) - 1
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                own = found.slice(row, n)
                lists = own.to_pylist() if own.null_count < n else [None] * n
                starts, ends, data = words.starts, words.ends, words.bytes.tobytes()
                for t, spans in enumerate(lists):
                    low, high = int(words.first[t]), int(words.first[t + 1])
                    for s in spans or ():
                        a, b = low + s["start"], low + s["start"] + s["words"]
                        # The span counts if its words are those of the source.
                        if b <= high and _joined(data, starts[a:b], ends[a:b]) == press.decompress(s["said"]):
                            gone[a] += 1
                            gone[b] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept, merged, totals = [], [], np.diff(words.first)
                for t in range(n):
                    low, high = int(words.first[t]), int(words.first[t + 1])
                    flags = gone[low:high]
                    at = np.flatnonzero(~flags) + low
                    kept.append(_joined(data, starts[at], ends[at]))
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                    merged.append([{"start": x, "end": y} for x, y in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
                lost = np.array([sum(s["end"] - s["start"] for s in m) for m in merged], dtype=np.int64)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(totals.astype(np.int64)), pa.array(lost), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(merged, span)], ["id", "n_words", "n_removed", "kept", "spans"])

    kind = slim.schema["id"].dataType.simpleString()
    met = _packed(slim.withColumn("doc", F.col("id").cast("long"))).join(per_doc, "doc", "left").select("id", "text", "spans")
    return met.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string, spans array<struct<start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS said FROM w),
f AS (SELECT said, min(doc_id) AS least FROM h GROUP BY said HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (said) WHERE doc_id > least),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS said FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::bigint AS n_words, (len(ws) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
