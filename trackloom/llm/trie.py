"""Operator 13: the prefix trie of conversations, from a Cartesian tree over their LCP array.

Conversations are sorted by their turns.  The trie is then told by one array: of each
conversation, how many first turns it shares with the one before it (LCP).  A node that
branches is an interval between the nearest smaller values on either side of an LCP entry;
entries of equal value within one interval are one node; what lies between a node and its
parent in depth, and below the last shared turn, are chains of nodes with one interval.
Every sum over a subtree is a difference of prefix sums over the interval.

The sorted order is dealt to blocks by range, and each block does this for itself.  A node
that reaches over a border between blocks is on the path of the block's first or last
conversation, no deeper than the LCP at that border, so a block has few of them; which
block such a node begins in is the nearest smaller value over one number for each block,
the least LCP in it.  Their parts are then summed.

A turn is known by 128 bits of the SHA-256 of its role and text; a conversation is a row
of 20 bytes a turn.  What goes through the driver are five numbers for each block.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, read_table

KEY = 16
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "depth long, n_convs long, conv_id long, parent long, n_children long, n_leaves long, total long, own long, above long, ends string, first boolean, last boolean, parent_first boolean, parent_last boolean"
_BLOCK = f"kind string, block int, {_NODE}, head binary, head_chars array<int>, tail binary, least long"


def conversations_of(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turns): each conversation's turns in order, as (key, chars).

    Order is by turn, null first; ties by role, then by the digest of the text.  Null roles
    and texts are empty.  Rows without a conv_id belong to no conversation.  A turn that is
    repeated counts as often as it stands there.  Further columns are not read.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(text, 256).substr(1, 16).alias("tie"), F.substring(digest, 1, 2 * KEY).alias("key"), F.length(text).alias("chars")).alias("t"),
    )
    return slim.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.key.alias("key"), t.chars.alias("chars"))).alias("turns"))


def rebuilt(convs: DataFrame, *, hundred: int = 100, most: int = 5) -> DataFrame:
    """Rows (conv_id, turns): the first h turns of the conversation that begins its hundred,
    then its own after its first h; h is the CRC-32 of its decimal id modulo 6.  All of
    either where it has fewer; nothing of a first conversation that is absent."""
    base = F.col("conv_id") - F.col("conv_id") % hundred
    heads = convs.where(F.col("conv_id") % hundred == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = convs.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    nothing = F.slice("turns", 1, 0)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", nothing), 1, F.greatest("h", F.lit(1)))).otherwise(nothing)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(nothing)
    return own.select("conv_id", F.concat(head, rest).alias("turns"))


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry but the first and last, which are smaller than all: the nearest smaller
    ones to its left and right, and the first entry of its value between these."""
    n = len(values)
    left, right, same = np.zeros(n, np.int64), np.full(n, n - 1, np.int64), np.arange(n)
    stack: list[int] = [0]
    said = values.tolist()
    for i in range(1, n):
        v = said[i]
        while said[stack[-1]] > v:
            right[stack.pop()] = i
        top = stack[-1]
        if said[top] == v and top:
            left[i], same[i] = left[top], same[top]
            stack[-1] = i
            right[top] = -i  # is that of the later one
        else:
            left[i] = top
            stack.append(i)
    for i in range(n - 1, 0, -1):
        if right[i] < 0:
            right[i] = right[-right[i]]
    return left, right, same


class _Least:
    """Least value of any stretch, from the minima of stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step, top = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(top[: len(top) - step], top[step:]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.levels[k]
            out[at] = np.minimum(row[start[at]], row[end[at] - (1 << int(k))])
        return out


def shared_turns(n: np.ndarray, first: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many first turns each of consecutive conversations shares with the one before;
    -1 before the first and behind the last.  keys: (turns, 2) words of 64 bits."""
    out = np.full(len(n) + 1, -1, np.int64)
    most = np.minimum(n[1:], n[:-1])
    ends = np.cumsum(most)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - most, most)
    here, there = np.repeat(first[1:-1], most) + at, np.repeat(first[:-2], most) + at
    unlike = (keys[here] != keys[there]).any(axis=1)
    if len(most):
        stop = np.where(unlike, at, np.iinfo(np.int64).max)
        least = np.minimum.reduceat(np.append(stop, np.iinfo(np.int64).max), ends - most)
        out[1:-1] = np.where(most > 0, np.minimum(least, most), 0)
    return out


def trie_of(ids: np.ndarray, n: np.ndarray, keys: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray | list]:
    """The nodes of the trie of sorted conversations: see the module.

    ``total`` are the characters that all members have at or below a node, ``own`` those of
    the distinct nodes there; ``above`` those of the path that leads to it.
    """
    m = len(ids)
    first = np.concatenate([[0], np.cumsum(n)])
    lcp = shared_turns(n, first, keys)
    left, right, same = nearest_smaller(lcp)
    running = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    whole = running[first[1:]] - running[first[:-1]]
    fresh = running[first[1:]] - running[first[:-1] + np.maximum(lcp[:-1], 0)]  # of the turns that the one before lacks
    add = lambda x: np.concatenate([[0], np.cumsum(x)])
    wholes, freshes, leaves = add(whole), add(fresh), add(lcp[1:] < n)
    least = _Least(ids)

    # Branching nodes: an entry for each interval, and how its equal entries part the children.
    item = np.arange(1, m)
    longer = np.zeros(m + 1, np.int64)
    np.add.at(longer, same[item], n[item] > lcp[item])
    alike = np.zeros(m + 1, np.int64)
    np.add.at(alike, same[item], n[item] == lcp[item])
    top = item[same[item] == item]
    start, stop, depth = left[top], right[top], lcp[top]
    branches = longer[top] + (n[start] > depth)
    ended = np.where(n[start] == depth, 1 + alike[top], 0)
    # Below the last shared turn, each conversation is a chain by itself.
    alone = np.flatnonzero(n > np.maximum(lcp[:-1], lcp[1:]))
    start, stop, depth = np.concatenate([start, alone]), np.concatenate([stop, alone + 1]), np.concatenate([depth, n[alone]])
    branches, ended = np.concatenate([branches, np.zeros(len(alone), np.int64)]), np.concatenate([ended, np.ones(len(alone), np.int64)])
    above = np.maximum(lcp[start], lcp[stop])
    entry = np.where(lcp[start] >= lcp[stop], start, stop)  # whose interval is the parent's
    root = above < 0
    up, down = np.where(root, 0, left[entry]), np.where(root, m, right[entry])
    members, own_least, up_least = stop - start, least(start, stop), least(up, down)
    digests, said = [], [str(x) for x in ids.tolist()]
    for a, k in zip(start.tolist(), ended.tolist(), strict=True):
        digests.append(hashlib.sha256(",".join(said[a : a + k]).encode()).hexdigest() if k else EMPTY)

    # Missing depths.
    many = depth - above
    chain = np.repeat(np.arange(len(start)), many)
    d = np.arange(len(chain)) - np.repeat(np.cumsum(many) - many, many) + above[chain] + 1
    s, e = start[chain], stop[chain]
    bottom, begins = d == depth[chain], d == above[chain] + 1
    before = running[first[s] + np.maximum(d - 1, 0)] - running[first[s]]
    up_s, up_e = np.where(begins, up[chain], s), np.where(begins, down[chain], e)
    return {
        "depth": d, "n_convs": members[chain], "conv_id": own_least[chain], "parent": np.where(begins, up_least[chain], own_least[chain]), "n_children": np.where(bottom, branches[chain], 1),
        "n_leaves": leaves[e] - leaves[s], "total": wholes[e] - wholes[s] - (e - s) * before, "own": whole[s] - before + freshes[e] - freshes[s + 1], "above": before,
        "ends": np.where(bottom, np.array(digests, dtype=object)[chain], EMPTY), "first": s == 0, "last": e == m, "parent_first": (up_s == 0) & (d > 0), "parent_last": (up_e == m) & (d > 0),
        "texts": [(int(depth[c]), bool(start[c] == 0), ",".join(said[start[c] : start[c] + ended[c]])) for c in np.flatnonzero((ended > 0) & ((start == 0) | (stop == m)))],
    }


def _block_rows(batches):
    """The nodes of one block, its ends that may go on in others, and what its borders need."""
    from pyspark import TaskContext

    schema = pa.schema([("kind", pa.string()), ("block", pa.int32()), *[(f.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]) for f in _NODE.split(", ")], ("head", pa.binary()), ("head_chars", pa.list_(pa.int32())), ("tail", pa.binary()), ("least", pa.int64())])
    block = TaskContext.get().partitionId()
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    seq, chars = table.column("seq").combine_chunks(), table.column("chars").combine_chunks()
    n = np.array([len(x) // KEY for x in seq.to_pylist()], dtype=np.int64)
    keys = np.frombuffer(b"".join(seq.to_pylist()), dtype=np.uint64).reshape(-1, 2)
    nodes = trie_of(table.column("conv_id").to_numpy(), n, keys, chars.flatten().to_numpy().astype(np.int64))
    texts, lcp = nodes.pop("texts"), shared_turns(n, np.concatenate([[0], np.cumsum(n)]), keys)

    def rows(kind: str, size: int, **columns) -> pa.RecordBatch:
        given = {"kind": pa.array([kind] * size), "block": pa.array([block] * size, pa.int32()), **columns}
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)

    for at in range(0, len(nodes["depth"]), 1 << 16):
        part = {k: pa.array(v[at : at + (1 << 16)]) for k, v in nodes.items()}
        yield rows("node", len(part["depth"]), **part)
    if texts:
        yield rows("ends", len(texts), depth=pa.array([d for d, _, _ in texts]), first=pa.array([f for _, f, _ in texts]), ends=pa.array([t for _, _, t in texts]))
    inner = lcp[1:-1].min() if len(n) > 1 else np.iinfo(np.int32).max
    yield rows("block", 1, n_convs=pa.array([len(n)]), head=seq[:1], head_chars=chars[:1], tail=seq[len(seq) - 1 :], least=pa.array([int(inner)]))


@dataclass
class Borders:
    """Five numbers for each block, in order: its partition; the LCP at the border before it
    and behind it; the least LCP within it or at the border before it; turns of its last
    conversation; and characters of the turns shared over the border before it."""

    block: np.ndarray
    before: np.ndarray
    behind: np.ndarray
    least: np.ndarray
    turns: np.ndarray
    chars: np.ndarray

    def start(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last block before ``at`` whose least LCP is below ``depth``: where a node of
        that depth begins which lies on both sides of the border before ``at``."""
        levels = [self.least]
        while len(levels[-1]) > 1 << (len(levels) - 1):
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][: len(levels[-1]) - step], levels[-1][step:]))
        here = at - 1
        for k in range(len(levels) - 1, -1, -1):  # leap over stretches of 2^k blocks without a smaller one
            low = here - (1 << k) + 1
            leap = (low >= 0) & (levels[k][np.clip(low, 0, len(levels[k]) - 1)] >= depth)
            here = np.where(leap, here - (1 << k), here)
        return here


def _borders(blocks: DataFrame) -> Borders:
    """From the first and last conversation of each block; only numbers come to the driver."""

    def work(batches):
        for batch in batches:
            d = batch.to_pydict()
            out = []
            for block, head, chars, tail, least, prev in zip(d["block"], d["head"], d["head_chars"], d["tail"], d["least"], d["prev"], strict=True):
                x = -1
                if prev is not None:
                    k = min(len(head), len(prev)) // KEY
                    a, b = (np.frombuffer(y, np.uint64)[: 2 * k].reshape(-1, 2) for y in (head, prev))
                    unlike = np.flatnonzero((a != b).any(axis=1))
                    x = int(unlike[0]) if len(unlike) else k
                out.append((block, x, min(least, x), len(tail) // KEY, sum(chars[: max(x, 0)])))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["block", "x", "least", "turns", "chars"]).astype(np.int64), preserve_index=False)

    # One row for each block: the only group here, and its size is the number of partitions.
    ranked = blocks.selectExpr("block", "head", "head_chars", "tail", "least", "lag(tail) OVER (ORDER BY block) AS prev")
    found = ranked.mapInArrow(work, "block long, x long, least long, turns long, chars long").toPandas().sort_values("block")
    x = found["x"].to_numpy()
    return Borders(found["block"].to_numpy(), x, np.append(x[1:], -1), found["least"].to_numpy(), found["turns"].to_numpy(), found["chars"].to_numpy())


def _placed(borders: Borders):
    """A task that tells of each node whether it reaches over a border, and if so by which
    block and depth it is known everywhere; what lies over a border is counted once."""

    def work(batches):
        for batch in batches:
            x = batch.to_pandas()
            at = np.searchsorted(borders.block, x["block"].to_numpy())
            d, before, behind = x["depth"].to_numpy(), borders.before[at], borders.behind[at]
            first, last = x["first"].to_numpy(bool), x["last"].to_numpy(bool)
            over, on = first & (d <= before), last & (d <= behind)
            x["begin"] = np.where(over, borders.start(at, d), np.where(on, at, -1))
            over_up, on_up = x["parent_first"].to_numpy(bool) & (d - 1 <= before), x["parent_last"].to_numpy(bool) & (d - 1 <= behind)
            x["parent_begin"] = np.where(over_up, borders.start(at, d - 1), np.where(on_up, at, -1))
            x["n_children"] -= first & (d < before)
            x["n_leaves"] -= last & (behind >= borders.turns[at])
            # Nodes on the path that the border before shares are the block before's as well.
            x["own"] -= np.where(over, borders.chars[at] - x["above"].to_numpy(), 0)
            yield pa.RecordBatch.from_pandas(x[["block", "first", "begin", "parent_begin", "depth", "n_convs", "conv_id", "parent", "n_children", "n_leaves", "total", "own", "ends"]], preserve_index=False)

    return work


def _digests(batches):
    """SHA-256 of the ids of each node, whose parts come one after the other."""
    node, digest = None, None
    for batch in batches:
        out = []
        for begin, depth, text in zip(*(batch.column(c).to_pylist() for c in ("begin", "depth", "ends")), strict=True):
            if node == (begin, depth):
                digest.update(b"," + text.encode())
                continue
            if node:
                out.append((*node, digest.hexdigest()))
            node, digest = (begin, depth), hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["begin", "depth", "digest"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([digest.hexdigest()])], ["begin", "depth", "digest"])


def prefix_trie(convs: DataFrame, *, block_convs: int = 1 << 15, block_turns: int = 1 << 18) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv_id, turns of key and chars).

    conv_id, the smallest member; depth; parent_conv_id (root: null); n_convs; n_children;
    n_leaves; saved_tokens; ends_sha256.  Conversations without turns are members of the
    root alone.  Without any conversation there is no root, and no row.  Copies of a
    conversation lie side by side in the order and may fill any number of blocks.
    ``block_convs`` and ``block_turns`` are about what a task holds at a time; a longer
    conversation is a block by itself.
    """
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t.key), "")).alias("seq")
    rows = materialize(convs.select("conv_id", seq, F.transform("turns", lambda t: t.chars).alias("chars")))
    n, turns = rows.agg(F.count("*"), F.sum(F.length("seq") / KEY)).first()
    blocks = max(1, -(-n // block_convs), int(-(-(turns or 0) // block_turns)))
    dealt = rows.repartitionByRange(blocks, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    local = materialize(dealt.mapInArrow(_block_rows, _BLOCK))
    borders = _borders(local.where("kind = 'block'"))

    nodes = local.where("kind = 'node'").drop("kind", "head", "head_chars", "tail", "least")
    names = "block int, first boolean, begin long, parent_begin long, depth long, n_convs long, conv_id long, parent long, n_children long, n_leaves long, total long, own long, ends string"
    placed = nodes.mapInArrow(_placed(borders), names)
    saved = (F.col("total") - F.col("own")).alias("saved_tokens")
    closed = placed.where("begin < 0").select("conv_id", "depth", "parent", "parent_begin", "n_convs", "n_children", "n_leaves", saved, F.col("ends").alias("ends_sha256"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "total", "own")]
    open_ = materialize(placed.where("begin >= 0").groupBy("begin", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_begin").alias("parent_begin"), *sums))
    where = local.where("kind = 'ends'").select("block", "depth", "first", "ends").join(placed.where("begin >= 0").select("block", "depth", "first", "begin"), ["block", "depth", "first"])
    digests = where.repartition("begin", "depth").sortWithinPartitions("begin", "depth", "block").select("begin", "depth", "ends").mapInArrow(_digests, "begin long, depth long, digest string")
    merged = open_.join(digests, ["begin", "depth"], "left").select("conv_id", "depth", F.lit(None).cast("long").alias("parent"), "parent_begin", "n_convs", "n_children", "n_leaves", saved, F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"))
    parents = open_.select(F.col("begin").alias("parent_begin"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"))
    parent = F.when(F.col("depth") > 0, F.coalesce("up", "parent")).alias("parent_conv_id")
    every = closed.unionByName(merged).join(parents, ["parent_begin", "depth"], "left")
    return every.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(conversations_of(read_table(spark, sf_dir, "conversations"))))


#: CRC-32 by its definition, a byte of the decimal id at a time; the trie by grouping all first turns.
OP13_SQL = """
WITH RECURSIVE t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, rest, r) AS (
    SELECT DISTINCT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM t
    UNION ALL
    SELECT conv_id, rest[2:], list_reduce([xor(r, ord(rest[1])::BIGINT), 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
    FROM crc WHERE rest <> ''
), h AS (
    SELECT conv_id, xor(r, 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base FROM crc WHERE rest = ''
), turns AS (
    SELECT h.conv_id, t.pos AS pos, role, text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
    UNION ALL
    SELECT h.conv_id, 1000000 + t.pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h
), placed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text FROM turns
), paths AS (
    SELECT conv_id, depth, text, list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
    UNION ALL SELECT conv_id, 0, '', [] FROM h
), nodes AS (
    SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS own FROM paths GROUP BY depth, path
), ended AS (
    SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, path, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) AS k FROM paths) WHERE k = 1 GROUP BY path
), children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), subtrees AS (
    SELECT n.path[1:k] AS path, sum(own) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
    FROM nodes n LEFT JOIN children c USING (path), range(0, depth + 1) AS g(k) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens,
    sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (path) LEFT JOIN children c USING (path) LEFT JOIN ended e USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
