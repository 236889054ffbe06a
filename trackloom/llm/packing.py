"""Operator 10: best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` (only longer ones are cut).  Pieces
are dealt at random to groups of about ``group_pieces``; each group is packed by itself:
first document sets that provably dominate all alternatives are fixed as sequences, which
shrinks the instance, then the remainder is packed best fit, longest first.
A group's packing is at worst a sequence or so above what its own sizes need.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, read_table

#: How a byte-level tokenizer parts texts before it merges bytes (fixed value).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of white space or of other characters from which the faster library is not asked: it recurses over white space.
LONG_RUN = 4096
_BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """Token ids of texts by a tokenizer file.

    A plain byte-level file, whose merges are in the order of their ids, is run by the
    faster of the two libraries; other files, and texts that hold special tokens or runs of
    ``LONG_RUN`` or more, by the one whose format it is.  Ids are equal.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in said["added_tokens"]]
        self.fast = self._ranked(said)

    @staticmethod
    def _ranked(said: dict):
        model, first = said["model"], said["pre_tokenizer"] or {}
        simple = model["type"] == "BPE" and said["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
        if not simple or odd:
            return None
        import tiktoken

        # Byte-level files write each byte as a printable character.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        special = {t["content"] for t in said["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids) or len(ranks) != len(merged) + 256:
            return None
        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _has_long_run(text: str) -> bool:
        return len(text) >= LONG_RUN and (_BLANKS.search(text) is not None or max(map(len, text.split()), default=0) >= LONG_RUN)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.special) or self._has_long_run(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row_id, doc_id, piece, start, length, ids_crc32) for each piece of each row of
    ``docs``; row_id is any number, one for each row."""
    kind = dict(docs.dtypes)[id_col]

    def work(batches):
        encoder, end = Encoder(tokenizer), np.array([end_id], dtype="<u4")
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([encoder.encode(text), end]) if text else end
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].data))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in (2, 0)), pa.array(pieces, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums))], ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col, F.monotonically_increasing_id()).mapInArrow(work, f"row_id long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Sizes:
    """A multiset of sizes 1 to capacity, with the largest size up to a bound, in words of bits."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.count = np.bincount(sizes, minlength=capacity + 1).tolist()
        self.bits = sum(1 << s for s, n in enumerate(self.count) if n)
        self.n = len(sizes)

    def upto(self, most: int) -> int:
        """The largest size present that is at most ``most``; 0 if none."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.bits & ((1 << (most + 1)) - 1) else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest, as far as there are as many."""
        out, bits = [], self.bits
        while bits and len(out) < k:
            s = (bits & -bits).bit_length() - 1
            out += [s] * min(self.count[s], k - len(out))
            bits &= bits - 1
        return out

    def take(self, size: int) -> None:
        self.count[size] -= 1
        self.n -= 1
        if not self.count[size]:
            self.bits ^= 1 << size

    def put(self, size: int) -> None:
        if not self.count[size]:
            self.bits |= 1 << size
        self.count[size] += 1
        self.n += 1


def reduce_sizes(left: Sizes, capacity: int, most_tries: int | None = 64) -> list[list[int]]:
    """Martello-Toth reduction: sets of sizes that some optimal packing has as bins.

    For the largest item: alone, if nothing fits beside it; with one item that fills the
    bin; with the largest fitting item, if no two others fit beside it; with that item
    also if no three fit and it is at least as long as the best pair.  An item for which
    no rule holds stays and the next smaller size is tried; what was fixed changes what
    fits, so the larger ones are tried again until nothing is fixed any more.  Smaller
    items leave more room, so more sets compete and fewer rules hold: a pass ends after
    ``most_tries`` items without one (None: it tries all).  That bounds the work only; what
    is not fixed is packed by best fit, so no item is lost.
    """
    bins: list[list[int]] = []
    fixed = True
    while fixed and left.n:
        fixed, tries, big = False, 0, left.upto(capacity)
        while big and (most_tries is None or tries < most_tries):
            left.take(big)
            room = capacity - big
            fit = left.upto(room)
            small = left.smallest(3)
            chosen: list[int] | None = None
            if not fit:
                chosen = [big]
            elif fit == room or len(small) < 2 or small[0] + small[1] > room:
                chosen = [big, fit]
            elif (len(small) < 3 or sum(small) > room) and fit >= _best_pair(left, room):
                chosen = [big, fit]
            if chosen is None:
                left.put(big)
                tries += 1
                big = left.upto(big - 1)
                continue
            for s in chosen[1:]:
                left.take(s)
            bins.append(chosen)
            fixed = True
            big = left.upto(big)
    return bins


def _best_pair(left: Sizes, room: int) -> int:
    """The largest sum, at most ``room``, of two items."""
    best, a = 0, left.upto(room)
    while a:
        left.take(a)
        b = left.upto(room - a)
        left.put(a)
        if b and a + b > best:
            best = a + b
        if best == room or 2 * a <= best:
            break
        a = left.upto(a - 1)
    return best


def best_fit(left: Sizes, capacity: int) -> list[list[int]]:
    """Best fit, longest first: each item goes to the fullest bin that holds it.  An empty
    bin is opened only when no bin does, and is then filled greedily to the brim."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    bits = 0
    while left.n:
        size = left.upto(capacity)
        left.take(size)
        open_ = bits >> size
        if open_:
            free = size + ((open_ & -open_).bit_length() - 1)
            at = room[free].pop()
            if not room[free]:
                bits ^= 1 << free
        else:
            free, at = capacity, len(bins)
            bins.append([])
        bins[at].append(size)
        if free > size:
            if not room.get(free - size):
                bits |= 1 << (free - size)
            room.setdefault(free - size, []).append(at)
    return bins


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its place in it."""
    left = Sizes(sizes, capacity)
    bins = reduce_sizes(left, capacity)
    bins += best_fit(left, capacity)
    by_size: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable").tolist():
        by_size.setdefault(int(sizes[i]), []).append(i)
    where, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for b, members in enumerate(bins):
        at = 0
        for s in members:
            i = by_size[s].pop()
            where[i], offset[i] = b, at
            at += s
    return where, offset


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, group_pieces: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row_id, doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per
    piece; row_id tells rows of equal doc_id apart, as copies that a mix makes.

    A null or empty text is one piece, the end id alone; repeated rows are packed each;
    an empty table gives no rows; further columns are not read.  ``tokenizer`` is the path
    of a byte-level tokenizer file that every executor can read.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col).withColumn("uid", F.monotonically_increasing_id()))
    groups = max(1, round(pieces.count() / group_pieces))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        where, offset = pack_sizes(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["pack"].astype("int64") * (1 << 32) + where, offset=offset)[names]

    names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes if c in names) + ", sequence_id long, offset long"
    return dealt.groupBy("pack").applyInPandas(work, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
