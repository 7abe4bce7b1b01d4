"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Pieces of one length are interchangeable, so best-fit decreasing is decided on
the histogram of lengths: at most ``capacity`` rows whatever the corpus.  Open
bins are grouped by remaining capacity and a segment tree over the capacities
gives the tightest open one in logarithmic time; all pieces of a length that fit
the same group of bins are placed in one step.  The plan (ranges of piece ranks
against ranges of sequence numbers) is then looked up by every piece through its
rank among the pieces of its length.  The bins are exactly those of
piece-by-piece best-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import map_batches, materialise

#: Groups among which the pieces of one length are ranked side by side.
RANK_GROUPS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """A segment tree over the capacities 0..size that finds the smallest non-empty one at or above a bound."""

    def __init__(self, size: int):
        self.base = 1 << max(1, size + 1).bit_length()
        self.full = bytearray(2 * self.base)

    def set(self, capacity: int, present: bool) -> None:
        at = self.base + capacity
        self.full[at] = present
        while at > 1:
            at //= 2
            self.full[at] = self.full[2 * at] | self.full[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        at = self.base + need
        if self.full[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.full[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.base
            at //= 2
        return None


def plan(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``(length, count)``.

    Returns ``(length, first_rank, n, first_sequence, offset)``: the pieces of
    that length with ranks ``first_rank .. first_rank + n - 1`` go, in order, to
    the sequences from ``first_sequence`` on, each at ``offset``.
    """
    tree, open_bins, out, used = CapacityTree(capacity), {}, [], 0

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            open_bins.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            left = tree.tightest(length)
            todo = count - rank
            if left is None:
                left, first, n = capacity, used, -(-todo // (capacity // length))
                used += n
            else:
                first, n = open_bins[left].pop()
                if not open_bins[left]:
                    del open_bins[left]
                    tree.set(left, False)
            # once opened, a bin stays the tightest while another piece of this length fits
            per = left // length
            whole, rest = min(n, todo // per), 0
            for k in range(per if whole else 0):
                out.append((length, rank, whole, first, capacity - left + k * length))
                rank += whole
            leave(left - per * length, first, whole)
            if whole < n and rank < count:
                rest = count - rank
                for k in range(rest):
                    out.append((length, rank, 1, first + whole, capacity - left + k * length))
                    rank += 1
                leave(left - rest * length, first + whole, 1)
            leave(left, first + whole + (rest > 0), n - whole - (rest > 0))
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: its ids, then ``end_id``; one longer than ``capacity`` is cut so that only its first piece is shorter."""

    def run(batches):
        encode = tokens.encoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, x in zip(out, (doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).transform(map_batches, run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are the single token ``end_id``.  Repeated rows are
    packed each; a null doc_id is kept; extra columns are ignored; an empty
    table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    group = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(RANK_GROUPS)).cast("int")
    # ranks within (length, group) plus the counts of the groups before it: no length is ranked in one task
    counts = materialise(cut.groupBy("length", group.alias("g")).count(), "piece-counts")
    before = counts.select("length", "g", (F.sum("count").over(Window.partitionBy("length").orderBy("g")) - F.col("count")).alias("before"))
    # at most `capacity` rows reach the driver
    steps = plan([(r[0], r[1]) for r in counts.groupBy("length").agg(F.sum("count")).collect()], capacity)
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    for length in {s[0] for s in steps}:
        own = sorted(s[1:] for s in steps if s[0] == length)
        by_length[length] = tuple(np.array(c, np.int64) for c in zip(*own, strict=True))
    shared = cut.sparkSession.sparkContext.broadcast(by_length)
    order = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("g", group).withColumn("r", F.row_number().over(order).cast("long") - 1)
    ranked = ranked.join(before, ["length", "g"]).withColumn("r", F.col("r") + F.col("before"))

    def place(batches):
        table = shared.value
        for b in batches:
            length, rank = (np.asarray(b.column(k)) for k in (3, 5))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, _, bins, offset = table[int(x)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = bins[k] + rank[at] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "r").transform(map_batches, place, PIECES + ", sequence_id long, offset long")
