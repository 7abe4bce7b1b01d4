"""Removal of repeated byte strings by distributed suffix sorting with a difference cover.

A byte of a document goes when a string of ``WIDTH`` = 50 bytes that covers it
also starts in a document with a smaller doc_id.

1. Each 50-byte window is given a key that depends on its bytes alone: the
   smallest hash of the ``GRAM``-byte strings in it.  Equal windows have equal
   keys, so a window whose key occurs in one document only repeats nothing
   earlier and needs no sorting.  Runs of windows with one key form a segment.
   A run of more than ``PIECE`` windows is cut into several segments.
2. Segments whose key occurs in several documents are dealt by key, so that all
   occurrences of a window meet in one task, whatever the corpus.
3. Rows come sorted by key and text, and equal texts are found by comparing the
   bytes of neighbours.  A key with a single segment text repeats it whole: there
   is nothing left to sort.  Of all others, each task sorts the suffixes of the
   distinct texts by the difference-cover method
   (positions not divisible by three: sort triples, name them, recurse on the
   names until they are distinct or span the width; order the rest by one symbol
   and a name; merge), then compares the prefixes of adjacent suffixes.  A class
   of equal prefixes passes on its smallest doc_id.
4. A key with more than ``HOT`` windows is not sorted in one task: its windows
   are dealt one by one by a 128-bit hash and aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise

WIDTH, GRAM = 50, 20
#: Windows of one key that are sorted in one task, at most, and those of one segment.
HOT, PIECE = 1_000_000, 4000
#: Bytes of segments that a task takes in at once (whole keys), and bytes of distinct texts that are sorted at once.
INTAKE, CHUNK = 8_000_000, 1_500_000
#: Keys (8 bytes each) that are broadcast, at most; beyond it each document is sent its own keys by shuffle.
FEW_KEYS = 8_000_000
#: Bytes of removed runs that are broadcast, at most; beyond it they are joined by shuffle.
FEW_BYTES = 32_000_000

_B = 0xD1342543DE82EF95
_M64 = 0xFFFFFFFFFFFFFFFF


def gram_hashes(b: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all ``k``-byte strings of ``b``, by doubling."""
    parts, n = [(b.astype(np.uint64) + np.uint64(1 + salt)) * np.uint64(0x9E3779B97F4A7C15)], 1
    while 2 * n <= k:
        h = parts[-1]
        parts.append(h[:-n] * np.uint64(pow(_B + 2 * salt, n, 1 << 64)) + h[n:])
        n *= 2
    out, at, total = None, 0, len(b) - k + 1
    for j in range(len(parts) - 1, -1, -1):
        if k >> j & 1:
            x = parts[j][at : at + total]
            out = x.copy() if out is None else out * np.uint64(pow(_B + 2 * salt, 1 << j, 1 << 64)) + x
            at += 1 << j
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def window_keys(b: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """The key of each window of ``width`` bytes; none for shorter texts."""
    if len(b) < width:
        return np.empty(0, np.uint64)
    m, n, w = gram_hashes(b, gram), 1, width - gram + 1
    total = len(m) - w + 1
    while 2 * n <= w:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[:total], m[w - n : w - n + total])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(keys))


def suffix_order(s: np.ndarray, span: int) -> np.ndarray:
    """Ranks of all suffixes of ``s`` (symbols from 1), in any order where ``span`` symbols agree."""
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda k: s[k:].tolist())
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        return rank
    top = int(s.max()) + 1
    pad = np.append(s, np.zeros(3, s.dtype)).astype(np.uint64)
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    if top < 1 << 21:
        packed = (pad[sample] * np.uint64(top) + pad[sample + 1]) * np.uint64(top) + pad[sample + 2]
        order = np.argsort(packed)
        p = packed[order]
        new = np.append(True, p[1:] != p[:-1])
    else:
        t = (pad[sample + 2], pad[sample + 1], pad[sample])
        order = np.lexsort(t)
        new = np.append(True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in t]))
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    at = sample[order]
    if int(new.sum()) < len(sample) and span > 3:
        names = suffix_order(names, -(-span // 3)) + 1
        at = sample[np.argsort(names)]
    at = at[at < n]  # the sample may hold the end
    rank = np.zeros(n + 4, np.uint64)  # of sample positions, from 1; 0 beyond the end
    rank[sample] = names
    # the rest: one symbol, then the rank of the position after it
    rest = np.arange(0, n, 3)
    big = np.uint64(int(names.max()) + 2)
    r0 = pad[rest] * big + rank[rest + 1]
    own = np.argsort(r0)
    rest, r0 = rest[own], r0[own]
    # merge: against positions 1 mod 3 by one symbol, against 2 mod 3 by two
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    k1 = pad[one] * big + rank[one + 1]
    o1 = np.argsort(k1)
    pair = pad * np.uint64(top) + np.append(pad[1:], np.uint64(0))
    dense = pair[:n]
    if top * top * int(big) >= 1 << 63:  # two symbols as one, so that they pack with a rank
        dense = np.unique(dense, return_inverse=True)[1].astype(np.uint64)
    k2 = dense[two] * big + rank[two + 2]
    o2 = np.argsort(k2)
    below1 = np.searchsorted(k1[o1], r0)
    below2 = np.searchsorted(k2[o2], dense[rest] * big + rank[rest + 2])
    out = np.empty(n, np.int64)
    out[rest] = np.arange(len(rest)) + below1 + below2
    # a sample suffix stands after the rest suffixes that are not below it
    is_one = at % 3 == 1
    before = np.empty(len(at), np.int64)
    pos1, pos2 = np.empty(n, np.int64), np.empty(n, np.int64)
    pos1[one[o1]] = np.searchsorted(below1, np.arange(len(one)), side="right")
    pos2[two[o2]] = np.searchsorted(below2, np.arange(len(two)), side="right")
    before[is_one], before[~is_one] = pos1[at[is_one]], pos2[at[~is_one]]
    out[at] = np.arange(len(at)) + before
    return out


def repeats(segments: list[bytes], first: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each window of each of the distinct ``segments``, the smallest of ``first`` over the segments that hold it."""
    sizes = np.array([len(x) for x in segments])
    s = np.frombuffer(b"\0".join(segments) + b"\0" * width, np.uint8)
    starts = np.append(0, np.cumsum(sizes + 1)[:-1])
    symbols = s.astype(np.int64) + 2
    ends = starts + sizes
    symbols[ends] = 1
    order = np.argsort(suffix_order(symbols[: ends[-1] + 1], width))
    n_windows = sizes - width + 1
    owner = np.repeat(np.arange(len(segments)), n_windows)
    at = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(n_windows)[:-1]), n_windows) + starts[owner]
    window = np.full(len(s), -1, np.int64)
    window[at] = np.arange(len(at))
    seq = window[order]
    seq = seq[seq >= 0]
    # adjacent prefixes: their hashes, and where those agree the bytes themselves
    h = gram_hashes(s, width)[at[seq]]
    same = h[1:] == h[:-1]
    k = np.flatnonzero(same)
    view = np.lib.stride_tricks.sliding_window_view(s, width)
    for c in range(0, len(k), 100_000):
        part = k[c : c + 100_000]
        same[part] = (view[at[seq[part]]] == view[at[seq[part + 1]]]).all(axis=1)
    begin = np.flatnonzero(np.append(True, ~same))
    low = np.minimum.reduceat(first[owner[seq]], begin)
    out = np.empty(len(at), np.int64)
    out[seq] = np.repeat(low, np.diff(np.append(begin, len(seq))))
    return np.split(out, np.cumsum(n_windows)[:-1])


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))


def _keys(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, n)``: each document's keys, once, with the number of their windows."""

    def run(batches):
        for batch in batches:
            ks, ds, ns = [], [], []
            for d, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = window_keys(np.frombuffer(b.as_buffer(), np.uint8))
                if len(keys):
                    begin, end = _runs(keys)
                    u, at = np.unique(keys[begin], return_inverse=True)
                    ks.append(u)
                    ns.append(np.bincount(at, end - begin).astype(np.int64))
                    ds.append(np.full(len(u), d, np.int64))
                if sum(map(len, ks)) > 500_000:
                    yield _batch(ks, ds, ns)
                    ks, ds, ns = [], [], []
            if ks:
                yield _batch(ks, ds, ns)

    def _batch(ks, ds, ns):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ns))], names=["key", "doc_id", "n"])

    return _text(docs).where("doc_id IS NOT NULL AND length(b) >= 50").transform(map_batches, run, "key long, doc_id long, n long")


_SEG = "key long, doc_id long, tag long, start long, seg binary"


def _segments(src: DataFrame, shared) -> DataFrame:
    """Segments of ``src(doc_id, b[, keys])`` whose key is among the shared sorted keys, or else the row's own."""

    def run(batches):
        wanted = shared.value if shared is not None else None
        for batch in batches:
            rows = [[], [], [], []]
            segs, held = [], 0
            for k, d in enumerate(batch.column(0).to_pylist()):
                buf = batch.column(1)[k].as_buffer()
                b = np.frombuffer(buf, np.uint8)
                keys = window_keys(b)
                own = wanted if wanted is not None else np.sort(np.array(batch.column(2)[k].as_py(), np.int64))
                if not len(keys) or not len(own):
                    continue
                s, e = _runs(keys)
                key = keys[s].view(np.int64)
                hit = own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key
                s, e, key = s[hit], e[hit], key[hit]
                if not len(s):
                    continue
                if int((e - s).max()) > PIECE:
                    many = -(-(e - s) // PIECE)
                    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    s, e, key = np.repeat(s, many) + nth * PIECE, np.repeat(e, many), np.repeat(key, many)
                    e = np.minimum(e, s + PIECE)
                raw, tag = bytes(buf), crc32(buf)
                segs += [raw[i : j + WIDTH - 1] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
                for out, x in zip(rows, (key, np.full(len(s), d, np.int64), np.full(len(s), tag, np.int64), s.astype(np.int64)), strict=True):
                    out.append(x)
                held += len(s)
                if held > 100_000:
                    yield _out(rows, segs)
                    rows, segs, held = [[], [], [], []], [], 0
            if held:
                yield _out(rows, segs)

    def _out(rows, segs):
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in rows), pa.array(segs, pa.binary())], names=["key", "doc_id", "tag", "start", "seg"])

    return src.transform(map_batches, run, _SEG)


_CUT = "doc_id long, tag long, s long, e long"


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _cuts_of(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Removed runs ``(doc_id, tag, start, end)`` of whole keys' segments, sorted by key and text."""
    key, doc, tag, start = (rows.column(k).to_numpy() for k in range(4))
    seg = rows.column(4).combine_chunks()
    size = pc.binary_length(seg).to_numpy().astype(np.int64)
    new_key = np.append(True, key[1:] != key[:-1])
    new_text = new_key.copy()
    new_text[1:] |= pc.not_equal(seg.slice(1), seg.slice(0, len(seg) - 1)).to_numpy(zero_copy_only=False)
    first_row = np.flatnonzero(new_text)
    low = np.minimum.reduceat(doc, first_row)  # by text: its smallest doc_id
    text = np.cumsum(new_text) - 1
    of_key = np.cumsum(new_key[first_row]) - 1
    alone = np.bincount(of_key)[of_key] == 1  # one string wherever the key occurs: nothing to sort
    gone = alone[text] & (doc > low[text])
    yield doc[gone], tag[gone], start[gone], start[gone] + size[gone]

    texts = np.flatnonzero(~alone)
    if not len(texts):
        return
    # chunks of whole keys, for windows of different keys differ
    ends = np.cumsum(size[first_row[texts]])
    last = np.append(of_key[texts][1:] != of_key[texts][:-1], True)
    row_of = np.flatnonzero(~alone[text])
    begin, base = 0, 0
    for k in np.flatnonzero(last).tolist():
        if ends[k] - base < CHUNK and k + 1 < len(texts):
            continue
        own = texts[begin : k + 1]
        lows = repeats(seg.take(pa.array(first_row[own])).to_pylist(), low[own])
        width = np.array([len(x) for x in lows])
        offset = np.cumsum(width) - width
        flat = np.concatenate(lows)
        lo, hi = np.searchsorted(text[row_of], (own[0], own[-1] + 1))
        mine = row_of[lo:hi]
        index = np.searchsorted(own, text[mine])
        step = np.searchsorted(np.cumsum(width[index]), np.arange(1, int(width[index].sum()) // CHUNK + 2) * CHUNK)
        for i, j in zip([0, *(step[:-1] + 1)], [*(step[:-1] + 1), len(mine)], strict=True):
            part, at = mine[i:j], index[i:j]
            if not len(part):
                continue
            inside = _ranges(width[at])
            row = np.repeat(np.arange(len(part)), width[at])
            hit = np.flatnonzero(flat[np.repeat(offset[at], width[at]) + inside] < doc[part][row])
            if len(hit):
                row, pos = row[hit], inside[hit]
                cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (np.diff(pos) > WIDTH)))
                r, s, e = part[row[cut]], pos[cut], pos[np.append(cut[1:] - 1, len(pos) - 1)]
                yield doc[r], tag[r], start[r] + s, start[r] + e + WIDTH
        begin, base = k + 1, int(ends[k])


def _sorted_cuts(segments: DataFrame) -> DataFrame:
    """Removed byte runs from suffix-sorting each task's segments, an intake of whole keys at a time."""

    def run(batches: Iterable[pa.RecordBatch]):
        def out(part: list[pa.RecordBatch]):
            for cuts in _cuts_of(pa.Table.from_batches(part)):
                if len(cuts[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cuts], names=["doc_id", "tag", "s", "e"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            if size > INTAKE:
                change = np.flatnonzero(key != held[-1].column(0)[-1].as_py())  # sorted by key: where the last one ends
                if len(change):
                    k = int(change[0])
                    yield from out([*held, batch.slice(0, k)] if k else held)
                    held, size, batch = [], 0, batch.slice(k)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from out(held)

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(n, "key").sortWithinPartitions("key", "seg").transform(map_batches, run, _CUT)


def _hot_cuts(segments: DataFrame) -> DataFrame:
    """The same for keys with many segments, window by window."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                segs = part.column(4).to_pylist()
                sizes = np.array([len(x) - WIDTH + 1 for x in segs])
                if not len(sizes):
                    continue
                hs = [(gram_hashes(b := np.frombuffer(x, np.uint8), WIDTH), gram_hashes(b, WIDTH, 1)) for x in segs]
                index = pa.array(np.repeat(np.arange(len(segs)), sizes))
                pos = np.repeat(np.asarray(part.column(3)), sizes) + np.concatenate([np.arange(k) for k in sizes])
                h1, h2 = (np.concatenate([h[k] for h in hs]).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), part.column(1).take(index), part.column(2).take(index), pa.array(pos)], names=["h1", "h2", "doc_id", "tag", "s"])

    windows = materialise(segments.transform(map_batches, run, "h1 long, h2 long, doc_id long, tag long, s long"), "suffix-hot")
    low = materialise(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low")), "suffix-hot-low")
    hit = windows.join(low, ["h1", "h2"]).where("low < doc_id")
    return hit.select("doc_id", "tag", "s", (F.col("s") + WIDTH).alias("e"))


def _merge(cuts: DataFrame) -> DataFrame:
    """``(doc_id, tag, runs)``: maximal removed runs of each document, packed as 64-bit starts then ends."""
    grouped = cuts.groupBy("doc_id", "tag").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))  # bounded by one text

    def run(batches):
        for b in batches:
            out = []
            for s, e in zip(b.column(2), b.column(3), strict=True):
                s, e = (np.asarray(x.values) for x in (s, e))
                o = np.argsort(s, kind="stable")
                s, reach = s[o], np.maximum.accumulate(e[o])
                new = np.append(True, s[1:] > reach[:-1])
                out.append(np.concatenate([s[new], reach[np.append(new[1:], True)]]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "tag", "runs"])

    return grouped.select("doc_id", "tag", "s", "e").transform(map_batches, run, "doc_id long, tag long, runs binary")


def removed_runs(docs: DataFrame, hot: int = HOT, few_keys: int = FEW_KEYS) -> DataFrame:
    """``(doc_id, tag, runs)`` of the documents with something to remove; ``tag`` is the CRC-32 of the text."""
    spark = docs.sparkSession
    keys = _keys(docs).groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.sum("n").alias("n"))
    keys = materialise(keys.where("a < z").select("key", "n"), "suffix-keys")
    total, n_hot = keys.agg(F.count("*"), F.coalesce(F.sum((F.col("n") > hot).cast("long")), F.lit(0))).first()
    src = _text(docs).where("doc_id IS NOT NULL")
    shared = None
    if total <= few_keys:
        shared = spark.sparkContext.broadcast(np.sort(keys.select("key").toArrow().column(0).to_numpy()))
    else:
        own = _keys(docs).join(keys.select("key"), "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # bounded by one text
        src = src.join(own, "doc_id")
    segments = _segments(src, shared)
    if not n_hot:
        return _merge(_sorted_cuts(segments))
    hot_keys = F.broadcast(keys.where(F.col("n") > hot).select("key"))  # each stands for more than `hot` rows
    segments = materialise(segments, "suffix-segments")
    cuts = _sorted_cuts(segments.join(hot_keys, "key", "left_anti")).unionByName(_hot_cuts(segments.join(hot_keys, "key", "left_semi")))
    return _merge(cuts)


def dedup(docs: DataFrame, hot: int = HOT, few_keys: int = FEW_KEYS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, starts, ends)`` for every row of ``docs``.

    ``kept`` holds the remaining bytes; ``starts`` and ``ends`` the maximal
    removed runs.  Null texts are empty; texts under 50 bytes lose nothing; rows
    with a null id neither lose bytes nor take any from others; rows that repeat
    an id take none from each other; extra columns are ignored; an empty table
    gives no rows.
    """
    runs = materialise(removed_runs(docs, hot, few_keys), "suffix-runs")
    size = runs.agg(F.coalesce(F.sum(F.length("runs") + 16), F.lit(0))).first()[0]

    def tag(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([crc32(x.as_buffer()) for x in b.column(1)], pa.int64())], names=["doc_id", "b", "tag"])

    rows = _text(docs).transform(map_batches, tag, "doc_id long, b binary, tag long")
    rows = rows.join(F.broadcast(runs) if size <= FEW_BYTES else runs, ["doc_id", "tag"], "left")

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for b, r in zip(batch.column(1), batch.column(2), strict=True):
                text = b.as_py()
                edges = np.frombuffer(r.as_py(), np.int64) if r.is_valid else np.empty(0, np.int64)
                s, e = edges[: len(edges) // 2].tolist(), edges[len(edges) // 2 :].tolist()
                kept = b"".join(text[i:j] for i, j in zip([0, *e], [*s, len(text)], strict=True))
                for c, x in zip(out, (len(text), len(text) - len(kept), len(s), kept, s, e), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "starts", "ends"])

    return rows.select("doc_id", "b", "runs").transform(map_batches, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>")

