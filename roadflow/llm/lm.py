"""Stupid-backoff language-model scores against the counts of the whole corpus.

S(w | context) = c(context w) / c(context) where the n-gram was seen, else
``ALPHA`` times the score with a shorter context, down to c(w) / N and, for
unseen words, 1 / N.  Counts are those of all other documents: a document's own
occurrences are taken off, so that none is judged by itself.

The computation is a relational one on packed rows.  Documents are exploded into
n-grams batch by batch; a batch sends each distinct n-gram once, with its count,
to the count table, which is partitioned by hash (so that a very frequent n-gram
is a single entry of a batch and no partition is hot).  Partitions add up the
counts and send the totals back to the batches they came from, where they are
joined to the documents' n-grams and summed per document.  A packed row holds one
batch's sorted hashes of one partition as gaps, 6 to 8 bytes an n-gram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise

ALPHA = 0.4
ORDER = 3
#: Bytes of text in a batch (the last one of a partition may be smaller).
BATCH_BYTES = 10_000_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit hashes of the lower-cased words of a text; remembers words up to a bound."""

    def __init__(self, most: int = 150_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str) -> np.ndarray:
        toks = _WORD.findall(text)
        codes = list(map(self.known.get, toks))
        if None in codes:
            for k, c in enumerate(codes):
                if c is None:
                    if len(self.known) >= self.most:
                        self.known.clear()
                    codes[k] = c = xxhash.xxh64_intdigest(toks[k].lower(), 3)
                    if len(toks[k]) < 40:
                        self.known[toks[k]] = c
        return np.array(codes, np.uint64)


def ngrams(words: list[np.ndarray], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: hashes of all n-grams of a batch, and the flat position of each one's last word; none crosses documents."""
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    place = np.concatenate([np.arange(len(w)) for w in words]) if words else np.empty(0, np.int64)
    out, h, at = [], flat, np.arange(len(flat))
    for n in range(1, order + 1):
        if n > 1:
            at = np.flatnonzero(place >= n - 1)
            h = np.full(len(at), n, np.uint64)
            for k in range(n - 1, -1, -1):
                h = (h ^ flat[at - k]) * _MIX
                h ^= h >> np.uint64(31)
        out.append((h, at))
    return out


def _pack(sorted_hashes: np.ndarray) -> bytes:
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    body = gaps[1:]
    if len(body) and int(body.max()) >> 48 == 0:
        return b"6" + gaps[:1].tobytes() + (body & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (body >> np.uint64(32)).astype("<u2").tobytes()
    return b"8" + gaps.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"8":
        return np.cumsum(np.frombuffer(raw, "<u8", offset=1), dtype=np.uint64)
    n = (len(raw) - 9) // 6
    low = np.frombuffer(raw, "<u4", n, 9).astype(np.uint64)
    high = np.frombuffer(raw, "<u2", n, 9 + 4 * n).astype(np.uint64)
    return np.cumsum(np.append(np.frombuffer(raw, "<u8", 1, 1), low | high << np.uint64(32)), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them."""
    top = int(x.max(initial=0))
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    return kind[-1].encode() + x.astype(kind).tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=1).astype(np.int64)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """``(batch id, doc ids, texts)``: the partition's rows in order, cut by size alone."""
    part, k = 0, 0
    ids, texts, size = [], [], 0
    for b in rows:
        part = b.column(2)[0].as_py() if b.num_rows else part
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(i)
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield part << 32 | k, ids, texts
                ids, texts, size, k = [], [], 0, k + 1
    if ids:
        yield part << 32 | k, ids, texts


def _repeatable(df: DataFrame) -> bool:
    """Whether ``df`` is a plain scan of files: each of its partitions has the same rows in the same order whenever it is read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"^[\s:+|-]*(?:\*\(\d+\)\s*)?(\w+)", plan, re.M)
    return "FileScan" in nodes and set(nodes) <= {"FileScan", "Project", "Filter", "ColumnarToRow"}


_COUNTS = "p int, n int, batch long, hashes binary, counts binary"
_TOTALS = "batch long, n int, p int, totals binary, tokens long"


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """``(doc_id, n_words, log_score, mean_log_score)`` for every row of ``docs``.

    Words are runs of letters, digits and underscores, lower-cased; the score is
    the sum of the logarithms.  Texts of any length are read whole.  Null, empty and wordless texts have 0 words, a
    score of 0 and a null mean; repeated rows are documents of their own; null
    ids keep a row each; extra columns are ignored; an empty table gives no rows.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _repeatable(src):
        src = materialise(src, "lm-docs")  # batches must be the same in both passes
    src = src.withColumn("part", F.spark_partition_id())
    spark = docs.sparkSession
    n_scan = src.rdd.getNumPartitions()
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_scan)
    n_parts = 4 * n_tasks
    edges = np.array([(k << 64) // n_parts for k in range(1, n_parts)], np.uint64)

    def explode(rows):
        words = Words()
        for batch, _, texts in _batches(rows):
            for n, (h, _) in enumerate(ngrams([words(t) for t in texts], order), 1):
                u, c = np.unique(h, return_counts=True)
                cut = [0, *np.searchsorted(u, edges).tolist(), len(u)]
                out = [(p, n, batch, _pack(u[i:j]), _small(c[i:j])) for p, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["p", "n", "batch", "hashes", "counts"])

    def total(rows):
        def flush(held):
            hashes = [_unpack(r[3]) for r in held]
            counts = [_large(r[4]) for r in held]
            u, at = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = np.bincount(at, np.concatenate(counts).astype(np.float64)).astype(np.int64)[at]
            parts = np.split(sums, np.cumsum([len(h) for h in hashes])[:-1])
            tokens = [int(c.sum()) if held[0][1] == 1 else 0 for c in counts]
            cols = ([r[2] for r in held], [r[1] for r in held], [r[0] for r in held], [_small(s) for s in parts], tokens)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["batch", "n", "p", "totals", "tokens"])

        held: list[tuple] = []
        for b in rows:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][:2] != r[:2]:
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    counts = src.transform(map_batches, explode, _COUNTS).repartition(n_tasks, "p").sortWithinPartitions("p", "n")
    totals = materialise(counts.transform(map_batches, total, _TOTALS), "lm-totals")
    corpus = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def label(rows):
        for batch, ids, texts in _batches(rows):
            for at in range(0, len(ids), 2000):
                part = ids[at : at + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.int64()), pa.array(texts[at : at + 2000], pa.string())], names=["batch", "place", "doc_id", "text"])

    null = F.lit(None)
    left = totals.select("batch", "n", "p", "totals", null.cast("long").alias("place"), null.cast("long").alias("doc_id"), null.cast("string").alias("text"))
    right = src.transform(map_batches, label, "batch long, place long, doc_id long, text string")
    right = right.select("batch", F.lit(99).alias("n"), F.lit(0).alias("p"), null.cast("binary").alias("totals"), "place", "doc_id", "text")
    both = left.unionByName(right).repartition(n_tasks, "batch").sortWithinPartitions("batch", "n", "p", "place")

    def sums(rows):
        words = Words()

        def flush(ids, arrays, parts):
            grams = ngrams(arrays, order)
            sizes = np.array([len(a) for a in arrays])
            doc = np.repeat(np.arange(len(arrays)), sizes)
            n = len(doc)
            seen = []  # by order: occurrences in other documents, at each position
            for k, (h, at) in enumerate(grams, 1):
                u, inv = np.unique(h, return_inverse=True)
                known = np.concatenate(parts.get(k, [np.empty(0, np.int64)]))
                if len(known) != len(u):
                    raise RuntimeError("the input changed between the two passes")
                _, own_at, own = np.unique(doc[at] * np.int64(len(u) + 1) + inv, return_inverse=True, return_counts=True)
                c = np.zeros(n, np.int64)
                c[at] = known[inv] - own[own_at]
                seen.append(c)
            rest = np.maximum(1, corpus - sizes)[doc].astype(np.float64)  # words of all other documents
            s = np.maximum(seen[0], 1) / rest if n else np.empty(0)
            if n:
                s[seen[0] == 0] *= alpha
            for k in range(2, order + 1):
                at = grams[k - 1][1]
                # the context is the (k-1)-gram that ends one word earlier
                ok = seen[k - 1][at] > 0
                higher = seen[k - 1][at] / np.maximum(1, seen[k - 2][at - 1])
                s[at] = np.where(ok, higher, alpha * s[at])
            sums = np.bincount(doc, np.log(s), minlength=len(arrays)) if n else np.zeros(len(arrays))
            mean = [float(x / k) if k else None for x, k in zip(sums, sizes, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "log_score", "mean_log_score"])

        cur, ids, arrays, parts = None, [], [], {}
        for b in rows:
            names = b.schema.names
            cols = {x: b.column(names.index(x)) for x in names}
            for k, batch in enumerate(cols["batch"].to_pylist()):
                if batch != cur:
                    if ids:
                        yield flush(ids, arrays, parts)
                    cur, ids, arrays, parts = batch, [], [], {}
                if cols["totals"][k].is_valid:
                    parts.setdefault(cols["n"][k].as_py(), []).append(_large(cols["totals"][k].as_py()))
                else:
                    ids.append(cols["doc_id"][k].as_py())
                    arrays.append(words(cols["text"][k].as_py()))
        if ids:
            yield flush(ids, arrays, parts)

    return both.transform(map_batches, sums, "doc_id long, n_words long, log_score double, mean_log_score double")
