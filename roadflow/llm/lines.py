"""Near-duplicate line removal through a deletion-neighbourhood join.

Lines (split at newlines) of at least ``MIN_CHARS`` characters within one edit
(insertion, deletion or substitution of one character) of an earlier line are
removed, wherever that line stands; the earliest by (doc_id, line number) stays.
Shorter lines always stay.

Equal lines are one class, represented by its earliest occurrence.  Two lines
within one edit, the longer of M characters, agree in their first or in their
last (M - 1) // 2 characters, and cut into ``BLOCKS`` they differ within one block
at most; so only classes that share a half, and of those only classes that share
all but a block, with another class are expanded.
They emit their deletion neighbourhood as hashed keys: the line itself and the
line without its i-th character, with i.  A substitution shows as the same
deletion at the same i, an insertion or deletion as one line's deletion equal to
the other line; nothing else counts.  Each class thus learns its earliest
neighbour by two minima per key, never by listing a key's pairs, and the edit
distance to it is verified on the texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard_since, free_name, map_batches, materialise, written

MIN_CHARS = 20
#: Blocks of a line, of which two lines within one edit share all but one.
BLOCKS = 8
#: Line numbers that are broadcast with their documents' ids, at most; beyond it they are joined by shuffle.
FEW = 2_000_000

_B = 0xD1342543DE82EF95
_INV = pow(_B, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def neighbourhood(line: str, powers: np.ndarray) -> np.ndarray:
    """Signed hashes of the line (first) and of the line without its i-th character, in order."""
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(code)
    term = _mix(code + np.uint64(0x9E3779B97F4A7C15)) * powers[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(term, out=total[1:])
    out = np.empty(n + 1, np.uint64)
    out[0] = total[n]
    out[1:] = total[:n] + (total[n] - total[1:]) * np.uint64(_INV)
    # the length tells apart sums of different spans
    size = np.full(n + 1, n - 1, np.uint64)
    size[0] = n
    return _mix(out ^ _mix(size)).view(np.int64)


def powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for k in range(n):
        out[k] = x
        x = x * _B & 0xFFFFFFFFFFFFFFFF
    return out


def _occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, h1, h2, n, line)``: one row a line long enough, with a 128-bit hash of it."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    rows = rows.withColumn("n", F.char_length("line")).where(F.col("n") >= MIN_CHARS)
    return rows.select("doc_id", "line_no", *_hashes(), "n", "line")


def _hashes():
    return F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")


def _with_lines(docs: DataFrame, table: DataFrame, column: str, how: str) -> DataFrame:
    """``docs`` joined to ``table(doc_id, column)``, a list of line numbers for some of the documents."""
    size = table.agg(F.coalesce(F.sum(F.size(column) + 4), F.lit(0))).first()[0]
    return docs.join(F.broadcast(table) if size <= FEW else table, "doc_id", how)


def _halves(line, n):
    """Hashed halves of a line, for partners that are no longer (M = n) and one longer (M = n + 1)."""
    keys = []
    for m in (n, n + 1):
        half = ((m - 1) / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), m, F.left(line, half)), F.xxhash64(F.lit(1), m, F.right(line, half))]
    return F.array(*keys)


def _all_but_a_block(line, n):
    """For each block and M: a hash of what stands before and after it."""
    keys = []
    for m in (n, n + 1):
        for k in range(BLOCKS):
            a, z = ((m * x / BLOCKS).cast("int") for x in (k, k + 1))
            keys.append(F.xxhash64(F.lit(k), m, F.left(line, a), F.right(line, m - z)))
    return F.array(*keys)


def _shared(classes: DataFrame, keys) -> DataFrame:
    """Rows of ``classes`` that share one of their ``keys`` with another class."""
    own = classes.select("h1", "h2", F.explode(keys).alias("key")).distinct()
    met = own.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return own.join(met, "key").select("h1", "h2").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no)`` of the lines to remove; ``line_no`` counts from 0.

    Null texts are empty; rows with a null doc_id neither lose lines nor take any
    from others; rows that repeat a doc_id lose the same line numbers; extra
    columns are ignored; an empty table gives no rows.
    """
    occ = _occurrences(docs)
    lean = materialise(occ.select("doc_id", "line_no", "h1", "h2", "n", _halves(F.col("line"), F.col("n")).alias("halves")), "lines")
    pos = F.struct("doc_id", "line_no")
    classes = materialise(lean.groupBy("h1", "h2").agg(F.min(pos).alias("first"), F.any_value("halves").alias("halves"), F.count("*").alias("copies")), "line-classes")
    near = materialise(classes.join(materialise(_shared(classes, F.col("halves")), "line-halves"), ["h1", "h2"]).select("h1", "h2", "first"), "line-near")
    verified = _earliest_neighbours(docs, near)
    beaten = materialise(verified.select("h1", "h2"), "line-beaten")
    repeated = classes.where("copies > 1").select("h1", "h2", "first")
    # all lines of a class with an earlier neighbour go; of other classes all but the first
    gone = classes.select("h1", "h2").join(beaten, ["h1", "h2"], "left_semi").withColumn("first", F.lit(None).cast("struct<doc_id:bigint,line_no:int>"))
    gone = gone.unionByName(repeated.join(beaten, ["h1", "h2"], "left_anti"))
    gone = materialise(gone, "line-gone")
    hit = lean.select("doc_id", "line_no", "h1", "h2").join(gone, ["h1", "h2"]).where(F.col("first").isNull() | ~pos.eqNullSafe(F.col("first")))
    return hit.select("doc_id", "line_no").distinct()


def _earliest_neighbours(docs: DataFrame, near: DataFrame) -> DataFrame:
    """``(h1, h2)`` of the classes in ``near`` that have a verified earlier neighbour."""
    # the lines are fetched from their documents by number: the texts aren't shuffled where the numbers are few
    wanted = materialise(near.select("first.doc_id", "first.line_no").distinct(), "line-wanted")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = wanted.count() <= FEW // 4
    if not few:
        src = src.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = src.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, ["doc_id", "line_no"])
    texts = rows.select(*_hashes(), "line").join(near, ["h1", "h2"]).select("h1", "h2", "first.doc_id", "first.line_no", "line").dropDuplicates(["h1", "h2"])
    texts = materialise(texts, "line-texts")
    close = materialise(_shared(texts, _all_but_a_block(F.col("line"), F.char_length("line"))), "line-close")
    texts = materialise(texts.join(close, ["h1", "h2"]).select("h1", "h2", "doc_id", "line_no", "line"), "line-texts")

    def expand(batches):
        table = powers(1024)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                lines = part.column(4).to_pylist()
                longest = max(map(len, lines), default=0)
                if longest > len(table):
                    table = powers(2 * longest)
                hs = [neighbourhood(s, table) for s in lines]
                if not hs:
                    continue
                sizes = np.array([len(h) for h in hs])
                at = np.concatenate([np.arange(-1, k - 1, dtype=np.int32) for k in sizes])
                index = pa.array(np.repeat(np.arange(len(hs)), sizes))
                left = [part.column(k).take(index) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*left, pa.array(np.concatenate(hs)), pa.array(at)], names=["h1", "h2", "doc_id", "line_no", "v", "at"])

    keys = texts.transform(map_batches, expand, "h1 long, h2 long, doc_id long, line_no int, v long, at int")
    first = F.struct("doc_id", "line_no", "h1", "h2")
    by_key = Window.partitionBy("v")
    keys = keys.withColumn("first", first)
    keys = keys.withColumn("same", F.min("first").over(Window.partitionBy("v", "at")))
    keys = keys.withColumn("whole", F.min(F.when(F.col("at") == -1, F.col("first"))).over(by_key))
    keys = keys.withColumn("less", F.min(F.when(F.col("at") >= 0, F.col("first"))).over(by_key))
    met = F.array(F.when(F.col("at") >= 0, F.col("same")), F.when(F.col("at") >= 0, F.col("whole")), F.when(F.col("at") == -1, F.col("less")))
    pairs = keys.select("h1", "h2", "first", F.explode(F.array_compact(met)).alias("other"))
    pairs = pairs.where("other.doc_id < first.doc_id OR (other.doc_id = first.doc_id AND other.line_no < first.line_no)")
    pairs = pairs.groupBy("h1", "h2").agg(F.min("other").alias("other"))
    a = texts.select("h1", "h2", F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("b"))
    both = pairs.select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).join(a, ["h1", "h2"]).join(b, ["o1", "o2"])
    return both.where(F.levenshtein("a", "b", 1) >= 0).select("h1", "h2").distinct()


def line_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)`` for every row of ``docs``; ``removed`` lists line numbers, comma-joined."""
    gone = removed_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("gone"))  # bounded by one document's lines
    gone = materialise(gone, "line-docs")
    size = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    out = docs.select("doc_id", size.alias("n_lines")).join(gone, "doc_id", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.concat_ws(",", F.transform("gone", lambda x: x.cast("string"))), F.lit("")).alias("removed"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut from ``text`` (and ``n_chars`` brought up to date where there is one).

    A document all of whose lines go is a copy of earlier text and goes itself;
    one that was empty from the start stays as it is.  Columns of any name pass
    unchanged; texts of any length are cut in linear time.
    """
    mark = written()
    number, changed = free_name(docs, "lines"), free_name(docs, "cut")
    gone = removed_lines(docs).groupBy("doc_id").agg(F.collect_list("line_no").alias(number))
    gone = materialise(gone, "line-docs")
    discard_since(docs.sparkSession, mark, gone)

    @F.pandas_udf("string")
    def rest(text: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(text, numbers, strict=True):
            if n is None:
                out.append(None)
                continue
            drop = set(n.tolist())
            kept = [x for k, x in enumerate(t.split("\n")) if k not in drop]
            out.append("\n".join(kept) if any(x.strip(" ") for x in kept) else None)
        return pd.Series(out, dtype=object)

    hit = F.col(number).isNotNull()
    out = _with_lines(docs, gone, number, "left").withColumn(changed, rest(F.when(hit, F.col("text")), F.col(number)))
    out = out.where(~hit | F.col(changed).isNotNull()).withColumn("text", F.when(hit, F.col(changed)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
