"""SimHash near-duplicate detection through a byte-position inverted index.

A 64-bit fingerprint has eight positional bytes.  Fingerprints that differ in at
most ``MAX_BITS`` = 2 bits differ in at most two of them, so they share at least
``MIN_MATCHES`` = 6.  The count filter is applied while the index is probed: a
posting list holds the fingerprints that agree on six given byte positions (28
choices of positions), so only pairs that reach the guaranteed minimum ever meet
and a list holds at most 2**16 distinct fingerprints, whatever the corpus.

Inside a list members differ in the two free bytes only.  Two of them are within
two bits exactly when both are within one bit of a common value, so every member
is posted under itself and its sixteen one-bit neighbours and is linked to the
smallest member met there.  That emits a number of links linear in the members
(never all pairs), each link is verified (shared bytes, then differing bits), and
the links connect exactly what all qualifying pairs would connect.

``keep_one_each`` asks for all documents whose sets of word shingles have a Jaccard
similarity of at least ``SIMILARITY``.  The fingerprints of these sets go through
the same index, and what it finds is verified by the shingles.  Two bits of 64
cannot promise that similarity, so an exact search for the pairs that the index
leaves follows: similar sets differ in at most k shingles (k follows from their
sizes), so of more than k parts that the shingles are dealt to by hash, one at
least is the same in both.  Sets not yet connected meet where they share such a
part and are verified by their shingles too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, discard_since, map_batches, materialise, written
from .decontaminate import window_hashes

MAX_BITS = 2
MIN_MATCHES = 8 - MAX_BITS
#: Words of a shingle and least Jaccard similarity of near copies; MAX_BITS belongs to the fingerprints alone.
SHINGLE = 5
SIMILARITY = 0.8
#: Rounds that link the sets of a part to one of them, at least one and at most; and pairs of sets not yet connected, over the sets posted, up to which
#: no more rounds are run.  Nor are they if one leaves more than half of the pairs: sets that share parts are then mostly no near copies.
LEADERS, FEW_PAIRS = 4, 4
#: Sets of one part that are compared with each other in one task, at most twice as many.
BLOCK = 1024
#: Posts of a set, its smallest, by which a pair that an earlier post has told is known.
FIRST = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint_bytes(text: str | None, n: int = 3, seed: int = 42) -> bytes:
    """The fingerprint as eight big-endian bytes; null counts as empty.

    Words are runs of bytes other than space and \\x09-\\x0D after A-Z have been
    lower-cased; fewer than ``n`` words form one shingle, none give zero.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(words) < n:
        hashes = digest(b" ".join(words), seed)
    else:
        hashes = b"".join([digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))])
    return majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8))


def majority(rows: np.ndarray) -> bytes:
    """The bits that are set in over half of the hashes, given as big-endian bytes."""
    total, ones = len(rows), np.zeros(64, np.int64)
    for at in range(0, total, 65536):  # keeps the unpacked bits of a very long text small
        ones += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > total).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``: one signed 64-bit fingerprint a row of ``docs``."""

    def run(batches):
        for b in batches:
            raw = b"".join(fingerprint_bytes(t.as_py(), n, seed) for t in b.column(1))
            fp = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.transform(map_batches, run, "doc_id long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _shared_bytes(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8))


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``(u, v)`` that connect what distinct fingerprints ``fps(fp)`` within two bits connect."""
    lists = []
    for k, free in enumerate(combinations(range(8), MAX_BITS)):
        held = F.col("fp").bitwiseAND(F.lit(_mask(tuple(p for p in range(8) if p not in free))).cast("long"))
        lists.append(F.struct(F.lit(k).alias("k"), held.alias("held")))
    posted = fps.select("fp", F.explode(F.array(*lists)).alias("p")).select("fp", "p.k", "p.held")
    met = posted.withColumn("n", F.count("*").over(Window.partitionBy("k", "held"))).where("n > 1")
    table = []
    for free in combinations(range(8), MAX_BITS):
        ones = [1 << (8 * p + bit) for p in free for bit in range(8)]
        table.append(F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in (0, *ones)]))
    flips = F.element_at(F.array(*table), F.col("k") + 1)
    probes = met.select("k", "held", "fp", F.explode(flips).alias("flip")).withColumn("at", F.col("fp").bitwiseXOR(F.col("flip")))
    low = probes.withColumn("low", F.min("fp").over(Window.partitionBy("k", "held", "at")))
    pairs = low.where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    checked = pairs.where((_shared_bytes(F.col("u"), F.col("v")) >= MIN_MATCHES) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
    return checked.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that
    differ in at most two bits.  Null, empty and blank texts have fingerprint
    zero and are linked like any other; identical fingerprints are one class;
    repeated doc_ids keep a row each; rows with a null doc_id are given a null
    component unless a row with an id shares it; extra columns are ignored; an
    empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, n, seed), "simhash")
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fp")
    comps = materialise(connected_components(links(fps), "simhash-cc"), "simhash-cc")
    named = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = materialise(named.select("fp", "root", "first_id"), "simhash-root")
    lowest = materialise(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-low")
    table = materialise(named.join(lowest, "root").select("fp", "component_id"), "simhash-class")
    return prints.join(table, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingles(text: str | None, n: int = SHINGLE, cache: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer than ``n`` words form one shingle, none give none."""
    if cache is not None and len(cache) > 100_000:  # less than window_hashes allows itself
        cache.clear()
    return np.unique(window_hashes((text or "").encode().lower().split(), n, cache).view(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def size_levels(similarity: float) -> list[int]:
    """The largest set size of each level; similar sets are on the same or on neighbouring levels."""
    out, low = [], 1
    while low < 1 << 40:
        out.append(int(low / similarity + 1e-9))
        low = out[-1] + 1
    return out


def _parts(level: int, similarity: float, levels: list[int]) -> tuple[int, int]:
    """The most shingles that two similar sets on a level differ in, and the parts that sets are dealt to there."""
    k = int(2 * levels[level] * (1 - similarity) / (1 + similarity) + 1e-9)
    return k, k + 1 + (k * 3 // 20 + 6 if k else 0)  # more than k + 1, for some stay empty


def signatures(hashes: np.ndarray, similarity: float, levels: list[int]) -> tuple[np.ndarray, bytes]:
    """Signed 64-bit hashes of the set's parts, of which similar sets have one in common, and its sketch.

    A set is posted on its own level and on the next.  On a level two similar
    sets differ in at most k shingles, so at least m - k of its m parts agree.
    The k + 1 largest parts are posted (of equal ones those of larger hash): of
    the parts that agree the last in this order has at most k parts after it in
    either set.  Large parts are rarely shared by chance.  The sketch has a bit
    for each value of some low hash bits: whether an odd number of shingles has
    it.  Two sketches differ in no more bits than the sets differ in shingles.
    """
    if not len(hashes):
        return np.empty(0, np.int64), bytes(8)
    out, x = [], _mixed(hashes)
    bits = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    odd = np.bincount((_mixed(x) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    sketch = np.packbits(odd.astype(np.uint8)).tobytes()
    own = bisect_left(levels, len(hashes))
    for level in (own, own + 1):
        k, m = _parts(level, similarity, levels)
        part = (x >> np.uint64(20)) % np.uint64(m)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        at, sums = part[starts], np.add.reduceat(_mixed(x[order]), starts)
        size = np.append(starts[1:], len(part)) - starts
        if len(at) <= k:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
            at, sums, size = np.append(at, empty), np.append(sums, np.zeros(len(empty), np.uint64)), np.append(size, np.zeros(len(empty), np.int64))
        post = _mixed(sums ^ _mixed(at * np.uint64(64) + np.uint64(level + 1)))
        out.append(post[np.lexsort((post, size))[-k - 1 :]])
    return np.concatenate(out).view(np.int64), sketch


def _folded(sketch: bytes, n: int) -> np.ndarray:
    """The sketch for fewer hash bits, as ``n`` bytes in 64-bit words: its halves differ or agree bit by bit."""
    x = np.frombuffer(sketch, np.uint64)
    while 8 * len(x) > n:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _most(size, size2, similarity: float):
    """The most shingles that similar sets of these sizes differ in."""
    return (size + size2) * ((1 - similarity) / (1 + similarity)) + 1e-6


def may_be_similar(size: int, sketch: bytes, size2: int, sketch2: bytes, similarity: float) -> bool:
    """False only for sets that are not similar: their sketches differ in too many bits."""
    n = min(len(sketch), len(sketch2))
    return int(np.bitwise_count(_folded(sketch, n) ^ _folded(sketch2, n)).sum()) <= _most(size, size2, similarity)


def _alike(a: np.ndarray, x: list[bytes], b: np.ndarray, y: list[bytes], similarity: float) -> np.ndarray:
    """``may_be_similar`` of many pairs of sets of sizes ``a`` and ``b`` with sketches ``x`` and ``y``."""
    out = np.zeros(len(a), bool)
    width = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)])
    for n in np.unique(width).tolist():
        at = np.flatnonzero(width == n)
        p, q = (np.stack([_folded(z[k], n) for k in at]) for z in (x, y))
        out[at] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= _most(a[at], b[at], similarity)
    return out


def _plausible(pairs: DataFrame, similarity: float) -> DataFrame:
    """The count filter: of the pairs of sets ``(u, v, a, x, b, y)`` those whose sketches differ in few bits, each once."""

    def run(batches):
        for b in batches:
            x, y = (b.column(k).to_pylist() for k in (3, 5))
            fine = _alike(b.column(2).to_numpy(), x, b.column(4).to_numpy(), y, similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(fine, pa.bool_()))

    sizes = F.least("a", "b") >= F.lit(similarity - 1e-9) * F.greatest("a", "b")
    pairs = pairs.where(sizes).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "a", "x", "b", "y")
    return pairs.transform(map_batches, run, "u long, v long").distinct()


def _by_fingerprint(classes: DataFrame, similarity: float) -> DataFrame:
    """Plausible pairs ``(u, v)`` that the byte-position index finds: sets of one fingerprint, and of linked ones, by a set of each."""
    one = F.struct("key", F.col("size").alias("size"), "sketch")
    lead = materialise(classes.groupBy("fp").agg(F.min(one).alias("one")), "near-fp")
    same = classes.join(lead, "fp").where("key <> one.key").select(F.col("key").alias("u"), "one.key", F.col("size").alias("a"), F.col("sketch").alias("x"), "one.size", "one.sketch")
    ends = [lead.select(F.col("fp").alias(c), F.col("one").alias(f"{c}1")) for c in "uv"]
    near = links(lead.select("fp")).join(ends[0], "u").join(ends[1], "v").select("u1.key", "v1.key", "u1.size", "u1.sketch", "v1.size", "v1.sketch")
    return _plausible(same.toDF("u", "v", "a", "x", "b", "y").unionByName(near.toDF("u", "v", "a", "x", "b", "y")), similarity)


def _led(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """Plausible pairs ``(u, v)`` of each set of a post and the one that comes first there in an order of the round's own."""
    lead = F.min(F.struct(F.xxhash64("key", F.lit(k)), "key", "size", "comp", "sketch")).over(Window.partitionBy("post"))
    pairs = rows.withColumn("lead", lead).where("comp <> lead.comp")
    pairs = pairs.select(F.col("key").alias("u"), F.col("lead.key").alias("v"), F.col("size").alias("a"), F.col("sketch").alias("x"), F.col("lead.size").alias("b"), F.col("lead.sketch").alias("y"))
    return _plausible(pairs, similarity)


def _met(a: list[tuple], b: list[tuple] | None, post: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Plausible pairs ``(u, v)`` among ``a``, or between ``a`` and ``b``, but for those known to share a smaller post.

    A member is ``(key, size, comp, sketch, its FIRST smallest posts)``.
    """
    n = min(len(x[3]) for x in (a if b is None else [*a, *b]))
    other = a if b is None else b
    table = np.stack([_folded(x[3], n) for x in other])
    size, comp = np.array([x[1] for x in other]), np.array([x[2] for x in other])
    step = max(1, 4096 // len(other))
    for at in range(0, len(a), step):
        some = a[at : at + step]
        own = np.stack([_folded(x[3], n) for x in some])
        own_size, own_comp = np.array([x[1] for x in some])[:, None], np.array([x[2] for x in some])[:, None]
        near = np.bitwise_count(own[:, None, :] ^ table[None, :, :]).sum(axis=2, dtype=np.int64) <= _most(size, own_size, similarity)
        near &= (comp != own_comp) & (np.minimum(size, own_size) >= (similarity - 1e-9) * np.maximum(size, own_size))
        if b is None:
            near &= np.arange(len(other)) > at + np.arange(len(some))[:, None]
        for i, j in zip(*(z.tolist() for z in np.nonzero(near)), strict=True):
            if min(set(some[i][4]).intersection(other[j][4]), default=post) >= post:
                yield min(some[i][0], other[j][0]), max(some[i][0], other[j][0])


def _all_plausible(rows: DataFrame, similarity: float) -> DataFrame:
    """Plausible pairs ``(u, v)`` of the sets of each post ``(post, key, size, comp, sketch, first)`` that are not yet connected, each once.

    The sets of a post are dealt to blocks and pairs of blocks to tasks; only the pairs found leave a task.
    """
    by_post = Window.partitionBy("post")
    rows = rows.withColumn("blocks", F.ceil(F.count("*").over(by_post) / BLOCK).cast("int"))
    rows = rows.withColumn("low", F.min("comp").over(by_post)).withColumn("high", F.max("comp").over(by_post)).where("low < high")
    small = rows.where("blocks = 1").select("post", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("b"), "key", "size", "comp", "sketch", "first")
    # few posts have more than one block, and the rows of the others are where they have to be
    large = rows.where("blocks > 1").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("post", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "b", "key", "size", "comp", "sketch", "first")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = large.repartition(n, "post", "i", "j")

    def run(batches):
        def out(at, held):
            post, i, j = at
            a, b = [x[1:] for x in held if x[0] == i], [x[1:] for x in held if x[0] == j]
            pairs = list(_met(a, None if i == j else b, post, similarity)) if a and b else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["u", "v"])

        at, held = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for post, i, j, *rest in zip(*cols, strict=True):
                if (post, i, j) != at:
                    if len(held) > 1:
                        yield from out(at, held)
                    at, held = (post, i, j), []
                held.append(rest)
        if len(held) > 1:
            yield from out(at, held)

    found = [x.sortWithinPartitions("post", "i", "j").transform(map_batches, run, "u long, v long") for x in (small, large)]
    return found[0].unionByName(found[1]).distinct()


def _verified(pairs: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs of sets ``(u, v)`` those of at least ``similarity``."""
    u = hashes.select(F.col("key").alias("u"), F.col("hashes").alias("a"))
    v = hashes.select(F.col("key").alias("v"), F.col("hashes").alias("b"))

    def run(batches):
        for b in batches:
            fine = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(fine, pa.bool_()))

    return pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b").transform(map_batches, run, "u long, v long")


def near_copies(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, component_id)`` for the rows of ``docs`` with an id.

    ``component_id`` is the smallest doc_id reachable over documents whose sets
    of ``n``-word shingles have a Jaccard similarity of at least ``similarity``.
    Null, empty and blank texts are copies of each other; texts of any length are
    read whole; repeated rows are one class; extra columns are ignored; an empty
    table gives no rows.
    """
    levels = size_levels(similarity)
    src = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def post(batches):
        import xxhash

        cache: dict = {}
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                sets = [shingles(t.as_py(), n, cache) for t in part.column(1)]
                keys = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
                signed = [signatures(h, similarity, levels) for h in sets]
                ends = np.cumsum([0, *(len(x) for x, _ in signed)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for x, _ in signed]), pa.int64()))
                fps = np.frombuffer(b"".join(majority(_mixed(h).view(np.uint8).reshape(-1, 8)[:, ::-1]) for h in sets), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys), pa.array([len(h) for h in sets], pa.int64()), pa.array([x for _, x in signed], pa.binary()), pa.array(fps), lists],
                    names=["doc_id", "key", "size", "sketch", "fp", "posts"],
                )

    signed = materialise(src.transform(map_batches, post, "doc_id long, key long, size long, sketch binary, fp long, posts array<long>"), "near-signed")
    sets = materialise(signed.select("doc_id", "key"), "near-sets")
    by_post = Window.partitionBy("post")
    posts = signed.select("key", F.explode("posts").alias("post"))
    posts = posts.withColumn("low", F.min("key").over(by_post)).withColumn("high", F.max("key").over(by_post)).where("low < high")
    shared = materialise(posts.select("key", "post").distinct(), "near-shared")
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("fp").alias("fp"))
    classes = materialise(classes, "near-classes")
    discard(signed)

    def expand(batches):
        import xxhash

        cache: dict = {}
        for b in batches:
            found = [shingles(t.as_py(), n, cache).tobytes() for t in b.column(1)]
            same = [xxhash.xxh3_64_intdigest(h) == k % (1 << 64) for h, k in zip(found, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["key", "hashes"]).filter(pa.array(same, pa.bool_()))

    found = comps = tried = before = None

    def verify(pairs: DataFrame, name: str) -> None:
        """Pairs not yet tried whose sets are similar join ``found``, and ``comps`` are its components."""
        nonlocal found, comps, tried
        likely = materialise(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), name)
        tried = likely if tried is None else tried.unionByName(likely)
        if likely.isEmpty():
            return
        wanted = likely.select(F.explode(F.array("u", "v")).alias("key")).distinct().join(classes.select("key", "first_id"), "key")
        # a repeated doc_id may have other texts, which expand leaves out
        rows = src.join(wanted.select("key", F.col("first_id").alias("doc_id")), "doc_id").select("key", "text")
        hashes = materialise(rows.transform(map_batches, expand, "key long, hashes binary").dropDuplicates(["key"]), "near-hashes")
        linked = materialise(_verified(likely, hashes, similarity), "near-links")
        discard(hashes)
        if not linked.isEmpty():
            found = linked if found is None else found.unionByName(linked)
            comps = materialise(connected_components(found, "near-cc"), "near-cc")

    first = shared.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("post")), 1, FIRST).alias("first"))  # gathers one document's parts
    verify(_by_fingerprint(classes, similarity), "near-simhash")
    for k in range(LEADERS + 1):
        at = classes.select("key", "size", "sketch")
        if comps is None:
            at = at.withColumn("comp", F.col("key"))
        else:
            at = at.join(comps, at.key == comps.node, "left").select("key", "size", "sketch", F.coalesce("component", "key").alias("comp"))
        rows = shared.join(at, "key")
        own = rows.groupBy("post", "comp").count().groupBy("post").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
        posted, cross = own.where("n * n > same").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0.0))).first()
        if not posted:
            break
        last = k == LEADERS or k > 0 and (cross <= FEW_PAIRS * posted or cross > before / 2)
        before = cross
        verify(_all_plausible(rows.join(first, "key"), similarity) if last else _led(rows, k, similarity), "near-likely")
        src.sparkSession._jvm.System.gc()  # the shuffle files of the round may go
        if last:
            break
    if comps is None:
        named = classes.withColumn("root", F.col("key"))
    else:
        named = classes.join(comps, classes.key == comps.node, "left").withColumn("root", F.coalesce("component", "key"))
    named = materialise(named.select("key", "root", "first_id"), "near-root")
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = materialise(named.join(lowest, "root").select("key", "component_id"), "near-class")
    return sets.join(table, "key").select("doc_id", "component_id")


def keep_one_each(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents whose near-duplicate group holds a smaller doc_id.

    Near duplicates are those of ``near_copies``.  Rows that repeat one doc_id
    count as one document and stay or go together; rows with a null doc_id stay.
    """
    mark = written()
    gone = materialise(near_copies(docs, n, similarity).where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    discard_since(docs.sparkSession, mark, gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
