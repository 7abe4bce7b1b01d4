"""Shared plumbing: durable intermediate tables, bounded Arrow batches and a
distributed connected-components routine."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that a Python worker is handed, about at most (a row is never cut).
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Edges that connected_components settles in a single task, at most; beyond it rounds of joins do.
FEW_EDGES = 20_000

#: Folders that ``materialise`` has written in this process, in order.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Only a purely local session without that
    setting (tests) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    base = f"file://{tempfile.gettempdir()}/roadflow-shared"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, name: str = "t", by: str | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs no recomputation of
    what came before, and the reread table has exact size statistics.  ``by``
    names a column whose values get a folder each; ``onto`` is a materialised
    table to whose rows these are added.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}" if onto is None else onto._folder
    out = df.write if by is None else df.write.partitionBy(by)
    out.mode("errorifexists" if onto is None else "append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    if onto is None:
        _written.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        if getattr(t, "_folder", None) in _written:
            _delete(t.sparkSession, t._folder)


def written() -> int:
    """A mark for ``discard_since``: how many materialised tables there are."""
    return len(_written)


def discard_since(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Delete what was materialised after ``mark``, but for ``keep``; results that still read from it must have been written."""
    for path in _written[mark:]:
        if keep is None or path != getattr(keep, "_folder", None):
            _delete(spark, path)
    give_back()
    spark._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of what is out of use
    shrink_executors(spark)


def shrink_executors(spark: SparkSession) -> None:
    """A full collection on the executors, a task a core: their heaps shrink, so that the Python workers of the next stage find room beside them."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).agg(F.count("x")).collect()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keep_small() -> None:
    """Large blocks that are freed go to the system at once; by default the allocators keep ever larger ones."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except AttributeError:  # not glibc
        pass


def give_back() -> None:
    """Hand freed memory back to the system: workers are reused by later tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def map_batches(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(f, schema)`` over batches bounded by bytes as well as by rows; a task's end gives its memory back."""
    conf = df.sparkSession.conf
    if int(conf.get(_BYTES).rstrip("b")) > BATCH_BYTES:
        conf.set(_BYTES, str(BATCH_BYTES))

    def run(batches):
        keep_small()
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def _union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of the undirected graph ``edges(u, v)`` (BIGINT).

    Returns ``(node, component)`` for every node that has an edge to another
    node; ``component`` is the smallest node id reachable.  Alternates the
    large-star and small-star rewrites until the edge set stops changing; both
    are min-aggregations plus equi-joins, so no neighbourhood is ever gathered
    into one task, and every round is written to the shared folder.  At most
    ``FEW_EDGES`` edges are settled at once by union-find.  Null ends
    and self-loops are ignored; an empty input gives an empty result.
    """
    edges = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    cur = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    def state(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    if 0 < cur.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return map_batches(cur.repartition(1), _union_find, "node long, component long")
    before = state(cur)
    while before[0]:
        # large star: larger neighbours are rewired to the smallest neighbour
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, old = materialise(large, name), cur
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(old, large)
        after = state(cur)
        if after == before:
            break
        before = after
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
