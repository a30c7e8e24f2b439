"""What the corpus operators share: shared scratch tables, row numbers, star-based components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and only on a local master one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="codeloam-"))
    return f"{root.rstrip('/')}/codeloam-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder then stays behind
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    root = scratch_root(spark)
    if root not in _OWN:
        _OWN[root] = root
        atexit.register(_remove, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The lineage ends there, so later steps survive lost executors without repeating df,
    values from row numbering stay fixed, and the optimiser sees true sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let go of what earlier steps left behind. Spark removes shuffle files and broadcasts, on all machines, only once
    the driver's JVM has collected their handles, and that waits until its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch: Spark's own limit, 64 MB, costs each task's JVM and Python several times that.
BATCH, _BATCH_KEY, _BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def mapped(df: DataFrame, run: Callable, shape) -> DataFrame:
    """df.mapInArrow(run, shape) in batches of about BATCH bytes. Where the session still has Spark's limit it gets
    this one; any other is left as it is."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, str(BATCH))

    def task(batches):
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, shape)


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on idle, through stages that need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores behind it, so that no column of df is called that."""
    while name in df.columns:
        name += "_"
    return name


def numbered(df: DataFrame, label: str, key: str) -> DataFrame:
    """df as a table with a unique, fixed number for each row in the column key, which df doesn't have."""
    return materialise(df.withColumn(key, F.monotonically_increasing_id()), label)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in gone, a table of that one column; sent whole only at a proven size."""
    return df.join(F.broadcast(gone) if fits(gone, 16) else gone, key, "left_anti")


#: Bytes that are sent whole to every executor at most; the driver holds them too, several times over.
SENT = 4 << 20


def fits(df: DataFrame, row_bytes: int, limit: int = SENT) -> bool:
    """Whether a materialised table of rows of at most row_bytes is proven to stay under limit."""
    return df.count() * row_bytes <= limit


def empty_if_null(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of edges(a, b): long, as (node, root) with the smallest node as root.

    Alternating large-star and small-star steps; every step is a map-side combined minimum and one
    equi-join, and is written to the shared folder. Nothing is collected but a checksum per round."""

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("p")).select("p.u", "p.v")

    def small_side(m: DataFrame) -> DataFrame:
        """A star's centre may hold a third of all edges, so minima go to the edges while their size is proven small;
        beyond, adaptive joins split such a centre. There are at most two minima an edge."""
        return F.broadcast(m) if seen[0] * 2 * 16 <= SENT else m

    def large(e: DataFrame) -> DataFrame:
        n = both(e)
        m = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return n.where("v > u").join(small_side(m), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        n = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
        m = n.groupBy("u").agg(F.min("v").alias("m"))
        moved = n.join(small_side(m), "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("p"))
        return moved.select("p.a", "p.b").where("a != b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), label)
    seen = mark(edges)
    while seen[0]:
        edges = materialise(small(large(edges)), label)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
