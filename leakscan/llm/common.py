"""Shared plumbing: table reads, written intermediates in the shared folder, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"\x20\x09-\x0D"


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its task, and what it once took counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function for mapInArrow that gives its memory back at the end of a partition."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapped


def lean_group(run):
    """The same for applyInArrow, after each group."""

    def grouped(keys, group):
        try:
            return run(keys, group)
        finally:
            give_back()

    return grouped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="leakscan-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def save(df: DataFrame, name: str, few: bool = True) -> DataFrame:
    """Cuts lineage: writes to the shared folder and reads back, so a lost executor costs no recomputation.

    few: at most two files for each core, whatever the number of shuffle partitions; else a file for each partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leakscan/{name}-{uuid.uuid4().hex}"
    out = df.coalesce(2 * spark.sparkContext.defaultParallelism) if few else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key of more than this share of a table's rows is hot; there are 1000 of them at most.
HOT = 0.001


def join_hot(x: DataFrame, one: DataFrame, keys: list[str], total: int) -> DataFrame:
    """x joined with one, which has a row for each key and in times how many of x's total rows have it.

    Rows of hot keys are sent to each executor, so that no task gets all rows of one; the others are shuffled at every size.
    """
    values = [c for c in one.columns if c not in (*keys, "times")]
    hot = F.col("times") > F.lit(HOT * total)
    few = F.broadcast(one.where(hot).select(*keys, *values))
    rest = x.join(few.select(*keys), keys, "left_anti").join(one.where(~hot).select(*keys, *values).hint("merge"), keys)
    return x.join(few, keys).unionByName(rest)


def drop_saved(df: DataFrame) -> None:
    """Removes the files of a table that save() made and that no later plan reads."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/leakscan/" in f:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of jobs that are over."""
    gc.collect()
    spark._jvm.System.gc()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges: (node, smallest node it is tied to)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                up[max(p, q)] = min(p, q)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["src", "dst"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node in edges (src, dst): columns node, comp.

    Each partition first contracts its edges to a forest; alternating large-star and small-star
    rounds then join the forests. Minima are taken map-side, nothing is broadcast, and each round is written to the
    shared folder. The merge joins are by node: what is left of a hub's edges after the contraction, one
    for each partition and node at most, streams through one task, in which it isn't gathered.
    """
    edges = save(edges.select("src", "dst").where("src <> dst").mapInArrow(_forest, "src long, dst long"), "forest")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("dst", "src"))
        low = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("low"))
        large = both.join(low.hint("merge"), "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low.hint("merge"), "src")
        small = small.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(low.select("src", "low"))
        small = save(small.where("src <> dst").distinct(), "small")
        drop_saved(edges)
        edges, before, state = small, state, _state(small)
        if state == before:
            break
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("comp"))
    return save(pairs.union(edges.select("dst", "dst")).distinct(), "components")
