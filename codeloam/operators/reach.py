"""Reachability over labelled edges: which files are reached only through test code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(seeds: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, bucket of all states reached from seeds(node, bucket) over edges(src, dst, test_only, uncertain, forced).

    An uncertain edge leads to 'source', one for tests to 'tests', any other keeps the bucket; a node that
    is forced is always 'tests'. Breadth first: each round joins the newest states only and drops the
    known ones; keep() writes a round, so lineage stays short. At most one round a state."""
    seen = keep(seeds.select("node", "bucket").distinct(), "reach-0")
    fresh, k = seen, 0
    while not fresh.isEmpty():
        k += 1
        to = F.when(F.col("forced"), "tests").when(F.col("uncertain"), "source").when(F.col("test_only"), "tests").otherwise(F.col("bucket"))
        step = fresh.join(edges, fresh["node"] == edges["src"]).select(F.col("dst").alias("node"), to.alias("bucket")).distinct()
        fresh = keep(step.join(seen, ["node", "bucket"], "left_anti"), f"reach-{k}")
        seen = seen.unionByName(fresh)
    return seen


def file_buckets(nodes: DataFrame, seeds: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, bucket: 'tests' for nodes that are reached as tests and never as source.

    Nodes that no seed reaches (cycles) seed a second pass as source."""
    first = reach(seeds, edges, keep)
    rest = nodes.select("node").distinct().join(first.select("node").distinct(), "node", "left_anti").withColumn("bucket", F.lit("source"))
    states = first.unionByName(reach(rest, edges, keep))
    verdict = states.groupBy("node").agg(F.max(F.when(F.col("bucket") == "source", 1).otherwise(0)).alias("source"))
    return verdict.select("node", F.when(F.col("source") == 1, "source").otherwise("tests").alias("bucket"))
