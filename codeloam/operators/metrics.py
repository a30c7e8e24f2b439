"""Totals of functions and lines for each revision and bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import eroded, mass, ratio
from ..schema import BUCKETS


def with_mass(functions: DataFrame) -> DataFrame:
    return functions.withColumn("mass", mass(F.col("cc"), F.col("sloc")))


def ordered_sum(value: Column, *order: Column) -> Column:
    """A sum whose additions happen in one fixed order, so that its last bits never change.

    It gathers the group in one row: for the files of one revision and bucket, not for unbounded keys."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.aggregate(rows, F.lit(0.0), lambda total, row: total + row["v"])


def exact_sum(value: Column) -> Column:
    """A sum that no order of additions can change: exact decimals, combined before the shuffle."""
    return F.sum(value.cast("decimal(28,15)")).cast("double")


def function_totals(functions: DataFrame) -> DataFrame:
    """rev, bucket, functions, mass, mass_over_cc_10: outermost functions only."""
    top = functions.where("depth = 0")
    return top.groupBy("rev", "bucket").agg(
        F.count(F.lit(1)).alias("functions"), exact_sum(F.col("mass")).alias("mass"), exact_sum(eroded(F.col("cc"), F.col("mass"))).alias("mass_over_cc_10")
    )


def line_totals(lines: DataFrame, name: str) -> DataFrame:
    """Distinct lines of each file, summed by revision and bucket."""
    return lines.select("rev", "path", "bucket", "line").distinct().groupBy("rev", "bucket").agg(F.count(F.lit(1)).alias(name))


def totals(revisions: DataFrame, functions: DataFrame, source_lines: DataFrame, clone_lines: DataFrame) -> DataFrame:
    """One row for each revision and bucket, zeros where a bucket is empty."""
    frame = revisions.select("rev").distinct().withColumn("bucket", F.explode(F.array(*(F.lit(b) for b in BUCKETS))))
    keys = ["rev", "bucket"]
    joined = frame.join(function_totals(functions), keys, "left").join(line_totals(source_lines, "source_lines"), keys, "left").join(line_totals(clone_lines, "clone_lines"), keys, "left")
    filled = joined.fillna(0)
    return filled.select(
        "rev", "bucket", "functions", "mass", "mass_over_cc_10", ratio(F.col("mass_over_cc_10"), F.col("mass")).alias("erosion"),
        "source_lines", "clone_lines", ratio(F.col("clone_lines").cast("double"), F.col("source_lines")).alias("clone_share"),
    )
