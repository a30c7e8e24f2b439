"""Selection of commits over time, and series of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BARS = "▁▂▃▄▅▆▇█"


def month_commits(commits: DataFrame, count: int) -> DataFrame:
    """commits(pos, rev, ts) from the newest in log order: ord, rev, ts, axis_label.

    For each of the last `count` months up to the head's, the first commit in log order (not the latest by
    date) before the next month; a commit keeps its first month. The head is appended if no month chose it
    and is labelled 'head' unless its time is a month's start. Months are UTC."""
    if count <= 0:
        raise ValueError(f"months must be greater than zero, got {count}")
    ends = commits.agg(F.min_by("ts", "pos").alias("head_ts"), F.min_by("rev", "pos").alias("head_rev"), F.min("ts").alias("first_ts"))
    now, first = F.date_trunc("month", "head_ts"), F.date_trunc("month", "first_ts")
    months = F.greatest(F.lit(1), F.round(F.months_between(now, first)).cast("int") + 1)
    back = F.least(F.lit(count), months) - 1
    spread = ends.select("head_ts", "head_rev", F.explode(F.sequence(F.lit(0), back)).alias("k"), back.alias("back"))
    grid = spread.select("head_ts", "head_rev", F.add_months(F.date_trunc("month", "head_ts"), F.col("k") - F.col("back")).cast("timestamp").alias("month"))
    # a commit can serve the months whose end lies after it: those from its own month on
    reach = commits.join(F.broadcast(grid), F.col("ts") < F.add_months("month", 1).cast("timestamp"))
    chosen = reach.groupBy("month").agg(F.min("pos").alias("pos"))
    once = chosen.groupBy("pos").agg(F.min("month").alias("month"))
    picked = commits.join(F.broadcast(once), "pos", "left").join(F.broadcast(ends), F.lit(True))
    is_head = F.col("rev") == F.col("head_rev")
    kept = picked.where(F.col("month").isNotNull() | is_head)
    label = F.when(is_head & (F.col("ts") != F.date_trunc("month", "head_ts")), "head").otherwise(F.coalesce(F.date_format("month", "yyyy-MM"), F.lit("")))
    # at most one row a month
    order = W.orderBy(F.col("month").asc_nulls_last())
    return kept.select(F.row_number().over(order).alias("ord"), "rev", "ts", label.alias("axis_label"))


def merge_commits(merges: DataFrame, count: int) -> DataFrame:
    """The newest `count` merges(pos, rev, ts), oldest first."""
    newest = merges.orderBy("pos").limit(count)
    return newest.select(F.row_number().over(W.orderBy(F.col("pos").desc())).alias("ord"), "rev", "ts")


def trim_leading(points: DataFrame) -> DataFrame:
    """points(ord, bucket, source_lines, ...) without those before any bucket had a source line."""
    first = points.where("source_lines != 0").agg(F.min("ord").alias("first"))
    return points.join(F.broadcast(first), points["ord"] >= F.col("first")).drop("first")


def bar_index(value: Column, low: Column, high: Column) -> Column:
    """0 to 7; the lowest for a flat series."""
    scaled = F.round((value - low) / (high - low) * 7).cast("int")
    return F.when(high == low, F.lit(0)).otherwise(scaled)


def sparklines(points: DataFrame, value: str) -> DataFrame:
    """bucket, sparkline of a value over ord."""
    over = W.partitionBy("bucket")
    barred = points.withColumn("i", bar_index(F.col(value), F.min(value).over(over), F.max(value).over(over)))
    bar = F.substring(F.lit(BARS), F.col("i") + 1, F.lit(1))
    rows = F.array_sort(F.collect_list(F.struct("ord", bar.alias("bar"))))
    return barred.groupBy("bucket").agg(F.array_join(F.transform(rows, lambda r: r["bar"]), "").alias("sparkline"))
