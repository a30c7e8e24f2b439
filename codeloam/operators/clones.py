"""Maximal exact-token clone pairs.

matches finds them from files with their tokens; windows() gives all hashed windows of a table of tokens. A window of
tokens is known by a 128-bit hash built by doubling: the hash of 2k tokens is the hash of two hashes of k, read ahead with
lead() over one sort of each file. A run of matches on one diagonal (file, file, distance) starts where the tokens before
differ and ends where the tokens behind differ; an end follows its start on the diagonal, so extents need no search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schema import CLONE_LINES, CLONE_TOKENS
from . import matches

_FILE = ["rev", "language", "path"]
PAIR = ["a_path", "a_start", "a_end", "b_path", "b_start", "b_end", "tokens", "lines"]


def windows(tokens: DataFrame, size: int = CLONE_TOKENS) -> DataFrame:
    """rev, language, path, pos, gram (two longs), pred and next (hashes of the neighbouring tokens)."""
    order = W.partitionBy(*_FILE).orderBy("pos")
    one = tokens.select(*_FILE, "pos", F.xxhash64(F.col("text").cast("binary")).alias("a"), F.xxhash64(F.lit(7).cast("long"), F.col("text").cast("binary")).alias("b"))
    one = one.select("*", F.struct(F.lag("a").over(order).alias("a"), F.lag("b").over(order).alias("b")).alias("pred"))
    one = one.select("*", F.struct(F.lead("a", size).over(order).alias("a"), F.lead("b", size).over(order).alias("b")).alias("next"))
    one = one.select("*", F.lead("pos", size - 1).over(order).alias("last"))
    have = 1
    while have * 2 <= size:
        step = have
        one = one.select(*_FILE, "pos", "pred", "next", "last", F.xxhash64("a", F.lead("a", step).over(order)).alias("a"), F.xxhash64("b", F.lead("b", step).over(order)).alias("b"))
        have *= 2
    if have < size:
        rest = size - have
        one = one.select(*_FILE, "pos", "pred", "next", "last", F.xxhash64("a", F.lead("a", rest).over(order)).alias("a"), F.xxhash64("b", F.lead("b", rest).over(order)).alias("b"))
    return one.where("last is not null").select(*_FILE, "pos", F.col("a").alias("gram_a"), F.col("b").alias("gram_b"), "pred", "next")


def token_files(tokens: DataFrame, source_lines: DataFrame | None = None) -> DataFrame:
    """rev, language, path, tokens, source: a row a file, as the codes that matches reads."""
    codes = F.struct("pos", F.xxhash64(F.col("text").cast("binary")).alias("a"), F.xxhash64(F.lit(7).cast("long"), F.col("text").cast("binary")).alias("b"), "line", "end_line")
    files = tokens.groupBy(*_FILE).agg(F.array_sort(F.collect_list(codes)).alias("tokens"))
    none = F.array().cast("array<int>")
    if source_lines is None:
        return files.withColumn("source", none)
    lines = source_lines.groupBy("rev", "path").agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("source"))
    return files.join(lines, ["rev", "path"], "left").withColumn("source", F.coalesce("source", none))


def extents(tokens: DataFrame, size: int = CLONE_TOKENS) -> DataFrame:
    """rev, a_path, a_pos, b_path, b_pos, tokens of all maximal pairs that don't overlap themselves."""
    return matches.matches(token_files(tokens), "codes", size).select("rev", "a_path", "a_pos", "b_path", "b_pos", "tokens")


def clone_pairs(tokens: DataFrame, source_lines: DataFrame, size: int = CLONE_TOKENS, least_lines: int = CLONE_LINES) -> DataFrame:
    """rev, id, a_path, a_start, a_end, b_path, b_start, b_end, tokens, lines.

    tokens: rev, language, path, pos (from 0), text, line, end_line. Lines are the distinct source lines
    of the range, of the side that has fewer. Ids don't depend on positions."""
    found = matches.matches(token_files(tokens, source_lines), "codes", size, least_lines)
    row = F.array_sort(F.collect_list(F.struct("pos", "text")))
    said = tokens.groupBy("rev", "path").agg(row.getField("text").alias("said"))
    return matches.with_ids(found, said, "tokens").select("rev", "id", *PAIR)


def text_pairs(files: DataFrame, ids: bool = False, size: int = CLONE_TOKENS, least_lines: int = CLONE_LINES) -> DataFrame:
    """The same of files (rev, language, path, text) whose tokens are the words between blanks; ids only if asked for."""
    found = matches.text_matches(files, size, least_lines)
    if not ids:
        return found.select("rev", *PAIR)
    return matches.with_ids(found, files.select("rev", "path", F.col("text").alias("said")), "texts").select("rev", "id", *PAIR)


def text_ranges(files: DataFrame, size: int = CLONE_TOKENS, least_lines: int = CLONE_LINES) -> DataFrame:
    """ranges() with the same union as those of text_pairs(), without making all pairs."""
    return matches.text_ranges(files, size, least_lines)


def ranges(pairs: DataFrame) -> DataFrame:
    side = lambda s: F.struct(F.col(f"{s}_path").alias("path"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"))
    return pairs.select("rev", F.explode(F.array(side("a"), side("b"))).alias("r")).select("rev", "r.path", "r.start", "r.end")


def union_ranges(found: DataFrame) -> DataFrame:
    """Overlapping ranges of a file as one; ranges that only touch end to start stay apart."""
    order = W.partitionBy("rev", "path").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    longest = found.groupBy("rev", "path", "start").agg(F.max("end").alias("end"))
    marked = longest.withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy("rev", "path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def clone_lines(pairs: DataFrame, source_lines: DataFrame) -> DataFrame:
    """rev, path, bucket, line: source lines inside any clone. Ranges are opened into lines, so the join is on equality."""
    return covered_lines(ranges(pairs), source_lines)


def covered_lines(found: DataFrame, source_lines: DataFrame) -> DataFrame:
    """The same of ranges."""
    inside = union_ranges(found).select("rev", "path", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    return source_lines.join(inside, ["rev", "path", "line"], "left_semi").select("rev", "path", "bucket", "line").distinct()
