"""Scans: files to functions, tokens, lines, clones and totals, for any number of revisions in one job."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions.text import mass
from ..operators import clones, metrics, modules
from ..schema import MAX_BYTES
from ..sources import config as C
from ..sources import directory as D
from ..sources import git as G
from ..sources.scratch import keep

#: Part of the cache key: a change of any analyser needs a new one.
VERSION = "3"
#: Dialects whose files may use markup that the analyser can't read.
MARKUP = ("typescript:tsx", "typescript:jsx")

_FN = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("ord", T.IntegerType()), ("parent", T.IntegerType()), ("depth", T.IntegerType()), ("name", T.StringType()), ("bucket", T.StringType()), ("line", T.IntegerType()), ("cc", T.IntegerType()), ("sloc", T.IntegerType()))]))
_TOKEN = T.ArrayType(T.StructType([T.StructField("text", T.BinaryType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]))
_LINE = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("bucket", T.StringType())]))
ANALYSIS = T.StructType([T.StructField("oid", T.StringType()), T.StructField("dialect", T.StringType()), T.StructField("status", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()), T.StructField("git_lines", T.BooleanType()), T.StructField("functions", _FN), T.StructField("tokens", _TOKEN), T.StructField("lines", _LINE), T.StructField("modules", T.StringType()), T.StructField("test_only", T.BooleanType())])

_LEADING = re.compile(rb"(?s)\s*(//[^\n]*\n?|/\*.*?\*/|<!--.*?-->)")
_HASH = re.compile(rb"\s*(#[^\n]*\n?)")
_SHEBANG = re.compile(rb"(#!(?!\[)[^\n]*\n?)")
_GO_LINE = re.compile(rb"(?m)^// Code generated .* DO NOT EDIT\.\r?$")


def is_generated(content: bytes, dialect: str, truncated: bool = False) -> bool:
    """Whether one of the comments in front of any code says so; of a cut file only whole lines count."""
    text = content.removeprefix(b"\xef\xbb\xbf")
    if truncated and dialect == "go":
        text = text[: text.rfind(b"\n") + 1]
    at, leading = 0, []
    while True:
        m = (_SHEBANG.match(text, at) if at == 0 else None) or _LEADING.match(text, at) or (_HASH.match(text, at) if dialect == "python" else None)
        if not m:
            break
        leading.append(m[1])
        at = m.end()
    for c in leading:
        lower = c.lower()
        if b"@generated" in lower or b"linguist-generated" in lower:
            return True
        if dialect == "go" and _GO_LINE.search(c):
            return True
        if dialect != "go" and b"Code generated " in c and b" DO NOT EDIT." in c:
            return True
    return False


def _analyse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from ..parse import go, python_, rust, typescript  # noqa: F401  they register themselves
    from ..parse.common import ANALYSERS, Result, flat, module_json

    for frame in frames:
        rows = []
        for oid, dialect, size, path, content in zip(frame["oid"], frame["dialect"], frame["size"], frame["path"], frame["content"]):
            row = dict.fromkeys(ANALYSIS.names) | {"oid": oid, "dialect": dialect, "status": "ok", "warnings": [], "git_lines": True, "functions": [], "tokens": [], "lines": [], "modules": "[]", "test_only": False}
            if is_generated(content, dialect, size > len(content)):
                row["status"] = "generated"
            elif size > MAX_BYTES:
                row["status"] = "skipped"
            elif (run := ANALYSERS.get(dialect) or ANALYSERS.get(dialect.split(":")[0])) is None:
                row["warnings"] = [f"no analyser for {dialect}"]
            else:
                r = run("", content)
                if r.error and dialect in MARKUP:  # a file that can't be read whole, but needn't be wrong
                    r = Result(warnings=[f"markup that can't be read: {r.error}"])
                row |= {"warnings": [w.removeprefix(": ") for w in r.warnings], "error": r.error and r.error.removeprefix(": "), "git_lines": r.git_line_coordinates, "functions": flat(r.functions), "tokens": [{"text": t.text, "line": t.line, "end_line": t.end_line} for t in r.tokens], "lines": [{"line": a, "bucket": b} for a, b in r.source_lines], "modules": module_json(r.modules), "test_only": r.test_only}
            rows.append(row)
        yield pd.DataFrame(rows, columns=ANALYSIS.names)


@dataclass
class Snapshot:
    """The relations of one or more revisions, each with a column rev."""

    files: DataFrame
    functions: DataFrame
    tokens: DataFrame
    source_lines: DataFrame
    clone_pairs: DataFrame
    clone_lines: DataFrame
    totals: DataFrame
    skipped: DataFrame
    warnings: DataFrame


def _candidates(listing: DataFrame, config: C.Config) -> DataFrame:
    """Paths that are analysed, before any content is read."""
    path = F.col("path")
    kept = listing.where(~paths.excluded(path, config.excludes) & paths.language(path).isNotNull())
    return kept.select("*", paths.language(path).alias("language"), paths.dialect(path).alias("dialect"), paths.bucket(path, config.test_globs).alias("file_bucket"))


def _analysed(listing: DataFrame, read, cache: str | None) -> DataFrame:
    """One analysis for each content and dialect, whatever revisions or paths share it; known ones come from the cache."""
    spark = listing.sparkSession
    once = listing.dropDuplicates(["oid", "dialect"]).select("oid", "dialect", "size", "path")
    known = None
    if cache:
        folder = f"{cache.rstrip('/')}/version={VERSION}"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            known = keep(spark.read.schema(ANALYSIS).parquet(folder).dropDuplicates(["oid", "dialect"]).join(once.select("oid", "dialect"), ["oid", "dialect"], "left_semi").select(*ANALYSIS.names), "cached")
            once = once.join(known.select("oid", "dialect"), ["oid", "dialect"], "left_anti")
    fresh = keep(read(once).mapInPandas(_analyse, ANALYSIS), "analysis")
    if cache:
        fresh.where("size(warnings) = 0 and error is null").write.mode("append").parquet(folder)
    return fresh if known is None else fresh.unionByName(known)


def _module_buckets(files: DataFrame, ok: DataFrame, everything: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """ok with the buckets that Rust files are reached in, and warnings; nothing to do without Rust."""
    rust = ok.where("language = 'rust'").select("rev", "path", F.col("file_bucket").alias("bucket"), "test_only", "modules")
    if rust.isEmpty():
        return ok, None
    known = everything.select("rev", "path")
    packages = known.where(paths.base_name(F.col("path")) == "Cargo.toml").select("rev", F.regexp_replace("path", "/?Cargo\\.toml$", "").alias("path"))
    ignored = known.where("path like '%.rs'").join(rust.select("rev", "path"), ["rev", "path"], "left_anti")
    buckets, warnings = modules.classify(rust, packages, ignored, keep)
    moved = ok.join(buckets.withColumnRenamed("bucket", "reached"), ["rev", "path"], "left")
    return keep(moved.withColumn("file_bucket", F.coalesce("reached", "file_bucket")).drop("reached"), "files-reached"), warnings


def snapshot(everything: DataFrame, config, read, cache: str | None = None) -> Snapshot:
    """everything: rev, path, oid, size of all files, content unread; config: one, or one for each revision;
    read adds content to rows that have oid and path."""
    everything = keep(everything, "listing")
    if isinstance(config, C.Config):
        listing = _candidates(everything, config)
    else:
        listing = None
        for rev, own in config.items():
            one = _candidates(everything.where(F.col("rev") == rev), own)
            listing = one if listing is None else listing.unionByName(one)
    listing = keep(listing, "candidates")
    revisions = everything.select("rev").distinct()
    files = listing.join(_analysed(listing, read, cache), ["oid", "dialect"])
    ok = keep(files.where("status = 'ok'"), "files")
    failed = [r.e for r in ok.where("error is not null").select(F.concat_ws(": ", "path", "error").alias("e")).orderBy("e").collect()]
    if failed:
        raise ValueError("; ".join(failed))
    ok, reached = _module_buckets(files, ok, everything)
    one = ok.select("rev", "path", "file_bucket", F.explode("functions").alias("f"))
    number = lambda k: F.xxhash64("rev", "path", k)
    fn = one.select("rev", "path", number("f.ord").alias("fn_id"), F.when(F.col("f.parent").isNotNull(), number("f.parent")).alias("parent_id"), "f.depth", "f.ord", "f.name", F.when(F.col("file_bucket") == "tests", "tests").otherwise(F.col("f.bucket")).alias("bucket"), "f.line", "f.cc", "f.sloc")
    fn = fn.withColumn("mass", mass(F.col("cc"), F.col("sloc")))
    tokens = ok.select("rev", "language", "path", F.posexplode("tokens").alias("pos", "t")).select("rev", "language", "path", "pos", "t.text", "t.line", "t.end_line")
    lines = ok.select("rev", "path", "file_bucket", F.explode("lines").alias("l")).select("rev", "path", F.when(F.col("file_bucket") == "tests", "tests").otherwise(F.col("l.bucket")).alias("bucket"), "l.line").distinct()
    pairs = keep(clones.clone_pairs(tokens, lines), "pairs")
    covered = keep(clones.clone_lines(pairs, lines), "covered")
    skipped = files.where("status = 'skipped'").select("rev", "path", F.lit(MAX_BYTES).cast("long").alias("max_bytes"), F.col("size").alias("asked_bytes"))
    warnings = ok.select("rev", F.explode("warnings").alias("w"), "path").select("rev", F.concat_ws(": ", "path", "w").alias("warning"))
    if reached is not None:
        warnings = warnings.unionByName(reached)
    paths_ = ok.select("rev", "path", F.col("file_bucket").alias("bucket"), F.col("git_lines").alias("git_line_coordinates"))
    return Snapshot(paths_, fn, tokens, lines, pairs, covered, metrics.totals(revisions, fn, lines, covered), skipped, warnings)


def pruned(excludes: list[str]):
    """Whether a directory is never entered: by its name, or by a configured pattern for directories."""
    known = [re.compile(paths.python_regex(p.removeprefix("./").rstrip("/"))) for p in excludes if p.endswith("/")]

    def skip(directory: str) -> bool:
        name = directory.rsplit("/", 1)[-1]
        return name.startswith(".") or name in paths.SKIPPED_DIRECTORIES or any(k.match(directory) for k in known)

    return skip


def scan_directory(spark: SparkSession, root: str) -> Snapshot:
    """The directory is read by the executors, so it must be at the same path on all of them."""
    config = C.of_directory(root)
    listed = D.list_directory(spark, root, pruned(config.excludes))
    return snapshot(listed, config, lambda rows: D.read_files(rows, root, MAX_BYTES))


def scan_revisions(spark: SparkSession, repository: str, revisions: dict[str, str], cache: str | None = None) -> Snapshot:
    """revisions: label by revision; all of them in one job, each with the configuration in its tree."""
    listing, configs = None, {}
    for rev, label in revisions.items():
        one = G.list_tree(spark, repository, G.resolve_tree(repository, rev), label)
        listing = one if listing is None else listing.unionByName(one)
        configs[label] = C.of_revision(repository, rev)
    return snapshot(listing, configs, lambda rows: G.read_blobs(rows, repository, MAX_BYTES), cache)


def scan_files(spark: SparkSession, files: DataFrame, config: C.Config | None = None) -> Snapshot:
    """files(rev, path, oid, size, content) that are in memory already."""
    content = files.select("oid", "content").dropDuplicates(["oid"])
    return snapshot(files.drop("content"), config or C.Config(), lambda rows: rows.join(content, "oid"))
