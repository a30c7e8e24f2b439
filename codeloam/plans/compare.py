"""Comparisons: base to head, and totals over a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones, diff, trend
from ..schema import BUCKETS, CUTOFF
from ..sources import git as G
from ..sources.scratch import keep
from . import scan as S


class Incomplete(ValueError):
    """A snapshot with skipped files or warnings can't be compared."""


def require_complete(snapshot: S.Snapshot) -> None:
    problems = [r.p for r in snapshot.skipped.select(F.concat(F.lit("skipped "), "path").alias("p")).unionByName(snapshot.warnings.select(F.concat(F.lit("warning: "), "warning").alias("p"))).distinct().orderBy("p").collect()]
    if problems:
        raise Incomplete("incomplete scan: " + "; ".join(problems))


def functions_tree(rows: list, key) -> list[dict]:
    """Rows with id, parent and depth as nested dictionaries, in the order given."""
    nodes, top = {}, []
    for r in sorted(rows, key=lambda r: r.depth):
        item = key(r) | {"nested": []}
        nodes[(r.path, r.fn_id)] = item
        (nodes[(r.path, r.parent_id)]["nested"] if r.parent_id is not None else top).append(item)
    return top


def _totals(rows) -> dict:
    return {r.bucket: {k: r[k] for k in ("functions", "mass", "mass_over_cc_10", "erosion", "source_lines", "clone_lines", "clone_share")} for r in rows}


def _pair(r) -> dict:
    return {"id": r.id, "a": {"file": r.a_path, "start": r.a_start, "end": r.a_end}, "b": {"file": r.b_path, "start": r.b_start, "end": r.b_end}, "tokens": r.tokens, "lines": r.lines}


def _function(path: str, f) -> dict | None:
    return f and {"file": path, "name": f.name, "bucket": f.bucket, "line": f.line, "cc": f.cc, "sloc": f.sloc, "mass": f.mass}


def snapshot_document(snapshot: S.Snapshot, rev: str) -> dict:
    """One revision as the value that the renderers take. Its rows come to the driver: a report is read by people."""
    at = lambda df: df.where(F.col("rev") == rev)
    fns = at(snapshot.functions).orderBy("path", "line", "name", "ord").collect()
    fields = lambda r: {"file": r.path, "name": r.name, "bucket": r.bucket, "line": r.line, "cc": r.cc, "sloc": r.sloc, "mass": r.mass}
    buckets = _totals(at(snapshot.totals).collect())
    for b, t in buckets.items():  # the rows are here: masses to the last bit, added in order of path and place
        own = [f for f in sorted(fns, key=lambda f: (f.path.encode(), f.ord)) if f.depth == 0 and f.bucket == b]
        t["mass"], t["mass_over_cc_10"] = 0.0, 0.0
        for f in own:
            t["mass"] += f.mass
            t["mass_over_cc_10"] += f.mass if f.cc > CUTOFF else 0.0
        t["erosion"] = t["mass_over_cc_10"] / t["mass"] if t["mass"] else 0.0
    lines = at(snapshot.clone_lines).groupBy("path", "bucket").agg(F.sort_array(F.collect_set("line")).alias("lines")).orderBy("path", "bucket")
    return {
        "rev": rev,
        "buckets": buckets,
        "functions": functions_tree(fns, fields),
        "clones": [_pair(r) for r in at(snapshot.clone_pairs).orderBy("a_path", "a_start", "a_end", "b_path", "b_start", "b_end", "id").collect()],
        "clone_coverage": [{"file": r.path, "bucket": r.bucket, "lines": list(r.lines)} for r in lines.collect()],
        "skipped": [r.path for r in at(snapshot.skipped).orderBy("path").collect()],
        "skipped_details": [{"file": r.path, "max_bytes": r.max_bytes, "asked_bytes": r.asked_bytes} for r in at(snapshot.skipped).orderBy("path").collect()] or None,
        "warnings": sorted(r.warning for r in at(snapshot.warnings).collect()),
    }


def compare(both: S.Snapshot, touched: DataFrame, changes: DataFrame | None, base: str = "base", head: str = "head") -> dict:
    """The difference of two revisions of one snapshot, as a document."""
    side = lambda df, rev: df.where(F.col("rev") == rev).drop("rev")
    base_files, head_files = side(both.files, base), side(both.files, head)
    spread = keep(diff.touched_paths(touched, base_files, head_files), "touched")
    same = diff.compatible_paths(base_files, head_files)
    base_fn, head_fn = side(both.functions, base), side(both.functions, head)
    base_pairs, head_pairs = side(both.clone_pairs, base), side(both.clone_pairs, head)
    ends = clones.ranges(base_pairs.withColumn("rev", F.lit(base))).select("path", F.explode(F.array("start", "end")).alias("line"))
    mapped = keep(diff.map_lines(base_fn.select("path", "line").unionByName(ends), changes, same if changes is not None else None), "mapped")
    depth = both.functions.agg(F.max("depth")).first()[0] or 0
    deltas = keep(diff.function_deltas(base_fn, head_fn, spread, mapped, depth), "deltas")
    changed = diff.clone_changes(base_pairs, head_pairs, spread, mapped)
    masses = {r.bucket: r for r in diff.mass_by_bucket(deltas).collect()}
    before, after = _totals(side(both.totals, base).collect()), _totals(side(both.totals, head).collect())
    lines = {rev: {r.bucket: r.clone_lines for r in diff.touched_lines(side(both.clone_lines, rev), spread).collect()} for rev in (base, head)}
    order = diff.delta_order()
    rows = [r for r in deltas.withColumn("k", F.struct(F.lit(0))).orderBy("depth", *order, "match_id").collect()]
    nodes, top = {}, []
    for r in rows:
        item = {"file": r.path, "name": r.name, "before": _function(r.path, r.before), "after": _function(r.path, r.after), "delta_mass": r.delta_mass, "note": r.note, "nested": []}
        nodes[r.match_id] = item
        (nodes[r.parent_match]["nested"] if r.depth else top).append(item)
    found = changed.orderBy("id", "a_path", "a_start", "b_path", "b_start").collect()
    return {
        "base": base, "head": head, "touched": sorted(r.path for r in touched.distinct().collect()),
        "buckets": {b: {
            "mass_added_over_cc_10": masses[b].added, "mass_removed_over_cc_10": masses[b].removed, "erosion_before": before[b]["erosion"], "erosion_after": after[b]["erosion"],
            "clone_share_before": before[b]["clone_share"], "clone_share_after": after[b]["clone_share"], "clone_lines_touched_before": lines[base][b], "clone_lines_touched_after": lines[head][b],
        } for b in BUCKETS},
        "functions": top, "clones_added": [_pair(r) for r in found if r.change == "+"], "clones_removed": [_pair(r) for r in found if r.change == "-"],
    }


def diff_revisions(spark: SparkSession, repository: str, base: str, head: str, cache: str | None = None) -> dict:
    tip = G.resolve_commit(repository, head)
    start = G.merge_base(repository, G.resolve_commit(repository, base), tip)
    files = G.changed_files(repository, start, tip)
    both = S.scan_revisions(spark, repository, {start: "base", tip: "head"} if start != tip else {start: "base"}, cache)
    if start == tip:
        both = S.Snapshot(*(keep(df.unionByName(df.withColumn("rev", F.lit("head"))), "same") for df in vars(both).values()))
    require_complete(both)
    touched = spark.createDataFrame([(f,) for f in files], "path string")
    sides = [both.files.where(F.col("rev") == r) for r in ("base", "head")]
    used = both.functions.select("path").union(both.clone_pairs.select("a_path")).union(both.clone_pairs.select("b_path"))
    asked = diff.mapping_paths(used, diff.compatible_paths(*sides), diff.touched_paths(touched, *sides))
    wanted = [r.path for r in asked.orderBy("path").collect()]  # names for Git's command line
    return compare(both, touched, G.line_changes(spark, repository, start, tip, wanted)) | {"base": start, "head": tip}


def trend_points(spark: SparkSession, repository: str, head: str, months: int | None = None, merges: int | None = None, cache: str | None = None) -> list[dict]:
    if (months or merges or 0) <= 0:
        raise ValueError("months or merges must be greater than zero")
    log = G.history(spark, repository, head, merges is not None).withColumn("ts", F.to_timestamp("date"))
    chosen = trend.month_commits(log, months) if months else trend.merge_commits(log, merges).withColumn("axis_label", F.lit(""))
    commits = chosen.join(log.select("rev", "date"), "rev").orderBy("ord").collect()
    if not commits:
        return []
    shots = S.scan_revisions(spark, repository, {c.rev: c.rev for c in commits}, cache)
    require_complete(shots)
    order = spark.createDataFrame([(c.ord, c.rev, c.date, c.axis_label) for c in commits], "ord int, rev string, date string, axis_label string")
    rows = trend.trim_leading(shots.totals.join(F.broadcast(order), "rev")).orderBy("ord", "bucket").collect()
    points: dict[int, dict] = {}
    for r in rows:
        points.setdefault(r.ord, {"rev": r.rev, "date": r.date, "buckets": {}, "axis_label": r.axis_label})["buckets"] |= _totals([r])
    return [points[k] for k in sorted(points)]
