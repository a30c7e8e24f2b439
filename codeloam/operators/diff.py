"""Base-to-head differences: line mapping, function matching and clone identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import note
from ..schema import BUCKETS, CUTOFF
from ..sources.scratch import keep

_METRICS = ("name", "bucket", "line", "cc", "sloc", "mass")


def hunk_deltas(changes: DataFrame) -> DataFrame:
    """path, boundary, before_start, before_count, delta: lines gained up to and with each hunk.

    A pure insertion takes effect behind its line."""
    boundary = F.col("before_start") + F.when(F.col("before_count") == 0, 1).otherwise(0)
    order = W.partitionBy("path").orderBy("boundary").rowsBetween(W.unboundedPreceding, 0)
    rows = changes.withColumn("boundary", boundary)
    return rows.select("path", "boundary", "before_start", "before_count", F.sum(F.col("after_count") - F.col("before_count")).over(order).cast("int").alias("delta"))


def map_lines(lines: DataFrame, changes: DataFrame | None, compatible: DataFrame | None = None) -> DataFrame:
    """lines(path, line) with mapped, null where the line is gone.

    A backward as-of join: hunks and lines are sorted together and the last hunk is carried forward.
    Without changes every line stays; with them only the paths in compatible, if given, are mapped."""
    wanted = lines.select("path", "line").distinct()
    if changes is None:
        return wanted.withColumn("mapped", F.col("line"))
    hunks = hunk_deltas(changes)
    empty = F.lit(None).cast("struct<start:int,count:int,delta:int>")
    events = hunks.select("path", F.col("boundary").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("before_start").alias("start"), F.col("before_count").alias("count"), "delta").alias("hunk"))
    events = events.unionByName(wanted.select("path", F.col("line").alias("at"), F.lit(1).alias("kind"), empty.alias("hunk")))
    order = W.partitionBy("path").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    seen = events.withColumn("last", F.last("hunk", ignorenulls=True).over(order)).where("kind = 1")
    gone = (F.col("last.count") != 0) & (F.col("at") < F.col("last.start") + F.col("last.count"))
    mapped = F.when(F.col("last").isNull(), F.col("at")).when(gone, F.lit(None)).otherwise(F.col("at") + F.col("last.delta"))
    out = seen.select("path", F.col("at").alias("line"), mapped.cast("int").alias("mapped"))
    if compatible is not None:
        known = compatible.select("path").distinct().withColumn("ok", F.lit(True))
        out = out.join(known, "path", "left").select("path", "line", F.when(F.col("ok"), F.col("mapped")).alias("mapped"))
    return out


def touched_paths(touched: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """touched(path) and the paths that appear, vanish or change their bucket between base and head(path, bucket)."""
    a = base.select("path", F.col("bucket").alias("before"))
    b = head.select("path", F.col("bucket").alias("after"))
    moved = a.join(b, "path", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("path")
    return touched.select("path").union(moved).distinct()


def compatible_paths(base: DataFrame, head: DataFrame) -> DataFrame:
    """Paths whose lines count as Git counts them on both sides."""
    return head.where("git_line_coordinates").join(base.where("git_line_coordinates"), "path", "left_semi").select("path").distinct()


def mapping_paths(used: DataFrame, compatible: DataFrame, touched: DataFrame) -> DataFrame:
    """Paths whose hunks are needed: they hold functions or clones, are compatible and touched."""
    return used.select("path").intersect(compatible.select("path")).intersect(touched.select("path"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("line", "cc", "sloc", "ord")))


def _left(rows: DataFrame, pairs: DataFrame, id_: str) -> DataFrame:
    return rows.join(pairs.select(F.col(id_).alias("fn_id")), "fn_id", "left_anti")


def _pair(before: DataFrame, after: DataFrame, keys: list[str], how: str, phase: int) -> DataFrame:
    """k-th with k-th of equal keys."""
    a = _ranked(before, keys).select(*keys, "rank", F.col("fn_id").alias("before_id"))
    b = _ranked(after, keys).select(*keys, "rank", F.col("fn_id").alias("after_id"))
    return a.join(b, [*keys, "rank"], how).select("before_id", "after_id", F.lit(phase).alias("phase"))


def match_functions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """before_id, after_id, phase of functions grouped by keys: by mapped line, then by signature, then in order.

    before: keys, fn_id, ord, line, cc, sloc, signature, mapped (null: gone); after: the same without mapped."""
    before, after = keep(before, "before"), keep(after, "after")
    first = _pair(before.where("mapped is not null").withColumn("spot", F.col("mapped")), after.withColumn("spot", F.col("line")), [*keys, "spot"], "inner", 1)
    first = keep(first, "by-line")
    before, after = _left(before, first, "before_id"), _left(after, first, "after_id")
    second = keep(_pair(before, after, [*keys, "signature"], "inner", 2), "by-signature")
    third = _pair(_left(before, second, "before_id"), _left(after, second, "after_id"), keys, "full", 3)
    return first.unionByName(second).unionByName(third)


def signatures(functions: DataFrame, depths: int) -> DataFrame:
    """functions with a signature of each one's own values and, sorted, of those nested in it."""
    own = functions.withColumn("signature", F.lit(None).cast("string"))
    done = None
    for depth in range(depths, -1, -1):
        level = functions.where(F.col("depth") == depth)
        if done is None:
            inner = level.select(F.col("fn_id").alias("up")).where("false").withColumn("below", F.array().cast("array<string>"))
        else:
            inner = done.where(F.col("depth") == depth + 1).groupBy(F.col("parent_id").alias("up")).agg(F.sort_array(F.collect_list("signature")).alias("below"))
        joined = level.join(inner, F.col("fn_id") == F.col("up"), "left").drop("up")
        text = F.to_json(F.struct("path", "name", F.coalesce("bucket", F.lit(BUCKETS[0])).alias("bucket"), "cc", "sloc", "mass", F.coalesce("below", F.array().cast("array<string>")).alias("below")))
        level = joined.select(*functions.columns, F.sha2(text, 256).alias("signature"))
        done = level if done is None else done.unionByName(level)
    return done if done is not None else own


def function_deltas(base: DataFrame, head: DataFrame, touched: DataFrame, mapped: DataFrame, depths: int = 8) -> DataFrame:
    """Changes of functions in touched files, the nested ones under the match of their parents.

    base, head: path, fn_id, parent_id, depth, ord and the metrics. One row for each match: match_id,
    parent_match, depth, path, name, before, after (structs, one may be null), delta_mass, note, phase.
    Matches without any difference, in themselves or below, are left out."""
    columns = ["path", "fn_id", "parent_id", "depth", "ord", *_METRICS]
    sides = []
    for side in (base, head):
        own = side.join(touched.select("path"), "path", "left_semi").select(*columns)
        sides.append(signatures(own, depths))
    before = keep(sides[0].join(mapped, ["path", "line"], "left"), "before-side")
    after = keep(sides[1], "after-side")
    matches = None
    for depth in range(depths + 1):
        a, b = before.where(F.col("depth") == depth), after.where(F.col("depth") == depth)
        if depth == 0:
            a, b, keys = a.withColumn("up", F.lit("")), b.withColumn("up", F.lit("")), ["up", "path", "name"]
        else:
            a = a.join(level.select(F.col("before_id").alias("parent_id"), F.col("match_id").alias("up")), "parent_id")
            b = b.join(level.select(F.col("after_id").alias("parent_id"), F.col("match_id").alias("up")), "parent_id")
            keys = ["up", "path", "name"]
        found = match_functions(a, b, keys)
        known = a.select(F.col("fn_id").alias("before_id"), F.col("up").alias("up_a"))
        known_b = b.select(F.col("fn_id").alias("after_id"), F.col("up").alias("up_b"))
        level = found.join(known, "before_id", "left").join(known_b, "after_id", "left")
        level = level.select(F.concat_ws("/", F.coalesce(F.col("before_id").cast("string"), F.lit("")), F.coalesce(F.col("after_id").cast("string"), F.lit(""))).alias("match_id"), F.coalesce("up_a", "up_b").alias("parent_match"), F.lit(depth).alias("depth"), "before_id", "after_id", "phase")
        level = keep(level, "matches")
        matches = level if matches is None else matches.unionByName(level)
        if depths == 0:
            break
    pack = lambda rows, id_, name: rows.select(F.col("fn_id").alias(id_), F.col("path").alias(f"{name}_path"), F.struct(*_METRICS).alias(name))
    rows = matches.join(pack(before, "before_id", "before"), "before_id", "left").join(pack(after, "after_id", "after"), "after_id", "left")
    rows = rows.select(
        "match_id", "parent_match", "depth", F.coalesce("before_path", "after_path").alias("path"), F.coalesce("before.name", "after.name").alias("name"), "before", "after",
        (F.coalesce("after.mass", F.lit(0.0)) - F.coalesce("before.mass", F.lit(0.0))).alias("delta_mass"), note(F.col("before.cc"), F.col("after.cc")).alias("note"), "phase",
    )
    return prune_unchanged(keep(rows, "changes"), depths)


def prune_unchanged(rows: DataFrame, depths: int) -> DataFrame:
    """Without matches that are equal on both sides and have nothing left below them, from the inside out."""
    same = F.col("before").isNotNull() & F.col("after").isNotNull()
    for c in ("cc", "sloc", "mass", "bucket"):
        same = same & F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
    rows = rows.withColumn("same", same)
    kept = None
    for depth in range(depths, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if kept is not None:
            held = kept.where(F.col("depth") == depth + 1).select(F.col("parent_match").alias("match_id")).distinct().withColumn("holds", F.lit(True))
            level = level.join(held, "match_id", "left").where("not same or holds").drop("holds")
        else:
            level = level.where("not same")
        kept = level if kept is None else kept.unionByName(level)
    return kept.drop("same")


def delta_order() -> list[Column]:
    return [F.abs("delta_mass").desc(), F.col("path"), F.col("name"), F.coalesce("after.line", "before.line")]


def mass_by_bucket(deltas: DataFrame) -> DataFrame:
    """bucket, added, removed: mass over the cutoff that outermost functions gained and lost."""
    over = lambda side: F.coalesce(F.col(f"{side}.cc") > CUTOFF, F.lit(False))
    of = lambda side: F.coalesce(F.col(f"{side}.bucket"), F.lit(BUCKETS[0]))
    moved = F.col("before").isNotNull() & F.col("after").isNotNull() & (of("before") != of("after"))
    zero = F.lit(0.0)
    gain = F.when(moved, F.when(over("after"), F.col("after.mass")).otherwise(zero)).otherwise(F.when(over("after") & (F.col("delta_mass") > 0), F.col("delta_mass")).otherwise(zero))
    loss = F.when(moved, F.when(over("before"), F.col("before.mass")).otherwise(zero)).otherwise(F.when(over("before") & (F.col("delta_mass") < 0), -F.col("delta_mass")).otherwise(zero))
    parts = F.array(F.struct(of("after").alias("bucket"), gain.alias("added"), zero.alias("removed")), F.struct(of("before").alias("bucket"), zero.alias("added"), loss.alias("removed")))
    sums = deltas.where("depth = 0").select(F.explode(parts).alias("p")).groupBy("p.bucket").agg(F.sum("p.added").alias("added"), F.sum("p.removed").alias("removed"))
    frame = deltas.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return frame.join(sums, "bucket", "left").fillna(0.0)


def largest_contributor(deltas: DataFrame, sign: int) -> DataFrame:
    """The outermost change that added (1) or removed (-1) most over the cutoff in the source bucket; the
    first in report order among equals."""
    side = "after" if sign > 0 else "before"
    fit = deltas.where("depth = 0").where((F.col("delta_mass") * sign > 0) & (F.col(f"{side}.cc") > CUTOFF) & (F.coalesce(F.col(f"{side}.bucket"), F.lit(BUCKETS[0])) == BUCKETS[0]))
    return fit.orderBy(*delta_order()).limit(1)


_ENDS = [f"{s}_{e}" for s in "ab" for e in ("start", "end")]
_PAIR = ["id", "a_path", "a_start", "a_end", "b_path", "b_start", "b_end", "tokens", "lines"]


def clone_changes(base: DataFrame, head: DataFrame, touched: DataFrame, mapped: DataFrame | None) -> DataFrame:
    """change ('+' or '-') and the pair: identities that head has more often than base, or the other way.

    Pairs whose four ends map onto a head pair of the same id match first (without mapped every line stays); then as many
    of the rest as both sides have cancel, from the front; what is left counts if a side of it is touched."""
    a = base.select(*_PAIR)
    if mapped is None:
        a = a.select("*", *(F.col(e).alias(f"m_{e}") for e in _ENDS))
    else:
        a = a.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("a_path", "a_start", "b_path", "b_start", "a_end", "b_end")))
        ends = F.array(*(F.struct(F.lit(e).alias("end"), F.col(f"{e[0]}_path").alias("path"), F.col(e).alias("line")) for e in _ENDS))
        long = a.select("id", "n", F.explode(ends).alias("e")).select("id", "n", "e.*").join(mapped, ["path", "line"], "left")
        wide = long.groupBy("id", "n").agg(*(F.max(F.when(F.col("end") == e, F.col("mapped"))).alias(f"m_{e}") for e in _ENDS))
        a = a.join(wide, ["id", "n"]).drop("n")
    b = head.select(*_PAIR, *(F.col(e).alias(f"m_{e}") for e in _ENDS))
    rows = a.withColumn("head", F.lit(False)).unionByName(b.withColumn("head", F.lit(True)))
    return changed_sides(rows.repartition("id"), touched)


def changed_sides(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """The same of pairs with head (false: of the base) and m_a_start to m_b_end, mapped ends. All steps group by id
    first, so rows that are dealt by id are not shuffled again."""
    spot = ["a_path", "b_path", *(f"m_{e}" for e in _ENDS)]
    number = lambda *keys: F.row_number().over(W.partitionBy("id", *keys).orderBy("n"))
    alone = lambda *keys: F.count(F.lit(1)).over(W.partitionBy("id", *keys)) == 1
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("id", "head").orderBy("a_path", "a_start", "b_path", "b_start", "a_end", "b_end")))
    rows = rows.withColumn("placed", F.expr(" and ".join(f"m_{e} is not null" for e in _ENDS)))
    rows = rows.withColumn("k", number("head", "placed", *spot)).withColumn("rest", ~F.col("placed") | alone("placed", *spot, "k"))
    rows = rows.withColumn("k", number("head", "rest")).where("rest").withColumn("left", alone("k"))
    rows = rows.where("left").select(F.when(F.col("head"), "+").otherwise("-").alias("change"), *_PAIR)
    hit = touched.select("path").distinct()
    either = rows.join(hit.withColumnRenamed("path", "a_path").withColumn("ta", F.lit(1)), "a_path", "left").join(hit.withColumnRenamed("path", "b_path").withColumn("tb", F.lit(1)), "b_path", "left")
    return either.where("ta = 1 or tb = 1").select("change", *_PAIR)


def touched_lines(clone_lines: DataFrame, touched: DataFrame) -> DataFrame:
    """bucket, clone_lines of touched files; both buckets, zero if none."""
    counted = clone_lines.select("path", "bucket", "line").distinct().join(touched.select("path").distinct(), "path", "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("clone_lines"))
    frame = clone_lines.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return frame.join(counted, "bucket", "left").fillna(0)
