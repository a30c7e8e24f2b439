"""Rust module graphs: which files are compiled for tests only.

A context is a file together with the directory in which it looks for its modules. Contexts are found
from each other, one revision's declarations at a time; the states that they are reached in spread over
all revisions at once.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reach

#: Directories whose files are targets of their own.
TARGETS = ("tests", "examples", "benches", "src/bin")


def is_root(path: str, packages: set[str]) -> bool:
    """Whether a file starts a crate, by its place in the nearest package above it."""
    above = posixpath.dirname(path)
    while above:
        if above in packages:
            path = path[len(above) + 1 :]
            break
        above = posixpath.dirname(above)
    folder, base = posixpath.split(path)
    if folder in TARGETS or path == "build.rs":
        return True
    if base in ("main.rs", "lib.rs") and folder in ("", "src"):
        return True
    return base == "main.rs" and posixpath.dirname(folder) in TARGETS


def module_directory(path: str, explicit: bool) -> str:
    """Where a file's own modules are: beside it if it was named outright or is mod.rs, else below its name."""
    folder, base = posixpath.split(path)
    return folder if explicit or base == "mod.rs" else posixpath.join(folder, posixpath.splitext(base)[0])


def _inside(base: str, name: str) -> str | None:
    if name.startswith("/") or "\0" in name:
        return None
    target = posixpath.normpath(posixpath.join(base, name))
    return None if target == ".." or target.startswith("../") else target


def discover(files: dict[str, list[dict]], packages: set[str], omitted: Callable[[str], bool]) -> tuple[list[tuple], dict[tuple, list[str]], dict[str, tuple]]:
    """Edges (from, to, test_only, uncertain) between contexts, warnings by context, and each file's first context."""
    first = {p: (p, module_directory(p, is_root(p, packages))) for p in files}
    edges, warnings, seen, todo = [], {}, set(), list(first.values())

    def resolve(context: tuple, modules: list[dict], folder: str, beside: str, test: bool, unsure: bool) -> None:
        for m in modules:
            only, unknown, paths = test or m["test_only"], unsure or m["uncertain"], []
            say = lambda text, m=m: warnings.setdefault(context, []).append(f"Rust module {m['name']} in {context[0]}: {text}")
            for name in [*([m["path"]] if m["path"] is not None else []), *m["alternatives"]]:
                target = _inside(beside, name)
                if target is None:
                    unknown = True
                    say(f"path {json.dumps(name)} is outside the analyzed snapshot or invalid")
                else:
                    paths.append(target)
            if m["uncertain"]:
                say("conditional or unsupported path; possible targets retain source scope")
            if m["inline"]:
                for d in paths + ([posixpath.join(folder, m["name"])] if m["path"] is None else []):
                    resolve(context, m["children"], d, d, only, unknown)
                continue
            named = len(paths)
            if m["path"] is None:
                paths += [posixpath.join(folder, m["name"] + ".rs"), posixpath.join(folder, m["name"], "mod.rs")]
            found = [(p, module_directory(p, k < named)) for k, p in enumerate(paths) if p in files]
            if not found and not any(map(omitted, paths)):
                say(f"no analyzed target among {json.dumps(paths)}")
            if len(found) > 1 and not unknown:
                unknown = True
                say(f"multiple analyzed targets among {json.dumps(paths)}; retaining source scope")
            for to in found:
                edges.append((context, to, only, unknown))
                todo.append(to)

    while todo:
        context = todo.pop()
        if context not in seen:
            seen.add(context)
            resolve(context, files[context[0]], context[1], posixpath.dirname(context[0]), False, False)
    return edges, warnings, first


_GRAPH = "rev string, kind string, src string, dst string, test_only boolean, uncertain boolean, path string, note string"


def classify(files: DataFrame, packages: DataFrame, ignored: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """files(rev, path, bucket, test_only, modules as JSON), packages(rev, path of a directory), ignored(rev, path):
    rev, path, bucket of Rust files as reached, and rev, warning.

    A revision's declarations (names and paths, no content) are resolved in one task."""
    gathered = files.select("rev", F.struct(F.lit("file").alias("kind"), "path", "bucket", "test_only", "modules").alias("r"))
    extra = lambda df, kind: df.select("rev", F.struct(F.lit(kind).alias("kind"), "path", F.lit("").alias("bucket"), F.lit(False).alias("test_only"), F.lit("[]").alias("modules")).alias("r"))
    rows = gathered.unionByName(extra(packages, "package")).unionByName(extra(ignored, "ignored")).select("rev", "r.*")

    def graph(frame: pd.DataFrame) -> pd.DataFrame:
        rev = frame["rev"].iloc[0]
        of = lambda kind: frame[frame["kind"] == kind]
        own = {r.path: json.loads(r.modules) for r in of("file").itertuples()}
        skipped, roots = set(of("ignored")["path"]), set(of("package")["path"])
        edges, warnings, first = discover(own, roots, skipped.__contains__)
        name = "\0".join
        out = [(rev, "edge", name(a), name(b), t, u, b[0], "") for a, b, t, u in edges]
        incoming = {b[0] for _, b, _, _ in edges}
        out += [(rev, "first" if p not in incoming or is_root(p, roots) else "later", name(c), "", False, False, p, "") for p, c in first.items()]
        out += [(rev, "warning", name(c), "", False, False, c[0], w) for c, ws in warnings.items() for w in ws]
        return pd.DataFrame(out, columns=[f.split()[0] for f in _GRAPH.split(", ")])

    made = keep(rows.groupBy("rev").applyInPandas(graph, _GRAPH), "modules")
    node = lambda c: F.concat_ws("\1", "rev", c)
    forced = files.select("rev", "path", ((F.col("bucket") == "tests") | F.col("test_only")).alias("forced"))
    edges = keep(made.where("kind = 'edge'").join(forced, ["rev", "path"]).select(node("src").alias("src"), node("dst").alias("dst"), "test_only", "uncertain", "forced").distinct(), "module-edges")
    starts = made.where("kind in ('first', 'later')").join(forced, ["rev", "path"]).select("kind", node("src").alias("node"), F.when(F.col("forced"), "tests").otherwise("source").alias("bucket"))
    states = reach.reach(starts.where("kind = 'first'").select("node", "bucket"), edges, keep)
    of_file = lambda df: df.select("bucket", "node", F.split("node", "\1|\0").alias("p")).select("bucket", "node", F.col("p")[0].alias("rev"), F.col("p")[1].alias("path"))
    rest = of_file(starts).join(of_file(states).select("rev", "path").distinct(), ["rev", "path"], "left_anti").select("node", "bucket")
    states = keep(states.unionByName(reach.reach(rest, edges, keep)), "module-states")
    per_file = of_file(states).groupBy("rev", "path").agg(F.max(F.when(F.col("bucket") == "source", 1).otherwise(0)).alias("source"))
    buckets = per_file.select("rev", "path", F.when(F.col("source") == 1, "source").otherwise("tests").alias("bucket"))
    said = made.where("kind = 'warning'").select(node("src").alias("node"), "rev", "note").join(states.select("node").distinct(), "node", "left_semi")
    return buckets, said.select("rev", F.col("note").alias("warning")).distinct()
