"""Git as relations: trees, blobs, hunks and history. The driver lists; executors read blobs."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import COMMITS, LINE_CHANGES

_HUNK = re.compile(rb"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPE = re.compile(rb"\\([0-7]{3}|.)", re.S)
_LETTERS = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v"}


def to_text(raw: bytes) -> str:
    """Paths as text; bytes that aren't UTF-8 survive as lone surrogates, which Spark can't hold, so as \\xHH."""
    return raw.decode("utf-8", "backslashreplace")


def git(repository: str, *arguments: str) -> bytes:
    done = subprocess.run(["git", "-C", repository, *arguments], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def resolve_commit(repository: str, rev: str) -> str:
    return git(repository, "rev-parse", "--verify", "--end-of-options", f"{rev}^{{commit}}").decode().strip()


def resolve_tree(repository: str, rev: str) -> str:
    return git(repository, "rev-parse", "--verify", "--end-of-options", f"{rev}^{{tree}}").decode().strip()


def merge_base(repository: str, base: str, head: str) -> str:
    return git(repository, "merge-base", base, head).decode().strip()


def changed_files(repository: str, base: str, head: str) -> list[str]:
    """Sorted; a rename is a removed and an added file."""
    return sorted(to_text(p) for p in git(repository, "diff", "--no-renames", "--name-only", "-z", base, head, "--").split(b"\0") if p)


def list_tree(spark: SparkSession, repository: str, rev: str, label: str | None = None) -> DataFrame:
    """rev, path, oid, size of regular files, without content; links and submodules are left out."""
    rows = []
    for entry in git(repository, "ls-tree", "-r", "-l", "-z", "--full-tree", rev).split(b"\0"):
        if entry:
            meta, _, path = entry.partition(b"\t")
            mode, kind, oid, size = meta.split()
            if kind == b"blob" and mode in (b"100644", b"100755"):
                rows.append((label or rev, to_text(path), oid.decode(), int(size)))
    return spark.createDataFrame(rows, "rev string, path string, oid string, size long")


def read_blobs(listing: DataFrame, repository: str, limit: int) -> DataFrame:
    """listing with content: the first `limit` bytes of each blob (0: all), from one git process a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for frame in frames:
                content = []
                for oid in frame["oid"]:
                    child.stdin.write(oid.encode() + b"\n")
                    child.stdin.flush()
                    answer = child.stdout.readline().split()
                    if len(answer) != 3 or answer[0] != oid.encode() or answer[1] != b"blob":
                        raise RuntimeError(f"git cat-file: unexpected answer for {oid}: {answer}")
                    size = int(answer[2])
                    kept = child.stdout.read(min(size, limit) if limit else size)
                    rest = size - len(kept)
                    while rest:
                        rest -= len(child.stdout.read(min(rest, 1 << 20)))
                    if child.stdout.read(1) != b"\n":
                        raise RuntimeError(f"git cat-file: no end after {oid}")
                    content.append(kept)
                yield frame.assign(content=content)
        finally:
            child.stdin.close()
            child.wait()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema)
    return listing.mapInPandas(run, f"{fields}, content binary")


def _unquote(raw: bytes) -> bytes:
    if not raw.startswith(b'"'):
        return raw
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _LETTERS.get(m[1], m[1]), raw[1:-1])


def parse_patch(patch: bytes) -> list[tuple[str, int, int, int, int]]:
    """path, before start and count, after start and count of each hunk of a patch without context.

    Content lines are counted off, so lines that look like headers can't be taken for them."""
    out, old, new, skip = [], None, None, 0
    for line in patch.split(b"\n"):
        if skip and line[:1] in (b"+", b"-", b"\\"):
            skip -= line[:1] != b"\\"
            continue
        if line.startswith(b"diff --git "):
            old = new = None
        elif line.startswith(b"--- "):
            old = line[4:].rstrip(b"\t")
        elif line.startswith(b"+++ "):
            new = line[4:].rstrip(b"\t")
        elif m := _HUNK.match(line):
            a, b, c, d = (1 if x is None else int(x) for x in m.groups())
            path = _unquote(new if new != b"/dev/null" else old)
            out.append((to_text(path.partition(b"/")[2]), a, b, c, d))
            skip = b + d
    return out


def line_changes(spark: SparkSession, repository: str, base: str, head: str, paths: list[str]) -> DataFrame:
    """Hunks of the given paths; without paths none, and Git isn't asked."""
    rows = []
    for at in range(0, len(paths), 500):
        command = ["--literal-pathspecs", "diff", "-U0", "--no-color", "--no-ext-diff", "--no-renames", "--diff-algorithm=myers", "--no-indent-heuristic", "--inter-hunk-context=0", base, head, "--", *paths[at : at + 500]]
        rows += parse_patch(git(repository, *command))
    return spark.createDataFrame(rows, LINE_CHANGES)


def history(spark: SparkSession, repository: str, rev: str, merges: bool = False) -> DataFrame:
    """pos, rev, date of the first parents from rev back, in log order."""
    fields = git(repository, "log", "--first-parent", *(["--merges"] if merges else []), "-z", "--format=%H%x00%cI", rev).split(b"\0")
    pairs = zip(fields[::2], fields[1::2])
    rows = [(k, r.decode().strip(), re.sub(r"\+00:00$", "Z", d.decode().strip())) for k, (r, d) in enumerate(pairs) if r.strip()]
    return spark.createDataFrame(rows, COMMITS)
