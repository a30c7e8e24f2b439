"""Classification of paths, as columns: exclusion, test bucket, language, globs and the size limit."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_BYTES

#: Directories that are never analysed, and extensions by language.
SKIPPED_DIRECTORIES = ("vendor", "node_modules", "dist", "target")
SCRIPT_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
LANGUAGES = {"go": "go", "py": "python", "rs": "rust"} | {e: "typescript" for e in SCRIPT_EXTENSIONS}


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the point; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def glob_regex(pattern: str) -> str:
    """A Java expression for one glob over a whole path: * and ? stay within a component, [..] are
    classes (^ negates), a backslash escapes. ValueError if the pattern is malformed."""
    out, i = ["^"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                raise ValueError(f"bad pattern {pattern!r}")
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            ranges = []
            while not (ranges and pattern[i : i + 1] == "]"):
                ends = []
                while True:
                    if i >= len(pattern) or pattern[i] in "]-" and not ends or pattern[i] == "]":
                        raise ValueError(f"bad pattern {pattern!r}")
                    if pattern[i] == "\\":
                        i += 1
                        if i >= len(pattern):
                            raise ValueError(f"bad pattern {pattern!r}")
                    ends.append(f"\\x{{{ord(pattern[i]):x}}}")
                    i += 1
                    if len(ends) == 1 and pattern[i : i + 1] == "-":
                        i += 1
                        continue
                    break
                ranges.append("-".join(ends))
            i += 1
            out.append(f"[{'^' if negated else ''}{''.join(ranges)}]")
        else:
            out.append(f"\\x{{{ord(c):x}}}" if not c.isalnum() else c)
    return "".join(out) + "$"


def python_regex(pattern: str) -> str:
    """glob_regex() as an expression for Python."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), glob_regex(pattern))


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a glob takes the path, or, with a slash at its end, one of the directories above it."""
    hit = F.lit(False)
    for pattern in patterns:
        pattern = pattern.removeprefix("./")
        hit = hit | path.rlike(glob_regex(pattern))
        if pattern.endswith("/"):
            hit = hit | path.rlike(glob_regex(pattern.rstrip("/")).removesuffix("$") + "/")
    return hit


def excluded(path: Column, patterns: list[str] = ()) -> Column:
    go = extension(path) == "go"
    inside = F.exists(directories(path), lambda d: d.startswith(".") | d.isin(*SKIPPED_DIRECTORIES) | ((d == "testdata") & go))
    return inside | matches(path, list(patterns))


def excluded_directory(path: Column, patterns: list[str] = ()) -> Column:
    """Whether a directory can be pruned: by any component's name, or by a pattern for directories."""
    named = F.exists(F.split(path, "/"), lambda d: d.startswith(".") | d.isin(*SKIPPED_DIRECTORIES))
    return named | matches(F.concat(path, F.lit("/x")), [p for p in patterns if p.endswith("/")])


def is_test(path: Column, patterns: list[str] = ()) -> Column:
    ext, base = extension(path), base_name(path)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    stem = F.when(ext.isin("ts", "mts", "cts"), F.regexp_replace(stem, r"\.d$", "")).otherwise(stem)
    script = ext.isin(*SCRIPT_EXTENSIONS)
    above = directories(path)
    return (
        (F.array_contains(above, "__tests__") & script)
        | (F.array_contains(above, "tests") & ext.isin("py", "rs"))
        | ((ext == "go") & base.endswith("_test.go"))
        | (script & stem.rlike(r"\.(test|spec)$"))
        | ((ext == "py") & (base.startswith("test_") | base.endswith("_test.py")))
        | matches(path, list(patterns))
    )


def bucket(path: Column, patterns: list[str] = ()) -> Column:
    return F.when(is_test(path, patterns), "tests").otherwise("source")


def language(path: Column) -> Column:
    """Null for files that no analyser takes."""
    ext, out = extension(path), F.lit(None).cast("string")
    for name in sorted(set(LANGUAGES.values())):
        out = F.when(ext.isin(*(e for e, n in LANGUAGES.items() if n == name)), name).otherwise(out)
    return out


def dialect(path: Column) -> Column:
    """The language, for scripts with their extension; declaration files are a dialect of their own."""
    declared = F.regexp_extract(F.lower(path), r"\.(d\.(?:ts|mts|cts))$", 1)
    kind = F.when(declared != "", declared).otherwise(extension(path))
    return F.when(language(path) == "typescript", F.concat(F.lit("typescript:"), kind)).otherwise(language(path))


def oversized(size: Column) -> Column:
    return size > MAX_BYTES
