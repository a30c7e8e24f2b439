"""What all language analysers share: results, line counts and the registry."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field


@dataclass
class Function:
    """A function with those nested in it; cc counts its own and all nested decisions, plus one."""

    name: str
    line: int
    start: int
    end: int
    decisions: int = 0
    bucket: str | None = None
    sloc: int = 0
    nested: list["Function"] = field(default_factory=list)

    @property
    def cc(self) -> int:
        return 1 + self.total()

    def total(self) -> int:
        return self.decisions + sum(f.total() for f in self.nested)


@dataclass
class Token:
    text: bytes
    line: int
    end_line: int


@dataclass
class Module:
    """A module that a file declares: where its file may be, and what reaching it means."""

    name: str
    path: str | None = None
    alternatives: tuple[str, ...] = ()
    test_only: bool = False
    inline: bool = False
    uncertain: bool = False
    children: list["Module"] = field(default_factory=list)


@dataclass
class Result:
    """What one file yields; error stops a whole scan, warnings stop comparisons only."""

    functions: list[Function] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)
    source_lines: list[tuple[int, str]] = field(default_factory=list)  # line, bucket
    warnings: list[str] = field(default_factory=list)
    modules: list[Module] = field(default_factory=list)
    test_only: bool = False
    git_line_coordinates: bool = True
    error: str | None = None


_SCRIPT_LINES = re.compile("\r\n|[\n\r\u2028\u2029]")


def line_ends(text: str, script: bool) -> list[int]:
    """Offsets behind each terminator."""
    if script:
        return [m.end() for m in _SCRIPT_LINES.finditer(text)]
    return [i + 1 for i, c in enumerate(text) if c == "\n"]


def is_blank(c: str, script: bool = False) -> bool:
    """Unicode white space; scripts also take the byte order mark and all space separators."""
    if script:
        return c in "\t\x0b\x0c \xa0\ufeff\n\r\u2028\u2029" or unicodedata.category(c) == "Zs"
    return c in "\t\n\x0b\x0c\r \x85\xa0" or unicodedata.category(c) in ("Zs", "Zl", "Zp")


def blank_spans(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """text with the spans blanked, line ends kept."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], re.sub("[^\r\n\u2028\u2029]", " ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def sloc(code: str, start: int, end: int) -> int:
    """Lines of a span of comment-free code with something on them."""
    return sum(any(not is_blank(c) for c in line) for line in code[start:end].split("\n"))


def lines_with_code(code: str, script: bool = False) -> list[tuple[int, int, int]]:
    """line, start, end of the physical lines of comment-free code that hold anything."""
    out, at = [], 0
    for line, stop in enumerate([*line_ends(code, script), len(code)], 1):
        if any(not is_blank(c, script) for c in code[at:stop]):
            out.append((line, at, stop))
        at = stop
    return out


def by_bucket(code: str, tests: list[tuple[int, int]], script: bool = False) -> list[tuple[int, str]]:
    """Source lines by bucket: a line with code inside and outside the test spans is in both."""
    out = []
    for line, a, b in lines_with_code(code, script):
        inside = {any(s <= i < e for s, e in tests) for i in range(a, b) if not is_blank(code[i], script)}
        out += [(line, "tests" if t else "source") for t in sorted(inside)]
    return out


def flat(functions: list[Function], bucket: str = "source") -> list[dict]:
    """Functions as rows in pre-order: number, parent's number, depth, order among all, and values."""
    rows: list[dict] = []

    def visit(f: Function, parent: int | None, depth: int, above: str) -> None:
        own = "tests" if above == "tests" else f.bucket or above
        k = len(rows)
        rows.append({"ord": k, "parent": parent, "depth": depth, "name": f.name, "bucket": own, "line": f.line, "cc": f.cc, "sloc": f.sloc})
        for g in f.nested:
            visit(g, k, depth + 1, own)

    for f in functions:
        visit(f, None, 0, bucket)
    return rows


def module_json(modules: list[Module]) -> str:
    return json.dumps([asdict(m) for m in modules])


ANALYSERS: dict[str, Callable[[str, bytes], Result]] = {}


def analyser(language: str):
    def add(f):
        ANALYSERS[language] = f
        return f

    return add
