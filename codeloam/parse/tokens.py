"""Lexed text as tokens with bracket partners, for parsers that work on structure alone."""

from __future__ import annotations

from bisect import bisect_right

from .common import Function


class Tokens:
    """kind, text and span of each token; partner of each bracket; the bracket around each token."""

    OPEN = {"(": ")", "[": "]", "{": "}"}

    def __init__(self, text: str, lexed: list[tuple[str, int, int]], line_starts: list[int]):
        self.text, self.lines = text, line_starts
        self.kind = [k for k, _, _ in lexed]
        self.span = [(a, b) for _, a, b in lexed]
        self.word = [text[a:b] for a, b in self.span]
        self.partner: dict[int, int] = {}
        self.around: list[int] = []
        stack: list[int] = []
        for i, (kind, w) in enumerate(zip(self.kind, self.word)):
            if kind == "close":
                opener = stack.pop() if stack else -1
                if opener < 0 or self.kind[opener] != "open":
                    raise SyntaxError(f"unmatched markup in line {self.line(i)}")
                self.partner[opener], self.partner[i] = i, opener
            closes = kind == "sign" and w in ")]}" or kind == "template" and w[0] == "}"
            if closes:
                opener = stack.pop() if stack else -1
                right = "}`" if opener >= 0 and self.kind[opener] == "template" else self.OPEN.get(self.word[opener]) if opener >= 0 else None
                if right is None or (right == "}`") != (kind == "template") or kind == "sign" and right != w:
                    raise SyntaxError(f"unmatched {w[:10]!r} in line {self.line(i)}")
                self.partner[opener] = i
                if not (kind == "template" and w.endswith("${")):
                    self.partner[i] = opener
            self.around.append(stack[-1] if stack else -1)
            if kind == "open" or kind == "sign" and w in self.OPEN or kind == "template" and w.endswith("${"):
                stack.append(i)
        if stack:
            raise SyntaxError(f"missing end of {self.word[stack[-1]][:10]!r} in line {self.line(stack[-1])}")

    def __len__(self) -> int:
        return len(self.kind)

    def at(self, i: int) -> str:
        """The token, empty outside; strings never look like signs or words."""
        return self.word[i] if 0 <= i < len(self.kind) and self.kind[i] in ("word", "sign") else "\0" if 0 <= i < len(self.kind) else ""

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.span[i][0])

    def end_line(self, i: int) -> int:
        return bisect_right(self.lines, self.span[i][1] - 1)

    def breaks(self, i: int) -> bool:
        """Whether token i stands on a later line than the one before it ends on."""
        return i > 0 and self.line(i) > self.end_line(i - 1)

    def next(self, i: int) -> int:
        """The token behind i, or behind the bracket that i opens."""
        p = self.partner.get(i, -1)
        while p > i and self.partner.get(p, -1) > p:
            p = self.partner[p]  # the middle of a template
        return p + 1 if p > i else i + 1

    def parts(self, i: int) -> list[tuple[int, int]]:
        """The pieces around each expression of the template that i opens."""
        out = []
        while self.partner.get(i, -1) > i:
            out.append((i, self.partner[i]))
            i = self.partner[i]
        return out

    def split(self, a: int, b: int, sign: str = ",") -> list[tuple[int, int]]:
        """The ranges between signs at the level of a; an empty last one is left out."""
        out, start, i = [], a, a
        while i < b:
            if self.at(i) == sign:
                out.append((start, i))
                start = i + 1
            i = self.next(i)
        return out + ([(start, b)] if start < b else [])

    def find(self, a: int, b: int, *signs: str) -> int:
        """The first of the signs at the level of a, or b."""
        i = a
        while i < b and self.at(i) not in signs:
            i = self.next(i)
        return min(i, b)

    def source(self, a: int, b: int) -> str:
        return "".join(self.text[self.span[a][0] : self.span[b - 1][1]].split()) if a < b else ""


def nest(found: list[tuple[int, int, str]], tokens: Tokens) -> tuple[list[Function], list[Function]]:
    """Functions by first and last token as a forest, in order of their start, and all of them."""
    top: list[Function] = []
    all_: list[Function] = []
    stack: list[tuple[int, Function]] = []
    for a, b, name in sorted(found, key=lambda f: (f[0], -f[1])):
        while stack and stack[-1][0] < a:
            stack.pop()
        f = Function(name, tokens.line(a), tokens.span[a][0], tokens.span[b][1])
        (stack[-1][1].nested if stack else top).append(f)
        all_.append(f)
        stack.append((b, f))
    return top, all_


def count_decisions(functions: list[Function], tokens: Tokens, decisions: set[int]) -> None:
    """Each decision goes to the innermost function around it."""
    ordered = sorted(functions, key=lambda f: (f.start, -f.end))
    k, open_ = 0, []
    for i in sorted(decisions):
        a = tokens.span[i][0]
        while k < len(ordered) and ordered[k].start <= a:
            open_.append(ordered[k])
            k += 1
        while open_ and open_[-1].end <= a:
            open_.pop()
        if open_:
            open_[-1].decisions += 1
