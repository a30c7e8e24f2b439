"""Go: a lexer by the language's token rules, and functions found by their brackets."""

from __future__ import annotations

import re

from .common import Function, Result, Token, analyser, blank_spans, by_bucket, sloc

_LEX = re.compile(
    r"""(?P<blank>[ \t\r\n]+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<rune>'(?:[^'\\\n]|\\.[^'\n]*)')"""
    r"""|(?P<number>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?|0[bBoO][0-9_]+)i?)"""
    r"""|(?P<word>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)|(?P<sign>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|&\^|<<|>>|[-+*/%&|^]=|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.S,
)
#: The language's keywords, and the tokens behind which a line end ends a statement.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset({"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"})
_DECISIONS = frozenset({"if", "for", "case", "&&", "||"})
_HEADS = frozenset({"if", "for", "switch", "select", "case", "range"})
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class _Lexed:
    """Tokens as (kind, start, end) with bracket partners, enclosing brackets and statement ends."""

    def __init__(self, text: str):
        self.text, self.kind, self.span, self.comments, self.ended = text, [], [], [], []
        at, pending = 0, False
        while at < len(text):
            m = _LEX.match(text, at)
            if m is None or m.end() == at:
                raise SyntaxError(f"unexpected character at byte {at}")
            kind, at = m.lastgroup, m.end()
            if kind == "comment":
                self.comments.append(m.span())
            if kind in ("blank", "comment"):
                pending = pending or "\n" in m.group()
                continue
            self.ended.append(pending and bool(self.kind) and self._ends(len(self.kind) - 1))
            pending = False
            self.kind.append(kind)
            self.span.append(m.span())
        self.partner, self.around, self.composite, stack = {}, [], set(), []
        for i in range(len(self.kind)):
            t = self.word(i)
            if self.kind[i] == "sign" and t in ")]}":
                if not stack or _PAIRS[self.word(stack[-1])] != t:
                    raise SyntaxError(f"unmatched {t!r}")
                opener = stack.pop()
                self.partner[opener], self.partner[i] = i, opener
            self.around.append(stack[-1] if stack else -1)
            if self.kind[i] == "sign" and t in _PAIRS:
                stack.append(i)
        if stack:
            raise SyntaxError("missing closing bracket")

    def word(self, i: int) -> str:
        return self.text[slice(*self.span[i])] if 0 <= i < len(self.span) else ""

    def _ends(self, i: int) -> bool:
        return self.kind[i] in ("raw", "string", "rune", "number") or (self.kind[i] == "word" and (w := self.word(i)) not in KEYWORDS) or self.word(i) in _ENDS

    def source(self, a: int, b: int) -> str:
        """Text of tokens a up to, not with, b."""
        return self.text[self.span[a][0] : self.span[b - 1][1]] if a < b else ""

    def skip_type(self, i: int) -> int:
        """The token behind a type that starts at i; i itself if none does."""
        w = self.word(i)
        if w in ("*", "<-", "~"):
            return self.skip_type(i + 1)
        if w == "(":
            return self.partner[i] + 1
        if w == "[":
            return self.skip_type(self.partner[i] + 1)
        if w in ("struct", "interface"):
            return self.partner[i + 1] + 1
        if w == "map":
            return self.skip_type(self.partner[i + 1] + 1)
        if w == "chan":
            return self.skip_type(i + 2 if self.word(i + 1) == "<-" else i + 1)
        if w == "func":
            return self.skip_signature(i + 1)
        if i < len(self.kind) and self.kind[i] == "word" and w not in KEYWORDS:
            i += 1
            while self.word(i) == ".":
                i += 2
            return self.partner[i] + 1 if self.word(i) == "[" else i
        return i

    def skip_signature(self, i: int) -> int:
        if self.word(i) != "(":
            raise SyntaxError("expected parameters")
        return self.skip_type(self.partner[i] + 1)


def _statement_start(x: _Lexed, i: int) -> int:
    """The first token of the statement, clause or element that token i stands in, within its brackets."""
    level = x.around[i]
    j = i
    while j - 1 > level:
        p = j - 1
        if x.kind[p] == "sign" and x.word(p) in ")]}":
            if x.ended[j] and x.word(p) == "}" or x.ended[j]:
                return j
            j = x.partner[p]
            continue
        if x.ended[j] or x.word(p) == ";" or (x.word(p) == ":" and x.word(_clause(x, p, level)) in ("case", "default")):
            return j
        j = p
    return j


def _clause(x: _Lexed, colon: int, level: int) -> int:
    j = colon - 1
    while j > level and x.word(j) not in ("case", "default", ";", "{"):
        j = x.partner[j] if x.kind[j] == "sign" and x.word(j) in ")]}" else j
        if x.ended[j]:
            break
        j -= 1
    return j if j > level else -1


def _operand_start(x: _Lexed, end: int) -> int:
    """The first token of the operand whose last token is `end`."""
    j = end
    while j >= 0:
        w = x.word(j)
        if x.kind[j] == "sign" and w in ")]}":
            j = x.partner[j]
            before = x.word(j - 1)
            if j and not x.ended[j] and (x.kind[j - 1] == "word" and before not in KEYWORDS or before in (")", "]", "}")):
                j -= 1
                continue
            return j
        if j >= 2 and x.word(j - 1) == "." and not x.ended[j]:
            j -= 2
            continue
        return j
    return 0


def _elements(x: _Lexed, opener: int, at: int) -> tuple[int, int]:
    """Which element of a bracket's list token `at` lies in, and how many there are."""
    index = commas = 0
    j, close = opener + 1, x.partner[opener]
    while j < close:
        if x.word(j) == "," and x.kind[j] == "sign":
            commas += 1
            index += j < at
            if j + 1 == close:
                commas -= 1
        j = x.partner[j] + 1 if x.kind[j] == "sign" and x.word(j) in _PAIRS else j + 1
    return index, commas + 1


def _top_level(x: _Lexed, a: int, b: int, signs: tuple[str, ...]) -> list[int]:
    out, j = [], a
    while j < b:
        if x.kind[j] == "sign":
            if x.word(j) in signs:
                out.append(j)
            if x.word(j) in _PAIRS:
                j = x.partner[j]
        j += 1
    return out


def _assigned(x: _Lexed, start: int, at: int) -> str | None:
    """The target that the value at token `at` of a statement goes to."""
    signs = _top_level(x, start, at, ("=", ":="))
    if not signs:
        return None
    sign = signs[-1]
    while x.word(start) in KEYWORDS and x.word(start) != "func":
        start += 1
    names = _top_level(x, start, sign, (",",))
    edges = [start - 1, *names, sign]
    index = len(_top_level(x, sign + 1, at, (",",)))
    if index >= len(edges) - 1:
        return None
    a, b = edges[index] + 1, edges[index + 1]
    declared = x.word(start - 1) == "var" or x.word(x.around[at] - 1) == "var"
    return x.word(a) if declared else x.source(a, b).strip()


def _literal_name(x: _Lexed, func: int, bodies: set[int]) -> str:
    suffix, at = "", func
    while True:
        opener = x.around[at]
        if opener >= 0 and x.word(opener) == "(":
            before = opener - 1
            called = before >= 0 and (x.kind[before] == "word" and x.word(before) not in KEYWORDS or x.word(before) in (")", "]", "}"))
            if called:
                index, count = _elements(x, opener, at)
                start = _operand_start(x, before)
                callee = "".join(x.source(start, opener).split())
                suffix = f".cb:{callee}{f'[{index}]' if count > 1 else ''}{suffix}"
                at = start
                continue
            if x.word(before) not in ("var", "const"):
                at = opener
                continue
        if opener >= 0 and x.word(opener) == "{" and opener not in bodies and _is_literal(x, opener):
            start = opener + 1
            for comma in _top_level(x, opener + 1, at, (",",)):
                start = comma + 1
            colon = _top_level(x, start, at, (":",))
            if colon:
                suffix = "." + x.source(start, colon[0]).strip("\"'`") + suffix
            else:
                suffix = f"[{_elements(x, opener, at)[0]}]{suffix}"
            at = _type_start(x, opener)
            continue
        if opener >= 0 and x.word(opener) == "[":
            at = opener
            continue
        target = _assigned(x, _statement_start(x, at), at)
        if target:
            return target + suffix
        return suffix.removeprefix(".") or "(anonymous)"


def _type_start(x: _Lexed, opener: int) -> int:
    """The first token of the type in front of a composite literal's brace, or the brace."""
    j = opener - 1
    if j < 0 or x.word(j) in ("{", ",", ":", "(", "="):
        return opener
    start = _operand_start(x, j)
    while start and (x.word(start - 1) in ("]", "*", "&", "func", "map")):
        start = x.partner[start - 1] if x.word(start - 1) == "]" else start - 1
    if start and x.word(start - 1) == "map":
        start -= 1
    return start


def _is_literal(x: _Lexed, opener: int) -> bool:
    """Whether a brace opens a composite literal rather than a block."""
    before = x.word(opener - 1)
    if opener in x.composite:
        return True
    if before in ("{", ",", ":") and x.word(x.around[opener]) == "{":
        return True
    if opener == 0 or before == ")" or before in KEYWORDS and before not in ("struct", "interface"):
        return False
    start = _statement_start(x, opener)
    while start > 1 and x.word(start - 1) == ";" and x.around[start - 1] == x.around[opener]:
        start = _statement_start(x, start - 2)  # a header has up to three parts
    return x.word(start) not in _HEADS and x.word(start) not in ("else", "func", "type") or x.around[opener] >= 0 and x.word(x.around[opener]) in "(["


def _receiver(x: _Lexed, opener: int) -> str:
    """The type's name in a receiver."""
    j = x.partner[opener] - 1
    while x.word(j) in (")", "]"):
        j = x.partner[j] - 1 if x.word(j) == "]" else j - 1
    return x.word(j) if x.kind[j] == "word" else "(anonymous)"


def _string_tokens(text: str, start: int) -> list[tuple[int, int]]:
    """Quote, content and escapes, quote."""
    last = start + len(text) - 1
    spans = [(start, start + 1)]
    if text[0] == "`":
        if len(text) > 2:
            spans.append((start + 1, last))
    else:
        for m in re.finditer(r"\\x[^\n]{0,2}|\\u[^\n]{0,4}|\\U[^\n]{0,8}|\\[0-7][^\n]{0,2}|\\.|[^\\]+", text[1:-1], re.S):
            spans.append((start + 1 + m.start(), start + 1 + m.end()))
    return [*spans, (last, last + 1)]


@analyser("go")
def analyse(path: str, content: bytes) -> Result:
    """Any syntax error that this parser sees is an error of the whole scan."""
    text = content.removeprefix(b"\xef\xbb\xbf").decode("latin-1")
    try:
        x = _Lexed(text)
        functions = _functions(x)
    except (SyntaxError, KeyError, IndexError) as error:
        return Result(error=f"{path}: invalid Go: {error}")
    result = Result(functions=functions[0])
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]

    def line(offset: int) -> int:
        from bisect import bisect_right

        return bisect_right(starts, offset)

    for kind, (a, b) in zip(x.kind, x.span):
        for c, d in _string_tokens(text[a:b], a) if kind in ("raw", "string") else [(a, b)]:
            result.tokens.append(Token(text[c:d].encode("latin-1"), line(c), line(c) + text.count("\n", c, d)))
    code = blank_spans(text.replace("\x85", "~").replace("\xa0", "~"), x.comments)
    for f in functions[1]:
        f.line, f.sloc = line(f.start), sloc(code, f.start, f.end)
    result.source_lines = by_bucket(code, [])
    return result


def _functions(x: _Lexed) -> tuple[list[Function], list[Function]]:
    """Outermost functions with the nested ones in them, and all of them."""
    found: list[tuple[int, int, str]] = []
    bodies: set[int] = set()
    literals = []
    for i in range(len(x.kind)):
        if x.kind[i] != "word" or x.word(i) != "func":
            continue
        if i and x.word(i - 1) == "]" and not x.ended[i]:
            opener = x.skip_signature(i + 1)  # the type of a literal's elements
            if x.word(opener) == "{" and not x.ended[opener]:
                x.composite.add(opener)
            continue
        if x.around[i] < 0 and x.word(i + 1) != "(" or x.around[i] < 0 and x.kind[x.partner[i + 1] + 1] == "word" and x.word(x.partner[i + 1] + 2) in ("(", "["):
            if _statement_start(x, i) != i:
                continue
            j = i + 1
            owner = ""
            if x.word(j) == "(":
                owner = _receiver(x, j) + "."
                j = x.partner[j] + 1
            name = owner + x.word(j)
            j += 1
            if x.word(j) == "[":
                j = x.partner[j] + 1
            body = x.skip_signature(j)
            if x.word(body) == "{" and not x.ended[body]:
                bodies.add(body)
                found.append((i, x.partner[body], name.encode("latin-1").decode("utf-8", "replace")))
        else:
            body = x.skip_signature(i + 1)
            if x.word(body) == "{" and body < len(x.kind) and not x.ended[body]:
                bodies.add(body)
                literals.append((i, x.partner[body]))
    found += [(a, b, _literal_name(x, a, bodies).encode("latin-1").decode("utf-8", "replace")) for a, b in literals]
    found.sort()
    top: list[Function] = []
    everything, stack = [], []
    for a, b, name in found:
        while stack and stack[-1][0] < a:
            stack.pop()
        f = Function(name, 0, x.span[a][0], x.span[b][1])
        (stack[-1][1].nested if stack else top).append(f)
        everything.append(f)
        stack.append((b, f))
    spans = sorted(((f.start, f.end, f) for f in everything), key=lambda s: s[0])
    k, open_ = 0, []
    for i in range(len(x.kind)):
        a = x.span[i][0]
        while k < len(spans) and spans[k][0] <= a:
            open_.append(spans[k])
            k += 1
        while open_ and open_[-1][1] <= a:
            open_.pop()
        if open_ and x.word(i) in _DECISIONS and x.kind[i] in ("word", "sign"):
            open_[-1][2].decisions += 1
    return top, everything
