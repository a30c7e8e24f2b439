"""TypeScript and JavaScript: a lexer that tells expressions from divisions, and a walk over statements and members."""

from __future__ import annotations

import re

from .common import Result, Token, analyser, blank_spans, lines_with_code, line_ends
from .tokens import Tokens, count_decisions, nest

_LEX = re.compile(
    r"""(?P<blank>[\s\ufeff]+)|(?P<comment>//[^\n\r\u2028\u2029]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n]|\\(?:\r\n|.))*"|'(?:[^'\\\n]|\\(?:\r\n|.))*')"""
    r"""|(?P<number>0[xXbBoO][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?)|(?P<word>[#@]?(?:[^\W\d]|\$|\\u)(?:[\w$\u200c\u200d]|\\u(?:\{[0-9a-fA-F]+\})?)*)"""
    r"""|(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]])""",
    re.S,
)
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{)", re.S)
_TAG = re.compile(r"[^\W\d][\w$-]*(?:[.:][^\W\d][\w$-]*)*|\$[\w$-]*(?:\.[\w$-]+)*")
_ATTRIBUTE = re.compile(r"[^\W\d][\w$-]*(?::[\w$-]+)?|\$[\w$-]*")
_TYPE_ARGUMENTS = re.compile(r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_CHARACTERS = re.compile(r"[^<>{}]+")
_END = re.compile(">")
_ANY = re.compile(".", re.S)
#: Dialects that may hold markup.
MARKUP = ("typescript:tsx", "typescript:jsx", "typescript:js", "typescript:mjs", "typescript:cjs")
#: Words behind which an operand starts, those that open a control head, and member modifiers.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
_HEADS = frozenset("if for while switch catch with".split())
_MODIFIERS = frozenset("static public private protected readonly async override declare abstract accessor get set export default".split())
_TYPE_PREFIXES = frozenset("keyof typeof readonly unique infer new abstract asserts".split())
_BINARY = frozenset("&& || ??".split())


def lex(text: str, markup: bool = False) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Tokens and comments; a first line that starts with #! is a comment. With markup, elements are tokens too: the
    first and the last one of an outermost element are a pair of brackets, of kinds open and close."""
    lexer = _Lexer(text, markup)
    at = 0
    if text.startswith("#!"):
        at = (line_ends(text, True) or [len(text)])[0]
        lexer.comments.append((0, at))
    lexer.code(at)
    return lexer.out, lexer.comments


class _Lexer:
    def __init__(self, text: str, markup: bool):
        self.text, self.markup = text, markup
        self.out: list[tuple[str, int, int]] = []
        self.comments: list[tuple[int, int]] = []
        self.not_markup: set[int] = set()

    def code(self, at: int, inner: bool = False) -> int:
        """To the end of the text, or behind the brace that closes the one in front of at."""
        text, out = self.text, self.out
        braces: list[bool] = []  # whether each open brace belongs to a template
        while at < len(text):
            c = text[at]
            if c == "`" or c == "}" and braces and braces[-1]:
                m = _TEMPLATE.match(text, at + 1)
                if not m:
                    raise SyntaxError("unterminated template")
                if c == "}":
                    braces.pop()
                if m.group().endswith("${"):
                    braces.append(True)
                out.append(("template", at, m.end()))
                at = m.end()
                continue
            if c == "/" and text[at : at + 2] not in ("//", "/*") and not _operand_end(out, text):
                m = _REGEX.match(text, at)
                if m:
                    out.append(("regex", *m.span()))
                    at = m.end()
                    continue
            if c == "<" and self.markup and at not in self.not_markup and not _operand_end(out, text):
                kept = len(out), len(self.comments)
                try:
                    at = self.element(at, True)
                    continue
                except SyntaxError:  # type parameters
                    del out[kept[0] :], self.comments[kept[1] :]
                    self.not_markup.add(at)
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise SyntaxError(f"unexpected {c!r}")
            if m.lastgroup == "comment":
                self.comments.append(m.span())
            elif m.lastgroup != "blank":
                out.append((m.lastgroup, *m.span()))
                if c == "{":
                    braces.append(False)
                elif c == "}" and braces:
                    braces.pop()
                elif c == "}" and inner:
                    return m.end()
            at = m.end()
        if inner:
            raise SyntaxError("missing end of '{'")
        return at

    def blank(self, at: int) -> int:
        """Behind blanks and comments inside a tag."""
        while (m := _LEX.match(self.text, at)) and m.lastgroup in ("blank", "comment"):
            if m.lastgroup == "comment":
                self.comments.append(m.span())
            at = m.end()
        return at

    def mark(self, at: int, pattern: re.Pattern, kind: str = "markup") -> int:
        m = pattern.match(self.text, at)
        if not m:
            raise SyntaxError(f"unexpected {self.text[at : at + 1]!r} in markup")
        self.out.append((kind, *m.span()))
        return m.end()

    def braced(self, at: int) -> int:
        self.out.append(("sign", at, at + 1))
        return self.code(at + 1, True)

    def element(self, at: int, outermost: bool = False) -> int:
        """An element or fragment from its first < on."""
        text = self.text
        self.out.append(("open" if outermost else "markup", at, at + 1))
        at = self.blank(at + 1)
        name = ""
        if text[at : at + 1] != ">":
            begin = at
            at = self.blank(self.mark(at, _TAG))
            name = text[begin : self.out[-1][2]]
            if text[at : at + 1] == "<":
                at = self.blank(self.mark(at, _TYPE_ARGUMENTS))
            while text[at : at + 1] not in ("/", ">"):
                if text[at : at + 1] == "{":
                    at = self.blank(self.braced(at))
                    continue
                at = self.blank(self.mark(at, _ATTRIBUTE))
                if text[at : at + 1] == "=":
                    at = self.blank(self.mark(at, _ANY))
                    c = text[at : at + 1]
                    at = self.blank(self.braced(at) if c == "{" else self.element(at) if c == "<" else self.mark(at, _QUOTED))
            if text[at] == "/":
                at = self.blank(self.mark(at, _ANY))
                return self.mark(at, _END, "close" if outermost else "markup")
        at = self.mark(at, _END)
        while at < len(text):
            c = text[at]
            if c == "{":
                at = self.braced(at)
            elif c != "<":
                m = _CHARACTERS.match(text, at)
                if not m:
                    raise SyntaxError(f"unexpected {c!r} in markup")
                if m.group().strip():
                    self.out.append(("markup", *m.span()))
                at = m.end()
            elif text[(after := self.blank(at + 1)) : after + 1] != "/":
                at = self.element(at)
            else:
                at = self.blank(self.mark(self.blank(self.mark(at, _ANY)), _ANY))
                if name:
                    begin = at
                    at = self.blank(self.mark(at, _TAG))
                    if text[begin : self.out[-1][2]] != name:
                        raise SyntaxError(f"missing end of <{name}>")
                return self.mark(at, _END, "close" if outermost else "markup")
        raise SyntaxError(f"missing end of <{name}>")


def _operand_end(out: list, text: str) -> bool:
    if not out:
        return False
    kind, a, b = out[-1]
    w = text[a:b]
    if kind == "word":
        return w not in _BEFORE_OPERAND
    if kind == "template":
        return w.endswith("`")
    return kind in ("string", "number", "regex", "close") or w in (")", "]", "}")


def _join(owner: str | None, name: str) -> str:
    return f"{owner}.{name}" if owner else name


class _Walk:
    """Finds functions with their names. A hint is the name that the next function in its place takes."""

    def __init__(self, t: Tokens, markup: bool = False):
        self.t, self.found, self.types = t, [], []
        for i in range(len(t)):  # type parameters in front of parameters are brackets
            if t.at(i) == "<" and not self.operand_end(i - 1):
                stop = self.angles(i, len(t))
                if t.at(stop) == "(":
                    t.partner[i], t.partner[stop - 1] = stop - 1, i
                elif markup:  # neither an element nor type parameters
                    raise SyntaxError(f"unexpected '<' in line {t.line(i)}")

    def angles(self, i: int, end: int) -> int:
        """Behind the > that closes the < at i; i where none does."""
        t, level, j = self.t, 0, i
        while j < end and t.at(j) not in (";", ")", "]", "}"):
            level += (t.at(j) == "<") - (t.at(j) == ">")
            j = j + 1 if t.at(j) == "<" else t.next(j)
            if not level:
                return j
        return i

    def type_end(self, i: int, end: int) -> int:
        """Behind a type that starts at i and stands inside an expression."""
        t, operand = self.t, False
        while i < end:
            w = t.at(i)
            if w == "<":
                stop = self.angles(i, end)
                if stop == i:
                    return i
                i = stop
            elif not operand and (w in ("|", "&", "-", "=>") or w in _TYPE_PREFIXES and t.kind[i + 1 : i + 2] and t.at(i + 1) not in (")", "]", "}", ",", ";", ".", "[", "|", "&")):
                i += 1
            elif not operand:
                if t.kind[i] == "sign" and w not in ("(", "[", "{"):
                    return i
                i, operand = t.next(i), True
                if w == "(" and t.at(i) == "=>":
                    i, operand = i + 1, False
            elif w in (".", "|", "&"):
                i, operand = i + 1, False
            elif w == "[" and not t.breaks(i):
                i = t.next(i)
            else:
                return i
        return i

    def operand_end(self, i: int) -> bool:
        if i < 0:
            return False
        t = self.t
        if t.kind[i] == "word":
            return t.word[i] not in _BEFORE_OPERAND and t.word[i] not in _HEADS
        return t.kind[i] in ("string", "number", "regex", "template", "close") or t.at(i) in (")", "]", "}")

    def statement_end(self, i: int, end: int) -> int:
        """Behind the last token of an expression statement: at a semicolon, or where a line end must end it."""
        t, j = self.t, i
        while j < end:
            if t.at(j) == ";":
                return j
            if j > i and t.breaks(j) and self.operand_end(j - 1) and (t.kind[j] in ("word", "number", "string") and t.at(j) not in ("in", "of", "instanceof", "as", "extends", "satisfies") or t.at(j) in ("{", "++", "--", "!")):
                return j
            j = t.next(j)
        return end

    def block(self, i: int, end: int, prefix: str | None) -> None:
        t = self.t
        while i < end:
            w, ahead = t.at(i), t.at(i + 1)
            if w == ";":
                i += 1
            elif w == "{":
                self.block(i + 1, t.partner[i], prefix)
                i = t.next(i)
            elif w in ("export", "default", "declare", "abstract", "else", "try", "finally", "do") and ahead not in (":", "=", "("):
                i += 1
            elif t.kind[i] == "word" and w.startswith("@"):
                i += 1
                while t.at(i) in (".", "(") or t.at(i - 1) == ".":
                    if t.at(i) == "(":
                        self.arguments(i, None, w[1:])
                    i = t.next(i)
            elif w == "async" and ahead == "function":
                i = self.function(i, end, None, prefix)
            elif w == "function":
                i = self.function(i, end, None, prefix)
            elif w == "class":
                i = self.class_(i, end, None, prefix)
            elif w in ("namespace", "module") and t.kind[i + 1 : i + 2] in (["word"], ["string"]) and not t.breaks(i + 1):
                body = t.find(i, end, "{")
                self.block(body + 1, t.partner.get(body, body), _join(prefix, t.source(i + 1, body)))
                i = t.next(body)
            elif w in ("interface", "enum") and t.kind[i + 1 : i + 2] == ["word"]:
                body = t.find(i, end, "{")
                self.types.append((i, t.partner.get(body, body)))
                i = t.next(body)
            elif w == "type" and t.kind[i + 1 : i + 2] == ["word"] and t.at(i + 2) in ("=", "<"):
                stop = self.statement_end(i, end)
                self.types.append((i, stop))
                i = stop
            elif w == "import" and ahead not in ("(", "."):
                i = self.statement_end(i, end)
            elif w in _HEADS and (ahead == "(" or ahead == "await"):
                head = t.find(i, end, "(")
                self.block(head + 1, t.partner[head], None) if w == "for" else self.expression(head + 1, t.partner[head], None)
                i = t.next(head)
            elif w == "catch":
                i += 1
            elif w in ("case", "default"):
                stop = t.find(i, end, ":")
                self.expression(i + 1, stop, None)
                i = stop + 1
            elif t.kind[i] == "word" and ahead == ":" and w not in _BEFORE_OPERAND:
                i += 2
            else:
                stop = max(self.statement_end(i, end), i + 1)
                if w in ("const", "let", "var", "using"):
                    for a, b in t.split(i + 1, stop):
                        self.declared(a, b)
                else:
                    self.expression(i + (w in ("return", "throw")), stop, None)
                i = stop

    def declared(self, a: int, b: int) -> None:
        t = self.t
        eq = t.find(a, b, "=")
        colon = t.find(a, eq, ":")
        if t.at(a) in ("{", "["):
            self.expression(a + 1, t.partner[a], None)
            self.expression(eq + 1, b, None)
        else:
            if colon < eq:
                self.types.append((colon, eq))
            self.expression(eq + 1, b, t.source(a, a + 1))

    def function(self, i: int, end: int, hint: str | None, prefix: str | None = None) -> int:
        """A function whose first token is i; returns what follows it."""
        t, start = self.t, i
        while t.at(i) in ("async", "function", "*"):
            i += 1
        name = t.word[i] if t.kind[i] == "word" and t.at(i) != "(" else ""
        full = _join(hint or prefix, name) if name else hint or "(anonymous)"
        return self.body(start, t.find(i, end, "("), end, full)

    def body(self, start: int, params: int, end: int, name: str) -> int:
        """A function from its parameters on; without a body it is only a signature."""
        t = self.t
        if params >= end:
            return end
        self.parameters(params)
        i = t.partner[params] + 1
        if t.at(i) == ":":
            stop = i + 1
            while stop < end and t.at(stop) != ";":
                opens = t.at(stop) == "{" and stop > i + 1 and t.at(stop - 1) not in (":", "|", "&", "<", "=>", ",", "is")
                if opens or t.breaks(stop) and self.operand_end(stop - 1) and t.at(stop) not in ("{", "|", "&", "=>", ">"):
                    break
                stop = t.next(stop)
            self.types.append((i, stop))
            i = stop
        if t.at(i) != "{":
            return i
        self.found.append((start, t.partner[i], name))
        self.block(i + 1, t.partner[i], None)
        return t.partner[i] + 1

    def parameters(self, opener: int) -> None:
        t = self.t
        for a, b in t.split(opener + 1, t.partner[opener]):
            eq = t.find(a, b, "=")
            colon = t.find(a, eq, ":")
            if colon < eq:
                self.types.append((colon, eq))
            elif t.at(a) in ("{", "["):
                self.expression(a + 1, t.partner[a], None)
            if eq < b:
                self.expression(eq + 1, b, t.source(a, a + 1))

    def class_(self, i: int, end: int, hint: str | None, prefix: str | None = None) -> int:
        t = self.t
        name = t.word[i + 1] if t.kind[i + 1] == "word" and t.at(i + 1) not in ("extends", "implements") else ""
        body = i + 1
        while body < end and t.at(body) != "{":
            if t.at(body) == "(":
                self.arguments(body, None, t.source(body - 1, body))
            body = t.next(body)
        if body >= end:
            return end
        owner = _join(hint or prefix, name) if name else hint or prefix or "(anonymous)"
        self.members(body, owner, False)
        return t.partner[body] + 1

    def members(self, opener: int, owner: str | None, literal: bool) -> None:
        """Members of a class, or of an object literal."""
        t, end, i = self.t, self.t.partner[opener], opener + 1
        while i < end:
            if t.at(i) in (";", ","):
                i += 1
                continue
            if t.kind[i] == "word" and t.word[i].startswith("@"):
                i = t.next(i + 1) if t.at(i + 1) == "(" else i + 1
                continue
            if t.at(i) == "...":
                stop = t.find(i, end, ",")
                self.expression(i + 1, stop, None)
                i = stop
                continue
            start, words = i, []
            while t.at(i) in _MODIFIERS and t.at(i + 1) not in ("(", ":", "=", ",", ";", "?", "!", "<", "}"):
                words.append(t.at(i))
                i += 1
                if t.at(i - 1) == "static" and t.at(i) == "{":
                    self.block(i + 1, t.partner[i], owner)
                    break
            if words[-1:] == ["static"] and t.at(i) == "{":
                i = t.next(i)
                continue
            if t.at(i) == "*":
                i += 1
            if i >= end:
                return
            computed = t.at(i) == "["
            stop = t.next(i)
            if computed:
                self.expression(i + 1, stop - 1, None)
            key = t.source(i, stop).strip("\"'")
            lead = "".join(f"{w} " for w in words if w in ("static", "get", "set", "accessor"))
            name = _join(owner, lead + key)
            i = stop
            while t.at(i) in ("?", "!"):
                i += 1
            if t.at(i) == "<":
                i = t.find(i, end, "(")
            if t.at(i) == "(":
                i = self.body(start, i, end, name)
            elif literal:
                stop = t.find(i, end, ",")
                self.expression(i + 1, stop, name)
                i = stop
            else:
                stop = max(self.statement_end(i, end), i)
                eq = t.find(i, stop, "=")
                if t.at(i) == ":":
                    self.types.append((i, eq))
                self.expression(eq + 1, stop, name)
                i = max(stop, start + 1)

    def arguments(self, opener: int, hint: str | None, callee: str) -> None:
        t = self.t
        given = t.split(opener + 1, t.partner[opener])
        for k, (a, b) in enumerate(given):
            self.expression(a, b, _join(hint, f"cb:{callee}{f'[{k}]' if len(given) > 1 else ''}"))

    def operand_start(self, i: int) -> int:
        """The first token of the operand that ends with token i."""
        t = self.t
        while i > 0:
            if t.at(i) in (")", "]", "}"):
                i = t.partner[i]
                if not self.operand_end(i - 1):
                    return i
                i -= 1
            elif t.at(i - 1) in (".", "?."):
                i -= 2
            elif t.at(i) == "!" and self.operand_end(i - 1):
                i -= 1
            else:
                return i
        return i

    def arrow(self, i: int, end: int) -> int:
        """The => of an arrow function whose parameters start at i, or -1."""
        t = self.t
        if t.kind[i] == "word" and t.at(i + 1) == "=>":
            return i + 1
        if t.at(i) == "<":
            i = t.find(i, end, "(")
        if i >= end or t.at(i) != "(":
            return -1
        j = t.partner[i] + 1
        if t.at(j) == "=>":
            return j
        if t.at(j) == ":":
            k = j + 1
            while k < end and t.at(k) not in ("=>", ",", ";", "=", "?", ":"):
                k = t.next(k)
            if k < end and t.at(k) == "=>" and t.at(i - 1) != "?":
                return k
        return -1

    def markup(self, opener: int, hint: str | None) -> None:
        """An element: the expressions in its braces."""
        t, i = self.t, opener + 1
        while i < t.partner[opener]:
            if t.at(i) == "{":
                self.expression(i + 1, t.partner[i], hint)
            i = t.next(i)

    def expression(self, i: int, end: int, hint: str | None) -> None:
        """One expression; its outermost function, class or literal takes the hint."""
        t, first = self.t, i
        while i < end:
            w = t.at(i)
            fresh = i == first or not self.operand_end(i - 1)
            if fresh and (t.kind[i] == "word" or w in ("(", "<")):
                start = i
                at = i + 1 if w == "async" and not t.breaks(i + 1) and t.at(i + 1) not in ("=>", ".", ",", ")", "function") else i
                sign = self.arrow(at, end) if at < end else -1
                if sign >= 0:
                    if t.at(at) == "(":
                        self.parameters(at)
                    body = sign + 1
                    last = t.partner[body] if t.at(body) == "{" else end - 1
                    self.found.append((start, last, hint or "(anonymous)"))
                    if t.at(body) == "{":
                        self.block(body + 1, last, None)
                    else:
                        self.expression(body, end, None)
                    i = last + 1
                    continue
            if w in ("as", "satisfies") and not fresh and not t.breaks(i) and t.at(i - 1) not in (".", "?."):
                stop = max(self.type_end(i + 1, end), i + 1)
                self.types.append((i, stop))
                i = stop
            elif t.kind[i] == "open":
                self.markup(i, hint)
                i = t.next(i)
            elif w == "function" or w == "async" and t.at(i + 1) == "function":
                i = self.function(i, end, hint)
            elif w == "class" and fresh:
                i = self.class_(i, end, hint)
            elif w == "{" and fresh:
                self.members(i, hint, True)
                i = t.next(i)
            elif w == "[":
                if fresh:
                    for k, (a, b) in enumerate(t.split(i + 1, t.partner[i])):
                        self.expression(a, b, f"{hint or ''}[{k}]")
                else:
                    self.expression(i + 1, t.partner[i], None)
                i = t.next(i)
            elif w == "(":
                before = i - 1
                if not fresh or t.at(before) == "?." or t.at(before) in ("super", "import"):
                    before -= t.at(before) == "?."
                    self.arguments(i, hint, t.source(self.operand_start(before), before + 1))
                elif t.at(before) == ">" and i > first and t.find(first, i, "<") < i:
                    opened = max(k for k in range(first, i) if t.at(k) == "<" and t.around[k] == t.around[i])
                    self.arguments(i, hint, t.source(self.operand_start(opened - 1), opened))
                else:
                    self.expression(i + 1, t.partner[i], hint)
                i = t.next(i)
            elif t.kind[i] == "template" and i in t.partner and t.partner[i] > i:
                for a, b in t.parts(i):
                    self.expression(a + 1, b, None)
                i = t.next(i)
            elif w == "=" and i > first:
                self.expression(i + 1, end, t.source(self.operand_start(i - 1), i))
                return
            else:
                i += 1


def _decisions(t: Tokens, types: list[tuple[int, int]]) -> set[int]:
    skipped = set()
    for a, b in types:
        skipped.update(range(a, b))
    out = set()
    for i in range(len(t)):
        w = t.at(i)
        if i in skipped or w not in ("if", "for", "while", "do", "catch", "case", "?", "&&", "||", "??"):
            continue
        if t.at(i - 1) in (".", "?.") or w not in _BINARY and w != "?" and t.at(i + 1) in (":", ",", "}") and w != "do":
            continue
        if w == "while" and t.at(i - 1) in ("}", ";") and _closes_do(t, i):
            continue
        if w == "?" and (t.at(i + 1) in (":", ")", ",", "]", "=", ";", "}", "") or t.at(i + 1) == "(" and t.at(i - 1) not in (")", "]") and t.span[i][0] == t.span[i - 1][1] and t.span[i + 1][0] == t.span[i][1]):
            continue
        if w == "catch" and t.at(i + 1) not in ("(", "{"):
            continue
        out.add(i)
    return out


def _closes_do(t: Tokens, i: int) -> bool:
    if t.at(i - 1) == "}":
        return t.at(t.partner[i - 1] - 1) == "do"
    j, level = i - 1, t.around[i]
    while j > level and t.at(j - 1) not in (";", "{", "}"):
        if t.at(j) == "do":
            return True
        j -= 1
    return t.at(j) == "do"


@analyser("typescript")
def analyse(path: str, content: bytes, markup: bool = False) -> Result:
    """Any syntax error that this parser sees is an error of the whole scan."""
    try:
        text = content.decode("utf-8").removeprefix("\ufeff")
        lexed, comments = lex(text, markup)
        starts = [0, *line_ends(text, True)]
        t = Tokens(text, lexed, starts)
        walk = _Walk(t, markup)
        walk.block(0, len(t), None)
    except (SyntaxError, UnicodeDecodeError, KeyError, IndexError, RecursionError) as error:
        return Result(error=f"{path}: invalid script: {error}")
    top, all_ = nest(walk.found, t)
    count_decisions(all_, t, _decisions(t, walk.types))
    code = lines_with_code(blank_spans(text, comments), script=True)
    for f in all_:
        a, b = f.line, t.lines and len([s for s in starts if s < f.end])
        f.sloc = sum(a <= line <= b for line, _, _ in code)
    ends = len(line_ends(text, True))
    result = Result(functions=top, git_line_coordinates=text.count("\n") == ends, source_lines=[(line, "source") for line, _, _ in code])
    result.tokens = [Token(w.encode(), t.line(i), t.end_line(i)) for i, w in enumerate(t.word)]
    return result


def _analyse_markup(path: str, content: bytes) -> Result:
    """The same for dialects in which an operand that starts with < is an element."""
    return analyse(path, content, True)


for _dialect in MARKUP:
    analyser(_dialect)(_analyse_markup)
