"""Rust: a lexer, items and closures found by structure, test scopes by three-valued cfg logic."""

from __future__ import annotations

import re

from .common import Module, Result, Token, analyser, blank_spans, by_bucket, sloc
from .tokens import Tokens, count_decisions, nest

_LEX = re.compile(
    r"""(?P<blank>\s+)|(?P<comment>//[^\n]*)|(?P<raw>(?:b|c)?r(?P<hashes>\#*)".*?"(?P=hashes))|(?P<string>[bc]?"(?:[^"\\]|\\.)*")"""
    r"""|(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')|(?P<lifetime>'(?:[^\W\d])\w*)"""
    r"""|(?P<number>0[xob][0-9a-fA-F_]+\w*|[0-9][0-9_]*(?:\.(?![._\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*)|(?P<word>r\#\w+|(?:[^\W\d])\w*)"""
    r"""|(?P<sign>\.\.\.|\.\.=|<<=|>>=|=>|->|::|\.\.|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:;,.@\#$(){}\[\]\\])""",
    re.S,
)
#: Words behind which an expression starts.
_BEFORE_OPERAND = frozenset("return in if while match let mut move ref else break loop unsafe async await yield box dyn as where".split())


def lex(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Tokens and comments; block comments nest."""
    out, comments, at = [], [], 0
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        at = text.find("\n") if "\n" in text else len(text)
        comments.append((0, at))
    while at < len(text):
        if text.startswith("/*", at):
            depth, end = 0, at
            for m in re.compile(r"/\*|\*/").finditer(text, at):
                depth += 1 if m.group() == "/*" else -1
                if not depth:
                    end = m.end()
                    break
            if end == at:
                raise SyntaxError("unterminated comment")
            comments.append((at, end))
            at = end
            continue
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise SyntaxError(f"unexpected {text[at]!r}")
        kind = "raw" if m["raw"] else m.lastgroup
        if kind == "comment":
            comments.append(m.span())
        elif kind != "blank":
            out.append((kind, *m.span()))
        at = m.end()
    return out, comments


def cfg_value(t: Tokens, a: int, b: int, test: bool) -> bool | None:
    """A predicate's value, None if it depends on what isn't known."""
    word = t.at(a)
    if b - a == 1:
        return test if word == "test" else None
    if t.at(a + 1) == "(" and word in ("all", "any", "not"):
        values = [cfg_value(t, x, y, test) for x, y in t.split(a + 2, t.partner[a + 1])]
        if word == "not":
            return None if len(values) != 1 or values[0] is None else not values[0]
        stop = word == "any"
        return stop if stop in values else None if None in values else not stop
    return None


def requires_test(t: Tokens, a: int, b: int) -> bool:
    """False without tests, and not false with them."""
    return cfg_value(t, a, b, False) is False and cfg_value(t, a, b, True) is not False


def _is_test_attribute(t: Tokens, a: int, b: int) -> bool:
    if t.at(a) == "test" and b == a + 1:
        return True
    return t.at(a) == "cfg" and t.at(a + 1) == "(" and any(requires_test(t, x, y) for x, y in t.split(a + 2, t.partner[a + 1])[:1])


def string_value(kind: str, text: str) -> str | None:
    """The content of a string literal, None if an escape isn't valid."""
    if kind == "raw":
        return text[text.index('"') + 1 : text.rindex('"')]
    if kind != "string":
        return None

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1].replace("_", ""), 16))
        if m[2]:
            return chr(int(m[2], 16))
        if m[3] is not None:
            return ""
        return {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "\\": "\\", '"': '"', "'": "'"}[m[4]]

    try:
        return re.sub(r"\\(?:u\{([0-9a-fA-F_]+)\}|x([0-7][0-9a-fA-F])|(\r?\n\s*)|(.))", one, text[text.index('"') + 1 : -1])
    except (KeyError, ValueError, OverflowError):
        return None


class _Walk:
    def __init__(self, t: Tokens):
        self.t, self.found, self.tests, self.modules, self.arms = t, [], [], [], set()

    def items(self, i: int, end: int, path: tuple[str, ...], modules: list[Module], testing: bool = False) -> None:
        """Items and statements between two tokens."""
        t = self.t
        attributes: list[tuple[int, int]] = []
        first = i
        while i < end:
            if t.at(i) == "#" and (t.at(i + 1) == "[" or t.at(i + 1) == "!" and t.at(i + 2) == "["):
                inner = t.at(i + 1) == "!"
                opener = i + 1 + inner
                if inner and _is_test_attribute(t, opener + 1, t.partner[opener]):
                    self.tests.append((t.span[first][0], t.span[end - 1][1] if end > first else 0))
                    testing = True
                if not inner:
                    attributes.append((opener + 1, t.partner[opener]))
                i = t.partner[opener] + 1
                continue
            test = any(_is_test_attribute(t, a, b) for a, b in attributes)
            start = i
            stop = self.item(i, end, path, modules, attributes, testing or test)
            if test:
                self.tests.append((t.span[start][0], t.span[max(start, stop - 1)][1]))
            attributes = []
            i = max(stop, i + 1)

    def item(self, i: int, end: int, path: tuple[str, ...], modules: list[Module], attributes: list, testing: bool) -> int:
        t, start = self.t, i
        while t.at(i) in ("pub", "default", "const", "async", "unsafe", "extern", "safe") and not (t.at(i) == "const" and t.kind[i + 1 : i + 2] == ["word"] and t.at(i + 1) not in ("fn", "unsafe", "async", "extern")):
            if t.at(i) == "extern" and t.kind[i + 1 : i + 2] == ["string"]:
                i += 1
            if t.at(i + 1) in ("{", "|", "||", "move"):
                break
            i = t.next(i + 1) if t.at(i) == "pub" and t.at(i + 1) == "(" else i + 1
        w = t.at(i)
        if w == "{":
            self.items(i + 1, t.partner[i], path, modules, testing)
            return t.partner[i] + 1
        if w == "mod" and t.kind[i + 1 : i + 2] == ["word"]:
            name = t.word[i + 1].removeprefix("r#")
            module = Module(name, test_only=testing)
            module.path, module.alternatives, module.uncertain = self.module_paths(attributes)
            modules.append(module)
            if t.at(i + 2) == "{":
                module.inline = True
                self.items(i + 3, t.partner[i + 2], (*path, name), module.children, testing)
                return t.partner[i + 2] + 1
            return i + 3
        if w in ("impl", "trait") and (w == "impl" or t.kind[i + 1 : i + 2] == ["word"]):
            body = t.find(i, end, "{", ";")
            if t.at(body) != "{":
                return body + 1
            owner = self.impl_owner(i + 1, body) if w == "impl" else t.word[i + 1]
            self.items(body + 1, t.partner[body], (*path, owner), [], testing)
            return t.partner[body] + 1
        if w == "fn" and t.kind[i + 1 : i + 2] == ["word"]:
            body = t.find(i, end, "{", ";")
            if t.at(body) != "{":
                return body + 1
            self.found.append((start, t.partner[body], "::".join((*path, t.word[i + 1].removeprefix("r#")))))
            self.items(body + 1, t.partner[body], (), modules, testing)
            return t.partner[body] + 1
        if w in ("struct", "enum", "union", "use", "type", "macro_rules") and t.at(i + 1) not in ("=", ".", "(", ";", ","):
            stop = t.find(i, end, "{", ";", "(")
            if t.at(stop) == "(":
                stop = t.find(stop, end, ";", "{")
            return t.partner[stop] + 1 if t.at(stop) == "{" and w != "use" else t.find(i, end, ";") + 1
        stop = self.statement_end(i, end)
        self.statement(i, stop)
        return stop + (t.at(stop) == ";")

    def impl_owner(self, i: int, body: int) -> str:
        t, depth = self.t, 0
        if t.at(i) == "<":
            while True:
                depth += (t.at(i) == "<") - (t.at(i) == ">")
                i += 1
                if not depth:
                    break
        stop = t.find(i, body, "where")
        at, depth = i, 0
        while at < stop and not (t.at(at) == "for" and t.at(at + 1) != "<" and not depth):
            depth += (t.at(at) == "<") - (t.at(at) == ">")
            at = t.next(at)
        if at < stop:
            return f"<{t.source(at + 1, stop)} as {t.source(i, at)}>"
        return t.source(i, stop)

    def module_paths(self, attributes: list) -> tuple[str | None, tuple[str, ...], bool]:
        t, direct, others, uncertain = self.t, None, [], False
        for a, b in reversed(attributes):
            if t.at(a) == "path" and t.at(a + 1) == "=":
                value = string_value(t.kind[a + 2], t.word[a + 2])
                if value is None:
                    uncertain = True
                    continue
                if direct is not None:
                    others.append(direct)
                    uncertain = True
                direct = value
            elif t.at(a) == "cfg_attr":
                for k in range(a, b - 2):
                    if t.at(k) == "path" and t.at(k + 1) == "=":
                        uncertain = True
                        value = string_value(t.kind[k + 2], t.word[k + 2])
                        if value is not None:
                            others.append(value)
        return direct, tuple(others), uncertain

    def statement_end(self, i: int, end: int) -> int:
        """A semicolon, or behind a block that ends a statement."""
        t, j = self.t, i
        block = t.at(i) in ("if", "match", "loop", "while", "for", "unsafe") or t.kind[i] == "lifetime"
        while j < end:
            if t.at(j) == ";":
                return j
            j = t.next(j)
            if block and t.at(j - 1) == "}" and t.at(j) not in ("else", ".", "?", "as"):
                return j
        return end

    def statement(self, i: int, end: int) -> None:
        t, hint = self.t, None
        if t.at(i) in ("let", "static", "const"):
            a = i + 1 + (t.at(i + 1) in ("mut", "ref"))
            eq = t.find(a, end, "=")
            hint = t.source(a, t.find(a, eq, ":")) if t.kind[a] == "word" else None
            i = eq + 1
        else:
            eq = t.find(i, end, "=")
            if eq < end and i < eq:
                hint = t.source(i, eq)
                i = eq + 1
        self.expression(i, end, hint)

    def operand_end(self, i: int) -> bool:
        t = self.t
        if i < 0:
            return False
        if t.kind[i] == "word":
            return t.word[i] not in _BEFORE_OPERAND
        return t.kind[i] in ("string", "raw", "char", "number") or t.at(i) in (")", "]", "}", "?")

    def expression(self, i: int, end: int, hint: str | None) -> None:
        t, first = self.t, i
        while i < end:
            w = t.at(i)
            fresh = i == first or not self.operand_end(i - 1) or t.at(i - 1) == "}" and t.at(i) in ("{",)
            if fresh and (w in ("|", "||") or w in ("move", "async", "static") and t.at(i + 1) in ("|", "||", "move")):
                i = self.closure(i, end, hint)
                continue
            if w == "match" and t.at(i - 1) != ".":
                body = t.find(i + 1, end, "{")
                self.expression(i + 1, body, None)
                if body < end:
                    self.match_arms(body)
                    i = t.partner[body] + 1
                    continue
                return
            if w == "{":
                before = i - 1
                literal = before >= first and self.operand_end(before) and t.kind[before] == "word" and t.word[before][:1].isupper() and not self.heads(first, i)
                if literal:
                    for a, b in t.split(i + 1, t.partner[i]):
                        if t.at(a + 1) == ":":
                            self.expression(a + 2, b, f"{hint}.{t.word[a]}" if hint else t.word[a])
                        else:
                            self.expression(a, b, None)
                else:
                    self.items(i + 1, t.partner[i], (), [])
                i = t.next(i)
            elif w == "(":
                given = t.split(i + 1, t.partner[i])
                if not fresh or t.at(i - 1) in ("!", ">") and i - 1 > first:
                    callee = t.source(self.operand_start(i - 1), i)
                    for k, (a, b) in enumerate(given):
                        mark = f"cb:{callee}{f'[{k}]' if len(given) > 1 else ''}"
                        self.expression(a, b, f"{hint}.{mark}" if hint else mark)
                elif len(given) > 1 or t.at(t.partner[i] - 1) == ",":
                    for k, (a, b) in enumerate(given):
                        self.expression(a, b, f"{hint or ''}[{k}]")
                else:
                    self.expression(i + 1, t.partner[i], hint)
                i = t.next(i)
            elif w == "[":
                for k, (a, b) in enumerate(t.split(i + 1, t.partner[i])):
                    self.expression(a, b, f"{hint or ''}[{k}]" if fresh else None)
                i = t.next(i)
            elif w in ("fn", "mod", "impl", "trait") and fresh and t.kind[i + 1 : i + 2] == ["word"]:
                i = self.item(i, end, (), [], [], False)
            else:
                i += 1

    def heads(self, a: int, i: int) -> bool:
        """Whether a control keyword at this level makes the next brace a block."""
        t, j, found = self.t, a, False
        while j < i:
            if t.at(j) in ("if", "while", "for", "match"):
                found = True
            elif t.at(j) == "{":
                found = False
            j = t.next(j)
        return found

    def operand_start(self, i: int) -> int:
        t = self.t
        while i > 0:
            if t.at(i) in (")", "]"):
                i = t.partner[i]
                if not self.operand_end(i - 1):
                    return i
                i -= 1
            elif t.at(i) == ">":
                depth = 0
                while i > 0:
                    depth += (t.at(i) == ">") - (t.at(i) == "<")
                    i -= 1
                    if not depth:
                        break
            elif t.at(i) in ("!", "?", "::"):
                i -= 1
            elif t.at(i - 1) in (".", "::"):
                i -= 2
            else:
                return i
        return i

    def closure(self, i: int, end: int, hint: str | None) -> int:
        t, start = self.t, i
        while t.at(i) in ("move", "async", "static"):
            i += 1
        if t.at(i) == "|":
            i += 1
            while i < end and t.at(i) != "|":
                i = t.next(i)
        i += 1
        if t.at(i) == "->":
            i = t.find(i, end, "{")
        if t.at(i) == "{":
            last = t.partner[i]
            self.found.append((start, last, hint or "(anonymous)"))
            self.items(i + 1, last, (), [])
            return last + 1
        self.found.append((start, max(start, end - 1), hint or "(anonymous)"))
        self.expression(i, end, None)
        return end

    def match_arms(self, opener: int) -> None:
        t, i, end = self.t, opener + 1, self.t.partner[opener]
        while i < end:
            arrow = t.find(i, end, "=>")
            if arrow >= end:
                return
            self.arms.add(arrow)
            self.expression(i, arrow, None)
            i = arrow + 1
            if t.at(i) == "{" and t.at(t.partner[i] + 1) not in (".", "?"):
                self.items(i + 1, t.partner[i], (), [])
                i = t.partner[i] + 1
                i += t.at(i) == ","
            else:
                stop = t.find(i, end, ",")
                self.expression(i, stop, None)
                i = stop + 1


def _decisions(t: Tokens, walk: _Walk) -> set[int]:
    out = set(walk.arms)
    closures = {a for a, _, _ in walk.found}
    for i in range(len(t)):
        w = t.at(i)
        if w in ("if", "while", "loop") and t.at(i - 1) != ".":
            out.add(i)
        elif w == "for" and t.at(i + 1) != "<" and _loops(t, i):
            out.add(i)
        elif w == "?" and t.at(i + 1) != "Sized" and walk.operand_end(i - 1):
            out.add(i)
        elif w == "&&" and walk.operand_end(i - 1) or w == "||" and i not in closures and walk.operand_end(i - 1):
            out.add(i)
    return out


def _loops(t: Tokens, i: int) -> bool:
    """A loop has its 'in' before its body; 'for' of an impl or a bound has not."""
    j = i + 1
    while j < len(t) and t.at(j) not in ("{", ";", "}"):
        if t.at(j) == "in":
            return True
        j = t.next(j)
    return False


@analyser("rust")
def analyse(path: str, content: bytes) -> Result:
    """A syntax error is a warning; then only the lines are counted."""
    text = content.decode("utf-8", "replace").removeprefix("\ufeff")
    result = Result()
    try:
        lexed, comments = lex(text)
        starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
        t = Tokens(text, lexed, starts)
        walk = _Walk(t)
        walk.items(0, len(t), (), result.modules)
    except (SyntaxError, KeyError, IndexError, RecursionError) as error:
        result.warnings.append(f"{path}: syntax error: {error}")
        result.source_lines = by_bucket(text, [])
        return result
    top, all_ = nest(walk.found, t)
    count_decisions(all_, t, _decisions(t, walk))
    code = blank_spans(text, comments)
    for f in all_:
        f.sloc = sloc(code, f.start, f.end)
        f.bucket = "tests" if any(a <= f.start and f.end <= b for a, b in walk.tests) else None
    result.functions = top
    result.test_only = any(a <= (t.span[0][0] if len(t) else 0) and b >= (t.span[-1][1] if len(t) else 1) for a, b in walk.tests)
    result.source_lines = by_bucket(code, walk.tests)
    for i, (kind, w) in enumerate(zip(t.kind, t.word)):
        if kind == "string":
            a = w.index('"')
            pieces = [w[: a + 1], *re.findall(r"\\(?:x..|u\{[^}]*\}|.)|[^\\]+", w[a + 1 : -1], re.S), '"']
        else:
            pieces = [w]
        line = t.line(i)
        for p in pieces:
            result.tokens.append(Token(p.encode(), line, line + p.count("\n")))
            line += p.count("\n")
    return result
