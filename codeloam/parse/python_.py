"""Python: functions and decisions from the syntax tree, tokens from the tokenizer."""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings

from .common import Function, Result, Token, analyser, blank_spans, by_bucket, sloc

_PREFIX = re.compile(r"[A-Za-z]*")
#: A print statement by itself on one line.
_PRINT = re.compile(r"\s*print\b(?!\s*(?:[=(.,\[:]|[-+*/%&|^]?=))[^\\]*$")


class _Source:
    """Text with line starts; columns of the syntax tree count UTF-8 bytes."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def at(self, line: int, byte: int) -> int:
        own = self.lines[line - 1]
        return self.starts[line - 1] + (byte if own.isascii() else len(own.encode()[:byte].decode(errors="ignore")))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)


def _decode(content: bytes) -> str:
    try:
        name, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
        text = content.decode(name)
    except (SyntaxError, UnicodeDecodeError, LookupError):
        text = content.decode("latin-1")
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def _compact(text: str) -> str:
    return re.sub(r"\s+", "", text)


class _Walk:
    """Collects functions with their names and decisions; every function takes those of its own body."""

    def __init__(self, source: _Source):
        self.source, self.top, self.docs = source, [], []

    def text(self, node: ast.AST) -> str:
        a, b = self.source.span(node)
        return _compact(self.source.text[a:b])

    def body(self, nodes: list[ast.stmt], owner: Function | None, path: list[str]) -> None:
        self.docstring(nodes)
        for n in nodes:
            self.visit(n, owner, path, None)

    def docstring(self, nodes: list[ast.stmt]) -> None:
        first = nodes[0] if nodes else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            self.docs.append(self.source.span(first))

    def add(self, name: str, node: ast.AST, owner: Function | None) -> Function:
        a, b = self.source.span(node)
        f = Function(name, node.lineno, a, b)
        (owner.nested if owner else self.top).append(f)
        return f

    def visit(self, n: ast.AST, owner: Function | None, path: list[str], hint: str | None) -> None:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in [*n.decorator_list, *n.args.defaults, *(x for x in n.args.kw_defaults if x)]:
                self.visit(d, owner, path, None)
            f = self.add(".".join([*path, n.name]), n, owner)
            self.body(n.body, f, [])
            return
        if isinstance(n, ast.Lambda):
            for d in [*n.args.defaults, *(x for x in n.args.kw_defaults if x)]:
                self.visit(d, owner, path, None)
            self.visit(n.body, self.add(hint or "(anonymous)", n, owner), [], None)
            return
        if isinstance(n, ast.ClassDef):
            for d in [*n.decorator_list, *n.bases, *(k.value for k in n.keywords)]:
                self.visit(d, owner, path, None)
            self.docstring(n.body)
            for x in n.body:
                self.visit(x, owner, [*path, n.name], None)
            return
        if owner is not None:
            owner.decisions += self.decisions(n)
        for child, name in self.named(n, hint):
            self.visit(child, owner, path, name)

    def decisions(self, n: ast.AST) -> int:
        if isinstance(n, ast.BoolOp):
            return len(n.values) - 1
        if isinstance(n, ast.comprehension):
            return 1 + len(n.ifs)
        if isinstance(n, ast.match_case):
            return 1 + (n.guard is not None)
        return int(isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)))

    def named(self, n: ast.AST, hint: str | None):
        """Children with the name that a lambda in that place takes."""
        if isinstance(n, ast.Assign):
            yield from ((t, None) for t in n.targets)
            target = n.targets[-1]
            if isinstance(target, (ast.Tuple, ast.List)) and isinstance(n.value, (ast.Tuple, ast.List)) and len(target.elts) == len(n.value.elts):
                yield from ((v, self.text(t)) for t, v in zip(target.elts, n.value.elts))
            else:
                yield n.value, self.text(target)
        elif isinstance(n, (ast.AnnAssign, ast.AugAssign, ast.NamedExpr)):
            yield n.target, None
            if n.value is not None:
                yield n.value, self.text(n.target)
        elif isinstance(n, ast.Dict):
            for k, v in zip(n.keys, n.values):
                if k is not None:
                    yield k, None
                yield v, f"{hint or ''}[{self.text(k)}]" if k is not None else hint
        elif isinstance(n, (ast.List, ast.Tuple, ast.Set)):
            for i, x in enumerate(n.elts):
                yield x, f"{hint or ''}[{i}]"
        elif isinstance(n, ast.Call):
            yield n.func, None
            given = [*n.args, *(k.value for k in n.keywords)]
            callback = f"cb:{self.text(n.func)}"
            for i, x in enumerate(given):
                yield x, f"{hint + '.' if hint else ''}{callback}{f'[{i}]' if len(given) > 1 else ''}"
        else:
            for c in ast.iter_child_nodes(n):
                yield c, hint if isinstance(n, (ast.IfExp, ast.Starred)) else None


def _strings(text: str, line: int) -> list[Token]:
    """A string as its opening quote with prefix, its content if any, and its closing quote."""
    head = _PREFIX.match(text).group()
    quote = text[len(head) : len(head) + 3]
    quote = quote if quote in ('"""', "'''") else text[len(head) : len(head) + 1]
    inner = text[len(head) + len(quote) : len(text) - len(quote)]
    after = line + inner.count("\n")
    out = [Token((head + quote).encode(), line, line)]
    if inner:
        out.append(Token(inner.encode(), line, after))
    return [*out, Token(quote.encode(), after, after)]


def _loose(text: str, line: int) -> list[Token]:
    """The tokens of one line by itself."""
    out: list[Token] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text.strip()).readline):
            if t.type == tokenize.STRING:
                out += _strings(t.string, line)
            elif t.string.strip() and t.type != tokenize.COMMENT:
                out.append(Token(t.string.encode(), line, line))
    except (SyntaxError, tokenize.TokenError):
        pass
    return out


def _mended(text: str) -> tuple[ast.Module, str, dict[int, str]]:
    """The tree of text, the text of the same length that it belongs to, and the lines that gave way in it: a line
    with an error becomes an empty head of a block, a constant, or at last blank. Print statements go at once. After
    many errors, fewer in a long text, more and more lines go at a time: attempts grow with the logarithm of the lines."""
    lines, damaged = text.split("\n"), {}
    patience = max(16, min(256, 4_000_000 // (len(text) + 1)))
    tries: dict[int, int] = {}
    attempts = 0
    while True:
        mended = "\n".join(lines)
        try:
            return ast.parse(mended), mended, damaged
        except SyntaxError as error:
            if error.lineno is None:
                raise
            header = re.search(r"expected an indented block after .* on line (\d+)", error.msg or "")
            at = min(int(header[1]) if header else error.lineno, len(lines)) - 1
            while at > 0 and not lines[at].strip():
                at -= 1
            if "'print'" in (error.msg or "") and at not in tries:
                for k, line in enumerate(lines):
                    if _PRINT.match(line):
                        damaged.setdefault(k + 1, line)
                        indent = line[: len(line) - len(line.lstrip())]
                        lines[k] = (indent + "0").ljust(len(line))
                tries[at] = 2
                continue
            attempts += 1
            run = 1 << min(attempts // patience, 40)
            for k in range(at, min(at + run, len(lines))):
                line = lines[k]
                if k > at and not line.strip():
                    continue
                if not line.strip() and tries.get(k, 0) > 2:
                    raise
                damaged.setdefault(k + 1, line)
                indent = line[: len(line) - len(line.lstrip())]
                head = "except 0:" if line.lstrip().startswith("except") else "with 0:"
                fits = line.rstrip().endswith(":") and not header and len(line.strip()) >= len(head)
                stage = max(tries.get(k, 0), 0 if fits else 1) if run == 1 else 2
                lines[k] = ((indent + (head, "0", "")[min(stage, 2)]).ljust(len(line)))[: len(line)]
                tries[k] = stage + 1


def _tokens(source: _Source, docs: list[tuple[int, int]], damaged: dict[int, str]) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens without comments and docstrings, with marks around each indented block; spans of comments. Of damaged
    lines the tokens up to the place where they can't be read."""
    pending = sorted(damaged, reverse=True)
    out: list[Token] = []
    comments: list[tuple[int, int]] = []
    opened: list[int] = []
    for t in tokenize.generate_tokens(io.StringIO(source.text).readline):
        a = source.starts[t.start[0] - 1] + t.start[1]
        b = source.starts[t.end[0] - 1] + t.end[1] if t.end[0] <= len(source.lines) else len(source.text)
        if t.type == tokenize.COMMENT:
            comments.append((a, b))
        elif t.type == tokenize.INDENT:
            opened.append(len(out))
        elif t.type == tokenize.DEDENT:
            start = opened.pop()
            if len(out) > start:
                out.append(Token(b"\0block:close", out[-1].end_line, out[-1].end_line))
                out.insert(start, Token(b"\0block:open", out[start].line, out[start].line))
                opened = [o + (o > start) for o in opened]
        elif t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.ENDMARKER) or any(x <= a < y for x, y in docs):
            continue
        while pending and pending[-1] <= t.start[0]:
            out += _loose(damaged[pending[-1]], pending.pop())
        if t.type in (tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT) or t.start[0] in damaged:
            continue
        if t.type == tokenize.STRING:
            out += _strings(t.string, t.start[0])
        elif t.string.strip():
            out.append(Token(t.string.encode(), t.start[0], t.end[0]))
    for line in reversed(pending):
        out += _loose(damaged[line], line)
    return out, comments


@analyser("python")
def analyse(path: str, content: bytes) -> Result:
    """A syntax error is a warning: the lines that hold it give way and the rest is analysed. Where nothing can be
    read, as with a null byte, only the lines are counted."""
    text = _decode(content)
    result = Result(git_line_coordinates=content.replace(b"\r\n", b"\n").count(b"\r") == 0)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree, mended, damaged = _mended(text)
        source = _Source(mended)
        walk = _Walk(source)
        walk.body(tree.body, None, [])
        result.tokens, comments = _tokens(source, walk.docs, damaged)
        if damaged:
            result.warnings.append(f"{path}: syntax error in line {min(damaged)}; the rest is analysed")
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError, IndentationError) as error:
        result.warnings.append(f"{path}: {type(error).__name__}: syntax error")
        result.source_lines = by_bucket(text, [])
        return result
    code = blank_spans(text, [*comments, *walk.docs])

    def count(f: Function) -> None:
        f.sloc = sloc(code, f.start, f.end)
        for g in f.nested:
            count(g)

    for f in walk.top:
        count(f)
    result.functions, result.source_lines = walk.top, by_bucket(code, [])
    return result


