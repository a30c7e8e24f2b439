"""The analysis engine on code of its own, on throwaway repositories and against the query catalogue's SQL."""

import json
import os
import random
import re
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloam import cli
from codeloam.functions import paths
from codeloam.operators import clones, diff, trend
from codeloam.operators import modules
from codeloam.parse import go, python_, rust, typescript
from codeloam.parse.common import flat
from codeloam.plans import scan
from codeloam.report import render as R
from codeloam.sources import git as G

BODY = "\n".join(f"\tvalue{i} := compute(value{i - 1}, {i}, \"s\")" for i in range(1, 9))
GO = f"package p\n\nfunc first(value0 int) int {{\n{BODY}\n\treturn value8\n}}\n"
COMPLEX = "package p\n\nfunc busy(a int) int {\n" + "".join(f"\tif a > {i} && a < {i + 9} {{\n\t\ta++\n\t}}\n" for i in range(7)) + "\treturn a\n}\n"


def table(functions):
    return [(f["depth"], f["name"], f["line"], f["cc"], f["sloc"]) for f in flat(functions)]


def test_go_names_and_decisions():
    source = b"""package p
var handler = func() {}
var ( a, b = func() int { return 1 }, func() {} )
type T struct{ f func(int) struct{} }
func (t *T[K]) M() { x.y = func() {}; run(1, func() { go func() {}() }) ; register(func(){}) }
var table = map[string]func(){ "k": func() {}, }
func g() (func() int, error) { if v, err := do(func() {}); err != nil || v { return func() int { return 2 }, nil }; return nil, nil }
func h(v int) {
	// comment
	switch v { case 1, 2: default: }
	select { case <-c: }
}
"""
    names = [(d, n, cc) for d, n, _, cc, _ in table(go.analyse("x.go", source).functions)]
    assert names == [(0, "handler", 1), (0, "a", 1), (0, "b", 1), (0, "T.M", 1), (1, "x.y", 1), (1, "cb:run[1]", 1), (2, "(anonymous)", 1), (1, "cb:register", 1), (0, "table.k", 1), (0, "g", 3), (1, "v.cb:do", 1), (1, "(anonymous)", 1), (0, "h", 3)]
    assert go.analyse("x.go", b"package p\nfunc f( {\n").error
    words = [t.text for t in go.analyse("x.go", 'package p\nvar s = "a\\x41b" + `r\nw`\n'.encode()).tokens]
    assert words == [b"package", b"p", b"var", b"s", b"=", b'"', b"a", b"\\x41", b"b", b'"', b"+", b"`", b"r\nw", b"`"]


def test_python_names_decisions_and_docstrings():
    source = b'''"""Parcels."""
weigh, tag = lambda p: p.kg, lambda p: p.id
pool.submit(lambda: None)
adder = lambda n: (lambda m: n + m)
class Depot:
    """Where parcels wait."""
    class Shelf:
        def sort(self, parcels):
            """Sorts them.

            Twice."""
            while parcels:
                if parcels[0] or self.full and not parcels:  # heavy ones
                    break
            match parcels:
                case [one] if one: return {p for p in parcels if p.kg}
                case _: pass
'''
    result = python_.analyse("x.py", source)
    assert table(result.functions) == [(0, "weigh", 2, 1, 1), (0, "tag", 2, 1, 1), (0, "cb:pool.submit", 3, 1, 1), (0, "adder", 4, 1, 1), (1, "(anonymous)", 4, 1, 1), (0, "Depot.Shelf.sort", 8, 10, 7)]
    assert (1, "source") not in result.source_lines and (9, "source") not in result.source_lines
    assert python_.analyse("x.py", b"def broken(:\n").warnings
    assert python_.analyse("x.py", "# -*- coding: latin-1 -*-\ns = 'é'\n".encode("latin-1")).warnings == []


SCRIPT = {
    "const total = rows.reduce((sum, row) => sum + row.price, 0); cart.onempty = debounce(() => {}, 50); const deep = retry(limit(() => fetch())); function checkout() { const later = wait(() => () => 0); }": ["total.cb:rows.reduce[0]", "cart.onempty.cb:debounce[0]", "deep.cb:retry.cb:limit", "checkout", " later.cb:wait", "  (anonymous)"],
    "router.use({ handle(req) {} }); mixin(class Basket { empty() {} }); queue(function drain() {});": ["cb:router.use.handle", "cb:mixin.Basket.empty", "cb:queue.drain"],
    "class Shelf { static spare = class Box { open() {} }; static { class Lid { lift() {} } } get room() { return 3 } restock = () => () => {}; }": ["Shelf.static spare.Box.open", "Shelf.Lid.lift", "Shelf.get room", "Shelf.restock", " (anonymous)"],
    "const steps = [() => 'wash', [() => 'dry']]; const both = zip(() => 'a', () => 'b'); const soon = (() => 7)();": ["steps[0]", "steps[1][0]", "both.cb:zip[0]", "both.cb:zip[1]", "soon"],
    "const menu = { order() {}, cancel: () => {}, get price() { return 1 }, drinks: { pour() {} }, tip: function gratuity() {} }; function kitchen() { return { cook() {} }; }": ["menu.order", "menu.cancel", "menu.get price", "menu.drinks.pour", "menu.tip.gratuity", "kitchen", " cook"],
    "const line = `${names.map(n => n)}, ${`and ${more}`}`; const half = price / 2 / count; const slug = title.replace(/[ /\"']+/g, (gap: string): string => '-'); namespace Till { export function ring(sum?: number): Map<string, () => void> { return sum } }": ["cb:names.map", "slug.cb:title.replace[1]", "Till.ring"],
}


@pytest.mark.parametrize("source", SCRIPT)
def test_script_names(source):
    result = typescript.analyse("x.ts", source.encode())
    assert result.error is None and [" " * f["depth"] + f["name"] for f in flat(result.functions)] == SCRIPT[source]


def test_script_decisions_and_lines():
    source = "#!/x\nfunction f(a?: number) {\n // c\n do { a++ } while (a < 3);\r\n if (a && b || c) {}\n\u00a0\n for (const x of y) {}\n return a ? 1 : b ?? 2;\n switch (a) { case 1: break; default: }\n try {} catch {} }"
    result = typescript.analyse("x.ts", source.encode())
    assert table(result.functions) == [(0, "f", 2, 10, 7)] and (1, "source") not in result.source_lines
    assert typescript.analyse("x.ts", b"function (").error and typescript.analyse("x.ts", b"let a = `b").error


RUST = {
    "mod harbour { trait Dock { fn moor(&self) {} } struct Pier; impl Pier { fn build() {} } impl Dock for Pier { fn moor(&self) {} } fn tide() { fn ebb() {} } }": ["harbour::Dock::moor", "harbour::Pier::build", "harbour::<Pier as Dock>::moor", "harbour::tide", " ebb"],
    "static HORN: fn() = boxed(|| {});\nfn sail() { let rope = tie(knot(|| {})); let crew = || rest(|| {}); let log = Log { entry: lock(|| {}) }; let done = (|| {})(); }": ["HORN.cb:boxed", "sail", " rope.cb:tie.cb:knot", " crew", "  cb:rest", " log.entry.cb:lock", " done"],
    "fn cargo() { let crates = [|| {}, /* spare */ || {}]; let hold = (|| {}, (|| {}, || {})); let both = join(|| {}, || {}); }": ["cargo", " crates[0]", " crates[1]", " hold[0]", " hold[1][0]", " hold[1][1]", " both.cb:join[0]", " both.cb:join[1]"],
}


@pytest.mark.parametrize("source", RUST)
def test_rust_names(source):
    result = rust.analyse("x.rs", source.encode())
    assert not result.warnings and [" " * f["depth"] + f["name"] for f in flat(result.functions)] == RUST[source]


def test_rust_decisions_and_test_scopes():
    source = b"""impl<T> Stack<T> where T: Copy {
    pub async fn push<'a>(&'a mut self, x: T) -> Option<&'a T> {
        /* one /* nested */ */
        if x || y && z? { 1 } else { match q { A { .. } if w => 1, _ => { 2 } } };
        for i in 0..3 { while let Some(_) = i {} }
        loop { break; }
    }
}
#[cfg(all(test, not(windows)))]
mod tests { #[test] fn t() {} }
"""
    result = rust.analyse("x.rs", source)
    assert [(f["name"], f["bucket"], f["cc"], f["sloc"]) for f in flat(result.functions)] == [("Stack<T>::push", "source", 11, 5), ("tests::t", "tests", 1, 1)]
    assert (10, "tests") in result.source_lines and (3, "source") not in result.source_lines
    for text, only in (("test", True), ('all(feature = "test", test,)', True), ("not(any(not(test), windows))", True), ("any(test, unix)", False), ("all(test, not(test))", False), ("all()", False), ("not(test)", False)):
        assert (rust.analyse("x", f"#[cfg({text})]\nfn h() {{}}".encode()).functions[0].bucket == "tests") == only
    assert rust.analyse("x", b"fn broken( {").warnings


def test_rust_modules(spark):
    declared = {
        "src/lib.rs": "mod a; #[cfg(test)] mod only; #[path = \"other/place.rs\"] mod p; mod inner { mod deep; } #[cfg_attr(x, path = \"maybe.rs\")] mod m; mod gone;",
        "src/a.rs": "#[cfg(test)] mod b;", "src/a/b.rs": "mod c;", "src/a/b/c.rs": "", "src/only/mod.rs": "", "src/other/place.rs": "", "src/inner/deep.rs": "", "src/maybe.rs": "", "src/loose.rs": "", "src/x.rs": "mod y;", "src/x/y.rs": "#[path = \"../x.rs\"] mod x;",
        "tests/it.rs": "mod common;", "tests/common/mod.rs": "",
    }
    from codeloam.parse.common import module_json
    from codeloam.sources.scratch import keep

    rows = [("r", p, "tests" if p.startswith("tests/") else "source", False, module_json(rust.analyse(p, s.encode()).modules)) for p, s in declared.items()]
    files = spark.createDataFrame(rows, "rev string, path string, bucket string, test_only boolean, modules string")
    none = spark.createDataFrame([], "rev string, path string")
    buckets, warnings = modules.classify(files, none, none, keep)
    tests = {r.path for r in buckets.collect() if r.bucket == "tests"}
    assert tests == {"src/a/b.rs", "src/a/b/c.rs", "src/only/mod.rs", "tests/it.rs", "tests/common/mod.rs"}
    said = " ".join(r.warning for r in warnings.collect())
    assert "module gone" in said and "module m " in said and "module deep" not in said


def test_globs():
    good = {"a/*.go": [("a/x.go", True), ("a/b/x.go", False)], "[a-c]?/[^x]": [("bz/y", True), ("bz/x", False), ("dz/y", False)], "\\*": [("*", True), ("a", False)]}
    import re

    for pattern, cases in good.items():
        rx = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), paths.glob_regex(pattern)))
        assert [bool(rx.match(p)) for p, _ in cases] == [w for _, w in cases]
    for bad in ("[", "[]a", "[a", "a\\"):
        with pytest.raises(ValueError):
            paths.glob_regex(bad)


def exhaustive(files, size):
    """Maximal equal runs by extending every equal window both ways."""
    found = set()
    segments = sorted(files.items())
    for i, (pa, a) in enumerate(segments):
        for pb, b in segments[i:]:
            for x in range(len(a)):
                for y in range(x + 1 if pa == pb else 0, len(b)):
                    if a[x] != b[y] or x and y and a[x - 1] == b[y - 1]:
                        continue
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if n >= size and (pa != pb or x + n <= y):
                        found.add((pa, x, pb, y, n))
    return found


@pytest.mark.parametrize("symbols", [1, 2, 6])
def test_extents_equal_the_exhaustive_detector(spark, symbols):
    rng = random.Random(symbols)
    files = {f"f{k}": [str(rng.randrange(symbols)) for _ in range(rng.randrange(25))] for k in range(4)}
    rows = [("r", "go", p, i, t, i + 1, i + 1) for p, ts in files.items() for i, t in enumerate(ts)]
    tokens = spark.createDataFrame(rows, "rev string, language string, path string, pos int, text string, line int, end_line int")
    got = {(r.a_path, r.a_pos, r.b_path, r.b_pos, r.tokens) for r in clones.extents(tokens, 5).collect()}
    assert got == exhaustive(files, 5)


def test_line_mapping(spark):
    lines = spark.createDataFrame([("f", i) for i in range(1, 6)] + [("g", 1)], "path string, line int")
    hunks = spark.createDataFrame([("f", 1, 2, 0, 0), ("f", 4, 0, 2, 2)], "path string, before_start int, before_count int, after_start int, after_count int")
    only = spark.createDataFrame([("f",)], "path string")
    got = {(r.path, r.line): r.mapped for r in diff.map_lines(lines, hunks, only).collect()}
    assert got == {("f", 1): None, ("f", 2): None, ("f", 3): 1, ("f", 4): 2, ("f", 5): 5, ("g", 1): None}
    assert all(r.mapped == r.line for r in diff.map_lines(lines, None).collect())


def test_months_take_the_first_commit_in_log_order(spark):
    dates = ["2026-03-20", "2026-03-05", "2026-02-05", "2026-01-15", "2026-01-20", "2026-01-20", "2026-01-10"]
    rows = spark.createDataFrame([(k, f"c{k}", d) for k, d in enumerate(dates)], "pos int, rev string, d string").withColumn("ts", F.to_timestamp("d"))
    got = [(r.rev, r.axis_label) for r in trend.month_commits(rows, 3).orderBy("ord").collect()]
    assert got == [("c3", "2026-01"), ("c2", "2026-02"), ("c0", "head")]
    one = rows.where("pos = 0").withColumn("ts", F.to_timestamp(F.lit("2026-03-01")))
    assert [r.axis_label for r in trend.month_commits(one, 9).collect()] == ["2026-03"]


def repository(tmp_path):
    home = str(tmp_path / "repo")
    os.makedirs(home)

    def git(*a, date="2026-01-10T12:00:00Z"):
        env = os.environ | {"GIT_COMMITTER_DATE": date, "GIT_AUTHOR_DATE": date, "GIT_CONFIG_GLOBAL": "/dev/null"}
        return subprocess.run(["git", "-C", home, "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True, env=env).stdout.decode().strip()

    def commit(files, date):
        for name, text in files.items():
            path = os.path.join(home, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            if text is None:
                os.remove(path)
            else:
                with open(path, "w") as f:
                    f.write(text)
        git("add", "-A")
        git("commit", "-q", "-m", "x", date=date)
        return git("rev-parse", "HEAD")

    git("init", "-q", "-b", "main")
    return home, git, commit


def test_scan_diff_and_trend_end_to_end(spark, tmp_path):
    home, git, commit = repository(tmp_path)
    base = commit({"a.go": GO, "vendor/v.go": GO, "odd name\n.go": "package p\n", "gen.go": "// Code generated by x. DO NOT EDIT.\npackage p\nfunc z() {}\n"}, "2026-01-10T12:00:00Z")
    os.symlink("a.go", os.path.join(home, "link.go"))
    head = commit({"a.go": "package p\n\n// moved\n" + GO.removeprefix("package p\n"), "b.go": GO.replace("first", "second"), "c.go": COMPLEX, "t_test.go": "package p\nfunc TestX() {}\n"}, "2026-02-20T12:00:00Z")
    doc = json.loads(cli.run(["scan", "HEAD", "--format", "json"], spark, home))
    assert [f["name"] for f in doc["functions"]] == ["first", "second", "busy", "TestX"]
    assert doc["buckets"]["tests"]["functions"] == 1 and len(doc["clones"]) == 1 and doc["skipped_details"] is None
    folder = json.loads(cli.run(["scan", ".", "--format", "json"], spark, home))
    assert {k: v for k, v in folder.items() if k != "rev"} == {k: v for k, v in doc.items() if k != "rev"}
    change = json.loads(cli.run(["diff", "--base", base, "--head", head, "--trend", "2", "--format", "json"], spark, home))
    assert Counter((f["name"], f["note"]) for f in change["functions"]) == Counter([("busy", "new"), ("second", "new"), ("TestX", "new")])
    assert change["buckets"]["source"]["mass_added_over_cc_10"] == change["functions"][0]["delta_mass"]
    assert len(change["clones_added"]) == 1 and change["clones_removed"] == [] and len(change["trend"]) == 2
    back = json.loads(cli.run(["diff", "--base", head, "--head", head, "--format", "json"], spark, home))
    assert back["functions"] == [] and back["clones_added"] == []
    assert "No complexity or clone changes" in cli.run(["diff", "--base", head, "--head", head, "--format", "md"], spark, home)
    shown = cli.run(["diff", "--base", base, "--head", head], spark, home)
    assert "busy" in shown and "clone pairs added" in shown
    cached = str(tmp_path / "cache")
    shots = [scan.scan_revisions(spark, home, {head: "h"}, f"file://{cached}").totals.orderBy("bucket").collect() for _ in range(2)]
    assert shots[0] == shots[1] and os.path.isdir(cached)


def test_a_stream_of_files_fills_the_cache(spark, tmp_path):
    from codeloam.streaming.incremental import analyse_stream

    shape = "rev string, path string, oid string, size long, content binary"
    rows = [("r", "a.go", "1", len(GO), GO.encode()), ("s", "b.go", "1", len(GO), GO.encode()), ("r", "x.txt", "2", 1, b"x"), ("r", "t.py", "3", 9, b"def f(): 1")]
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/in")
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        analyse_stream(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), cache, f"{tmp_path}/state").awaitTermination()
    kept = spark.read.schema(scan.ANALYSIS).parquet(f"{cache}/version={scan.VERSION}").collect()
    assert sorted((r.oid, r.functions[0].name) for r in kept) == [("1", "first"), ("3", "f")]


@pytest.mark.parametrize("source, functions", [
    ("def a(x):\n    if x:\n        return 1\n\ndef b(:\n    return 2\n\ndef c():\n    y = = 3\n    return [i for i in y if i]\n", [("a", 1, 2, 3), ("c", 8, 3, 3)]),
    ("def a():\n    print 'x'\n    try:\n        f()\n    except E, e:\n        pass\nclass C:\n    def m(self):\n        g(1,\n\n    def n(self): return 1\n", [("a", 1, 2, 6), ("C.m", 8, 1, 2), ("C.n", 11, 1, 1)]),
    ("def a():\ndef b():\n    return 1\n", [("b", 2, 1, 2)]),
    ("def a():\n    '''open\n    return 1\ndef b():\n  return 2\n", [("a", 1, 1, 3), ("b", 4, 1, 2)]),
    ("def f(x):\n    print x\n" * 300 + "def g():\n  )\n  (\n", [("f", 2 * i + 1, 1, 2) for i in range(300)] + [("g", 601, 1, 3)]),
])
def test_python_is_read_around_its_syntax_errors(source, functions):
    r = python_.analyse("", source.encode())
    assert [(f.name, f.line, f.cc, f.sloc) for f in r.functions] == functions and r.error is None
    assert len(r.warnings) == 1 and [t.line for t in r.tokens] == sorted(t.line for t in r.tokens)
    assert len(r.source_lines) == sum(bool(line.strip()) for line in source.split("\n"))


MARKUP = """export const Menu = ({entries}: {entries: string[]}) => {
  const pick = <T,>(x: T) => x;
  return (
    <nav className="a" {...rest}>
      <h1>Don't panic // no comment</h1>
      {/* gone */}
      {entries.map(e => <li key={e} onClick={() => e && go(e)}>{e ? <b>{e}</b> : <>none</>}</li>)}
      {entries.length > 0 && <Form.Row<string> render={function () { return <i/>; }} />}
    </nav>
  );
};
function After() { if (a < b) { return <p>it's</p> } return a < c }
const last = () => <p>don't</p>
"""


def test_markup():
    r = typescript.analyse("", MARKUP.encode(), True)
    assert r.error is None
    assert [(f["name"], f["depth"], f["line"], f["cc"]) for f in flat(r.functions)] == [
        ("Menu", 0, 1, 4), ("pick", 1, 2, 1), ("cb:entries.map", 1, 7, 3), ("(anonymous)", 2, 7, 2), ("(anonymous)", 1, 8, 1), ("After", 0, 12, 2), ("last", 0, 13, 1),
    ]
    texts = [t.text for t in r.tokens]
    assert b"Don't panic // no comment" in texts and b"gone" not in b" ".join(texts)
    assert typescript.analyse("", b"const f = () => <p>{a</p>;", True).error and typescript.analyse("", b"const f = () => <p></q>;", True).error


@pytest.mark.parametrize("markup", [False, True])
def test_type_parameters_and_asserted_types(markup):
    source = """const f = <T,>(x: T) => x;
const g = x as unknown as <T>(x: T) => T;
const k = <T, U extends {a: 1}>(a: T, b: U): T => { if (a) return a; };
const m = (x as Box<Item>).map(y => y);
type F = <T>(x: T) => T;
let n = as.map(v => v);
function o(a) { return a as B ? 1 : 2; }
"""
    r = typescript.analyse("", source.encode(), markup)
    assert [(f.name, f.line, f.cc) for f in r.functions] == [("f", 1, 1), ("k", 3, 2), ("m.cb:(xasBox<Item>).map", 4, 1), ("n.cb:as.map", 6, 1), ("o", 7, 2)]


def test_markup_in_a_scan(spark):
    """Markup is read by its dialect; what can't be read is a warning there, and the rest of the scan stays."""
    rows = [("r", "page.tsx", "1", 60, b"const p = () => <p>don't</p>;\n"), ("r", "bad.tsx", "2", 60, b"const p = () => <p>{a</p>;\n"), ("r", "a.go", "3", len(GO), GO.encode())]
    shot = scan.scan_files(spark, spark.createDataFrame(rows, "rev string, path string, oid string, size long, content binary"))
    assert sorted(r.name for r in shot.functions.collect()) == ["first", "p"] and [r.warning.split(":")[0] for r in shot.warnings.collect()] == ["bad.tsx"]


def test_configured_directories_are_never_entered(spark, tmp_path):
    for name in ("pkg/a/generated/x.go", "pkg/a/kept/y.go"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(GO)
    (tmp_path / ".codehealth.json").write_text('{"excludes": ["pkg/*/generated/"]}')
    skip = scan.pruned(["pkg/*/generated/", "*.py"])
    assert skip("pkg/a/generated") and skip("pkg/.git") and not skip("pkg/a") and not skip("pkg/a/b/generated")
    assert [r.path for r in scan.scan_directory(spark, str(tmp_path)).files.collect()] == ["pkg/a/kept/y.go"]


def test_patch_parser_counts_content_lines():
    patch = b'diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n--- a/fake\n-b\n+@@ -9 +9 @@\n@@ -5,0 +5,2 @@\n+c\n+d\ndiff --git "a/q\\n" "b/q\\n"\n--- "a/q\\n"\n+++ /dev/null\n@@ -3 +2,0 @@\n-x\n'
    assert G.parse_patch(patch) == [("x", 1, 2, 1, 1), ("x", 5, 0, 5, 2), ("q\n", 3, 1, 2, 0)]


def test_rendering():
    assert [R.number(x) for x in (0.0, 2.0, 0.1, 1e-7, 1.5e21, 1230368.7253820968)] == ["0", "2", "0.1", "1e-07", "1.5e+21", "1230368.7253820968"]
    assert R.aligned([["a", "bb", "c"], ["aaa", "b", "c"], [""], ["x", "y"]]) == "a    bb  c\naaa  b   c\n\nx  y\n"
    assert R.sparkline([0, 1, 0.5]) == "▁█▅" and R.sparkline([3, 3]) == "▁▁"
    assert R.safe("a\\b\n\u2028") == "a\\\\b\\n\\u2028" and R.inline("<a|'") == "&lt;a&#124;&#39;"
    with pytest.raises(ValueError, match="format must be"):
        R.render("trend", [], "xml")


DUCK = ["classify_bucket", "function_mass", "bucket_totals", "left_maximal_pairs", "clone_pairs", "clone_pair_ids", "clone_lines", "line_mapping_asof", "fn_delta", "mass_delta_by_bucket", "trend_points", "ext_reachability"]


@pytest.mark.parametrize("name", DUCK)
def test_queries_equal_their_sql(spark, name):
    import glob

    import duckdb

    from codeloam.plans.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no bundled tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    plain = lambda v: None if v is None else round(float(v), 9) if isinstance(v, float) else v
    want = Counter(tuple(plain(v) for v in row) for row in found.fetchall())
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(plain(v) for v in row) for row in got.select(*names).collect()) == want


def test_wide_ids_stay_apart(spark, tmp_path):
    from codeloam.plans import adapters
    from codeloam.plans.queries import QUERIES

    turns = [(conv, turn, "user", f"text {conv % 10}, {turn}") for conv in (6, 7, 8) for turn in range(1101)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    base = adapters.functions(spark, str(tmp_path))
    head = adapters.functions_head(base)
    assert base.select("fn_id").distinct().count() == base.count() == len(turns)
    assert head.select("fn_id").distinct().count() == head.count()
    found = [QUERIES[f"fn_match_phase{k}"](spark, str(tmp_path)).collect() for k in (1, 2, 3)]
    assert sum(r.before_id is not None for rows in found for r in rows) == base.where("conv_id % 3 != 0").count()
    assert sum(r.after_id is not None for rows in found for r in rows) == head.where("conv_id % 3 != 0").count()
    ids = spark.createDataFrame([(i,) for i in (7, 12345678, 123456780, 123456789)], "doc_id long")
    assert [r.path for r in ids.orderBy("doc_id").select(adapters.path_of()).collect()] == ["d00000007", "d12345678", "d123456780", "d123456789"]


def spread(rng, files):
    """Texts of words with random blanks, line ends and lines that hold only white space between them."""
    gaps = [" ", " ", " ", "\t", "\n", "\r\n", "\n\n", "\n   \n", "\n\x0b\n"]
    return {p: rng.choice(["", " ", "\n"]) + "".join(w + rng.choice(gaps) for w in words) for p, words in files.items()}


def matches_by_hand(texts, size, least):
    """Maximal matches with enough source lines, from exhaustive() over the words and their lines."""
    words = {p: [(w, n) for n, line in enumerate(t.split("\n"), 1) for w in re.findall(r"[^ \t\r\n]+", line)] for p, t in texts.items()}
    blank = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
    source = {p: {n for n, line in enumerate(t.split("\n"), 1) if not re.fullmatch(blank, line)} for p, t in texts.items()}
    found = Counter()
    for pa, x, pb, y, n in exhaustive({p: [w for w, _ in ws] for p, ws in words.items()}, size):
        a, b = (words[pa][x][1], words[pa][x + n - 1][1]), (words[pb][y][1], words[pb][y + n - 1][1])
        lines = min(len(source[p] & set(range(s, e + 1))) for p, (s, e) in ((pa, a), (pb, b)))
        if lines >= least:
            found[pa, *a, pb, *b, n, lines] += 1
    return found


@pytest.mark.parametrize("symbols, size, least", [(1, 5, 3), (2, 6, 4), (3, 5, 0), (5, 4, 2)])
def test_pairs_of_texts_equal_the_exhaustive_detector_with_lines(spark, symbols, size, least):
    rng = random.Random(symbols)
    long = ["x" * 5000, "é" * 9, "abcdefgh", "abcdefghi", "\u2003"][:symbols]
    files = {f"f{k:02}": [rng.choice(long) for _ in range(rng.randrange(60))] for k in range(9)}
    files["copy"] = files["f03"]
    texts = spread(rng, files)
    rows = [("r", "go", p, t) for p, t in texts.items()] + [("r", "go", "null", None), ("r", None, "lost", texts["f03"])]
    frame = spark.createDataFrame(rows, "rev string, language string, path string, text string")
    got = [tuple(r[c] for c in clones.PAIR) for r in clones.text_pairs(frame, size=size, least_lines=least).collect()]
    assert Counter(got) == matches_by_hand(texts, size, least)


def test_large_groups_of_copies_meet_in_pairs_that_start_or_end_there(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(40)}" for _ in range(70)]
    files = {}
    for k in range(45):
        own = list(base)
        if k % 3:
            own[rng.randrange(70)] = f"own{k % 5}"
        files[f"f{k:02}"] = own
    texts = {p: "\n".join(" ".join(w[i : i + 4]) for i in range(0, 70, 4)) for p, w in files.items()}
    frame = spark.createDataFrame([("r", "go", p, t) for p, t in texts.items()], "rev string, language string, path string, text string")
    got = Counter(tuple(r[c] for c in clones.PAIR) for r in clones.text_pairs(frame, size=20).collect())
    assert got == matches_by_hand(texts, 20, 5)


def test_windows_that_neither_start_nor_end_a_match_stay_in_their_task(spark):
    from codeloam.operators import matches

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(3000)) for _ in range(8)]
    frame = spark.createDataFrame([("r", "go", f"f{k}", t) for k, t in enumerate([*texts, texts[0], texts[1]])], "rev string, language string, path string, text string")
    sent = spark.sparkContext.broadcast(matches._filter(frame, "texts", 50))
    assert frame.mapInArrow(matches._window_rows("texts", 50, 0, sent), matches._WINDOW).count() < 1500
    assert matches.matches(frame, "texts", 50).count() == 2


@pytest.mark.parametrize("name", ["clone_bag_diff", "clone_ranges_union", "clone_share", "touched_clone_lines"])
def test_clone_queries_equal_their_sql(spark, name):
    test_queries_equal_their_sql(spark, name)


def test_only_windows_with_different_neighbours_are_sent(spark):
    from codeloam.operators import matches

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(3000)) for _ in range(8)]
    frame = spark.createDataFrame([("r", "go", f"f{k}", t) for k, t in enumerate([*texts, texts[0], texts[1]])], "rev string, language string, path string, text string")
    share = spark.sparkContext.broadcast
    sent = share(matches._filter(frame, "texts", 50))
    for sides, least, n in (("se", 0, 8), ("s", 0, 4), ("se", 2, 0)):
        only = share(matches._bits(frame.mapInArrow(matches._gram_rows("texts", 50, least, sides, sent), "h long, l long, r long")))
        assert frame.mapInArrow(matches._window_rows("texts", 50, least, sent, only), matches._WINDOW).count() == n


def test_clone_bag_diff_finds_pairs_once(spark):
    from codeloam.plans.queries import QUERIES

    plan = QUERIES["clone_bag_diff"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4  # windows, edges, matches, ids


def copied(rng):
    """Texts in groups of copies, with repeats inside, that have passages in common, and a pair of copies with too few lines."""
    words = [f"w{k}" for k in range(12)]
    base = [rng.choice(words) for _ in range(40)]
    own = {"a": base * 2, "b": [rng.choice(words) for _ in range(15)] + base[5:35], "c": ["same"] * 30, "d": base[10:25]}
    texts = {k: "\n".join(" ".join(w[i : i + 3]) for i in range(0, len(w), 3)) for k, w in own.items()}
    return {f"{(7 * i + 3) % 10}{k}{i}": t for k, t in texts.items() for i in range(4)} | {"5flat": " ".join(base), "1flat": " ".join(base)}


def test_ranges_of_copies_have_the_union_of_all_pairs(spark):
    texts = copied(random.Random(6))
    frame = spark.createDataFrame([("r", "go", p, t) for p, t in texts.items()], "rev string, language string, path string, text string")
    pairs = matches_by_hand(texts, 8, 3)
    assert Counter(tuple(r[c] for c in clones.PAIR) for r in clones.text_pairs(frame, size=8, least_lines=3).collect()) == pairs
    want = {p: set() for p in texts}
    for a, a0, a1, b, b0, b1, _, _ in pairs:
        want[a] |= set(range(a0, a1 + 1))
        want[b] |= set(range(b0, b1 + 1))
    got = {p: set() for p in texts}
    for r in clones.text_ranges(frame, 8, 3).collect():
        got[r.path] |= set(range(r.start, r.end + 1))
    assert got == want and not want["5flat"]


def test_copies_are_compared_once(spark):
    from codeloam.operators import matches

    texts = copied(random.Random(6))
    rows = [("r", "go", p, t) for p, t in texts.items()] + [("r", "py", "9py", texts["1flat"])]
    firsts, several = matches.copies(spark.createDataFrame(rows, "rev string, language string, path string, text string"), 8)
    assert sorted(r.path for r in firsts.collect()) == ["0a1", "0b1", "0c1", "0d1", "1flat", "9py"]
    assert {r.path: (len(r.paths), r.tokens, r.lines) for r in several.collect()} == {"0a1": (4, 80, 27), "0b1": (4, 45, 15), "0c1": (4, 30, 10), "0d1": (4, 15, 5), "1flat": (2, 40, 1)}
    again = spark.createDataFrame([*rows, ("r", "go", "0a1", "other")], "rev string, language string, path string, text string")
    assert sorted(r.path for r in matches.copies(again, 8)[0].collect() if r.path[1] == "a") == ["0a1", "0a1", "3a0"]


def changes_by_hand(base, head, touched, mapped):
    found = []
    for one in {p[0] for p in base + head}:
        order = lambda p: (p[1], p[2], p[4], p[5], p[3], p[6])
        a, b = (sorted((p for p in rows if p[0] == one), key=order) for rows in (base, head))
        for p in list(a):
            to = (p[0], p[1], mapped(p[1], p[2]), mapped(p[1], p[3]), p[4], mapped(p[4], p[5]), mapped(p[4], p[6]))
            if None not in to and to in b:
                a.remove(p)
                b.remove(to)
        n = min(len(a), len(b))
        found += [("-", *p) for p in a[n:]] + [("+", *p) for p in b[n:]]
    return Counter(r for r in found if r[2] in touched or r[5] in touched)


@pytest.mark.parametrize("moves", [False, True])
def test_clone_changes_of_bags_with_repeats(spark, moves):
    rng = random.Random(6)
    pair = lambda: (f"id{rng.randrange(12)}", f"f{rng.randrange(2)}", (x := rng.randrange(1, 4)), x + 5, f"g{rng.randrange(2)}", (y := rng.randrange(1, 4)), y + 5)
    base, head = [pair() for _ in range(150)], [pair() for _ in range(140)]
    to = {(p, n): (None if n == 2 else n + 1) if moves and p == "f1" else n for p in ("f0", "f1", "g0", "g1") for n in range(1, 9)}
    names = "id string, a_path string, a_start int, a_end int, b_path string, b_start int, b_end int, tokens int, lines int"
    frames = [spark.createDataFrame([(*p, 50, 5) for p in rows], names) for rows in (base, head)]
    touched = spark.createDataFrame([("f1",), ("g0",)], "path string")
    mapped = spark.createDataFrame([(*k, v) for k, v in to.items()], "path string, line int, mapped int") if moves else None
    got = Counter(tuple(r)[:-2] for r in diff.clone_changes(*frames, touched, mapped).collect())
    assert got == changes_by_hand(base, head, {"f1", "g0"}, lambda p, n: to[p, n]) and len(got) > 5
