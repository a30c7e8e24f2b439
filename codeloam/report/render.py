"""Documents as JSON, aligned text or Markdown. A document is what plans.compare returns."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from ..schema import BUCKETS, CUTOFF, MARKER

BARS = "▁▂▃▄▅▆▇█"
FORMATS = ("md", "json", "text")
EXPLAINER = "Mass is cyclomatic complexity times the square root of source lines. Erosion is the share of mass in functions over CC 10. Clone lines are source lines inside runs of at least 50 equal tokens over at least five lines."


def safe(text: str) -> str:
    """Control characters, line separators and backslashes as reversible escapes."""
    known = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return re.sub("[\\\\\x00-\x1f\x7f-\x9f\u2028\u2029]", lambda m: known.get(m[0]) or f"\\u{ord(m[0]):04x}", text)


def inline(text: str) -> str:
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("|", "&#124;")):
        text = text.replace(a, b)
    return text


def number(x: float) -> str:
    """The shortest decimal that reads back; whole numbers without a point, exponents only far from 1."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    if 1e-6 <= abs(x) < 1e21:
        short = repr(x)
        return short if "e" not in short else f"{x:.{max(0, 17 - int(math.floor(math.log10(abs(x)))))}f}".rstrip("0")
    mantissa, _, exponent = repr(x).partition("e")
    return f"{mantissa.removesuffix('.0')}e{int(exponent):+03d}"


def to_json(value, depth: int = 0) -> str:
    pad, inner = "  " * depth, "  " * (depth + 1)
    if isinstance(value, dict):
        if not value:
            return "{}"
        return "{\n" + ",\n".join(f"{inner}{json.dumps(k)}: {to_json(v, depth + 1)}" for k, v in value.items()) + f"\n{pad}}}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(inner + to_json(v, depth + 1) for v in value) + f"\n{pad}]" if value else "[]"
    if isinstance(value, float):
        return number(value)
    return json.dumps(value, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def _escaped(value, key: str = ""):
    """A copy with every path made safe, and without empty lists of nested rows and axis labels."""
    if isinstance(value, dict):
        return {k: _escaped(v, k) for k, v in value.items() if not (k == "nested" and not v) and k != "axis_label"}
    if isinstance(value, list):
        return [_escaped(v, key) for v in value]
    return safe(value) if isinstance(value, str) and key in ("file", "touched", "skipped", "warnings") else value


def aligned(rows: list[list[str]]) -> str:
    """Cells in columns two blanks apart; a column's block ends at a row that lacks it, and last cells take no room."""
    widths = [[0] * len(r) for r in rows]

    def block(a: int, b: int, column: int) -> None:
        at = a
        while at < b:
            if len(rows[at]) <= column + 1:
                at += 1
                continue
            end = at
            while end < b and len(rows[end]) > column + 1:
                end += 1
            width = max(len(rows[k][column]) for k in range(at, end))
            for k in range(at, end):
                widths[k][column] = width + 2 if width else 0
            block(at, end, column + 1)
            at = end

    block(0, len(rows), 0)
    return "".join("".join(c.ljust(w) for c, w in zip(r[:-1], ws)) + r[-1] + "\n" if r else "\n" for r, ws in zip(rows, widths))


def _walk(items: list[dict], mark: str, level: int = 0) -> Iterator[tuple[dict, str]]:
    for item in items:
        yield item, mark * level
        yield from _walk(item["nested"], mark, level + 1)


def _place(r: dict) -> str:
    return f"{safe(r['file'])}:{r['start']}-{r['end']}"


def _metric(f: dict | None, key: str) -> str:
    return "·" if f is None else str(f[key])


def _three(*values: float) -> list[str]:
    return [f"{v:.3f}" for v in values]


def _trend_rows(points: list[dict]) -> list[list[str]]:
    rows = [["date", "revision", "bucket", "erosion", "clone share"]]
    return rows + [[safe(p["date"]), safe(p["rev"]), b, *_three(p["buckets"][b]["erosion"], p["buckets"][b]["clone_share"])] for p in points for b in BUCKETS]


def snapshot_text(doc: dict) -> str:
    rows = [["revision", safe(doc["rev"])], ["bucket", "functions", "mass", "mass over CC 10", "erosion", "source lines", "clone lines", "clone share"]]
    for b in BUCKETS:
        t = doc["buckets"][b]
        rows.append([b, str(t["functions"]), *_three(t["mass"], t["mass_over_cc_10"], t["erosion"]), str(t["source_lines"]), str(t["clone_lines"]), *_three(t["clone_share"])])
    rows += [[""], ["clone pairs"], ["id", "first location", "second location", "tokens", "lines"]]
    rows += [[p["id"], _place(p["a"]), _place(p["b"]), str(p["tokens"]), str(p["lines"])] for p in doc["clones"]]
    rows += [[""], ["functions"], ["file", "line", "bucket", "name", "CC", "SLOC", "mass"]]
    rows += [[safe(f["file"]), str(f["line"]), f["bucket"], mark + safe(f["name"]), str(f["cc"]), str(f["sloc"]), *_three(f["mass"])] for f, mark in _walk(doc["functions"], ">")]
    rows += [["skipped", safe(s["file"]), f"max_file_bytes={s['max_bytes']}", f"asked_bytes={s['asked_bytes']}"] for s in doc["skipped_details"] or []]
    return aligned(rows + [["warning", safe(w)] for w in doc["warnings"]])


def diff_text(doc: dict, color: bool = False) -> str:
    rows = [["base", safe(doc["base"])], ["head", safe(doc["head"])]]
    rows.append(["bucket", "mass added over CC 10", "mass removed over CC 10", "clone lines touched before", "clone lines touched after", "erosion before", "erosion after", "clone share before", "clone share after"])
    paint: dict[int, list[tuple[str, str]]] = {}
    for b in BUCKETS:
        d = doc["buckets"][b]
        plus, minus = f"+{d['mass_added_over_cc_10']:.3f}", f"-{d['mass_removed_over_cc_10']:.3f}"
        paint[len(rows)] = [(plus, "32"), (minus, "31")]
        rows.append([b, plus, minus, str(d["clone_lines_touched_before"]), str(d["clone_lines_touched_after"]), *_three(d["erosion_before"], d["erosion_after"], d["clone_share_before"], d["clone_share_after"])])
    rows += [[""], ["functions"]]
    flat = list(_walk(doc["functions"], ">"))
    if any(mark for _, mark in flat):
        rows.append(["nested rows", "indented with > and excluded from headline and bucket totals"])
    rows.append(["file", "name", "CC before", "CC after", "SLOC before", "SLOC after", "mass delta", "note"])
    for f, mark in flat:
        delta = f"{f['delta_mass']:+.3f}"
        if f["delta_mass"]:
            paint[len(rows)] = [(delta, "32" if f["delta_mass"] > 0 else "31")]
        rows.append([safe(f["file"]), mark + safe(f["name"]), *(_metric(f[s], k) for k in ("cc", "sloc") for s in ("before", "after")), delta, safe(f["note"])])
    rows.append([""])
    for name in ("added", "removed"):
        pairs = doc[f"clones_{name}"]
        rows += [[f"clone pairs {name}", str(len(pairs))], ["first location", "second location", "tokens", "lines"]]
        rows += [[_place(p["a"]), _place(p["b"]), str(p["tokens"]), str(p["lines"])] for p in pairs]
    if doc.get("trend"):
        rows += [[""], *_trend_rows(doc["trend"])]
    lines = aligned(rows).split("\n")
    for k, tokens in paint.items() if color else ():
        for token, code in tokens:
            head, found, tail = lines[k].rpartition(token)
            lines[k] = f"{head}\x1b[{code}m{found}\x1b[0m{tail}" if found else lines[k]
    return "\n".join(lines)


def sparkline(values: list[float]) -> str:
    low, high = min(values), max(values)
    return "".join(BARS[0 if high == low else math.floor((v - low) / (high - low) * 7 + 0.5)] for v in values)


def _sparklines(points: list[dict]) -> list[str]:
    out = ["```text"]
    for name, key, show in (("erosion", "erosion", lambda v: f"{v:.3f}"), ("clone share", "clone_share", lambda v: f"{v * 100:.1f}%")):
        for b in BUCKETS:
            v = [p["buckets"][b][key] for p in points]
            out.append(f"{name}, {b:<6}  {show(v[0])} → {show(v[-1])}  {sparkline(v)}")
    return [*out, "```"]


def _charts(points: list[dict]) -> list[str]:
    label = lambda p: p["axis_label"] or (p["date"][:7] if re.match(r"\d{4}-\d\d-\d\dT", p["date"]) else safe(p["date"]))
    labels = ", ".join('"' + label(p).replace('"', '\\"') + '"' for p in points)
    out: list[str] = []
    for b in BUCKETS:
        values = ", ".join(f"{p['buckets'][b]['erosion']:.6f}" for p in points)
        out += [""] * bool(out) + ["```mermaid", '%%{init: {"xyChart": {"width": 420, "height": 300}}}%%', "xychart-beta", f'    title "{b.capitalize()} erosion by month"', f"    x-axis [{labels}]", '    y-axis "erosion" 0 --> 1', f"    line [{values}]", "```"]
    return out


def contributor(functions: list[dict], sign: int) -> str:
    side = "after" if sign > 0 else "before"
    fit = [f for f in functions if f["delta_mass"] * sign > 0 and f[side] and (f[side]["bucket"] or BUCKETS[0]) == BUCKETS[0] and f[side]["cc"] > CUTOFF]
    if not fit:
        return ""
    best = max(fit, key=lambda f: f["delta_mass"] * sign)
    return f"<code>{_cell(best['name'])}</code> in <code>{_cell(best['file'])}</code> (CC {best[side]['cc']}, {best[side]['sloc']} lines)"


def _cell(text: str) -> str:
    return inline(safe(text))


def diff_markdown(doc: dict) -> str:
    d, added, removed = doc["buckets"][BUCKETS[0]], doc["clones_added"], doc["clones_removed"]
    out = [MARKER, "## codehealth", "", "```diff"]
    plus, minus = d["mass_added_over_cc_10"], d["mass_removed_over_cc_10"]
    if not (plus or minus or added or removed or doc["functions"]):
        out += ["  No complexity or clone changes detected.", "```"]
    else:
        change = len(added) - len(removed)
        out += [f"+ {plus:.3f} source mass added to functions over CC 10", f"- {minus:.3f} source mass removed from functions over CC 10", f"± {f'{change:+d}' if change > 0 else change} clone pairs ({len(added)} introduced, {len(removed)} removed)", "```"]
        for name, sign in (("addition", 1), ("removal", -1)):
            if detail := contributor(doc["functions"], sign):
                out += ["", f"Largest {name}: {detail}."]
    out += ["", "| bucket | mass added over CC 10 | mass removed over CC 10 | clone lines in touched files |", "|---|---:|---:|---:|"]
    for b in BUCKETS:
        x = doc["buckets"][b]
        out.append(f"| {b} | +{x['mass_added_over_cc_10']:.3f} | -{x['mass_removed_over_cc_10']:.3f} | {x['clone_lines_touched_before']} → {x['clone_lines_touched_after']} |")
    trend = doc.get("trend") or []
    out += ["", *_sparklines(trend)] if trend else []
    flat = list(_walk(doc["functions"], "↳ "))
    nested = len(flat) - len(doc["functions"])
    out += ["", "<details>", f"<summary>{len(doc['functions'])} top-level function changes; {nested} nested function changes</summary>" if nested else f"<summary>{len(doc['functions'])} functions changed mass</summary>", ""]
    out += ["Nested rows are drill-down details and are excluded from headline and bucket totals.", ""] if nested else []
    out += ["| function | bucket before → after | CC before → after | SLOC before → after | Δmass | note |", "|---|---|---:|---:|---:|---|"]
    for f, mark in flat:
        pair = lambda k: f"{_metric(f['before'], k)} → {_metric(f['after'], k)}"  # noqa: E731, B023
        out.append(f"| <code>{mark}{_cell(f['name'])}</code> in <code>{_cell(f['file'])}</code> | {pair('bucket')} | {pair('cc')} | {pair('sloc')} | {f['delta_mass']:+.3f} | {_cell(f['note'])} |")
    out += ["", "</details>", "", "<details>", f"<summary>{len(added)} clone pairs introduced, {len(removed)} removed</summary>", ""]
    files = sorted({p[s]["file"] for p in added + removed for s in "ab"}, key=str.encode)
    labels = {f: f"f{k}" for k, f in enumerate(files, 1)}
    out += [f"<code>{label}</code> = <code>{_cell(f)}</code><br>" for f, label in labels.items()] + [""] * bool(files) + ["```text"]
    spot = lambda r: f"{labels[r['file']]}:{r['start']}-{r['end']}"
    out += [f"{sign} {spot(p['a'])} ↔ {spot(p['b'])}" for sign, pairs in (("+", added), ("-", removed)) for p in pairs]
    out += ["```", "", "</details>", "", "<details>", "<summary>How to read these numbers</summary>", "", EXPLAINER, "", "</details>"]
    return "\n".join(out + (["", *_charts(trend)] if trend else [])) + "\n"


def snapshot_markdown(doc: dict) -> str:
    out = ["## codehealth scan", "", f"Revision: <code>{_cell(doc['rev'])}</code>", "", "| bucket | functions | mass | mass over CC 10 | erosion | source lines | clone lines | clone share |", "|---|---:|---:|---:|---:|---:|---:|---:|"]
    for b in BUCKETS:
        t = doc["buckets"][b]
        out.append(f"| {b} | {t['functions']} | {t['mass']:.3f} | {t['mass_over_cc_10']:.3f} | {t['erosion']:.3f} | {t['source_lines']} | {t['clone_lines']} | {t['clone_share']:.3f} |")
    out += ["", "<details>", f"<summary>{len(doc['functions'])} functions</summary>", "", "| function | location | bucket | CC | SLOC | mass |", "|---|---|---|---:|---:|---:|"]
    out += [f"| <code>{mark}{_cell(f['name'])}</code> | <code>{_cell(f['file'])}:{f['line']}</code> | {f['bucket']} | {f['cc']} | {f['sloc']} | {f['mass']:.3f} |" for f, mark in _walk(doc["functions"], "↳ ")]
    out += ["", "</details>", "", "<details>", f"<summary>{len(doc['clones'])} clone pairs</summary>", "", "| first location | second location | tokens | lines |", "|---|---|---:|---:|"]
    spot = lambda r: f"<code>{_cell(r['file'])}:{r['start']}–{r['end']}</code>"
    out += [f"| {spot(p['a'])} | {spot(p['b'])} | {p['tokens']} | {p['lines']} |" for p in doc["clones"]] + ["", "</details>"]
    skipped = doc["skipped_details"] or []
    if skipped or doc["warnings"]:
        out += ["", "<details>", f"<summary>{len(skipped)} skipped files, {len(doc['warnings'])} warnings</summary>", ""]
        out += [f"- Skipped <code>{_cell(s['file'])}</code>: <code>max_file_bytes={s['max_bytes']}</code>, <code>asked_bytes={s['asked_bytes']}</code>" for s in skipped]
        out += [f"- Warning: {_cell(w)}" for w in doc["warnings"]] + ["", "</details>"]
    return "\n".join(out) + "\n"


def trend_markdown(points: list[dict]) -> str:
    out = ["## codehealth trend", ""]
    if not points:
        return "\n".join([*out, "No history points."]) + "\n"
    out += [*_sparklines(points), "", "| date | revision | bucket | erosion | clone share |", "|---|---|---|---:|---:|"]
    out += [f"| {_cell(p['date'])} | <code>{_cell(p['rev'])}</code> | {b} | {p['buckets'][b]['erosion']:.3f} | {p['buckets'][b]['clone_share']:.3f} |" for p in points for b in BUCKETS]
    return "\n".join([*out, "", *_charts(points)]) + "\n"


def render(kind: str, doc, format_: str, color: bool = False) -> str:
    """kind: snapshot, diff or trend."""
    if format_ not in FORMATS:
        raise ValueError(f'format must be md, json, or text, got "{format_}"')
    if format_ == "json":
        return to_json(_escaped(doc)) + "\n"
    if kind == "trend":
        return trend_markdown(doc) if format_ == "md" else aligned(_trend_rows(doc))
    if kind == "diff":
        return diff_markdown(doc) if format_ == "md" else diff_text(doc, color)
    return snapshot_markdown(doc) if format_ == "md" else snapshot_text(doc)


def bounded(text: str, units: int = 65_536, notice: str = "The full report is in the job summary.") -> str:
    """text, or what stands before its first details and a notice, within so many UTF-16 units."""
    if len(text.encode("utf-16-le")) // 2 <= units:
        return text
    head = text.partition("\n<details>")[0] + f"\n\n{notice}\n"
    return head if len(head.encode("utf-16-le")) // 2 <= units else f"{MARKER}\n{notice}\n"
