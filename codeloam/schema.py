"""Constants and schemas of the analysis relations."""

from __future__ import annotations

#: A clone needs this many tokens and source lines; mass above this complexity counts as eroded.
CLONE_TOKENS, CLONE_LINES, CUTOFF = 50, 5, 10
#: Larger files are skipped unless generated.
MAX_BYTES = 2 * 1024 * 1024
BUCKETS = ("source", "tests")
CONFIG_FILE = ".codehealth.json"
MARKER = "<!-- codehealth -->"

FILES = "rev string, path string, oid string, size long, content binary"
FUNCTIONS = "rev string, path string, fn_id long, parent_id long, depth int, ord int, name string, bucket string, line int, cc int, sloc int"
TOKENS = "rev string, path string, language string, pos int, text binary, line int, end_line int"
SOURCE_LINES = "rev string, path string, bucket string, line int"
LINE_CHANGES = "path string, before_start int, before_count int, after_start int, after_count int"
COMMITS = "pos int, rev string, date string"
