"""Column functions over source text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CUTOFF


def mass(cc: Column, sloc: Column) -> Column:
    return cc * F.sqrt(sloc.cast("double"))


def ratio(n: Column, d: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def eroded(cc: Column, mass_: Column) -> Column:
    return F.when(cc > CUTOFF, mass_).otherwise(F.lit(0.0))


def non_blank_lines(text: Column) -> Column:
    """Lines with a character that isn't Unicode white space."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"(?U)\S")))


def terminators(text: Column, language: Column) -> Column:
    """Line ends: LF alone, and for scripts also CR LF as one, CR, U+2028 and U+2029."""
    return F.when(language == "typescript", F.regexp_count(text, F.lit("\\r\\n|[\\n\\r\\u2028\\u2029]"))).otherwise(F.regexp_count(text, F.lit("\\n")))


def note(before_cc: Column, after_cc: Column) -> Column:
    return (
        F.when(before_cc.isNull(), "new")
        .when(after_cc.isNull(), "removed")
        .when((before_cc <= CUTOFF) & (after_cc > CUTOFF), f"crossed CC {CUTOFF}")
        .when((before_cc > CUTOFF) & (after_cc <= CUTOFF), f"back under CC {CUTOFF}")
        .otherwise("")
    )


def generated_marker(text: Column, ext: Column) -> Column:
    """Whether a leading comment says that the file is generated (text: the file's beginning).

    The leading comments are what one possessive expression takes from the start: blank space, line
    comments, block comments and, where the language has them, # and <!-- --> comments."""
    lead = r"(?s)^\x{FEFF}?((?:\s++|//[^\n]*+\n?|/\*.*?\*/|<!--.*?-->|#[^\n]*+\n?)*+)"
    plain = r"(?s)^\x{FEFF}?((?:\s++|//[^\n]*+\n?|/\*.*?\*/|<!--.*?-->|\A#![^\n]*+\n?)*+)"
    comments = F.when(ext == "py", F.regexp_extract(text, lead, 1)).otherwise(F.regexp_extract(text, plain, 1))
    marked = F.lower(comments).rlike("@generated|linguist-generated")
    canonical = comments.rlike(r"(?m)^// Code generated .* DO NOT EDIT\.\r?$")
    loose = comments.contains("Code generated ") & comments.contains(" DO NOT EDIT.")
    return marked | F.when(ext == "go", canonical).otherwise(loose)


def prefixed(x: Column) -> Column:
    """Binary x behind its length as eight bytes, in hex."""
    return F.concat(F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0"), F.hex(x))


def clone_id(first: Column, second: Column, said: Column) -> Column:
    """SHA-256 of the two paths in order and the tokens, each prefixed; said: the tokens so, joined."""
    lead = F.concat(prefixed(F.least(first, second).cast("binary")), prefixed(F.greatest(first, second).cast("binary")))
    return F.sha2(F.unhex(F.concat(lead, said)), 256)
