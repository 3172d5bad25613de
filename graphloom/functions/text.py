"""Scalar functions on text, paths, hashes and times, as Column expressions.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, shortest: int = 2) -> Column:
    """Lower-case runs of [a-z0-9_] with at least `shortest` characters; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), lambda t: F.length(t) >= shortest)


def query_tokens(query: str, shortest: int = 2) -> list[str]:
    """The tokens of a query, on the driver, by the same rule."""
    import re

    return [t for t in re.split("[^a-z0-9_]+", query.lower()) if len(t) >= shortest]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The path up to its last slash; . for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extname(path: Column) -> Column:
    """The last dot of the base name and what follows; empty without one or for dot files."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def normal_path(path: Column) -> Column:
    """Forward slashes, without a leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 1 for two empty ones."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def occurrences(text: Column, term: Column) -> Column:
    """How often a literal term occurs, without overlaps; 0 for an empty term or null text."""
    gone = F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, ((F.length(text) - gone) / F.length(term)).cast("int")).otherwise(0)


def estimated_tokens(value: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(value) / 4).cast("int")


def project_of(root: Column) -> Column:
    """The 4-character id of a workspace: 24 bits of its SHA-256, modulo 36^4, in base 36."""
    number = F.conv(F.substring(F.sha2(root, 256), 1, 6), 16, 10).cast("long") % F.lit(36**4)
    return F.lpad(F.lower(F.conv(number.cast("string"), 10, 36)), 4, "0")


def point_id(text: Column) -> Column:
    """A UUID-shaped id with version 4 and variant 8, from SHA-256."""
    h = F.sha2(text, 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def _fold32(text: Column, start: int, step) -> Column:
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(start).cast("long"), step)


def fnv1a(text: Column) -> Column:
    """FNV-1a over character codes, unsigned 32 bits."""
    return _fold32(text, 0x811C9DC5, lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))


def poly31(text: Column) -> Column:
    """The 31-polynomial hash as a signed 32-bit number."""
    h = _fold32(text, 0, lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 2**31, h - 2**32).otherwise(h).cast("int")


def poly31_hex(text: Column) -> Column:
    """poly31 without its sign, in hexadecimal."""
    return F.lower(F.hex(F.abs(poly31(text).cast("long"))))


def js_round(value: Column, digits: int) -> Column:
    return F.round(value, digits)


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1; empty beyond the end."""
    return F.array_join(F.slice(F.split(text, "\n"), max(1, first), max(0, last - max(1, first) + 1)), "\n")


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last of columns, counted from 1; empty beyond the end, null without either."""
    begin = F.greatest(F.lit(1), first)
    return F.array_join(F.slice(F.split(text, "\n"), begin, F.greatest(F.lit(0), last - begin + 1)), "\n")


def assembled(name: Column, description: Column, kind: Column, params: Column, extends: Column, implements: Column, path: Column) -> Column:
    """The text an element is embedded by; missing parts are left out."""
    named = lambda label, c: F.concat(F.lit(label), c)
    return F.concat_ws(" ", name, description, named("kind:", kind), named("params:", params), named("extends:", extends), named("implements:", implements), named("path:", path))


# The intents of a question, and the modes of a reference search, first match wins.
INTENTS = [
    ("test-impact", "(test|coverage|spec|affected)"),
    ("progress", "(progress|feature|task|blocked|milestone)"),
    ("dependency", "(import|dependency|depends|caller|called by|uses)"),
    ("structure", "(file|folder|class|function|structure|tree|list)"),
]
REF_MODES = [
    ("architecture", "(architect|structure|pattern|design|layer|module|overview|convention|best.?practice)"),
    ("docs", "(how to|example|guide|decision|adr|changelog)"),
    ("code", "(function|class|method|import|export|interface|type|impl|usage)"),
]


def _first(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def intent(query: Column) -> Column:
    """test-impact, progress, dependency, structure or general."""
    return _first(F.coalesce(query, F.lit("")), INTENTS, "general")


def ref_mode(query: Column, symbol: Column | None = None) -> Column:
    """architecture, docs, code or all; code wherever a symbol is given."""
    mode = _first(F.coalesce(query, F.lit("")), REF_MODES, "all")
    return mode if symbol is None else F.when(F.length(symbol) > 0, "code").otherwise(mode)
