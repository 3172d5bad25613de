"""Parsing of source code to symbols, by line rules per language, in Arrow batches.

A language is a table of rules; a block ends where its braces balance or its indentation ends. The
rules are regular expressions, so unusual layouts may be missed; texts that are null give nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "relative_path string, kind string, name string, start_line int, end_line int, exported boolean, parent string, detail string, specifiers array<string>"

_NAME = r"([A-Za-z_$][\w$]*)"
#: Words that open a block with brackets but aren't methods.
NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "else", "do", "try", "with", "new", "typeof", "await", "super"}


@dataclass
class Rules:
    """(kind, pattern) in order; group 1 is the name, `detail` and `parent` are named groups."""

    lines: list[tuple[str, re.Pattern]]
    indented: bool = False
    comment: str = "//"
    calls: re.Pattern = field(default_factory=lambda: re.compile(rf"(?<![\w$.]){_NAME}\s*\("))


def _rules(*pairs: tuple[str, str], **rest) -> Rules:
    return Rules([(k, re.compile(p)) for k, p in pairs], **rest)


_JS = _rules(
    ("class", rf"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}(?:<[^{{]*?>)?(?:\s+extends\s+(?P<parent>[\w$.]+)(?:<[^{{]*?>)?)?(?:\s+implements\s+(?P<detail>[^{{]+))?"),
    ("interface", rf"\s*(?:export\s+)?interface\s+{_NAME}(?:<[^{{]*?>)?(?:\s+extends\s+(?P<parent>[\w$.]+))?"),
    ("type", rf"\s*(?:export\s+)?type\s+{_NAME}(?:<[^=]*>)?\s*="),
    ("enum", rf"\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"),
    ("function", rf"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}\s*\((?P<detail>[^)]*)"),
    ("function", rf"\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?\((?P<detail>[^)]*)\)\s*(?::[^=]+)?=>"),
    ("test_suite", r"\s*describe\s*\(\s*['\"`]([^'\"`]+)"),
    ("test_case", r"\s*(?:it|test)\s*\(\s*['\"`]([^'\"`]+)"),
    ("method", rf"\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*{_NAME}\s*\((?P<detail>[^)]*)\)\s*(?::[^{{]+)?\{{\s*$"),
    ("variable", rf"\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?="),
)
LANGUAGE_RULES = {
    "typescript": _JS,
    "javascript": _JS,
    "python": _rules(("class", rf"\s*class\s+{_NAME}(?:\(\s*(?P<parent>[\w.]+))?"), ("function", rf"\s*(?:async\s+)?def\s+{_NAME}\s*\((?P<detail>[^)]*)"), indented=True, comment="#"),
    "go": _rules(("class", rf"\s*type\s+{_NAME}\s+(?P<detail>struct|interface)"), ("function", rf"\s*func\s+(?:\([^)]*\)\s*)?{_NAME}\s*\(")),
    "rust": _rules(("class", rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?P<detail>struct|enum|trait)\s+(?:)(?P<name>[A-Za-z_]\w*)"), ("function", rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+{_NAME}")),
    "java": _rules(
        ("class", rf"\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum)\s+{_NAME}(?:<[^{{]*?>)?(?:\s+extends\s+(?P<parent>[\w.]+))?(?:<[^{{]*?>)?(?:\s+implements\s+(?P<detail>[^{{]+))?"),
        ("method", rf"\s*(?:(?:public|private|protected|abstract|final|static|synchronized)\s+)+[\w<>\[\],.? ]+\s{_NAME}\s*\((?P<detail>[^)]*)\)"),
    ),
}
_ES_IMPORT = re.compile(r"^\s*import\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\*\s+as\s+(?P<star>[\w$]+)\s*)?(?:\{(?P<named>[^}]*)\}\s*)?(?:from\s+)?['\"](?P<source>[^'\"]+)['\"]", re.MULTILINE)
_ES_EXPORT_FROM = re.compile(r"^\s*export\s+(?:\*|\{(?P<named>[^}]*)\})\s+from\s+['\"](?P<source>[^'\"]+)['\"]", re.MULTILINE)
_ES_EXPORT = re.compile(r"^\s*export\s+(?P<default>default\s+)?(?:abstract\s+|async\s+)*(?:const|let|var|function\*?|class|interface|type|enum)?\s*(?P<name>[\w$]+)?", re.MULTILINE)
OTHER_IMPORTS = {
    "python": [re.compile(r"^\s*from\s+(?P<source>[\w.]+)\s+import\s+(?P<named>[^\n#]+)", re.MULTILINE), re.compile(r"^\s*import\s+(?P<source>[\w.]+)", re.MULTILINE)],
    "go": [re.compile(r"^\s*import\s+(?:\w+\s+)?\"(?P<source>[^\"]+)\"", re.MULTILINE), re.compile(r"^\s+(?:\w+\s+)?\"(?P<source>[^\"\n]+)\"\s*$", re.MULTILINE)],
    "rust": [re.compile(r"^\s*(?:pub\s+)?use\s+(?P<source>[^;]+);", re.MULTILINE)],
    "java": [re.compile(r"^\s*import\s+(?:static\s+)?(?P<source>[\w.*]+);", re.MULTILINE)],
}


def _names(text: str | None) -> list[str]:
    """Imported names of a list; those renamed by their own name."""
    out = []
    for part in (text or "").strip("() \n").split(","):
        name = re.split(r"\s+as\s+|:", part.strip().removeprefix("type "))[0].strip()
        if re.fullmatch(r"[\w$*]+", name):
            out.append(name)
    return out


def _braces_end(lines: list[str], start: int) -> int:
    level, opened = 0, False
    for n in range(start, len(lines)):
        code = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|//.*", "", lines[n])
        for c in code:
            if c == "{":
                level, opened = level + 1, True
            elif c == "}":
                level -= 1
                if opened and level <= 0:
                    return n
        if not opened and (code.rstrip().endswith(";") or n > start + 8):
            return n if code.rstrip().endswith(";") else start
    return len(lines) - 1 if opened else start


def _indent_end(lines: list[str], start: int) -> int:
    width = len(lines[start]) - len(lines[start].lstrip())
    end = start
    for n in range(start + 1, len(lines)):
        if lines[n].strip():
            if len(lines[n]) - len(lines[n].lstrip()) <= width:
                break
            end = n
    return end


def parse_symbols(text: str | None, language: str | None) -> list[tuple]:
    """(kind, name, first line, last line, exported, parent, detail, specifiers) of a source text, lines from 1.

    Kinds: class, interface, type, enum, function, method, variable, test_suite, test_case, import,
    export and call; the parent of a call or test case is the innermost function or suite around it.
    """
    rules = LANGUAGE_RULES.get(language or "")
    if not text or rules is None:
        return []
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    out: list[tuple] = []
    for n, line in enumerate(lines):
        if line.lstrip().startswith(rules.comment):
            continue
        for kind, pattern in rules.lines:
            m = pattern.match(line)
            if not m:
                continue
            groups = m.groupdict()
            name = groups.get("name") or m[1]
            if kind == "method" and name in NOT_METHODS:
                continue
            if kind == "variable" and line[:1].isspace():
                break
            end = _indent_end(lines, n) if rules.indented else n if kind in ("type", "variable") else _braces_end(lines, n)
            exported = bool(re.match(r"\s*(?:export|pub|public)\b", line)) or (language == "go" and name[:1].isupper()) or (language == "python" and not name.startswith("_"))
            out.append(("function" if kind == "method" else kind, name, n + 1, end + 1, exported, groups.get("parent"), (groups.get("detail") or "").strip() or None, None))
            break
    scopes = [s for s in out if s[0] == "function"]
    suites = [s for s in out if s[0] == "test_suite"]
    out = [(*s[:5], _around(suites, s[2]), *s[6:]) if s[0] == "test_case" else s for s in out]
    for n, line in enumerate(lines):
        scope = _around(scopes, n + 1)
        declares = any(s[2] == n + 1 for s in scopes)
        if scope and not line.lstrip().startswith(rules.comment):
            for m in rules.calls.finditer(line):
                if m[1] not in NOT_METHODS and not (declares and m[1] == scope):
                    out.append(("call", m[1], n + 1, n + 1, False, scope, None, None))
    return out + _imports(text, language or "")


def _around(scopes: list[tuple], line: int) -> str | None:
    inside = [s for s in scopes if s[2] <= line <= s[3]]
    return max(inside, key=lambda s: s[2])[1] if inside else None


def _imports(text: str, language: str) -> list[tuple]:
    at = lambda m: text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
    out = []
    if language in ("typescript", "javascript"):
        for m in _ES_IMPORT.finditer(text):
            names = [x for x in (m["default"], m["star"]) if x] + _names(m["named"])
            out.append(("import", m["source"], at(m), at(m), False, None, None, names))
        for m in _ES_EXPORT_FROM.finditer(text):
            out.append(("import", m["source"], at(m), at(m), False, None, "re-export", _names(m["named"])))
            out.append(("export", m["named"].strip() if m["named"] else "*", at(m), at(m), True, None, "re-export", None))
        for m in _ES_EXPORT.finditer(text):
            if m["name"] and m["name"] != "from":
                out.append(("export", m["name"], at(m), at(m), True, None, "default" if m["default"] else None, None))
    seen = set()
    for pattern in OTHER_IMPORTS.get(language, []):
        for m in pattern.finditer(text):
            if (m["source"], at(m)) not in seen:
                seen.add((m["source"], at(m)))
                out.append(("import", m["source"].strip(), at(m), at(m), False, None, None, _names(m.groupdict().get("named"))))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SYMBOLS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
    for batch in batches:
        rows = [(p, *s) for p, t, g in zip(*(batch.column(k).to_pylist() for k in range(3))) for s in parse_symbols(t, g)]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of source files (relative_path, text, language); embarrassingly parallel."""
    return files.select("relative_path", "text", "language").mapInArrow(_parse, SYMBOLS)


def file_facts(files: DataFrame) -> DataFrame:
    """(relative_path, language, loc, hash) per file."""
    return files.select("relative_path", "language", F.size(F.split("text", "\n")).alias("loc"), F.sha2("text", 256).alias("hash"))
