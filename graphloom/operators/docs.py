"""Markdown documents: sections, their features, kinds and titles, and the document graph.

Section splitting is a state machine over lines, so it runs in Arrow batches in Python; everything
derived from sections is built-in expressions. Null and empty texts give no section.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import basename

STORED = 4000
SECTIONS = "relative_path string, section int, heading string, level int, start_line int, content string"
_ATX, _FENCE = re.compile(r"^(#{1,3})\s+(.*?)\s*#*\s*$"), re.compile(r"^\s*(```|~~~)")


def split_sections(text: str | None) -> list[tuple[str, int, int, str]]:
    """(heading, level, first line, body) of a document; text before the first heading is a section without one.

    Headings of levels 1 to 3, with # or underlined by = or -, outside of fences; deeper ones stay in the body.
    """
    if not text:
        return []
    lines = text.replace("\r\n", "\n").split("\n")
    out: list[tuple[str, int, int, list[str]]] = [("", 0, 1, [])]
    fence = ""
    for n, line in enumerate(lines, 1):
        mark = _FENCE.match(line)
        if mark and (not fence or fence == mark[1]):
            fence = "" if fence else mark[1]
        elif not fence:
            body = out[-1][3]
            if head := _ATX.match(line):
                out.append((head[2], len(head[1]), n, []))
                continue
            if body and body[-1].strip() and not _ATX.match(body[-1]) and re.match(r"^(=+|-{2,})\s*$", line) and (len(body) < 2 or not body[-2].strip()):
                out.append((body.pop().strip(), 1 if line[0] == "=" else 2, n - 1, []))
                continue
        out[-1][3].append(line)
    parts = [(h, lv, n, "\n".join(b).strip()) for h, lv, n, b in out]
    return parts if parts[0][3] else parts[1:]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SECTIONS.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = [(p, k, h, lv, n, b) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (h, lv, n, b) in enumerate(split_sections(t))]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def sections(docs: DataFrame, path: str = "relative_path", text: str = "text") -> DataFrame:
    """(relative_path, section, heading, level, start_line, content) of markdown texts."""
    return docs.select(F.col(path).alias("relative_path"), F.col(text).alias("text")).mapInArrow(_split, SECTIONS)


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?ms)^\s*(```|~~~).*?(?:^\s*\1[^\n]*$|\z)", "")


def word_count(heading: Column, content: Column) -> Column:
    """Runs of other than white space in heading and content."""
    return F.size(F.regexp_extract_all(F.concat_ws(" ", heading, content), F.lit(r"\S+"), F.lit(0)))


def backtick_refs(heading: Column, content: Column) -> Column:
    """Distinct names in backticks, at most 120 characters, outside of fences."""
    raw = F.regexp_extract_all(F.concat_ws("\n", heading, without_fences(content)), F.lit("`([^`\n]+)`"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda r: F.trim(r)), lambda r: (F.length(r) > 0) & (F.length(r) <= 120)))


def links(content: Column) -> Column:
    """ARRAY<STRUCT<text, href>>."""
    pattern = r"\[([^\]\n]*)\]\(([^)\s]+)[^)]*\)"
    texts, hrefs = (F.regexp_extract_all(content, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(texts, hrefs, lambda t, h: F.struct(t.alias("text"), h.alias("href")))


def fences(content: Column) -> Column:
    """ARRAY<STRUCT<lang, code>> of fenced blocks."""
    pattern = r"(?ms)^```([^\n]*)\n(.*?)^```\s*$"
    langs, codes = (F.regexp_extract_all(content, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(langs, codes, lambda a, b: F.struct(F.trim(a).alias("lang"), b.alias("code")))


def kind(path: Column) -> Column:
    """readme, changelog, architecture, adr, guide or other; the first that fits."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = basename(low)
    return (
        F.when(base.rlike("readme"), "readme")
        .when(base.rlike("^(changelog|history)"), "changelog")
        .when(base.rlike(r"^(architecture|arch\.)"), "architecture")
        .when(low.rlike(r"adr[-_\s]?\d+") | low.rlike(r"(^|/)decisions?/") | low.rlike("(^|/)adr/"), "adr")
        .when(low.rlike("(^|/)docs/"), "guide")
        .otherwise("other")
    )


def documents(parts: DataFrame) -> DataFrame:
    """(relative_path, title, kind, word_count, sections): one row a document of sections()."""
    first = F.min_by(F.when(F.col("level") == 1, F.col("heading")), F.when((F.col("level") == 1) & (F.trim("heading") != ""), F.col("section")))
    out = parts.groupBy("relative_path").agg(first.alias("title"), F.sum(word_count(F.col("heading"), F.col("content"))).alias("word_count"), F.count("*").alias("sections"))
    return out.select("relative_path", F.coalesce("title", basename(F.col("relative_path"))).alias("title"), kind(F.col("relative_path")).alias("kind"), "word_count", "sections")


def section_ids(parts: DataFrame, project: str) -> DataFrame:
    return parts.withColumns({"id": F.concat(F.lit(f"{project}:sec:"), "relative_path", F.lit(":"), F.col("section").cast("string")), "doc_id": F.concat(F.lit(f"{project}:doc:"), "relative_path")})


def section_edges(parts: DataFrame) -> DataFrame:
    """(src, dst, type): SECTION_OF and NEXT_SECTION of rows with id, doc_id and section."""
    after = F.lead("id").over(Window.partitionBy("doc_id").orderBy("section", "id"))
    nexts = parts.select(F.col("id").alias("src"), after.alias("dst"), F.lit("NEXT_SECTION").alias("type")).filter("dst is not null")
    return parts.select(F.col("id").alias("src"), F.col("doc_id").alias("dst"), F.lit("SECTION_OF").alias("type")).unionByName(nexts)


def describes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, matched_name, strength): sections (id, ref) to the files, functions and classes they name.

    Files match by their path or its end after a slash, joined on the base name; symbols by their name.
    """
    r = refs.select(F.col("id").alias("src"), "ref").filter("ref is not null").distinct()
    files = nodes.filter("type = 'FILE' and path is not null").select(F.col("id").alias("dst"), F.col("path").alias("_gl_p"), basename(F.col("path")).alias("_gl_b"))
    by_path = r.withColumn("_gl_b", basename(F.col("ref"))).join(files, "_gl_b").filter((F.col("_gl_p") == F.col("ref")) | F.col("_gl_p").endswith(F.concat(F.lit("/"), "ref")))
    symbols = nodes.filter("type in ('FUNCTION', 'CLASS')").select(F.col("id").alias("dst"), F.col("name").alias("ref"))
    both = by_path.select("src", "dst", "ref").unionByName(r.join(symbols, "ref").select("src", "dst", "ref"))
    return both.select("src", "dst", F.col("ref").alias("matched_name"), F.lit(1.0).alias("strength")).distinct()


def checklist_tasks(docs: DataFrame, path: str = "relative_path", text: str = "text") -> DataFrame:
    """(relative_path, line, heading, name, status): - [ ] and - [x] lines under headings of level 2 or 3."""
    lines = docs.select(F.col(path).alias("relative_path"), F.posexplode(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")).alias("line", "text"))
    head = F.when(F.col("text").rlike(r"^#{2,3}\s"), F.regexp_replace("text", r"^#+\s+", ""))
    rows = lines.withColumn("heading", F.last(head, ignorenulls=True).over(Window.partitionBy("relative_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    box = r"^\s*[-*]\s+\[([ xX])\]\s+(.*)$"
    return rows.filter(F.col("text").rlike(box) & F.col("heading").isNotNull()).select("relative_path", (F.col("line") + 1).alias("line"), "heading", F.trim(F.regexp_extract("text", box, 2)).alias("name"), F.when(F.lower(F.regexp_extract("text", box, 1)) == "x", "completed").otherwise("pending").alias("status"))
