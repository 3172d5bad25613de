"""Splitting texts above a size limit into pieces at natural boundaries, with overlap.

One regular expression with bounded quantifiers consumes the text piece by piece. Its alternatives
are ordered by the strength of the boundary the piece ends at: paragraph, line, word, and characters
as the fallback. Each strength first tries to leave room for the full overlap and then to use the
whole limit, so a block, line or word that fits the limit is never cut. The overlap is looked back
from the piece before. All of it stays in the JVM, row by row, without a shuffle.

The pattern runs once, over a copy of the text in which the white space of blank lines is a mark of the
same length, so that every condition looks at a few characters only, however long a blank line is. Its
groups tell the strengths; the pieces are taken from the text by their lengths.

A cut within the white space of a blank line is one between paragraphs.

Limits count Unicode code points. Lines end at \\n or \\r\\n; a line of only whitespace is blank; a
pair \\r\\n is never cut. Without their overlaps the pieces concatenate to the text.

Defined results: a text within the limit is one piece; an empty or null text has no piece; repeated
rows give repeated pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
STRENGTHS = ("paragraph", "line", "word", "none")

#: Unicode white space, and of it all but the line feed.
_IN_LINE = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE = r"[\n" + _IN_LINE + "]"
_BLANK = "[" + _IN_LINE + "]"
#: Noncharacters: white space of a blank line; the ends of groups 1 to 4. In a text they count as letters.
_MARK, _ENDS = "\ufdd1", "\ufdd2\ufdd3\ufdd4\ufdd5"
#: White space of a line without other characters: its first, after a look ahead, and those that follow on.
_OF_BLANK = rf"(?!\r\n)(?:(?:(?<=\n)|\A)(?={_BLANK}*+(?:\n|\z))|(?!\A)\G){_BLANK}"

# Every condition first asks for a line feed beside the place, which most places lack.
_NEXT_IS_BLANK = rf"(?:{_MARK}|\r?\n|\z)"
_LINE_END = r"(?=[\r\n])(?:(?=\r\n)|(?<!\r)(?=\n))"
_PARAGRAPH = rf"(?:{_LINE_END}(?=\r?\n{_NEXT_IS_BLANK})|(?<=\n)(?:(?={_NEXT_IS_BLANK})|(?<=(?:\A|\n|{_MARK})\r?\n))|(?<={_MARK})|(?={_MARK})|\z)"
_LINE = rf"(?:(?<=\n)|{_LINE_END}|\z)"
_WORD = rf"(?:(?<=[{_MARK}\n{_IN_LINE}])|(?=[{_MARK}\n{_IN_LINE}])|\z)(?!(?<=\r)\n)"
_ANY = r"(?!(?<=\r)\n)"


def piece_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The pattern of one piece; groups 1 to 4 hold it by the strength of its boundary."""
    if not 0 <= overlap < limit - 1:
        raise ValueError("the overlap must leave room for text")
    room = limit - overlap
    roomy, full = f".{{1,{room}}}", f".{{{room + 1},{limit}}}" if overlap else "(?!)"
    return "(?s)" + "|".join(f"({roomy}{cut}|{full}{cut})" for cut in (_PARAGRAPH, _LINE, _WORD)) + f"|({roomy}{_ANY}|.)"


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """ARRAY<STRUCT<size, strength>> of a text, in order; strength numbers STRENGTHS by the cut after the piece."""
    marked = F.regexp_replace(F.translate(text, _MARK + _ENDS, "x" * 5), F.lit(_OF_BLANK), F.lit(_MARK))
    tagged = F.regexp_replace(marked, F.lit(piece_pattern(limit, overlap)), F.lit("".join(f"${k + 1}{end}" for k, end in enumerate(_ENDS))))
    each = F.filter(F.split(tagged, _ENDS[3]), lambda x: x != "")
    # the ends of the groups before the one that matched come first
    strength = lambda x: F.when(F.startswith(x, F.lit(_ENDS[:3])), 3).when(F.startswith(x, F.lit(_ENDS[:2])), 2).when(F.startswith(x, F.lit(_ENDS[0])), 1).otherwise(0)
    return F.transform(each, lambda x: F.struct((F.length(x) - 3).alias("size"), strength(x).alias("strength")))


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, offset, overlap, boundary, text): the ordered pieces of every non-empty text.

    text starts with `overlap` characters from the end of the piece before; offset is where the
    part after them starts in the text; boundary is the strength of the cut that ends the piece.
    """
    rows = df.select(F.col(id_col).alias("_gl_id"), F.col(text_col).alias("_gl_text")).filter(F.length("_gl_text") > 0)
    short = rows.filter(F.length("_gl_text") <= limit).select(F.col("_gl_id").alias(id_col), F.lit(0).alias("piece"), F.lit(0).alias("offset"), F.lit(0).alias("overlap"), F.lit(STRENGTHS[0]).alias("boundary"), F.col("_gl_text").alias("text"))
    # blocks of the text, so that a piece is taken from at most two of them and not from the whole
    wide = 4 * limit
    blocks = F.regexp_extract_all("_gl_text", F.lit(f"[\\s\\S]{{1,{wide}}}"), F.lit(0))
    cut = rows.filter(F.length("_gl_text") > limit).select("_gl_id", pieces(F.col("_gl_text"), limit, overlap).alias("_gl_p"), blocks.alias("_gl_b"))
    starts = F.aggregate("_gl_p", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["size"])))
    back = F.transform("_gl_p", lambda p, k: F.when(k > 0, F.least(F.lit(overlap), F.lit(limit) - p["size"], F.get("_gl_p", k - 1)["size"])).otherwise(0))
    cut = cut.withColumns({"_gl_s": starts, "_gl_o": back})

    def part(p: Column, k: Column) -> Column:
        begin = F.get("_gl_s", k) - F.get("_gl_o", k)
        at = F.floor(begin / wide).cast("int")
        two = F.concat(F.get("_gl_b", at), F.coalesce(F.get("_gl_b", at + 1), F.lit("")))
        return F.struct(F.get("_gl_s", k).alias("offset"), F.get("_gl_o", k).alias("overlap"), p["strength"].alias("strength"), F.substring(two, begin - at * wide + 1, p["size"] + F.get("_gl_o", k)).alias("text"))

    cut = cut.select("_gl_id", F.posexplode(F.transform("_gl_p", part)).alias("piece", "_gl_x"))
    boundary = F.element_at(F.array(*map(F.lit, STRENGTHS)), F.col("_gl_x.strength") + 1)
    return short.unionByName(cut.select(F.col("_gl_id").alias(id_col), "piece", "_gl_x.offset", "_gl_x.overlap", boundary.alias("boundary"), "_gl_x.text"))


#: A noncharacter that stands for blank lines in the check by lengths.
_BETWEEN = "\ufdd0"


def _longest(text: Column, separator: str) -> Column:
    return F.array_max(F.transform(F.split(text, separator), lambda x: F.length(x)))


def boundary_of(text: Column, limit: int = LIMIT) -> Column:
    """The coarsest cut that suffices, by the lengths of blocks, lines and words: an independent check of the pieces."""
    inner = rf"(?:\A|(?<=\n)){_BLANK}*(?:\n|\z)"
    marked = F.regexp_replace(text, inner, _BETWEEN + "\n")
    blocks = F.regexp_replace(marked, "\r?\n" + _BETWEEN, _BETWEEN)
    return (
        F.when(_longest(blocks, _BETWEEN + "\n?") <= limit, STRENGTHS[0])
        .when(_longest(text, "\r?\n") <= limit, STRENGTHS[1])
        .when(_longest(text, _SPACE + "+") <= limit, STRENGTHS[2])
        .otherwise(STRENGTHS[3])
    )


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, boundary): each text above the limit, with the weakest boundary that its pieces needed."""
    rows = df.select(F.col(id_col).alias("_gl_id"), F.col(text_col).alias("_gl_text")).filter(F.length("_gl_text") > limit)
    weakest = F.array_max(F.transform(pieces(F.col("_gl_text"), limit, overlap), lambda p: p["strength"]))
    return rows.select(F.col("_gl_id").alias(id_col), F.element_at(F.array(*map(F.lit, STRENGTHS)), weakest + 1).alias("boundary")).distinct()
