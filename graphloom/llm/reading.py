"""Reading level of the English prose of documents.

Words: each word of the graded texts gets an acquisition grade, the mean level of its occurrences
after levels are weighed equally. Sentences: quantiles of the grades of their known words, with the
sentence length, are mapped to a level by a softmax model calibrated on the sentences of the graded
texts; for calibration the grades of a text leave that text out. Sentence length is an addition to
the method: level 4 is reached by easy words in long sentences as well, which quantiles can't show.
Documents: words per level; the level of a document is the word-weighted median.

The graded texts are a bounded sample of labelled rows (MAX_GRADED); the model is a small table sent
to the executors, and documents are read where they lie, without a shuffle.

Prose is what is left without fenced and indented code, headings, tables, lists, logs, quotes, links
and inline code. A sentence is English if enough of its words are known or English function words.

Defined results: null and empty texts and texts without English prose have no level (null, 0 words);
repeated rows give repeated results; an empty table gives an empty result; graded texts that are
null, or without a level, are ignored; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
MAX_GRADED = 10_000
QUANTILES = (0.25, 0.5, 0.75, 0.9)
KNOWN = 0.6
FUNCTION = 0.3

#: Common English function words.
FUNCTION_WORDS = frozenset(
    "a an and are as at be been but by can could do does for from had has have he her his how i if in into is it its may more must my no not of on one or our out she should so some such than that the their them then there these they this those to under up was we were what when where which while who will with would you your".split()
)

_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)?")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[A-Z0-9\"'(])")
_FENCE = re.compile(r"^\s*(```|~~~)")
_NOT_PROSE = re.compile(
    r"\s*(?:#|\||>|[-*+•]\s|\d+[.)]\s)"  # headings, tables, quotes, lists
    r"|(?:\t| {4})\s*\S"  # indented code
    r"|\s*\[?(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d)"  # logs
    r"|\s*\w+(?:\([\w./-]+\))?!?: [a-z]"  # commit subjects
    r"|\s*(?:=+|-{2,}|\*{3,}|_{3,})\s*$"  # rules and underlined headings
    r"|.*(?:[;{}]|=>|\)\s*:)\s*$"  # code outside of fences
)
_LINK = re.compile(r"!?\[[^\]]*\]\([^)]*\)|<?https?://\S+|`[^`]*`|<[^<>\s][^<>]*>")


def prose(text: str) -> list[str]:
    """The paragraphs of prose of a text with markup."""
    out: list[str] = []
    lines: list[str] = []
    fence = ""
    for line in text.splitlines():
        mark = _FENCE.match(line)
        if fence or mark:
            if mark and not fence:
                fence = mark[1]
            elif mark and mark[1] == fence:
                fence = ""
        elif line.strip() and not _NOT_PROSE.match(line):
            lines.append(line)
            continue
        elif line.strip() and not lines:
            continue
        if lines:
            out.append(_LINK.sub(" ", " ".join(lines)))
            lines = []
    if lines:
        out.append(_LINK.sub(" ", " ".join(lines)))
    return out


def sentences(paragraph: str) -> list[list[str]]:
    """The words of each sentence, in lower case; of sentences mostly in other letters none."""
    out = []
    for s in _SENTENCE.split(" ".join(paragraph.split())):
        words = _WORD.findall(s.lower())
        if words and 2 * len(words) > len(_LETTERS.findall(s)):
            out.append(words)
    return out


def _quantiles(grades: list[float]) -> list[float]:
    grades.sort()
    out = []
    for q in QUANTILES:
        at = q * (len(grades) - 1)
        k = int(at)
        high = grades[min(k + 1, len(grades) - 1)]
        out.append(grades[k] + (at - k) * (high - grades[k]))
    return out


def _features(raw: np.ndarray) -> np.ndarray:
    """Quantiles and log length with their squares and products."""
    q, n = raw[:, :-1], raw[:, -1:]
    return np.hstack([q, n, q * n, n * n, q * q])


class Model:
    """Word grades and the calibrated map from sentences to levels."""

    def __init__(self, grades: dict[str, float], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.grades, self.mean, self.scale, self.weights = grades, mean, scale, weights

    def raw(self, words: list[str]) -> list[float] | None:
        """The quantiles and log length of an English sentence, else None."""
        known = [g for w in words if (g := self.grades.get(w)) is not None]
        if not known or (len(known) < KNOWN * len(words) and sum(w in FUNCTION_WORDS for w in words) < FUNCTION * len(words)):
            return None
        return [*_quantiles(known), float(np.log(len(words)))]

    def levels(self, raw: np.ndarray) -> np.ndarray:
        z = (_features(raw) - self.mean) / self.scale
        return (np.hstack([np.ones((len(z), 1)), z]) @ self.weights).argmax(1) + 1


def _grades(counts: dict[str, np.ndarray], totals: np.ndarray) -> dict[str, float]:
    levels = np.arange(1, LEVELS + 1)
    per = 1 / np.maximum(totals, 1)
    return {w: float((c * per) @ levels / (c * per).sum()) for w, c in counts.items() if c.sum() > 0}


def train(graded: list[tuple[str, int]], steps: int = 800, decay: float = 1e-4) -> Model:
    """The model of texts with their levels (1 to LEVELS)."""
    texts = [(lv, [s for p in prose(t) for s in sentences(p)]) for t, lv in graded if t and lv and 1 <= lv <= LEVELS]
    counts: dict[str, np.ndarray] = {}
    totals = np.zeros(LEVELS)
    words = [Counter(w for s in ss for w in s) for _, ss in texts]
    for (lv, _), own in zip(texts, words):
        totals[lv - 1] += sum(own.values())
        for w, n in own.items():
            counts.setdefault(w, np.zeros(LEVELS))[lv - 1] += n
    raw, label = [], []
    for (lv, ss), own in zip(texts, words):
        rest = {w: counts[w].copy() for w in own}
        for w, n in own.items():
            rest[w][lv - 1] -= n
        left = totals.copy()
        left[lv - 1] -= sum(own.values())
        held_out = Model(_grades(rest, left), *[np.zeros(0)] * 3)
        for s in ss:
            if (r := held_out.raw(s)) is not None:
                raw.append(r)
                label.append(lv)
    width = len(_features(np.zeros((1, len(QUANTILES) + 1)))[0])
    if not raw:
        return Model(_grades(counts, totals), np.zeros(width), np.ones(width), np.zeros((width + 1, LEVELS)))
    x = _features(np.array(raw))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    y = np.eye(LEVELS)[np.array(label) - 1]
    rate = 2 * len(z) / np.linalg.norm(z, 2) ** 2
    weights = np.zeros((width + 1, LEVELS))
    for _ in range(steps):
        p = np.exp(z @ weights - (z @ weights).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weights -= rate * (z.T @ (p - y) / len(z) + decay * weights)
    return Model(_grades(counts, totals), mean, scale, weights)


def words_by_level(texts: list[str | None], model: Model) -> np.ndarray:
    """Of each text, the words of English prose at each level."""
    out = np.zeros((len(texts), LEVELS), dtype=np.int64)
    raw, doc, size = [], [], []
    for k, t in enumerate(texts):
        for p in prose(t or ""):
            for s in sentences(p):
                if (r := model.raw(s)) is not None:
                    raw.append(r)
                    doc.append(k)
                    size.append(len(s))
    if raw:
        np.add.at(out, (np.array(doc), model.levels(np.array(raw)) - 1), size)
    return out


def fit(graded: DataFrame, id_col: str, text_col: str, level_col: str, limit: int = MAX_GRADED) -> Model:
    """The model of a table of graded texts, of which the first `limit` by id are used."""
    rows = graded.filter(F.col(text_col).isNotNull() & F.col(level_col).isNotNull()).dropDuplicates([id_col]).orderBy(id_col).limit(limit)
    return train([(r[0], r[1]) for r in rows.select(text_col, level_col).collect()])


def reading_levels(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, level, words, words1 .. words5): level is the median over words, null without English prose."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts = [f"words{k}" for k in range(1, LEVELS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_by_level(batch.column(1).to_pylist(), model)
            total = found.sum(1)
            middle = (found.cumsum(1) * 2 >= total[:, None]).argmax(1) + 1
            level = pa.array([int(m) if n else None for m, n in zip(middle, total)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), level, pa.array(total), *[pa.array(found[:, k]) for k in range(LEVELS)]], ["_gl_id", "level", "words", *counts])

    rows = docs.select(F.col(id_col).alias("_gl_id"), F.col(text_col).alias("_gl_text"))
    return rows.mapInArrow(run, f"_gl_id {kind}, level int, words long, {', '.join(c + ' long' for c in counts)}").withColumnRenamed("_gl_id", id_col)


def demanding(levels: DataFrame, id_col: str) -> DataFrame:
    """(id): the documents most of whose English prose, by words, is of level 4 or 5."""
    return levels.filter((F.col("words4") + F.col("words5")) * 2 > F.col("words")).select(id_col).distinct()
