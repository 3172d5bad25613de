"""Vectors: deterministic text embeddings, cosine similarity."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODE_DIM, DOC_DIM, DOC_CAP = 128, 384, 10


def code_vector(text: str | None) -> list[float] | None:
    """Each character adds 0.1 sin(code * place) at (place + code) mod 128; L2-normalised; zeros stay zeros."""
    if text is None:
        return None
    codes = np.fromiter(map(ord, text), np.float64, len(text))
    place = np.arange(len(codes))
    out = np.zeros(CODE_DIM)
    np.add.at(out, ((place + codes) % CODE_DIM).astype(int), 0.1 * np.sin(codes * place))
    norm = math.sqrt(float(out @ out))
    return (out / norm if norm else out).tolist()


def doc_vector(text: str | None) -> list[float] | None:
    """Counts (at most 10) of word tokens at their 31-polynomial hash mod 384; L2-normalised."""
    if text is None:
        return None
    out = np.zeros(DOC_DIM)
    for word in re.findall(r"[A-Za-z0-9_]+", text.lower()):
        h = 0
        for c in word:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        h = h - 2**32 if h >= 2**31 else h
        at = abs(h) % DOC_DIM
        out[at] = min(DOC_CAP, out[at] + 1)
    norm = math.sqrt(float(out @ out))
    return (out / norm if norm else out).tolist()


def embed_code(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(code_vector)

    return run(text)


def embed_doc(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(doc_vector)

    return run(text)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if either is all zero there."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms).otherwise(0.0)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """The cosine with one fixed vector, computed in Arrow batches as a matrix product; null for null and empty ones.

    Declared nondeterministic, so that a filter on the result isn't pushed below it and evaluated again.
    """
    q = np.asarray(query, np.float64)
    qn = float(np.linalg.norm(q))

    @F.pandas_udf(T.DoubleType())
    def run(s: pd.Series) -> pd.Series:
        out = np.full(len(s), np.nan)
        good = [k for k, v in enumerate(s) if v is not None and len(v)]
        same = [k for k in good if len(s.iloc[k]) == len(q)]
        if same:
            m = np.stack([np.asarray(s.iloc[k], np.float64) for k in same])
            norms = np.linalg.norm(m, axis=1) * qn
            out[same] = np.where(norms > 0, (m @ q) / np.where(norms > 0, norms, 1), 0.0)
        for k in set(good) - set(same):
            n = min(len(s.iloc[k]), len(q))
            v, w = np.asarray(s.iloc[k], np.float64)[:n], q[:n]
            norm = float(np.linalg.norm(v) * np.linalg.norm(w))
            out[k] = float(v @ w) / norm if norm else 0.0
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run.asNondeterministic()(vector)
