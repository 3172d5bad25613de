"""Encoding of texts with a public byte-level BPE vocabulary, and decoding.

Texts up to CHUNK characters are encoded where they lie, without a shuffle. Longer ones are cut into
chunks that overlap; the chunks are spread over the cluster and pre-tokenised in parallel, each from
its own start. Two neighbours are stitched at the first place in their overlap where both have a
pre-token boundary: from there on their pre-tokens agree, because the pre-tokeniser never looks back
beyond a boundary. BPE works within pre-tokens, so the ids between the stitches are those of the
text. A text whose chunks don't meet (one pre-token longer than the overlap) is put together and
encoded whole.
Decoding concatenates the bytes of the ids.

Defined results: every row gives one, repeated rows and rows with one id and different texts too,
whatever their length; empty and null texts have an empty list; text that looks like a special token is
plain text; a null row id is a value like others; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k"
#: A few times the usual text, so that only the long tail is cut.
CHUNK, OVERLAP = 8_000, 500
#: No boundary decision looks further ahead than this, so those before a chunk's last MARGIN characters hold.
MARGIN = 8


@lru_cache(maxsize=4)
def _encoding(path: str, name: str):
    """The encoder of a vocabulary file, once per process; the split pattern is the one in its JSON twin."""
    import tiktoken

    ranks = {}
    for line in Path(path, f"{name}.tiktoken").read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    # fixed value: the public split pattern of byte-level BPE vocabularies of this family
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pre_tokenizer(path: str, name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(Path(path, f"{name}.json"))).pre_tokenizer


def boundaries(text: str, path: str = TOKENIZERS, name: str = BYTE_BPE) -> list[int]:
    """Where the pre-tokens of a text start, and its length."""
    return [a for _, (a, _) in _pre_tokenizer(path, name).pre_tokenize_str(text)] + [len(text)]


def _encode_texts(path: str, name: str, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, name).encode_ordinary
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            column = pa.array([len(x) for x in ids], pa.int64()) if count else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["_gl_id", "_gl_ids"])

    return run


CHUNKS = "_gl_id {0}, _gl_h string, _gl_copies long, _gl_k int, _gl_left array<int>, _gl_leftn array<int>, _gl_right array<int>, _gl_rightn array<int>, _gl_ids array<int>, _gl_own string"


def _encode_chunk(encode, text: str, k: int, n: int, chunk: int, overlap: int, path: str, name: str) -> tuple:
    """Of chunk k of n: its boundaries in the two overlaps, the number of ids before each, and all ids."""
    # after white space the end of a part would change how that space splits, so no cut is made there
    at = [b for b in boundaries(text, path, name) if b in (0, len(text)) or not text[b - 1].isspace()]
    left = [b for b in at if b < overlap] if k else []
    # a tail shorter than the overlap lies wholly in the chunk before, whose end is that of the text
    ends = k == n - 2 and len(text) < chunk + overlap
    right = [b for b in at if chunk <= b <= len(text) - (0 if ends else MARGIN)] if k < n - 1 else []
    ids: list[int] = []
    counts: dict[int, int] = {0: 0}
    cuts = sorted({0, *left, *right, len(text)})
    for a, b in zip(cuts, cuts[1:]):
        ids += encode(text[a:b])
        counts[b] = len(ids)
    return left, [counts[b] for b in left], [b - chunk for b in right], [counts[b] for b in right], ids


def _encode_chunks(path: str, name: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, name).encode_ordinary
        ints = pa.list_(pa.int32())
        for batch in batches:
            k, n, text = (batch.column(c).to_pylist() for c in ("_gl_k", "_gl_n", "_gl_text"))
            done = [_encode_chunk(encode, t, i, m, chunk, overlap, path, name) for i, m, t in zip(k, n, text)]
            lists = [pa.array([d[j] for d in done], ints) for j in range(5)]
            own = pa.array([t[:chunk] for t in text], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_gl_id", "_gl_h", "_gl_copies")), pa.array(k, pa.int32()), *lists, own], ["_gl_id", "_gl_h", "_gl_copies", "_gl_k", "_gl_left", "_gl_leftn", "_gl_right", "_gl_rightn", "_gl_ids", "_gl_own"])

    return run


def _joined_parts(path: str, name: str):
    """One row for each copy: the ids of the stitched parts, or of the text if its chunks didn't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, name).encode_ordinary
        for batch in batches:
            again = [None if t is None else encode(t) for t in batch.column("_gl_text").to_pylist()]
            ids = batch.column("_gl_ids")
            if any(x is not None for x in again):
                ids = pa.array([b if a is None else a for a, b in zip(again, ids.to_pylist())], pa.list_(pa.int32()))
            rows = np.repeat(np.arange(batch.num_rows), batch.column("_gl_copies").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("_gl_id").take(rows), ids.take(rows)], ["_gl_id", "_gl_ids"])

    return run


def _long_texts(long: DataFrame, kind: str, path: str, name: str, chunk: int, overlap: int) -> DataFrame:
    """(_gl_id, _gl_ids) of the texts above the chunk size."""
    if not MARGIN < overlap <= chunk:
        raise ValueError("the overlap must lie between the margin and the chunk")
    parts = F.regexp_extract_all("_gl_text", F.lit(f"[\\s\\S]{{1,{chunk}}}"), F.lit(0))
    long = long.withColumn("_gl_h", F.md5("_gl_text"))  # tells the texts of one id apart
    cut = long.select("_gl_id", "_gl_h", parts.alias("_gl_p"))
    heads = F.transform("_gl_p", lambda p, k: F.concat(p, F.coalesce(F.left(F.get("_gl_p", k + 1), F.lit(overlap)), F.lit(""))))
    rows = cut.select("_gl_id", "_gl_h", F.size("_gl_p").alias("_gl_n"), F.posexplode(heads).alias("_gl_k", "_gl_text"))
    # the chunks are spread; those of repeated rows are encoded once
    rows = rows.groupBy("_gl_id", "_gl_h", "_gl_n", "_gl_k").agg(F.max("_gl_text").alias("_gl_text"), F.count("*").alias("_gl_copies"))
    done = rows.mapInArrow(_encode_chunks(path, name, chunk, overlap), CHUNKS.format(kind))
    by = Window.partitionBy("_gl_id", "_gl_h").orderBy("_gl_k")
    met = F.array_min(F.array_intersect("_gl_right", F.lead("_gl_left").over(by)))
    done = done.withColumn("_gl_next", F.lead("_gl_k").over(by)).withColumn("_gl_stitch", met).withColumn("_gl_from", F.lag("_gl_stitch").over(by))
    count_at = lambda places, counts, at: F.element_at(F.col(counts), F.array_position(places, F.col(at)).cast("int"))
    done = done.withColumn("_gl_lost", F.col("_gl_next").isNotNull() & F.col("_gl_stitch").isNull())
    begin = F.when(F.col("_gl_k") > 0, F.when(F.col("_gl_from").isNotNull(), count_at("_gl_left", "_gl_leftn", "_gl_from"))).otherwise(0)
    end = F.when(F.col("_gl_stitch").isNotNull(), count_at("_gl_right", "_gl_rightn", "_gl_stitch")).otherwise(F.size("_gl_ids"))
    part = F.slice("_gl_ids", F.coalesce(begin, F.lit(0)) + 1, F.greatest(F.lit(0), end - F.coalesce(begin, F.lit(0))))
    # the chunks of a text that didn't meet bring it along, so nothing is read or encoded for all again
    by_text = Window.partitionBy("_gl_id", "_gl_h")
    done = done.withColumn("_gl_lost", F.max("_gl_lost").over(by_text))
    of_chunk = F.struct("_gl_k", F.when(~F.col("_gl_lost"), part).alias("ids"), F.when(F.col("_gl_lost"), F.col("_gl_own")).alias("own"))
    whole = done.groupBy("_gl_id", "_gl_h").agg(F.max("_gl_copies").alias("_gl_copies"), F.max("_gl_lost").alias("_gl_lost"), F.sort_array(F.collect_list(of_chunk)).alias("_gl_all"))
    whole = whole.select("_gl_id", "_gl_copies", F.when(~F.col("_gl_lost"), F.flatten("_gl_all.ids")).alias("_gl_ids"), F.when(F.col("_gl_lost"), F.array_join("_gl_all.own", "")).alias("_gl_text"))
    return whole.mapInArrow(_joined_parts(path, name), f"_gl_id {kind}, _gl_ids array<int>")


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, name: str, chunk: int, overlap: int, count: bool) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_gl_id"), F.coalesce(text_col, F.lit("")).alias("_gl_text"))
    short = rows.filter(F.length("_gl_text") <= chunk).mapInArrow(_encode_texts(path, name, count), f"_gl_id {kind}, _gl_ids {'long' if count else 'array<int>'}")
    long = _long_texts(rows.filter(F.length("_gl_text") > chunk), kind, path, name, chunk, overlap)
    if count:
        long = long.select("_gl_id", F.size("_gl_ids").cast("long").alias("_gl_ids"))
    return short.unionByName(long)


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZERS, name: str = BYTE_BPE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids): the token ids of each text."""
    return _encoded(df, id_col, text_col, path, name, chunk, overlap, False).select(F.col("_gl_id").alias(id_col), F.col("_gl_ids").alias("ids"))


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZERS, name: str = BYTE_BPE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, tokens): the number of ids of each text."""
    return _encoded(df, id_col, text_col, path, name, chunk, overlap, True).select(F.col("_gl_id").alias(id_col), F.col("_gl_ids").alias("tokens"))


def decode_ids(ids: Column, path: str = TOKENIZERS, name: str = BYTE_BPE) -> Column:
    """The text of a list of ids: their bytes, concatenated; null for null."""

    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        own = _encoding(path, name)
        return lists.map(lambda x: None if x is None else b"".join(own.decode_single_token_bytes(i) for i in x).decode("utf-8", "replace"))

    return decode(ids)
