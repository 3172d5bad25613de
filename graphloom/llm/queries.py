"""Queries p1, p4, p7, p8 and p9 over the tables they are meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.mixing import mixture, shares, short_sources, source_plan
from graphloom.llm.reading import demanding, fit, reading_levels
from graphloom.llm.similar import nearest, similar_pairs
from graphloom.llm.splitting import oversized, split_texts
from graphloom.llm.tokens import count_tokens, encode_texts
from graphloom.session import cut_lineage
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sections above the limit with the coarsest cut that suffices."""
    return oversized(table(spark, folder, "sections"), "id", "content")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all sections."""
    return split_texts(table(spark, folder, "sections"), "id", "content")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of code embeddings of which one is among the 5 most similar to the other."""
    return similar_pairs(p4_nearest(spark, folder))


def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar ids of every usable code embedding."""
    return nearest(table(spark, folder, "code_embeddings"), "id", "vector")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokens): counted once and written, as several steps read it."""
    docs = table(spark, folder, "documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    counted = count_tokens(docs, "doc", "text").select("doc.doc_id", "doc.source", "tokens")
    return cut_lineage(counted.filter(F.col("source").isNotNull()).distinct())


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot reach their share, as the mixture shows."""
    sizes = _sizes(spark, folder)
    plan = source_plan(sizes, table(spark, folder, "mix_targets"))
    return short_sources(mixture(sizes, plan), plan)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    sizes = _sizes(spark, folder)
    return mixture(sizes, source_plan(sizes, table(spark, folder, "mix_targets")))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The actual shares of the sources in the mixture."""
    sizes = _sizes(spark, folder)
    plan = source_plan(sizes, table(spark, folder, "mix_targets"))
    return shares(mixture(sizes, plan), plan)


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level of the English prose of every document."""
    return reading_levels(table(spark, folder, "documents"), fit(table(spark, folder, "graded_texts"), "item_id", "text", "level"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents most of whose English prose is of level 4 or 5."""
    return demanding(p9_levels(spark, folder), "doc_id")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and words of English prose per source and level."""
    docs = table(spark, folder, "documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    levels = reading_levels(docs, fit(table(spark, folder, "graded_texts"), "item_id", "text", "level"), "doc", "text")
    return levels.groupBy(F.col("doc.source").alias("source"), "level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p4_found, p4_nearest, p7_ids, p8_found, p8_mixture, p8_shares, p9_found, p9_levels, p9_profile)}

_IN_LINE = r"[\t\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ANY_SPACE = _IN_LINE.replace("[", r"[\n")

SQL = {
    "p1_found": f"""WITH long AS (SELECT DISTINCT id, content FROM sections WHERE length(content) > 4000),
sized AS (
  SELECT id,
    list_max(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(content, '^({_IN_LINE}*\n)+', ''), '(\r?\n{_IN_LINE}*)+$', ''), '\r?\n({_IN_LINE}*\n)+'), lambda x: length(x))) AS block,
    list_max(list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: length(x))) AS line,
    list_max(list_transform(regexp_split_to_array(content, '{_ANY_SPACE}+'), lambda x: length(x))) AS word
  FROM long)
SELECT DISTINCT id, CASE WHEN block <= 4000 THEN 'paragraph' WHEN line <= 4000 THEN 'line' WHEN word <= 4000 THEN 'word' ELSE 'none' END AS boundary FROM sized""",
    "p4_found": """WITH v AS (
  SELECT DISTINCT id, CAST(vector AS DOUBLE[]) AS vector FROM code_embeddings
  WHERE id IS NOT NULL AND len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 6) DESC, b.id) AS n
  FROM v AS a JOIN v AS b ON a.id <> b.id)
SELECT DISTINCT least(x, y) AS "idA", greatest(x, y) AS "idB" FROM near WHERE n <= 5""",
}
