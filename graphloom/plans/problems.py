"""Queries p2, p3, p5 and p6: the core operators over the tables they are meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.asof import instant_ms, known_at_event, rectangles
from graphloom.operators.history import version_history
from graphloom.operators.intervals import gaps, periods
from graphloom.operators.orphans import dangling_references, orphan_counts
from graphloom.sources.tables import table

CLASS_ATTRIBUTES = ["name", "kind", "relativePath", "startLine", "endLine", "LOC", "summary", "isExported"]


def class_events(spark: SparkSession, folder: str) -> DataFrame:
    """(eventId, key, at): the classes that episodes mention and graph queries ask about, with their time."""
    episodes = table(spark, folder, "episodes").select(F.col("id").alias("eventId"), F.explode(F.array_distinct("entities")).alias("key"), F.col("timestamp").alias("at"))
    asked = table(spark, folder, "graph_queries")
    given = F.when(F.trim("asOf") != "", instant_ms(F.col("asOf"))).otherwise(F.col("issuedAt"))
    at = F.when(F.col("asOf").isNull(), F.col("issuedAt")).otherwise(given)
    return episodes.filter((F.col("key") != "")).unionByName(asked.select(F.col("id").alias("eventId"), F.col("classId").alias("key"), at.alias("at")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The class_nodes row known and valid at each event."""
    events = class_events(spark, folder)
    found = known_at_event(table(spark, folder, "class_nodes"), events, "id", "validFrom", "txTimestamp", "txId", F.col("validTo").isNotNull(), valid_at="at", known_at="at")
    return found.select("eventId", F.col("key").alias("classId"), F.col("payload").alias("txId"))


def p2_rectangles(spark: SparkSession, folder: str) -> DataFrame:
    """The regions of valid and recorded time in which each report is the current version."""
    found = rectangles(table(spark, folder, "class_nodes"), "id", "validFrom", "txTimestamp", "txId", F.col("validTo").isNotNull())
    return found.withColumnsRenamed({"key": "classId", "payload": "txId"})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The gaps between the held periods of each claimed target."""
    return gaps(table(spark, folder, "claims"), "targetId", "validFrom", "validTo", "id")


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The periods in which each target was held without interruption."""
    return periods(table(spark, folder, "claims"), "targetId", "validFrom", "validTo", "id")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return version_history(table(spark, folder, "class_nodes"), "id", "validFrom", "txTimestamp", CLASS_ATTRIBUTES, F.col("validTo").isNotNull(), tie="txId")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each version of each class with its period."""
    return _history(spark, folder).select("id", "validFrom", "validTo")


def p5_history(spark: SparkSession, folder: str) -> DataFrame:
    """The versions with their attributes."""
    return _history(spark, folder)


def references(spark: SparkSession, folder: str) -> DataFrame:
    """(tableName, rowId, refId, refTime) of claims, episodes and sections."""
    claims = table(spark, folder, "claims").select(F.lit("claims").alias("tableName"), F.col("id").alias("rowId"), F.col("targetId").alias("refId"), F.col("validFrom").alias("refTime"))
    episodes = table(spark, folder, "episodes").select(F.lit("episodes").alias("tableName"), F.col("id").alias("rowId"), F.explode(F.array_distinct("entities")).alias("refId"), F.col("timestamp").alias("refTime"))
    sections = table(spark, folder, "sections").select(F.lit("sections").alias("tableName"), F.col("id").alias("rowId"), F.col("docId").alias("refId"), F.col("txTimestamp").alias("refTime"))
    return claims.unionByName(episodes).unionByName(sections)


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "nodes").select("id", F.col("createdAt").alias("begins"), F.col("validTo").alias("ends"))
    features = table(spark, folder, "features").select("id", F.col("createdAt").alias("begins"), F.lit(None).cast("long").alias("ends"))
    return dangling_references(references(spark, folder), nodes.unionByName(features))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each reference to a node or feature absent at its time."""
    return _orphans(spark, folder).select("tableName", "rowId", "refId", "reason").distinct()


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The orphan references per table, month and reason."""
    return orphan_counts(_orphans(spark, folder))


QUERIES = {f.__name__: f for f in (p2_found, p2_rectangles, p3_found, p3_periods, p5_found, p5_history, p6_found, p6_counts)}

_REPORTS = """reports AS (
  SELECT DISTINCT id, coalesce("validFrom", "txTimestamp") AS vf, "txTimestamp" AS tx, "txId", "validTo" IS NOT NULL AS gone,
    name, kind, "relativePath", "startLine", "endLine", "LOC", summary, "isExported" FROM class_nodes
  WHERE id IS NOT NULL)"""
_FINAL = f"""{_REPORTS},
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, vf ORDER BY tx DESC, "txId" DESC) AS n FROM reports) WHERE n = 1),
marked AS (SELECT *, CASE WHEN gone THEN '-' ELSE CAST(row(name, kind, "relativePath", "startLine", "endLine", "LOC", summary, "isExported") AS VARCHAR) END AS state FROM final),
steps AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY vf) AS before FROM marked),
heads AS (SELECT *, lead(vf) OVER (PARTITION BY id ORDER BY vf) AS until FROM steps WHERE before IS NULL OR before <> state)"""
_EVER = 9223372036854775807
_HELD = """rows AS (
  SELECT id, "targetId", "validFrom" AS s, max("validTo") AS e FROM claims WHERE "targetId" IS NOT NULL AND "validFrom" IS NOT NULL GROUP BY ALL),
valid AS (SELECT *, coalesce(e, 9223372036854775807) AS z FROM rows WHERE e IS NULL OR e > s),
swept AS (SELECT *, max(z) OVER (PARTITION BY "targetId" ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM valid)"""
_ORPHANS = """refs AS (
  SELECT 'claims' AS "tableName", id AS "rowId", "targetId" AS "refId", "validFrom" AS t FROM claims
  UNION SELECT 'episodes', id, unnest(entities), "timestamp" FROM episodes
  UNION SELECT 'sections', id, "docId", "txTimestamp" FROM sections),
targets AS (SELECT id, "createdAt" AS a, coalesce("validTo", 9999999999999) AS z FROM nodes UNION SELECT id, "createdAt", 9999999999999 FROM features),
judged AS (
  SELECT "tableName", "rowId", "refId", t, count(targets.id) AS n, count(*) FILTER (a <= t) AS begun, count(*) FILTER (a <= t AND z > t) AS there
  FROM refs LEFT JOIN targets ON targets.id = "refId" WHERE "refId" <> '' GROUP BY ALL),
orphans AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS reason FROM judged WHERE n = 0 OR (t IS NOT NULL AND there = 0))"""

SQL = {
    "p2_found": f"""WITH {_REPORTS},
events AS (
  SELECT id AS "eventId", unnest(entities) AS "classId", "timestamp" AS t FROM episodes
  UNION SELECT id, "classId", CASE WHEN "asOf" IS NULL OR "asOf" = '' THEN "issuedAt" WHEN regexp_full_match("asOf", '[0-9]+') THEN CAST("asOf" AS BIGINT)
    WHEN length("asOf") = 10 THEN epoch_ms(CAST("asOf" || 'T00:00:00Z' AS TIMESTAMPTZ)) ELSE epoch_ms(CAST("asOf" AS TIMESTAMPTZ)) END FROM graph_queries),
best AS (SELECT "eventId", "classId", "txId", gone, row_number() OVER (PARTITION BY "eventId", "classId", t ORDER BY vf DESC, tx DESC, "txId" DESC) AS n
  FROM events JOIN reports ON id = "classId" AND vf <= t AND tx <= t)
SELECT "eventId", "classId", "txId" FROM best WHERE n = 1 AND NOT gone""",
    "p2_rectangles": f"""WITH {_REPORTS},
once AS (SELECT id, vf, tx, coalesce("txId", '') AS "txId", gone, coalesce(lead(tx) OVER (PARTITION BY id, vf ORDER BY tx), {_EVER}) AS replaced
  FROM (SELECT *, row_number() OVER (PARTITION BY id, vf, tx ORDER BY "txId" DESC, gone DESC) AS n FROM reports WHERE tx IS NOT NULL) WHERE n = 1),
ends AS (SELECT a.*, greatest(a.tx, b.tx) AS r, b.vf AS e FROM once AS a JOIN once AS b ON a.id = b.id AND b.vf > a.vf AND b.tx < a.replaced
  UNION ALL SELECT *, tx, {_EVER} FROM once),
steps AS (SELECT *, min(e) OVER (PARTITION BY id, vf, tx ORDER BY r RANGE UNBOUNDED PRECEDING) AS until FROM ends),
parts AS (SELECT id, vf, tx, until, replaced, "txId", gone, min(r) AS r FROM steps GROUP BY ALL)
SELECT id AS "classId", vf AS "validFrom", until AS "validTo", r AS "recordedFrom",
  coalesce(lead(r) OVER (PARTITION BY id, vf, tx ORDER BY r), replaced) AS "recordedTo", "txId", gone AS removed FROM parts""",
    "p5_history": f"""WITH {_FINAL},
versions AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> state THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY vf) AS v FROM steps),
each AS (SELECT id, v, gone, min(vf) AS a, count(*) AS snapshots, max(name) AS name, max(kind) AS kind, max("relativePath") AS "relativePath", max("startLine") AS "startLine",
  max("endLine") AS "endLine", max("LOC") AS "LOC", max(summary) AS summary, bool_or("isExported") AS "isExported" FROM versions GROUP BY id, v, gone),
timed AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY id ORDER BY a), 9999999999999) AS z FROM each)
SELECT id, name, kind, "relativePath", "startLine", "endLine", "LOC", summary, "isExported", a AS "validFrom", z AS "validTo", snapshots FROM timed WHERE NOT gone""",
    "p3_found": f"""WITH {_HELD} SELECT "targetId", prev AS "gapFrom", s AS "gapTo" FROM swept WHERE s > prev""",
    "p3_periods": f"""WITH {_HELD},
marked AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY "targetId" ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS island FROM swept)
SELECT "targetId", min(s) AS "periodFrom", nullif(max(z), 9223372036854775807) AS "periodTo", count(*) AS intervals FROM marked GROUP BY "targetId", island""",
    "p5_found": f"""WITH {_FINAL} SELECT id, vf AS "validFrom", coalesce(until, 9999999999999) AS "validTo" FROM heads WHERE NOT gone""",
    "p6_found": f"""WITH {_ORPHANS} SELECT DISTINCT "tableName", "rowId", "refId", reason FROM orphans""",
    "p6_counts": f"""WITH {_ORPHANS} SELECT "tableName", strftime(epoch_ms(t), '%Y-%m') AS month, reason, count(*) AS orphans FROM orphans GROUP BY ALL""",
}
