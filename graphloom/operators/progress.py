"""Features and tasks: listings, roll-ups, blockers, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph

# Other names of statuses.
STATUS = {"active": "in-progress", "all": None}


def items(rows: DataFrame, status: str | None = None, assignee: str | None = None, feature: str | None = None) -> DataFrame:
    """Features or tasks by status (active means in-progress, all none), assignee and feature."""
    status = STATUS.get(status, status) if status else None
    for column, value in (("status", status), ("assignee", assignee), ("featureId", feature)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows


def status_counts(rows: DataFrame) -> DataFrame:
    """(total, completed, in_progress, blocked, pending): one row."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count("*").alias("total"), n("completed").alias("completed"), n("in-progress").alias("in_progress"), n("blocked").alias("blocked"), n("pending").alias("pending"))


def feature_rollup(features: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, status, tasks, completed, blocked, progress): progress in percent, 0 without tasks."""
    per = tasks.groupBy(F.col("featureId").alias("id")).agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    rows = features.select("id", "status").join(per, "id", "left").na.fill(0, ["tasks", "completed", "blocked"])
    return rows.withColumn("progress", F.when(F.col("tasks") > 0, F.round(100 * F.col("completed") / F.col("tasks"), 2)).otherwise(0.0))


def implementation(graph: PropertyGraph, features: DataFrame) -> DataFrame:
    """(id, files, functions, classes, suites, cases): what implements a feature and tests it."""
    by = graph.edges_of("IMPLEMENTS", "IMPLEMENTED_BY").select(F.col("src").alias("id"), F.col("dst").alias("file")).distinct()
    files = graph.label("FILE").select(F.col("id").alias("file"), "path")
    own = features.select("id").join(by, "id").join(files, "file")
    inside = graph.hop(own.select("id", "file"), "file", ["CONTAINS"], "part").join(graph.nodes.select(F.col("id").alias("part"), "type"), "part")
    symbols = inside.groupBy("id").agg(F.count_if(F.col("type") == "FUNCTION").alias("functions"), F.count_if(F.col("type") == "CLASS").alias("classes"))
    paths = graph.nodes.select(F.col("id").alias("dst"), "path").filter("path is not null")
    tested = graph.edges_of("TESTS").join(paths, "dst").select(F.col("src").alias("test"), "path").join(own.select("id", "path"), "path").select("id", "test").distinct()
    tests = tested.join(graph.nodes.select(F.col("id").alias("test"), "type"), "test").groupBy("id").agg(F.count_if(F.col("type") == "TEST_SUITE").alias("suites"), F.count_if(F.col("type") == "TEST_CASE").alias("cases"))
    count = own.groupBy("id").agg(F.count("*").alias("files"))
    out = features.select("id").join(count, "id", "left").join(symbols, "id", "left").join(tests, "id", "left")
    return out.na.fill(0, ["files", "functions", "classes", "suites", "cases"])


def blocking(tasks: DataFrame, features: DataFrame, kind: str = "all", limit: int | None = 20) -> DataFrame:
    """Blocked tasks: all, critical (more than two blockers), features (of a feature not completed)."""
    rows = tasks.filter("status = 'blocked'")
    if kind == "critical":
        rows = rows.filter(F.size(F.coalesce("blockedBy", F.array().cast("array<string>"))) > 2)
    if kind in ("features", "feature"):
        rows = rows.join(features.filter("status <> 'completed'").select(F.col("id").alias("featureId")), "featureId", "left_semi")
    rows = rows.orderBy("id")
    return rows if limit is None else rows.limit(limit)


def update_task(tasks: DataFrame, task: str, status: str, now: int) -> DataFrame:
    """Tasks with a new status; completion and start leave their time."""
    hit = F.col("id") == task
    rows = tasks.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "updatedAt": F.when(hit, F.lit(now)).otherwise(F.col("updatedAt"))})
    if status == "completed":
        rows = rows.withColumn("completedAt", F.when(hit, F.lit(now)).otherwise(F.col("completedAt")))
    if status == "in-progress":
        rows = rows.withColumn("startedAt", F.when(hit, F.coalesce("startedAt", F.lit(now))).otherwise(F.col("startedAt")))
    return rows


def resolve_feature(features: DataFrame, asked: str) -> DataFrame:
    """At most one feature: exact id, id after the colon, that in any case, then its name."""
    low = asked.lower()
    rank = (
        F.when(F.col("id") == asked, 0)
        .when(F.col("id").endswith(":" + asked), 1)
        .when(F.lower("id").endswith(":" + low), 2)
        .when(F.lower("name") == low, 3)
    )
    return features.withColumn("_gl_r", rank).filter("_gl_r is not null").orderBy("_gl_r", "id").limit(1).drop("_gl_r")
