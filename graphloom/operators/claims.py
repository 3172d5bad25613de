"""Coordination: claims on nodes, their conflicts, staleness and expiry.

A claim is open while validTo is null. Rows of one claim id count once (the closed one if both
exist); claims without target conflict with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.temporal import close


def latest(claims: DataFrame) -> DataFrame:
    """One row a claim id; of an open and a closed delivery the closed one."""
    order = Window.partitionBy("id").orderBy(F.asc_nulls_last("validTo"), F.desc_nulls_last("validFrom"))
    return claims.withColumn("_gl_n", F.row_number().over(order)).filter("_gl_n = 1").drop("_gl_n")


def active(claims: DataFrame) -> DataFrame:
    return claims.filter("validTo is null")


def totals(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count_if(F.col("validTo").isNull()).alias("active"), F.count("*").alias("total"))


def conflicts(claims: DataFrame) -> DataFrame:
    """(targetId, agents, claims): targets with open claims of several agents.

    One row a target instead of all pairs: groups may be large. conflicting_claims() has the members.
    """
    per_agent = active(claims).filter("targetId is not null and agentId is not null").groupBy("targetId", "agentId").agg(F.count("*").alias("n"))
    return per_agent.groupBy("targetId").agg(F.count("*").alias("agents"), F.sum("n").alias("claims")).filter("agents > 1")


def conflicting_claims(claims: DataFrame) -> DataFrame:
    """(id, targetId, agentId, rivals): each open claim with the number of open claims of other agents on its target."""
    rows = active(claims).filter("targetId is not null and agentId is not null")
    per_agent = rows.groupBy("targetId", "agentId").agg(F.count("*").alias("own"))
    per_target = per_agent.groupBy("targetId").agg(F.sum("own").alias("all"))
    counts = per_agent.join(per_target, "targetId").filter(F.col("all") > F.col("own")).select("targetId", "agentId", (F.col("all") - F.col("own")).alias("rivals"))
    return rows.join(counts, ["targetId", "agentId"]).select("id", "targetId", "agentId", "rivals")


def conflict_pairs(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """(targetId, a, b), a < b: pairs of open claims of different agents on a few chosen targets."""
    rows = active(claims).join(targets.select("targetId").distinct(), "targetId", "left_semi").select("targetId", "id", "agentId")
    a, b = (rows.select("targetId", F.col("id").alias(x), F.col("agentId").alias(f"_gl_{x}")) for x in "ab")
    return a.join(b, "targetId").filter("a < b and _gl_a <> _gl_b").select("targetId", "a", "b")


def stale(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Open claims whose target (id, valid_from) has a version newer than the claim."""
    newest = targets.groupBy(F.col("id").alias("_gl_t")).agg(F.max("valid_from").alias("_gl_v"))
    return active(claims).join(newest, F.col("targetId") == F.col("_gl_t")).filter(F.col("_gl_v") > F.col("validFrom")).drop("_gl_t", "_gl_v")


def agent_summary(claims: DataFrame) -> DataFrame:
    """(agentId, claims, last_claim) of open claims, busiest first."""
    return active(claims).groupBy("agentId").agg(F.count("*").alias("claims"), F.max("validFrom").alias("last_claim")).orderBy(F.desc("claims"), F.desc("last_claim"), "agentId")


def blockers(claims: DataFrame, ids: DataFrame, agent: str, limit: int = 20) -> DataFrame:
    """Open claims of other agents on any of the ids, newest first."""
    mine = F.coalesce(F.col("agentId") == agent, F.lit(False))
    return active(claims).filter(~mine).join(ids.select(F.col("id").alias("targetId")), "targetId", "left_semi").orderBy(F.desc("validFrom"), "id").limit(limit)


def invalidate_stale(claims: DataFrame, targets: DataFrame, now: int) -> DataFrame:
    newest = targets.groupBy(F.col("id").alias("_gl_t")).agg(F.max("valid_from").alias("_gl_v"))
    joined = claims.join(newest, F.col("targetId") == F.col("_gl_t"), "left")
    return close(joined, F.col("_gl_v") > F.col("validFrom"), now, "code_changed").drop("_gl_t", "_gl_v")


def expire(claims: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    return close(claims, F.col("validFrom") < now - ttl_ms, now, "expired")


def complete_task(claims: DataFrame, task: str, now: int, outcome: str = "success") -> DataFrame:
    """Claims with those of a task closed; an outcome that is already set stays."""
    hit = F.col("validTo").isNull() & (F.col("taskId") == task)
    rows = claims.withColumn("outcome", F.when(hit, F.coalesce("outcome", F.lit(outcome))).otherwise(F.col("outcome")))
    return close(rows, F.col("taskId") == task, now, "task_completed")


def release(claims: DataFrame, claim: str, now: int, outcome: str | None = None) -> DataFrame:
    hit = F.col("validTo").isNull() & (F.col("id") == claim)
    rows = claims.withColumn("outcome", F.when(hit, F.coalesce(F.lit(outcome), "outcome")).otherwise(F.col("outcome")))
    return close(rows, F.col("id") == claim, now, "released")


def release_status(claims: DataFrame, claim: str) -> DataFrame:
    """(found, alreadyClosed): one row."""
    own = latest(claims.filter(F.col("id") == claim))
    return own.agg((F.count("*") > 0).alias("found"), F.coalesce(F.bool_and(F.col("validTo").isNotNull()), F.lit(False)).alias("alreadyClosed"))


def rival_of(claims: DataFrame, target: str, agent: str) -> DataFrame:
    """The newest open claim of another agent on a target, or nothing."""
    return active(latest(claims)).filter((F.col("targetId") == target) & (F.col("agentId") != agent)).orderBy(F.desc("validFrom"), "id").limit(1)


def target_version(nodes: DataFrame) -> DataFrame:
    """(id, version): the content hash, hash or commit of a node, else vf- and its begin."""
    p = lambda k: F.element_at("props", k)
    return nodes.select("id", F.coalesce(p("contentHash"), p("hash"), p("gitCommit"), F.concat(F.lit("vf-"), F.coalesce(F.col("valid_from").cast("string"), F.lit("0")))).alias("version"))


def agent_status(claims: DataFrame, episodes: DataFrame, agent: str) -> DataFrame:
    """(kind, id, taskId, at): an agent's open claims and last ten episodes, newest first."""
    own = active(latest(claims)).filter(F.col("agentId") == agent).select(F.lit("claim").alias("kind"), "id", "taskId", F.col("validFrom").alias("at"))
    last = episodes.filter(F.col("agentId") == agent).dropDuplicates(["id"]).orderBy(F.desc("timestamp"), "id").limit(10)
    return own.unionByName(last.select(F.lit("episode").alias("kind"), "id", "taskId", F.col("timestamp").alias("at"))).orderBy("kind", F.desc("at"), "id")
