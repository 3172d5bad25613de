"""Agent memory: validation, chaining, recall, reflection and context of episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import jaccard, query_tokens, tokens
from graphloom.operators.temporal import decay

MAX_ENTITIES = 100

# What each type of episode requires.
OUTCOMES = ["success", "failure", "partial"]
REQUIRED = {
    "DECISION": ["DECISION episodes require outcome: success | failure | partial.", "DECISION episodes require metadata.rationale (or metadata.reason).", "rationale", "reason"],
    "TEST_RESULT": ["TEST_RESULT episodes require outcome: success | failure | partial.", "TEST_RESULT episodes require metadata.testName or metadata.testFile.", "testName", "testFile"],
    "ERROR": [None, "ERROR episodes require metadata.errorCode or metadata.stack.", "errorCode", "stack"],
}
NO_ENTITY = "EDIT episodes require at least one entity reference."


def invalid_because() -> Column:
    """Why an episode (type, outcome, metadata, entities) is invalid, null if it is valid; metadata is JSON text."""
    kind, outcome = F.upper("type"), F.lower("outcome")
    text = lambda name: F.get_json_object("metadata", f"$.{name}").isNotNull()
    out = F.when((kind == "EDIT") & (F.size(F.coalesce("entities", F.array().cast("array<string>"))) == 0), NO_ENTITY)
    for name, (no_outcome, no_field, a, b) in REQUIRED.items():
        if no_outcome:
            out = out.when((kind == name) & ~F.coalesce(outcome.isin(*OUTCOMES), F.lit(False)), no_outcome)
        out = out.when((kind == name) & ~(text(a) | text(b)), no_field)
    return out


def admitted(episodes: DataFrame, entities: int | None = MAX_ENTITIES) -> DataFrame:
    """Valid episodes, once each, with their first entities; with all if `entities` is None."""
    rows = episodes.filter(invalid_because().isNull()).dropDuplicates(["id"])
    every = F.coalesce("entities", F.array().cast("array<string>"))
    return rows.withColumn("entities", every if entities is None else F.slice(every, 1, entities))


def involves(episodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): episodes and the existing nodes they mention."""
    pairs = episodes.select(F.col("id").alias("src"), F.explode("entities").alias("dst")).filter("dst is not null").distinct()
    return pairs.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def next_episode(episodes: DataFrame) -> DataFrame:
    """(src, dst): each episode and the one after it of the same project, agent and session."""
    by = Window.partitionBy("projectId", "agentId", "sessionId").orderBy("timestamp", "id")
    rows = episodes.filter("agentId is not null and sessionId is not null").dropDuplicates(["id"])
    return rows.select(F.lag("id").over(by).alias("src"), F.col("id").alias("dst")).filter("src is not null")


def recall(episodes: DataFrame, query: str, now: int, project: str | None = None, agent: str | None = None, task: str | None = None, types: Sequence[str] | None = None, entities: Sequence[str] = (), since: int | None = None, limit: int = 5, newest: int = 200) -> DataFrame:
    """(id, relevance, ...): 0.5 words + 0.3 recency + 0.2 entities, over the newest episodes that match.

    Sensitive episodes are never recalled. Without query entities their part is 0; two empty word
    sets overlap fully.
    """
    rows = episodes.filter(~F.coalesce("sensitive", F.lit(False)))
    for column, value in (("projectId", project), ("agentId", agent), ("taskId", task)):
        if value:
            rows = rows.filter(F.col(column) == value)
    if types:
        rows = rows.filter(F.col("type").isin(*types))
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= since)
    rows = rows.orderBy(F.desc_nulls_last("timestamp"), "id").limit(newest)
    words = F.array(*[F.lit(t) for t in query_tokens(query)]).cast("array<string>")
    wanted = F.array(*[F.lit(e) for e in entities]).cast("array<string>")
    graph = jaccard(wanted, F.coalesce("entities", F.array().cast("array<string>"))) if entities else F.lit(0.0)
    score = 0.5 * jaccard(words, tokens(F.col("content"))) + 0.3 * F.coalesce(decay(F.col("timestamp"), now), F.lit(0.0)) + 0.2 * graph
    return rows.withColumn("relevance", F.round(score, 4)).orderBy(F.desc("relevance"), "id").limit(max(1, min(limit, 50)))


def decisions(episodes: DataFrame, query: str, now: int, **rest) -> DataFrame:
    """recall() of DECISION episodes only."""
    return recall(episodes, query, now, types=["DECISION"], **rest)


def entity_patterns(episodes: DataFrame, top: int = 5) -> DataFrame:
    """(entity, n): the entities most often mentioned; repeats within an episode count."""
    return episodes.select(F.explode("entities").alias("entity")).filter("entity is not null").groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(top)


def reflection(recalled: DataFrame) -> DataFrame:
    """(episodes, insight): one row on what the recalled episodes have in common."""
    n = recalled.agg(F.count("*").alias("episodes")).withColumn("_gl_1", F.lit(1))
    top = entity_patterns(recalled, 3).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "entity"))).alias("t")).withColumn("_gl_1", F.lit(1))
    names = F.array_join(F.transform("t", lambda x: x["entity"]), ", ")
    found = F.when(F.size("t") > 0, F.concat(F.lit("recurring focus on "), names, F.lit("."))).otherwise("no dominant recurring entities detected.")
    return n.join(top, "_gl_1").select("episodes", F.concat(F.lit("Reflection over "), F.col("episodes").cast("string"), F.lit(" episodes: "), found).alias("insight"))


def learnings(recalled: DataFrame) -> DataFrame:
    """(entity, n, confidence): the three entities a reflection learns about."""
    return entity_patterns(recalled, 3).withColumn("confidence", F.least(F.lit(1.0), 0.5 + F.col("n") / 10))


def decisions_about(episodes: DataFrame, ids: DataFrame, limit: int = 10) -> DataFrame:
    """The newest DECISION episodes that mention any of the ids."""
    rows = episodes.filter("type = 'DECISION'").dropDuplicates(["id"])
    pairs = rows.select("id", F.explode("entities").alias("entity")).join(ids.select(F.col("id").alias("entity")), "entity", "left_semi").select("id").distinct()
    return rows.join(pairs, "id", "left_semi").orderBy(F.desc("timestamp"), "id").limit(limit)


def learnings_about(learned: DataFrame, applies: DataFrame, ids: DataFrame, limit: int = 10) -> DataFrame:
    """The most certain learnings (id, confidence, ...) that apply (src, dst) to any of the ids."""
    hit = applies.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return learned.join(hit, "id", "left_semi").orderBy(F.desc("confidence"), "id").limit(limit)


def recent(episodes: DataFrame, task: str | None = None, agent: str | None = None, limit: int = 10) -> DataFrame:
    """The newest episodes of a task, else of an agent."""
    rows = episodes.filter(F.col("taskId") == task) if task else episodes.filter(F.col("agentId") == agent) if agent else episodes
    return rows.dropDuplicates(["id"]).orderBy(F.desc("timestamp"), "id").limit(limit)
