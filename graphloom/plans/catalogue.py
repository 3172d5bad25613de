"""The reference queries: graph, time, coordination, memory, retrieval, documents, rules, tests, progress.

Every query runs over its whole tables; SQL holds the same question for an independent engine. Fixed
instants and query texts are parameters of the questions, not cuts of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.vectors import code_vector, embed_code, embed_doc
from graphloom.operators import budget, claims, community, docs, impact, layers, memory, progress, rank, retrieve, temporal, traverse
from graphloom.plans.cypher import cypher, from_words
from graphloom.plans.projection import GRAPH_SQL, graph_of
from graphloom.sources import build, code, imports
from graphloom.sources.tables import table
from graphloom.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


AT = 1_743_465_600_000  # 2025-04-01T00:00:00Z
ORDER_AT = 883_612_800_000  # 1998-01-01T00:00:00Z
NOW = 1_760_000_000_000
QUESTION = "stale cursor claim"
SEED = "p:1"


def seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


# ---- graph


@query(f"{GRAPH_SQL} SELECT type, count(*) AS n FROM gnodes GROUP BY type")
def node_census(spark, d):
    return traverse.census(graph_of(spark, d).nodes)


@query(f"{GRAPH_SQL} SELECT type, count(*) AS n FROM gedges GROUP BY type")
def edge_census(spark, d):
    return traverse.census(graph_of(spark, d).edges)


@query(f"{GRAPH_SQL} SELECT id, name FROM gnodes WHERE type = 'FILE' AND summary = 'BUILDING'")
def label_scan_filter(spark, d):
    return graph_of(spark, d).label("FILE").filter("summary = 'BUILDING'").select("id", "name")


@query(f"{GRAPH_SQL} SELECT id, type, name FROM gnodes WHERE id = 'n:7'")
def id_lookup(spark, d):
    return graph_of(spark, d).node("n:7").select("id", "type", "name")


@query(f"{GRAPH_SQL} SELECT src, dst, type FROM gedges WHERE src = 'n:7' OR dst = 'n:7'")
def adjacency(spark, d):
    g = graph_of(spark, d)
    return g.outgoing("n:7").unionByName(g.incoming("n:7"))


@query(f"""{GRAPH_SQL} SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT src AS id, 1 AS o, 0 AS i FROM gedges UNION ALL SELECT dst, 0, 1 FROM gedges) GROUP BY id""")
def out_in_degree(spark, d):
    return traverse.degrees(graph_of(spark, d).edges)


@query(f"""{GRAPH_SQL} SELECT r.dst AS id, count(DISTINCT i.src) AS importers FROM gedges i JOIN gedges r ON i.dst = r.src
WHERE i.type = 'IMPORTS' AND r.type = 'REFERENCES' GROUP BY r.dst""")
def two_hop_impact(spark, d):
    g = graph_of(spark, d)
    i = g.edges_of("IMPORTS").select(F.col("src").alias("importer"), F.col("dst").alias("via"))
    return g.hop(i, "via", ["REFERENCES"], "id").groupBy("id").agg(F.count_distinct("importer").alias("importers"))


@query(f"""{GRAPH_SQL} SELECT n.id, count(e.dst) AS imports, CAST(count(*) FILTER (o.valid_to IS NULL AND e.dst IS NOT NULL) AS BIGINT) AS current
FROM gnodes n LEFT JOIN gedges e ON e.src = n.id AND e.type = 'IMPORTS' LEFT JOIN gnodes o ON o.id = e.dst WHERE n.type = 'FILE' GROUP BY n.id""")
def optional_match_counts(spark, d):
    g = graph_of(spark, d)
    out = g.edges_of("IMPORTS").join(g.label("IMPORT").select(F.col("id").alias("dst"), "valid_to"), "dst")
    per = out.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("imports"), F.count_if(F.col("valid_to").isNull()).alias("current"))
    return g.label("FILE").select("id").join(per, "id", "left").na.fill(0, ["imports", "current"])


@query(f"""{GRAPH_SQL} SELECT id FROM gnodes n WHERE type IN ('FUNCTION', 'FILE') AND NOT EXISTS (SELECT 1 FROM gedges e WHERE e.type = 'TESTS' AND e.dst = n.id)""")
def anti_pattern_untested(spark, d):
    g = graph_of(spark, d)
    return g.label("FUNCTION", "FILE").select("id").join(g.edges_of("TESTS").select(F.col("dst").alias("id")), "id", "left_anti")


@query(f"""{GRAPH_SQL} SELECT src AS id FROM gedges WHERE type = 'CALLS_TO' AND dst = '{SEED}' UNION SELECT src FROM gedges WHERE type = 'TESTS' AND dst = '{SEED}'""")
def union_affected(spark, d):
    g = graph_of(spark, d)
    to = g.incoming(SEED)
    return to.filter("type = 'CALLS_TO'").select(F.col("src").alias("id")).union(to.filter("type = 'TESTS'").select("src")).distinct()


@query(f"""{GRAPH_SQL} SELECT id, type FROM gnodes n WHERE type = 'FILE' AND NOT EXISTS (SELECT 1 FROM gedges e WHERE e.src = n.id)""")
def unused_nodes(spark, d):
    return traverse.unused(graph_of(spark, d)).select("id", "type")


@query(f"""{GRAPH_SQL} SELECT DISTINCT a.src AS a, a.dst AS b FROM gedges a JOIN gedges b ON a.src = b.dst AND a.dst = b.src AND a.type = 'CALLS_TO' AND b.type = 'CALLS_TO' WHERE a.src < a.dst""")
def two_cycles(spark, d):
    return traverse.two_cycles(graph_of(spark, d).edges_of("CALLS_TO"))


@query(f"""{GRAPH_SQL}, c AS (SELECT src, dst FROM gedges WHERE type = 'CALLS_TO')
SELECT 2 AS length, a.src || ' -> ' || a.dst AS cycle FROM c a JOIN c b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT 3, a.src || ' -> ' || a.dst || ' -> ' || b.dst FROM c a JOIN c b ON a.dst = b.src JOIN c e ON e.src = b.dst AND e.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def cycles_upto3(spark, d):
    return traverse.cycles(graph_of(spark, d).edges_of("CALLS_TO"), 3)


_HOPS = f"""{GRAPH_SQL},
ends AS (SELECT src AS h, dst AS t FROM gedges UNION SELECT dst, src FROM gedges),
h0 AS (SELECT '{SEED}' AS id), h1 AS (SELECT DISTINCT t AS id FROM h0 JOIN ends ON id = h), h2 AS (SELECT DISTINCT t AS id FROM h1 JOIN ends ON id = h),
h3 AS (SELECT DISTINCT t AS id FROM h2 JOIN ends ON id = h),
hops AS (SELECT id, min(k) AS hops FROM (SELECT id, 0 AS k FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY id),
near AS (SELECT id, hops, CASE hops WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.3 END AS score FROM hops JOIN gnodes USING (id) WHERE type IN ('FILE', 'FUNCTION', 'CLASS'))"""


@query(f"{_HOPS} SELECT id, hops, score FROM near")
def khop_proximity(spark, d):
    return traverse.proximity(graph_of(spark, d), seeds(spark, SEED))


def _rank_sql(rounds: int, weight: str, start: str, base: str, d: float = 0.85) -> str:
    out = f""", e AS (SELECT src, dst, sum({weight}) AS w FROM ranked GROUP BY src, dst), s AS (SELECT *, w / sum(w) OVER (PARTITION BY src) AS share FROM e),
ids AS ({start}), r0 AS (SELECT id, {base} AS base, 1.0::DOUBLE / count(*) OVER () AS rank FROM ids)"""
    for k in range(1, rounds + 1):
        out += f""",
r{k} AS MATERIALIZED (SELECT r.id, r.base, {1 - d!r} * r.base + {d!r} * coalesce(i.flow, 0) AS rank FROM r0 r LEFT JOIN (SELECT dst, sum(rank * share) AS flow FROM s JOIN r{k - 1} p ON p.id = s.src GROUP BY dst) i ON i.dst = r.id)"""
    return out


_WEIGHT = "CASE type WHEN 'CALLS_TO' THEN 0.9::DOUBLE WHEN 'IMPORTS' THEN 0.7 WHEN 'CONTAINS' THEN 0.5 WHEN 'TESTS' THEN 0.4 ELSE 0.2 END"
_PPR, _PPR20 = (f"{GRAPH_SQL}, ranked AS (SELECT * FROM gedges)" + _rank_sql(n, _WEIGHT, "SELECT src AS id FROM gedges UNION SELECT dst FROM gedges", f"CASE WHEN id = '{SEED}' THEN 1.0::DOUBLE ELSE 0 END") for n in (5, 20))
_PR = ", ranked AS (SELECT DISTINCT src, dst FROM gedges)" + _rank_sql(5, "1.0::DOUBLE", "SELECT DISTINCT id FROM gnodes", "1.0::DOUBLE / count(*) OVER ()")


@query(f"{_PPR} SELECT id, round(rank, 6) AS score FROM r5")
def ppr_power_iteration(spark, d):
    return rank.personalised_pagerank(graph_of(spark, d), seeds(spark, SEED), rounds=5, limit=None)


@query(f"{_PPR20} SELECT id, round(rank, 6) AS score FROM r20 ORDER BY score DESC, id LIMIT 50")
def ppr_top50(spark, d):
    """20 rounds, the 50 best."""
    return rank.personalised_pagerank(graph_of(spark, d), seeds(spark, SEED))


@query(f"{GRAPH_SQL}{_PR} SELECT id, round(rank, 9) AS rank FROM r5")
def pagerank_global(spark, d):
    return rank.pagerank(graph_of(spark, d), rounds=5)


@query(f"""{_HOPS}{_PR} SELECT id, score FROM (SELECT coalesce(r.id, n.id) AS id, round(coalesce(round(r.rank, 9), 0) * {1 - 0.85!r} + coalesce(n.score, 0) * 0.85::DOUBLE, 6) AS score
  FROM (SELECT r5.* FROM r5 JOIN gnodes USING (id) WHERE type IN ('FILE', 'FUNCTION', 'CLASS')) r FULL JOIN near n ON r.id = n.id) ORDER BY score DESC, id LIMIT 50""")
def pagerank_proximity_blend(spark, d):
    return rank.blended_rank(graph_of(spark, d), seeds(spark, SEED), rounds=5)


@query(f"""{GRAPH_SQL} SELECT id, round(sum(w), 6) AS score FROM (SELECT dst AS id, {_WEIGHT} AS w FROM gedges WHERE src IN ('p:1', 'p:2') UNION ALL SELECT src, {_WEIGHT} FROM gedges WHERE dst IN ('p:1', 'p:2'))
GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def one_hop_expansion(spark, d):
    return traverse.expand(graph_of(spark, d), seeds(spark, "p:1", "p:2"))


_LABELS = f"""{GRAPH_SQL}, members AS (SELECT id, type, path, CASE WHEN path LIKE 'src/%' THEN split_part(path, '/', 2) WHEN path LIKE 'tests/%' THEN split_part(path, '/', 2) ELSE 'misc' END AS label
  FROM gnodes WHERE type IN ('FILE', 'FUNCTION', 'TEST_SUITE'))"""


@query(f"{_LABELS} SELECT label, count(*) AS n FROM members GROUP BY label")
def communities_directory(spark, d):
    return community.directory_communities(graph_of(spark, d).label("FILE", "FUNCTION", "TEST_SUITE")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""{_LABELS}, per AS (SELECT label, type, count(*) AS n, min(id) AS first FROM members GROUP BY ALL)
SELECT label, CAST(sum(n) AS BIGINT) AS member_count, coalesce(min(first) FILTER (type = 'FUNCTION'), min(first)) AS central_node,
  'Community ''' || label || ''' groups ' || sum(n) || ' code node(s): ' || string_agg(n || ' ' || lower(type) || ' node(s)', ', ' ORDER BY n DESC, type) || '.' AS summary FROM per GROUP BY label""")
def community_summaries(spark, d):
    return community.summaries(community.directory_communities(graph_of(spark, d).label("FILE", "FUNCTION", "TEST_SUITE")))


_VOTE = "SELECT l.id, coalesce(b.c, l.c) AS c FROM {0} l LEFT JOIN (SELECT h AS id, c FROM (SELECT h, c, row_number() OVER (PARTITION BY h ORDER BY count(*) DESC, c) AS k FROM ends JOIN {0} x ON x.id = t GROUP BY h, c) WHERE k = 1) b ON b.id = l.id"


@query(f"""{GRAPH_SQL}, ends AS (SELECT src AS h, dst AS t FROM gedges WHERE src <> dst UNION SELECT dst, src FROM gedges WHERE src <> dst),
l0 AS (SELECT DISTINCT id, id AS c FROM gnodes), l1 AS MATERIALIZED ({_VOTE.format('l0')}), l2 AS MATERIALIZED ({_VOTE.format('l1')}) SELECT id, c AS community FROM l2""")
def communities_label_prop(spark, d):
    return community.label_propagation(graph_of(spark, d), 2)


@query(f"""{GRAPH_SQL}, hit AS (SELECT id FROM gnodes WHERE type = 'FILE' AND contains(lower(path), 'nation3/') ORDER BY id LIMIT 1),
rows AS (SELECT DISTINCT 'out' AS direction, type, dst AS other FROM gedges WHERE src IN (FROM hit) UNION SELECT 'in', type, src FROM gedges WHERE dst IN (FROM hit)),
numbered AS (SELECT rows.*, name, row_number() OVER (PARTITION BY direction ORDER BY rows.type, other) AS n FROM rows LEFT JOIN gnodes ON id = other)
SELECT direction, type, other, name, n FROM numbered WHERE n <= 20""")
def explain_node(spark, d):
    return traverse.explain(graph_of(spark, d), "nation3/")


@query(f"""{GRAPH_SQL} SELECT count(*) AS nodes, count(*) FILTER (type = 'FILE') AS files, count(*) FILTER (type = 'FUNCTION') AS functions, count(*) FILTER (type = 'CLASS') AS classes,
  count(*) FILTER (type = 'IMPORT') AS imports, (SELECT count(*) FROM gedges) AS edges, (SELECT count(*) FROM embeddings) AS embeddings,
  round((SELECT count(*) FROM embeddings) / count(*) FILTER (type IN ('FILE', 'FUNCTION', 'CLASS')), 3) AS coverage, 'ok' AS status FROM gnodes""")
def health_rollup(spark, d):
    return traverse.health(graph_of(spark, d), table(spark, d, "embeddings"))


@query(f"""{GRAPH_SQL}, alive AS (SELECT id FROM gnodes WHERE valid_from <= {ORDER_AT} AND (valid_to IS NULL OR valid_to > {ORDER_AT}))
SELECT type, count(*) AS n FROM gedges WHERE src IN (FROM alive) AND dst IN (FROM alive) GROUP BY type""")
def asof_graph(spark, d):
    return traverse.census(graph_of(spark, d).scope("DEMO").as_of(ORDER_AT).edges)


# ---- time


def _versions(spark, d):
    n = table(spark, d, "nodes").dropDuplicates(["id", "createdAt", "validTo"])
    end = F.when(F.col("validTo") < 9_999_999_999_999, F.col("validTo"))
    return n.select("id", "type", F.col("projectId").alias("project_id"), "props", F.element_at("props", "name").alias("name"), F.element_at("props", "path").alias("path"), F.col("createdAt").alias("valid_from"), end.alias("valid_to"))


_VERSIONS = """WITH v AS (SELECT DISTINCT id, type, "projectId" AS project_id, props['name'] AS name, props['path'] AS path, "createdAt" AS valid_from, CASE WHEN "validTo" < 9999999999999 THEN "validTo" END AS valid_to FROM nodes)"""


@query(f"{_VERSIONS} SELECT type, count(*) AS n FROM v WHERE valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT}) GROUP BY type")
def asof_snapshot(spark, d):
    return traverse.census(temporal.as_of(_versions(spark, d), AT))


@query(f"""{_VERSIONS}, one AS (SELECT id, max(valid_from) AS valid_from, max(coalesce(valid_to, 9999999999999)) AS valid_to FROM v GROUP BY id),
rows AS (SELECT "targetId" AS id, count(*) AS n FROM claims WHERE "targetId" IS NOT NULL GROUP BY ALL)
SELECT rows.id, n FROM rows LEFT JOIN one USING (id) WHERE one.id IS NULL OR (valid_from <= {AT} AND valid_to > {AT})""")
def asof_rows(spark, d):
    one = _versions(spark, d).groupBy("id").agg(F.max("valid_from").alias("valid_from"), F.max(F.coalesce("valid_to", F.lit(9_999_999_999_999))).alias("valid_to"))
    rows = table(spark, d, "claims").filter("targetId is not null").groupBy(F.col("targetId").alias("id")).agg(F.count("*").alias("n"))
    return temporal.as_of_rows(rows, one, AT)


_DIFF = f"""{_VERSIONS}, a AS (SELECT id, any_value(type) AS type, max(valid_from) AS "at" FROM v WHERE type IN ('FILE', 'FUNCTION', 'CLASS') AND valid_from >= {AT} GROUP BY id),
r AS (SELECT id, any_value(type) AS type, max(valid_to) AS "at" FROM v WHERE type IN ('FILE', 'FUNCTION', 'CLASS') AND valid_to >= {AT} GROUP BY id),
diff AS (SELECT 'added' AS change, * FROM a UNION ALL SELECT 'removed', * FROM r UNION ALL SELECT 'modified', a.* FROM a JOIN r USING (id))"""


@query(_DIFF + ' SELECT change, id, type, "at" FROM diff')
def diff_since(spark, d):
    return temporal.diff_since(_versions(spark, d), AT)


@query(f"{_DIFF} SELECT change, count(*) AS n FROM diff GROUP BY change")
def diff_counts(spark, d):
    return temporal.diff_counts(temporal.diff_since(_versions(spark, d), AT))


def _transactions(spark, d):
    return table(spark, d, "class_nodes").select(F.col("txId").alias("id"), F.col("txTimestamp").alias("timestamp"), F.lit(None).cast("string").alias("gitCommit"), F.lit(None).cast("string").alias("agentId")).distinct()


@query(f"""SELECT DISTINCT "txId" AS id, "txTimestamp" AS timestamp FROM class_nodes WHERE "txTimestamp" >= {AT}""")
def transactions_since(spark, d):
    return temporal.transactions_since(_transactions(spark, d), AT)


@query(f"SELECT CAST({AT} AS BIGINT) AS since, 'timestamp' AS mode")
def anchor_resolution(spark, d):
    return temporal.anchor(spark, _transactions(spark, d), "2025-04-01")


@query("""SELECT doc_id, 'changed' AS change FROM documents WHERE sha256(text) <> sha256(regexp_replace(text, '^ +| +$', '', 'g'))""")
def incremental_changed(spark, d):
    t = table(spark, d, "documents")
    return temporal.changes(t.select("doc_id", F.sha2("text", 256).alias("hash")), t.select("doc_id", F.sha2(F.trim("text"), 256).alias("hash")), "doc_id")


@query(f"""SELECT type, count(*) AS n, round(sum(exp(-0.05 * greatest(0, ({NOW} - "timestamp") / 86400000.0))), 4) AS weight FROM (SELECT DISTINCT id, type, "timestamp" FROM episodes) GROUP BY type""")
def decayed_episodes(spark, d):
    e = table(spark, d, "episodes").select("id", "type", "timestamp").distinct()
    return e.groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum(temporal.decay(F.col("timestamp"), NOW)), 4).alias("weight"))


# ---- coordination

_LATEST = """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "validTo" NULLS LAST, "validFrom" DESC NULLS LAST) AS k FROM claims) WHERE k = 1)"""


def _claims(spark, d):
    return claims.latest(table(spark, d, "claims"))


def _targets(spark, d):
    return table(spark, d, "nodes").select("id", F.col("createdAt").alias("valid_from"))


@query(f"""{_LATEST} SELECT count(*) FILTER ("validTo" IS NULL) AS active, count(*) AS total FROM c""")
def claims_active(spark, d):
    return claims.totals(_claims(spark, d))


@query(f"""{_LATEST}, per AS (SELECT "targetId", "agentId", count(*) AS n FROM c WHERE "validTo" IS NULL AND "targetId" IS NOT NULL AND "agentId" IS NOT NULL GROUP BY ALL)
SELECT "targetId", count(*) AS agents, CAST(sum(n) AS BIGINT) AS claims FROM per GROUP BY "targetId" HAVING count(*) > 1""")
def claims_conflicts(spark, d):
    return claims.conflicts(_claims(spark, d))


@query(f"""{_LATEST}, o AS (SELECT * FROM c WHERE "validTo" IS NULL AND "targetId" IS NOT NULL AND "agentId" IS NOT NULL),
n AS (SELECT id, "targetId", "agentId", count(*) OVER (PARTITION BY "targetId") - count(*) OVER (PARTITION BY "targetId", "agentId") AS rivals FROM o) SELECT * FROM n WHERE rivals > 0""")
def claims_rivals(spark, d):
    return claims.conflicting_claims(_claims(spark, d))


@query(f"""{_LATEST}, t AS (SELECT id, max("createdAt") AS v FROM nodes GROUP BY id) SELECT c.id, c."targetId" FROM c JOIN t ON t.id = c."targetId" WHERE c."validTo" IS NULL AND v > c."validFrom" """)
def claims_stale(spark, d):
    return claims.stale(_claims(spark, d), _targets(spark, d)).select("id", "targetId")


@query(f"""{_LATEST} SELECT "agentId", count(*) AS claims, max("validFrom") AS last_claim FROM c WHERE "validTo" IS NULL GROUP BY "agentId" """)
def claims_agent_summary(spark, d):
    return claims.agent_summary(_claims(spark, d))


@query(f"""{_LATEST} SELECT CASE WHEN "validTo" IS NULL AND "validFrom" < {NOW} - 86400000 THEN 'expired' ELSE "invalidationReason" END AS reason, count(*) AS n FROM c GROUP BY 1""")
def claims_expire(spark, d):
    return claims.expire(_claims(spark, d), NOW, 86_400_000).groupBy(F.col("invalidationReason").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{_LATEST}, t AS (SELECT id, max("createdAt") AS v FROM nodes GROUP BY id)
SELECT CASE WHEN "validTo" IS NULL AND v > "validFrom" THEN 'code_changed' ELSE "invalidationReason" END AS reason, count(*) AS n FROM c LEFT JOIN t ON t.id = c."targetId" GROUP BY 1""")
def claims_invalidate_stale(spark, d):
    return claims.invalidate_stale(_claims(spark, d), _targets(spark, d), NOW).groupBy(F.col("invalidationReason").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{_LATEST} SELECT c.id, "targetId", "agentId" FROM c WHERE "validTo" IS NULL AND ("agentId" <> 'agent-01' OR "agentId" IS NULL) AND "targetId" IN (SELECT id FROM features) ORDER BY "validFrom" DESC NULLS LAST, c.id LIMIT 20""")
def claims_blockers(spark, d):
    return claims.blockers(_claims(spark, d), table(spark, d, "features").select("id"), "agent-01").select("id", "targetId", "agentId")


@query(f"""{_LATEST} SELECT 'claim' AS kind, id, "taskId", "validFrom" AS "at" FROM c WHERE "validTo" IS NULL AND "agentId" = 'agent-01'
UNION ALL FROM (SELECT 'episode', id, "taskId", "timestamp" FROM (SELECT DISTINCT id, "taskId", "timestamp" FROM episodes WHERE "agentId" = 'agent-01') ORDER BY "timestamp" DESC, id LIMIT 10)""")
def agent_status(spark, d):
    return claims.agent_status(table(spark, d, "claims"), table(spark, d, "episodes"), "agent-01")


# ---- memory

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_]+'), lambda t: length(t) >= 2)"
_RECALL = """WITH e AS (SELECT DISTINCT id, type, content, "timestamp", entities FROM episodes WHERE NOT coalesce(sensitive, false){0}),
newest AS (SELECT * FROM e ORDER BY "timestamp" DESC NULLS LAST, id LIMIT 200),
q AS (SELECT ['stale', 'cursor', 'claim'] AS w),
s AS (SELECT newest.*, list_distinct(""" + _WORDS.format("content") + """) AS words, w FROM newest, q),
r AS (SELECT id, type, entities, round(0.5::DOUBLE * len(list_intersect(words, w)) / (len(words) + len(w) - len(list_intersect(words, w))) + 0.3::DOUBLE * exp(-0.05 * greatest(0, ({1} - "timestamp") / 86400000.0)), 4) AS relevance FROM s)"""


def _episodes(spark, d):
    return table(spark, d, "episodes").dropDuplicates(["id"])


@query(_RECALL.format("", NOW) + " SELECT id, relevance FROM r ORDER BY relevance DESC, id LIMIT 20")
def episode_recall(spark, d):
    return memory.recall(_episodes(spark, d), QUESTION, NOW, limit=20).select("id", "relevance")


@query(_RECALL.format(" AND type = 'DECISION'", NOW) + " SELECT id, relevance FROM r ORDER BY relevance DESC, id LIMIT 5")
def decision_query(spark, d):
    return memory.decisions(_episodes(spark, d), QUESTION, NOW).select("id", "relevance")


_ENTITIES = """SELECT u AS entity, count(*) AS n FROM (SELECT unnest(entities) AS u FROM (SELECT DISTINCT id, entities FROM episodes)) WHERE u IS NOT NULL GROUP BY u ORDER BY n DESC, entity"""


@query(f"{_ENTITIES} LIMIT 5")
def reflect_patterns(spark, d):
    return memory.entity_patterns(_episodes(spark, d))


@query(f"SELECT entity, n, least(1.0::DOUBLE, 0.5::DOUBLE + n / 10) AS confidence FROM ({_ENTITIES} LIMIT 3)")
def reflect_learnings(spark, d):
    return memory.learnings(_episodes(spark, d))


@query(f"""SELECT (SELECT count(DISTINCT id) FROM episodes) AS episodes, 'Reflection over ' || (SELECT count(DISTINCT id) FROM episodes) || ' episodes: recurring focus on ' ||
(SELECT string_agg(entity, ', ' ORDER BY n DESC, entity) FROM ({_ENTITIES} LIMIT 3)) || '.' AS insight""")
def reflect_insight(spark, d):
    return memory.reflection(_episodes(spark, d))


@query("""SELECT * FROM (SELECT lag(id) OVER (PARTITION BY "projectId", "agentId", "sessionId" ORDER BY "timestamp" NULLS FIRST, id) AS src, id AS dst
FROM (SELECT DISTINCT id, "projectId", "agentId", "sessionId", "timestamp" FROM episodes WHERE "agentId" IS NOT NULL AND "sessionId" IS NOT NULL)) WHERE src IS NOT NULL""")
def next_episode(spark, d):
    return memory.next_episode(_episodes(spark, d))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE
  WHEN type = 'EDIT' AND coalesce(len(entities), 0) = 0 THEN 'EDIT episodes require at least one entity reference.'
  WHEN type = 'DECISION' AND NOT coalesce(lower(outcome) IN ('success', 'failure', 'partial'), false) THEN 'DECISION episodes require outcome: success | failure | partial.'
  WHEN type = 'DECISION' AND json_extract_string(metadata, '$.rationale') IS NULL AND json_extract_string(metadata, '$.reason') IS NULL THEN 'DECISION episodes require metadata.rationale (or metadata.reason).'
  WHEN type = 'TEST_RESULT' AND NOT coalesce(lower(outcome) IN ('success', 'failure', 'partial'), false) THEN 'TEST_RESULT episodes require outcome: success | failure | partial.'
  WHEN type = 'TEST_RESULT' AND json_extract_string(metadata, '$.testName') IS NULL AND json_extract_string(metadata, '$.testFile') IS NULL THEN 'TEST_RESULT episodes require metadata.testName or metadata.testFile.'
  WHEN type = 'ERROR' AND json_extract_string(metadata, '$.errorCode') IS NULL AND json_extract_string(metadata, '$.stack') IS NULL THEN 'ERROR episodes require metadata.errorCode or metadata.stack.' END AS reason
  FROM (SELECT DISTINCT id, type, outcome, metadata, entities FROM episodes)) GROUP BY reason""")
def episode_validate(spark, d):
    return _episodes(spark, d).groupBy(memory.invalid_because().alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT id AS src, u AS dst FROM (SELECT id, unnest(entities) AS u FROM episodes) WHERE u IN (SELECT id FROM nodes)""")
def episode_involves(spark, d):
    return memory.involves(table(spark, d, "episodes"), table(spark, d, "nodes"))


@query("""SELECT DISTINCT id, "timestamp" FROM (SELECT id, "timestamp", unnest(entities) AS u FROM episodes WHERE type = 'DECISION') WHERE u IN (SELECT id FROM features) ORDER BY "timestamp" DESC, id LIMIT 10""")
def decisions_about(spark, d):
    return memory.decisions_about(table(spark, d, "episodes"), table(spark, d, "features").select("id")).select("id", "timestamp")


@query("""SELECT DISTINCT id, "timestamp" FROM episodes WHERE "agentId" = 'agent-08' ORDER BY "timestamp" DESC, id LIMIT 10""")
def recent_episodes(spark, d):
    return memory.recent(table(spark, d, "episodes"), agent="agent-08").select("id", "timestamp")


# ---- retrieval

_HAY = "lower(concat_ws(' ', id, coalesce(name, ''), coalesce(path, ''), coalesce(summary, '')))"
_LEX = f"""lex AS (SELECT id, (contains(h, 'copper')::INT + contains(h, 'nation3')::INT + contains(h, 'economy')::INT) AS score FROM (SELECT id, {_HAY} AS h FROM gnodes WHERE type IN ('FILE', 'FUNCTION', 'CLASS')))"""
LEX_QUERY = "copper nation3 economy"


@query(f"{GRAPH_SQL}, {_LEX} SELECT id, score FROM lex WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def lexical_score(spark, d):
    return retrieve.lexical(graph_of(spark, d).label("FILE", "FUNCTION", "CLASS"), LEX_QUERY)


@query(f"{GRAPH_SQL} SELECT id FROM gnodes WHERE contains(lower(concat_ws(' ', id, coalesce(name, ''), coalesce(path, ''))), 'nation3') ORDER BY id LIMIT 5")
def seed_finder(spark, d):
    return retrieve.find_seeds(graph_of(spark, d).nodes, "nation3")


_BM25 = "WITH t AS (SELECT doc_id AS id, " + _WORDS.format("text") + """ AS ts FROM documents), x AS (SELECT count(*) AS n, avg(len(ts)) AS avg FROM t),
tf AS (SELECT id, w AS term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, unnest(ts) AS w, len(ts) AS l FROM t) WHERE w IN ('stale', 'cursor', 'claim') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg))), 6) AS score FROM tf JOIN df USING (term), x GROUP BY id)"""


@query(f"{_BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return retrieve.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), QUESTION, 20)


@query("SELECT w AS term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM (SELECT doc_id AS id, unnest(" + _WORDS.format("text") + ") AS w FROM documents) GROUP BY w")
def term_statistics(spark, d):
    p = retrieve.postings(table(spark, d, "documents"), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def _vectors(spark, d):
    """The embeddings as typed vectors; labels 0 to 2 stand for the three types, others for themselves."""
    names = F.when(F.col("label") == 0, "function").when(F.col("label") == 1, "class").when(F.col("label") == 2, "file").otherwise(F.col("label").cast("string"))
    return table(spark, d, "embeddings").select(F.concat(F.lit("v:"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("vector"), names.alias("type"), F.lit("demo").alias("project_id"))


_VEC = """v AS (SELECT 'v:' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE label WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'file' ELSE CAST(label AS VARCHAR) END AS type FROM embeddings),
q AS (SELECT x AS y, type AS own FROM v WHERE id = 'v:0'), near AS (SELECT id, type, own, round(list_cosine_similarity(x, y), 6) AS score FROM v, q)"""
_VLIST = """typed AS (SELECT id, type, score, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS k FROM near WHERE type IN ('function', 'class', 'file')),
vlist AS (SELECT id, row_number() OVER (ORDER BY CASE type WHEN 'function' THEN 0 WHEN 'class' THEN 1 ELSE 2 END, score DESC, id) AS rank FROM typed WHERE k <= {0})"""


@query(f"WITH {_VEC} SELECT id, score FROM near ORDER BY score DESC, id LIMIT 10")
def knn_cosine(spark, d):
    v = _vectors(spark, d)
    return retrieve.knn(v, retrieve.vector_of(v, "v:0"))


@query(f"WITH {_VEC} SELECT id, score FROM near WHERE id <> 'v:0' AND type = own AND score >= 0.2 ORDER BY score DESC, id LIMIT 10")
def similar_threshold(spark, d):
    return retrieve.similar_to(_vectors(spark, d), "v:0", 0.2)


@query(f"WITH {_VEC}, {_VLIST.format(10)} SELECT id, rank, 1.0::DOUBLE / rank AS score FROM vlist WHERE rank <= 10")
def vector_search_list(spark, d):
    v = _vectors(spark, d)
    return retrieve.vector_list(v, retrieve.vector_of(v, "v:0"))


@query(f"WITH {_VEC}, {_VLIST.format(4)} SELECT type, id, score FROM typed WHERE k <= 4")
def cross_type_knn(spark, d):
    v = _vectors(spark, d)
    return retrieve.across_types(v, retrieve.vector_of(v, "v:0"))


@query(f"WITH {_VEC}, {_VLIST.format(15)} SELECT id FROM vlist WHERE rank <= 10")
def entity_hints(spark, d):
    v = _vectors(spark, d)
    return retrieve.entity_hints(v, retrieve.vector_of(v, "v:0"), 5)


@query(f"WITH {_VEC}, n AS (SELECT id FROM near WHERE id <> 'v:0' AND score >= 0.2 ORDER BY score DESC, id LIMIT 5) SELECT count(*) AS neighbours, CASE WHEN count(*) < 2 THEN 'unique' WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS advice FROM n")
def refactor_advice(spark, d):
    v = _vectors(spark, d)
    return retrieve.refactor_advice(retrieve.knn(v.filter("id <> 'v:0'"), retrieve.vector_of(v, "v:0"), 5, 0.2))


def _graph_vectors(spark, d):
    """Vectors of parts, files and folders by their number, so that fused lists share ids."""
    prefix = F.when(F.col("label") == 0, "p:").when(F.col("label") == 1, "c:").otherwise("s:")
    names = F.when(F.col("label") == 0, "function").when(F.col("label") == 1, "class").when(F.col("label") == 2, "file").otherwise("other")
    return table(spark, d, "embeddings").select(F.concat(prefix, F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("vector"), names.alias("type"), F.lit("demo").alias("project_id"))


_HYBRID = f"""{GRAPH_SQL}, v AS (SELECT CASE label WHEN 0 THEN 'p:' WHEN 1 THEN 'c:' ELSE 's:' END || vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, vec_id, CASE label WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'file' ELSE 'other' END AS type FROM embeddings),
q AS (SELECT x AS y FROM v WHERE vec_id = 0), near AS (SELECT id, type, round(list_cosine_similarity(x, y), 6) AS score FROM v, q), {_VLIST.format(10)},
va AS (SELECT id, rank, 1.0::DOUBLE / rank AS score FROM vlist WHERE rank <= 10), {_LEX},
lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, score::DOUBLE AS score FROM lex WHERE score > 0 ORDER BY score DESC, id LIMIT 10),
sd AS (SELECT id FROM (SELECT id, 0 AS p, rank FROM va UNION ALL SELECT id, 1, rank FROM lx) ORDER BY p, rank LIMIT 10),
ex AS (SELECT id, round(sum(w), 6) AS score FROM (SELECT dst AS id, {_WEIGHT} AS w FROM sd JOIN gedges ON src = sd.id UNION ALL SELECT src, {_WEIGHT} FROM sd JOIN gedges ON dst = sd.id) GROUP BY id ORDER BY score DESC, id LIMIT 10),
gx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM ex),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf_score, max(score) FILTER (s = 'vector') AS vector, max(score) FILTER (s = 'bm25') AS bm25, max(score) FILTER (s = 'graph') AS graph
  FROM (SELECT *, 'vector' AS s FROM va UNION ALL SELECT *, 'bm25' FROM lx UNION ALL SELECT *, 'graph' FROM gx) GROUP BY id)
SELECT fused.id, rrf_score, vector, bm25, graph, type, name, path FROM fused JOIN gnodes USING (id) ORDER BY rrf_score DESC, id LIMIT 10"""


@query(_HYBRID)
def rrf_hybrid(spark, d):
    v = _graph_vectors(spark, d)
    own = table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("vector"), F.lit("q").alias("id"))
    return retrieve.hybrid(graph_of(spark, d), v, LEX_QUERY, retrieve.vector_of(own, "q"))


@query(f"""{GRAPH_SQL}, {_VEC}, hits AS (SELECT 'v:' || substr(id, 3) AS id FROM gnodes WHERE type = 'FUNCTION' AND contains(lower(name), 'part 1') ), n AS (SELECT id FROM near ORDER BY score DESC, id LIMIT 10)
SELECT id, max(score) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT id, 1.0::DOUBLE AS score, 'graph' AS source FROM hits UNION ALL SELECT id, 0.8::DOUBLE, 'vector' FROM n) GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def max_score_hybrid(spark, d):
    v = _vectors(spark, d)
    named = graph_of(spark, d).label("FUNCTION").filter(F.contains(F.lower("name"), F.lit("part 1"))).select(F.concat(F.lit("v:"), F.substring("id", 3, 30)).alias("id"))
    return retrieve.max_score(named, retrieve.knn(v, retrieve.vector_of(v, "v:0")))


@query(f"""{_LABELS}, c AS (SELECT label, count(*) AS member_count FROM members GROUP BY label) SELECT label, member_count FROM c WHERE contains(lower(label), 'nation12') ORDER BY member_count DESC, label LIMIT 10""")
def community_search(spark, d):
    found = community.summaries(community.directory_communities(graph_of(spark, d).label("FILE", "FUNCTION", "TEST_SUITE")))
    return retrieve.communities_for(found, "nation12").select("label", "member_count")


@query(f"{GRAPH_SQL} SELECT id, name FROM gnodes WHERE type IN ('FILE', 'FUNCTION', 'CLASS') AND (contains(lower(name), '00012') OR contains(lower(path), '00012')) ORDER BY id LIMIT 20")
def pattern_search(spark, d):
    return retrieve.pattern_search(graph_of(spark, d).nodes, "00012").select("id", "name")


_SECTIONS = "s AS (SELECT DISTINCT id, heading, content, \"docId\", \"startLine\" FROM sections)"


def _sections(spark, d):
    return table(spark, d, "sections").select("id", "heading", "content", "docId", "startLine").distinct()


@query(f"""WITH {_SECTIONS} SELECT id, heading, substr(content, 1, 500) AS excerpt, 1.0::DOUBLE AS score FROM s WHERE contains(lower(concat_ws(' ', heading, content)), 'stale') AND contains(lower(concat_ws(' ', heading, content)), 'cursor')
ORDER BY heading NULLS LAST, id LIMIT 10""")
def doc_search_all_terms(spark, d):
    return retrieve.search_sections(_sections(spark, d), "stale cursor")


@query(f"""WITH {_SECTIONS}, t AS (SELECT id, lower(concat_ws(' ', coalesce(heading, ''), coalesce(content, ''))) AS t, lower(coalesce(heading, '')) AS h FROM s),
n AS (SELECT id, sum(((length(t) - length(replace(t, w, ''))) // length(w)) * CASE WHEN contains(h, w) THEN 3 ELSE 1 END) AS score FROM t, (SELECT unnest(['stale', 'cursor']) AS w) GROUP BY id, t, h)
SELECT id, CAST(score AS INT) AS score FROM n WHERE score > 0""")
def ref_doc_score(spark, d):
    return retrieve.ref_doc_scores(_sections(spark, d), "stale cursor")


@query("""WITH t AS (SELECT "relativePath" AS path, lower(coalesce(text, '')) AS t FROM documents WHERE "relativePath" IS NOT NULL), n AS (SELECT path, t, (length(t) - length(replace(t, 'return', ''))) // 6 + CASE WHEN contains(lower(path), 'return') THEN 3 ELSE 0 END + (length(t) - length(replace(t, 'taskboard', ''))) // 9 * 5 AS score FROM t)
SELECT path, CAST(score AS INT) AS score FROM n WHERE score > 0""")
def ref_code_score(spark, d):
    files = table(spark, d, "documents").filter("relativePath is not null").select(F.col("relativePath").alias("path"), F.col("text").alias("content"))
    return retrieve.ref_code_scores(files, "return", "TaskBoard")


@query()
def ref_excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieve.excerpt(F.col("text"), ["stale", "cursor"]).alias("excerpt"))


@query("""SELECT id, CASE WHEN regexp_matches(lower(query), '(test|coverage|spec|affected)') THEN 'test-impact' WHEN regexp_matches(lower(query), '(progress|feature|task|blocked|milestone)') THEN 'progress'
  WHEN regexp_matches(lower(query), '(import|dependency|depends|caller|called by|uses)') THEN 'dependency' WHEN regexp_matches(lower(query), '(file|folder|class|function|structure|tree|list)') THEN 'structure' ELSE 'general' END AS intent FROM graph_queries""")
def intent_classify(spark, d):
    return table(spark, d, "graph_queries").select("id", X.intent(F.col("query")).alias("intent"))


@query("""SELECT id, CASE WHEN regexp_matches(lower(query), '(architect|structure|pattern|design|layer|module|overview|convention|best.?practice)') THEN 'architecture' WHEN regexp_matches(lower(query), '(how to|example|guide|decision|adr|changelog)') THEN 'docs'
  WHEN regexp_matches(lower(query), '(function|class|method|import|export|interface|type|impl|usage)') THEN 'code' ELSE 'all' END AS mode FROM graph_queries""")
def ref_mode_classify(spark, d):
    return table(spark, d, "graph_queries").select("id", X.ref_mode(F.col("query")).alias("mode"))


@query(f"{GRAPH_SQL} SELECT id, type FROM gnodes WHERE type = 'FUNCTION' AND id LIKE '%:77' ORDER BY id LIMIT 1")
def element_resolve(spark, d):
    return retrieve.resolve_element(graph_of(spark, d).label("FUNCTION"), "77").select("id", "type")


@query(f"""{GRAPH_SQL}, k AS (SELECT id, CASE WHEN path <> '' THEN split_part(path, '/', 1) || CASE WHEN contains(path, '/') THEN '/' || split_part(path, '/', 2) ELSE '' END ELSE 'root' END AS cluster FROM gnodes WHERE type IN ('FILE', 'FUNCTION')),
n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS r FROM k)
SELECT cluster, count(*) AS size, string_agg(id, ',' ORDER BY id) FILTER (r <= 5) AS sample FROM n GROUP BY cluster ORDER BY size DESC, cluster LIMIT 5""")
def clusters_by_prefix(spark, d):
    return retrieve.clusters(graph_of(spark, d).label("FILE", "FUNCTION"))


@query()
def prop_diff(spark, d):
    n = table(spark, d, "nodes").filter("type = 'FILE' and props is not null")
    ends = n.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return retrieve.property_diff(n, ends[0] or "", ends[1] or "")


@query(f"""{GRAPH_SQL}, x AS (SELECT id, split_part(path, '/', 2) AS area FROM gnodes WHERE type = 'FUNCTION'), {_LEX}, top AS (SELECT id FROM lex WHERE score > 0 AND id LIKE 'p:%' ORDER BY score DESC, id LIMIT 10)
SELECT area, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM top JOIN x USING (id) GROUP BY area""")
def duplicates_by_area(spark, d):
    f = graph_of(spark, d).label("FUNCTION")
    return retrieve.duplicates_by_area(retrieve.lexical(f, LEX_QUERY), f)


@query()
def text_vector_code(spark, d):
    return table(spark, d, "code_embeddings").select("id", embed_code(F.concat_ws(" ", "type", "name", "text")).alias("vector"))


@query()
def text_vector_docs(spark, d):
    return table(spark, d, "sections").select("id", embed_doc(F.concat_ws(" ", "heading", "content")).alias("vector"))


@query()
def semantic_search(spark, d):
    rows = table(spark, d, "code_embeddings").select("id", "vector", "type", F.col("projectId").alias("project_id")).distinct()
    return retrieve.knn(rows.filter(F.size("vector") == 128), code_vector(QUESTION), 10)


# ---- documents


@query()
def doc_sections(spark, d):
    return docs.sections(table(spark, d, "documents").select(F.coalesce("relativePath", F.col("doc_id").cast("string")).alias("relative_path"), "text"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(b, 'readme') THEN 'readme' WHEN regexp_matches(b, '^(changelog|history)') THEN 'changelog' WHEN regexp_matches(b, '^(architecture|arch\\.)') THEN 'architecture'
  WHEN regexp_matches(l, 'adr[-_\\s]?\\d+') OR regexp_matches(l, '(^|/)decisions?/') OR regexp_matches(l, '(^|/)adr/') THEN 'adr' WHEN regexp_matches(l, '(^|/)docs/') THEN 'guide' ELSE 'other' END AS kind
  FROM (SELECT lower("relativePath") AS l, list_last(string_split(lower("relativePath"), '/')) AS b FROM (SELECT DISTINCT id, "relativePath" FROM sections))) GROUP BY kind""")
def doc_kinds(spark, d):
    rows = table(spark, d, "sections").select("id", "relativePath").distinct()
    return rows.groupBy(docs.kind(F.col("relativePath")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {_SECTIONS} SELECT id, CASE WHEN content IS NULL AND heading IS NULL THEN 0 ELSE len(regexp_extract_all(concat_ws(' ', heading, content), '[^\\t\\n\\x0B\\f\\r ]+')) END AS words,
  coalesce(len(regexp_extract_all(content, '\\[([^\\]\\n]*)\\]\\(([^)\\t\\n\\x0B\\f\\r ]+)[^)]*\\)')), -1) AS links FROM s""")
def section_features(spark, d):
    return _sections(spark, d).select("id", docs.word_count(F.col("heading"), F.col("content")).alias("words"), F.coalesce(F.size(docs.links(F.col("content"))), F.lit(-1)).alias("links"))


@query("""SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY "docId" ORDER BY "startLine" NULLS FIRST, id) AS dst, 'NEXT_SECTION' AS type FROM (SELECT DISTINCT id, "docId", "startLine" FROM sections)) WHERE dst IS NOT NULL
UNION ALL SELECT DISTINCT id, "docId", 'SECTION_OF' FROM sections""")
def section_chain(spark, d):
    rows = table(spark, d, "sections").select("id", F.col("docId").alias("doc_id"), F.col("startLine").alias("section")).distinct()
    return docs.section_edges(rows)


@query(f"""{_VERSIONS}, {_SECTIONS}, refs AS (SELECT DISTINCT id AS src, trim(u) AS ref FROM (SELECT id, unnest(regexp_extract_all(heading, '[A-Za-z_]+')) AS u FROM s))
SELECT DISTINCT src, v.id AS dst, ref AS matched_name, 1.0::DOUBLE AS strength FROM refs JOIN v ON (v.type IN ('FUNCTION', 'CLASS') AND v.name = ref) OR (v.type = 'FILE' AND (v.path = ref OR v.path LIKE '%/' || ref))""")
def doc_describes(spark, d):
    refs = _sections(spark, d).select("id", F.explode(F.regexp_extract_all("heading", F.lit("[A-Za-z_]+"), F.lit(0))).alias("ref"))
    return docs.describes(refs, _versions(spark, d))


@query()
def checklist_tasks(spark, d):
    return docs.checklist_tasks(table(spark, d, "documents").select(F.coalesce("relativePath", F.col("doc_id").cast("string")).alias("relative_path"), "text"))


# ---- parsing and ids


def _snippets(spark, d):
    """The fenced code of documents, as source files by their language."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(docs.fences(F.replace("text", F.lit("\r"), F.lit("")))).alias("k", "f"))
    names = F.create_map(*[F.lit(x) for pair in {"ts": "typescript", "js": "javascript", "python": "python", "py": "python", "go": "go", "rust": "rust", "java": "java"}.items() for x in pair])
    path = F.concat(F.lit("snippets/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("k").cast("string"), F.lit("."), "f.lang")
    return t.select(path.alias("relative_path"), F.col("f.code").alias("text"), F.element_at(names, F.lower("f.lang")).alias("language")).filter("language is not null")


@query()
def code_symbols(spark, d):
    """The symbols of all fenced code."""
    return code.symbols(_snippets(spark, d))


@query()
def code_graph_census(spark, d):
    """Nodes by label of the graph of all fenced code."""
    return traverse.census(build.code_graph(_snippets(spark, d), "demo", 0).nodes)


@query()
def code_import_sources(spark, d):
    return imports.import_sources(_snippets(spark, d))


@query()
def document_graph_census(spark, d):
    """Edges by type of the graph of all documents as markdown files."""
    files = table(spark, d, "documents").select(F.coalesce("relativePath", F.col("doc_id").cast("string")).alias("relative_path"), "text")
    return traverse.census(build.document_graph(files, _versions(spark, d), "demo", 0).edges)


@query("""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point FROM (SELECT DISTINCT id, sha256(id) AS h FROM code_embeddings)""")
def vector_point_ids(spark, d):
    return table(spark, d, "code_embeddings").select("id", X.point_id(F.col("id")).alias("point")).distinct()


@query()
def text_hashes(spark, d):
    """The 32-bit hashes of section ids, and the project ids of their documents' paths."""
    return table(spark, d, "sections").select("id", X.fnv1a(F.col("id")).alias("fnv1a"), X.poly31(F.col("id")).alias("poly31"), X.project_of(F.col("relativePath")).alias("project"))


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL""")
def activity_windows(spark, d):
    """The plan of the activity stream over all events at once."""
    found = changes.activity(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT CASE WHEN regexp_matches(p, '\\.(ts|tsx|js|jsx|mjs|cjs)$') THEN 'npx vitest run' WHEN p LIKE '%.py' THEN 'pytest' WHEN p LIKE '%.go' THEN 'go test' WHEN p LIKE '%.rs' THEN 'cargo test' WHEN p LIKE '%.java' THEN 'mvn test' WHEN p LIKE '%.rb' THEN 'bundle exec rspec' END AS runner, count(*) AS n
FROM (SELECT DISTINCT id, props['path'] AS p FROM nodes) GROUP BY runner""")
def runner_choice(spark, d):
    rows = table(spark, d, "nodes").select("id", F.element_at("props", "path").alias("p")).distinct()
    return rows.groupBy(impact.runner(F.col("p")).alias("runner")).agg(F.count("*").alias("n"))


# ---- layers, tests, progress

# Region layers: each may import itself and the regions listed; EUROPE must not import AFRICA.
MATRIX = {"AFRICA": [], "AMERICA": ["AFRICA", "EUROPE"], "ASIA": ["*"], "EUROPE": ["AFRICA", "ASIA"], "MIDDLE EAST": ["ASIA"]}
_IMPORTS = """WITH i AS (SELECT DISTINCT 'n:' || c_nationkey AS file, 'n:' || s_nationkey AS target, rc.r_name AS source_layer, rs.r_name AS target_layer FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation nc ON nc.n_nationkey = c_nationkey JOIN region rc ON rc.r_regionkey = nc.n_regionkey JOIN nation ns ON ns.n_nationkey = s_nationkey JOIN region rs ON rs.r_regionkey = ns.n_regionkey),
e AS (SELECT file, target, 'not-allowed' AS kind, 'error' AS severity, source_layer, target_layer FROM i WHERE source_layer <> target_layer AND NOT (source_layer = 'ASIA' OR (source_layer = 'AMERICA' AND target_layer IN ('AFRICA', 'EUROPE'))
  OR (source_layer = 'EUROPE' AND target_layer IN ('AFRICA', 'ASIA')) OR (source_layer = 'MIDDLE EAST' AND target_layer = 'ASIA'))
UNION ALL SELECT file, target, 'forbidden', 'error', source_layer, target_layer FROM i WHERE source_layer = 'EUROPE' AND target_layer = 'AFRICA')"""


def _region_violations(spark, d):
    t = lambda n: table(spark, d, n)
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    pairs = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pairs = pairs.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    pairs = pairs.select("c_nationkey", "s_nationkey").distinct()
    rows = pairs.join(where.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("source_layer")), "c_nationkey").join(where.select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("target_layer")), "s_nationkey")
    rows = rows.select(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("file"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("target"), "source_layer", "target_layer")
    rules = [layers.Layer(k, [], v, ["AFRICA"] if k == "EUROPE" else []) for k, v in MATRIX.items()]
    s, u = F.col("source_layer"), F.col("target_layer")
    return layers.check_layers(rows, layers.allowed(s, u, rules), layers.forbidden(s, u, rules))


@query(f"{_IMPORTS} SELECT * FROM e")
def layer_violations(spark, d):
    return _region_violations(spark, d)


@query(f"""{_IMPORTS} SELECT (SELECT count(*) FROM nation) AS files, count(*) AS violations, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'error') = 0 AS success FROM e""")
def layer_statistics(spark, d):
    return layers.statistics(_region_violations(spark, d), table(spark, d, "nation"))


@query(f"""{_VERSIONS} SELECT layer, count(*) AS n FROM (SELECT CASE WHEN path LIKE 'src/types/%' THEN 'types' WHEN path LIKE 'src/utils/%' OR path LIKE 'src/lib/%' OR path LIKE 'src/helpers/%' THEN 'utils' WHEN path LIKE 'src/parsers/%' THEN 'parsers' WHEN path LIKE 'src/graph/%' THEN 'graph'
  WHEN path LIKE 'src/vector/%' THEN 'vector' WHEN path LIKE 'src/engines/%' THEN 'engines' WHEN path LIKE 'src/tools/%' THEN 'tools' WHEN regexp_matches(path, '^src/[^/]*\\.ts$') THEN 'server' END AS layer FROM v WHERE type = 'FILE') GROUP BY layer""")
def layer_assignment(spark, d):
    return _versions(spark, d).filter("type = 'FILE'").groupBy(layers.layer_of(F.col("path")).alias("layer")).agg(F.count("*").alias("n"))


_TESTED = f"{GRAPH_SQL}, dep AS (SELECT DISTINCT s.path AS test, p.path AS file FROM gedges e JOIN gnodes s ON s.id = e.src JOIN gnodes p ON p.id = e.dst WHERE e.type = 'TESTS')"


def _suites(spark, d):
    g = graph_of(spark, d).label("TEST_SUITE").select("id", "path")
    return g.join(table(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_acctbal").alias("duration")), "id").select("path", "duration")


@query(f"{_TESTED} SELECT test, file, true AS direct FROM dep")
def test_dependencies(spark, d):
    return impact.dependencies(graph_of(spark, d))


@query(f"{_TESTED} SELECT test, 'unit' AS category, duration, 'direct' AS how FROM (SELECT DISTINCT test FROM dep WHERE file IN (SELECT path FROM gnodes WHERE id IN ('p:1', 'p:2'))) JOIN (SELECT 'tests/nation' || s_nationkey || '/' || s_name || '.test.ts' AS test, s_acctbal AS duration FROM supplier) USING (test)")
def affected_tests(spark, d):
    g = graph_of(spark, d)
    changed = g.nodes.filter("id in ('p:1', 'p:2')").select("path")
    return impact.select_tests(_suites(spark, d), impact.dependencies(g), changed)


@query(f"{GRAPH_SQL} SELECT 'unit' AS category, count(*) AS tests, round(avg(s_acctbal), 2) AS average_duration FROM supplier")
def test_statistics(spark, d):
    return impact.statistics(_suites(spark, d))


@query("""SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(p, '/integration/') OR contains(p, '_integration_test.') OR contains(p, '.integration.test.') OR contains(p, '_integration_spec.') OR contains(p, '/integration_') OR contains(p, 'test_integration_') THEN 'integration'
  WHEN contains(p, '.performance.test.') OR contains(p, '_performance_test.') OR contains(p, '_bench_test.') OR contains(p, '_benchmark') OR contains(p, '/benchmarks/') THEN 'performance' WHEN contains(p, '/e2e/') OR contains(p, '/end_to_end/') OR contains(p, '_e2e_') THEN 'e2e' ELSE 'unit' END AS category
  FROM (SELECT lower("relativePath") AS p FROM documents)) GROUP BY category""")
def test_categories(spark, d):
    return table(spark, d, "documents").groupBy(impact.category(F.col("relativePath")).alias("category")).agg(F.count("*").alias("n"))


@query(f"""{_TESTED}, hit AS (SELECT DISTINCT test FROM dep WHERE file IN (SELECT path FROM gnodes WHERE id IN ('p:1', 'p:2'))), t AS (SELECT 'tests/nation' || s_nationkey || '/' || s_name || '.test.ts' AS test, s_acctbal AS duration FROM supplier)
SELECT count(*) AS selected, (SELECT count(*) FROM t) AS total, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM t), 2) AS coverage, round(sum(duration), 2) AS estimated_time, 'unit' AS category,
  CASE WHEN round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM t), 2) > 50 THEN 'run full suite' ELSE 'run selected tests' END AS advice FROM t JOIN hit USING (test)""")
def impact_summary(spark, d):
    suites = _suites(spark, d)
    out = impact.blast_radius(impact.selection_summary(affected_tests(spark, d), suites))
    return out.withColumn("estimated_time", F.round("estimated_time", 2))


def _tasks(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in-progress").otherwise("blocked")
    return o.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("featureId"), status.alias("status"), F.sequence(F.lit(1), F.col("o_orderpriority").substr(1, 1).cast("int")).cast("array<string>").alias("blockedBy"))


def _features(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_acctbal") > 9000, "completed").otherwise("in-progress").alias("status"), F.col("c_name").alias("name"))


_TASKS = """WITH t AS (SELECT 'o:' || o_orderkey AS id, 'c:' || o_custkey AS f, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in-progress' ELSE 'blocked' END AS status, CAST(o_orderpriority[1] AS INT) AS k FROM orders),
f AS (SELECT 'c:' || c_custkey AS id, CASE WHEN c_acctbal > 9000 THEN 'completed' ELSE 'in-progress' END AS status, c_name AS name FROM customer)"""


@query(f"""{_TASKS}, p AS (SELECT f, count(*) AS tasks, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'blocked') AS blocked FROM t GROUP BY f)
SELECT f.id, f.status, coalesce(tasks, 0) AS tasks, coalesce(completed, 0) AS completed, coalesce(blocked, 0) AS blocked, CASE WHEN tasks > 0 THEN round(100.0::DOUBLE * completed / tasks, 2) ELSE 0 END AS progress FROM f LEFT JOIN p ON p.f = f.id""")
def feature_rollup(spark, d):
    return progress.feature_rollup(_features(spark, d), _tasks(spark, d))


@query(f"""{_TASKS} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'in-progress') AS in_progress, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'pending') AS pending FROM t""")
def progress_counts(spark, d):
    return progress.status_counts(_tasks(spark, d))


@query(f"{_TASKS} SELECT t.id, f FROM t WHERE status = 'blocked' AND k > 2 AND f IN (SELECT id FROM f WHERE status <> 'completed')")
def blocking_issues(spark, d):
    critical = progress.blocking(_tasks(spark, d), _features(spark, d), "critical", None)
    return progress.blocking(critical, _features(spark, d), "features", None).select("id", F.col("featureId").alias("f"))


@query(f"{_TASKS} SELECT id, name FROM f WHERE id = 'c:42'")
def feature_resolve(spark, d):
    return progress.resolve_feature(_features(spark, d), "42").select("id", "name")


@query()
def budget_greedy_fill(spark, d):
    per_project = table(spark, d, "features").select("projectId", "id", X.estimated_tokens(F.concat_ws(" ", "name", "description")).alias("cost"))
    return budget.fill(per_project, "projectId", "id", "cost", 300)


# ---- Cypher texts; their SQL is that of the patterns


def _cypher(spark, d, text: str, **rest) -> DataFrame:
    return cypher(graph_of(spark, d), text, **rest)


@query(f"{GRAPH_SQL} SELECT f.path AS \"f.path\", f.name AS name FROM gnodes f WHERE type = 'FILE' AND contains(lower(name), '0001') ORDER BY f.path LIMIT 25")
def cypher_localisation(spark, d):
    return _cypher(spark, d, "MATCH (f:FILE) WHERE toLower(f.name) CONTAINS '0001' RETURN f.path, f.name AS name ORDER BY f.path LIMIT 25")


@query(f"{GRAPH_SQL} SELECT a.dst AS callee, count(DISTINCT a.src) AS callers FROM gedges a WHERE type = 'CALLS_TO' GROUP BY a.dst HAVING count(DISTINCT a.src) > 3")
def cypher_behaviour(spark, d):
    return _cypher(spark, d, "MATCH (a:FUNCTION)-[:CALLS_TO]->(b:FUNCTION) WITH b, count(DISTINCT a) AS callers WHERE callers > 3 RETURN b.id AS callee, callers")


@query(f"{GRAPH_SQL} SELECT DISTINCT i.src AS importer FROM gedges r JOIN gedges i ON i.dst = r.src AND i.type = 'IMPORTS' WHERE r.type = 'REFERENCES' AND r.dst = 'p:1'")
def cypher_impact(spark, d):
    return _cypher(spark, d, "MATCH (f:FUNCTION {id: $id})<-[:REFERENCES]-(i:IMPORT)<-[:IMPORTS]-(g:FILE) RETURN DISTINCT g.id AS importer", params={"id": "p:1"})


@query(f"{GRAPH_SQL} SELECT n.id FROM gnodes n WHERE type IN ('FUNCTION', 'FILE') AND NOT EXISTS (SELECT 1 FROM gedges WHERE type = 'TESTS' AND dst = n.id)")
def cypher_coverage(spark, d):
    return _cypher(spark, d, "MATCH (fn) WHERE (fn:FUNCTION OR fn:FILE) AND NOT (fn)<-[:TESTS]-() RETURN fn.id AS id")


@query(f"""{GRAPH_SQL} SELECT n.name AS nation, count(DISTINCT c.dst) AS files, count(DISTINCT o.dst) AS imports FROM gnodes n LEFT JOIN gedges c ON c.src = n.id AND c.type = 'CONTAINS' AND c.dst LIKE 'c:%'
LEFT JOIN gedges o ON o.src = c.dst AND o.type = 'IMPORTS' WHERE n.type = 'FOLDER' AND n.id LIKE 'n:%' GROUP BY n.id, n.name""")
def cypher_traceability(spark, d):
    text = "MATCH (n:FOLDER) WHERE n.id STARTS WITH 'n:' OPTIONAL MATCH (n)-[:CONTAINS]->(c:FILE) OPTIONAL MATCH (c)-[:IMPORTS]->(o:IMPORT) RETURN n.name AS nation, count(DISTINCT c) AS files, count(DISTINCT o) AS imports"
    return _cypher(spark, d, text)


@query(f"{GRAPH_SQL} SELECT DISTINCT a.src AS a, a.dst AS b FROM gedges a JOIN gedges b ON a.src = b.dst AND a.dst = b.src AND a.type = 'CALLS_TO' AND b.type = 'CALLS_TO' WHERE a.src < a.dst")
def cypher_cycle(spark, d):
    return _cypher(spark, d, "MATCH (a:FUNCTION)-[:CALLS_TO]->(b:FUNCTION)-[:CALLS_TO]->(a) WHERE a.id < b.id RETURN DISTINCT a.id AS a, b.id AS b")


@query(f"{_HOPS} SELECT id, hops FROM near WHERE hops > 0")
def cypher_variable_length(spark, d):
    return _cypher(spark, d, f"UNWIND ['{SEED}'] AS seed MATCH (s {{id: seed}}) MATCH p = (s)-[*1..3]-(n) WHERE n.id <> seed AND (n:FILE OR n:FUNCTION OR n:CLASS) RETURN n.id AS id, min(length(p)) AS hops")


@query(f"{GRAPH_SQL} SELECT src AS id FROM gedges WHERE type = 'CALLS_TO' AND dst = '{SEED}' UNION SELECT src FROM gedges WHERE type = 'TESTS' AND dst = '{SEED}'")
def cypher_union(spark, d):
    return _cypher(spark, d, f"MATCH (a)-[:CALLS_TO]->(b {{id: '{SEED}'}}) RETURN a.id AS id UNION MATCH (a)-[:TESTS]->(b {{id: '{SEED}'}}) RETURN a.id AS id")


@query(f"{GRAPH_SQL} SELECT count(*) AS n, count(*) FILTER (i.valid_to IS NULL) AS current FROM gedges e JOIN gnodes i ON i.id = e.dst WHERE e.type = 'IMPORTS' AND i.valid_from <= {ORDER_AT} AND (i.valid_to IS NULL OR i.valid_to > {ORDER_AT})")
def cypher_as_of(spark, d):
    return _cypher(spark, d, "MATCH (f:FILE)-[:IMPORTS]->(i:IMPORT) WHERE i.validTo IS NULL OR i.validTo > 0 RETURN count(*) AS n, count(CASE WHEN i.validTo IS NULL THEN 1 END) AS current", as_of=ORDER_AT, project="demo")


@query(f"{GRAPH_SQL} SELECT type, count(*) AS count FROM gnodes GROUP BY type")
def cypher_from_words(spark, d):
    query_text, params = from_words("how many nodes are there?")
    return _cypher(spark, d, query_text, params=params)


@query(f"""{GRAPH_SQL} SELECT DISTINCT a.name AS name FROM gedges e JOIN gnodes a ON a.id = e.src JOIN gnodes b ON b.id = e.dst
WHERE e.type = 'CALLS_TO' AND b.name = (SELECT name FROM gnodes WHERE id = 'p:7')""")
def cypher_callers_from_words(spark, d):
    name = graph_of(spark, d).node("p:7").first()["name"]
    query_text, params = from_words(f"who calls '{name}'?")
    return _cypher(spark, d, query_text, params=params)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return rrf_hybrid(spark, folder)

