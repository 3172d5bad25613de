"""The 39 calls of the public API: validated arguments in, an envelope of bounded rows out.

A call is a thin shell: it builds a lazy plan from the operators, collects at most its limit of rows
and shapes them. Engine holds the tables of one project; every call that writes replaces them by new
plans, so nothing runs before a row is asked for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import model
from graphloom.functions.text import lines_between, query_tokens
from graphloom.functions.vectors import code_vector
from graphloom.graph import PropertyGraph
from graphloom.operators import budget, claims, community, impact, layers, memory, progress, rank, retrieve, temporal, traverse
from graphloom.plans.cypher import cypher
from graphloom.session import cut_lineage

EPISODE = "id string, agentId string, sessionId string, taskId string, type string, content string, timestamp long, outcome string, metadata string, sensitive boolean, entities array<string>, projectId string"
CLAIM = "id string, agentId string, sessionId string, taskId string, claimType string, targetId string, intent string, validFrom long, targetVersionSHA string, validTo long, invalidationReason string, outcome string, projectId string"
TASK = "id string, name string, status string, featureId string, assignee string, dueDate long, blockedBy array<string>, updatedAt long, startedAt long, completedAt long"
FEATURE = "id string, name string, status string"
VECTOR = "id string, type string, project_id string, vector array<double>"
TX = "id string, timestamp long, gitCommit string, agentId string"

# The calls with their required and optional arguments and defaults.
CONTRACTS: dict[str, tuple[list[str], dict[str, Any]]] = {
    "graph_query": (["query"], {"language": "natural", "mode": "local", "limit": 100, "asOf": None}),
    "graph_rebuild": ([], {"mode": "incremental", "verbose": False, "workspaceRoot": None, "sourceDir": None, "indexDocs": True}),
    "graph_set_workspace": (["workspaceRoot"], {"sourceDir": None, "projectId": None}),
    "graph_health": ([], {}),
    "diff_since": (["since"], {"types": ["FILE", "FUNCTION", "CLASS"]}),
    "code_explain": (["element"], {"depth": 2}),
    "find_pattern": (["pattern"], {"type": "pattern"}),
    "tools_list": ([], {}),
    "contract_validate": (["tool"], {"arguments": {}}),
    "semantic_search": (["query"], {"type": "function", "limit": 5}),
    "find_similar_code": (["elementId"], {"threshold": 0.7, "limit": 10}),
    "code_clusters": (["type"], {"count": 5}),
    "semantic_diff": (["elementId1", "elementId2"], {}),
    "suggest_tests": (["elementId"], {"limit": 5}),
    "context_pack": (["task"], {"taskId": None, "agentId": None, "includeDecisions": True, "includeEpisodes": True, "includeLearnings": True}),
    "semantic_slice": ([], {"file": None, "symbol": None, "query": None, "context": "body", "pprScore": None}),
    "init_project_setup": (["workspaceRoot"], {"sourceDir": None, "projectId": None, "rebuildMode": "incremental", "withDocs": True}),
    "setup_copilot_instructions": ([], {"targetPath": None, "projectName": None, "dryRun": False, "overwrite": False}),
    "arch_validate": ([], {"files": None, "strict": False}),
    "arch_suggest": (["name", "type"], {"dependencies": []}),
    "index_docs": ([], {"workspaceRoot": None, "projectId": None, "incremental": True, "withEmbeddings": False}),
    "search_docs": ([], {"query": None, "symbol": None, "limit": 10}),
    "ref_query": (["repoPath"], {"query": "", "mode": "auto", "symbol": None, "limit": 10}),
    "test_select": (["changedFiles"], {"mode": "transitive"}),
    "test_categorize": ([], {"testFiles": []}),
    "impact_analyze": ([], {"files": None, "changedFiles": None, "depth": 3}),
    "test_run": (["testFiles"], {"parallel": True}),
    "progress_query": (["query"], {"status": None}),
    "task_update": (["taskId", "status"], {"notes": None, "assignee": None, "dueDate": None, "agentId": None}),
    "feature_status": (["featureId"], {}),
    "blocking_issues": ([], {"type": "all", "context": None}),
    "episode_add": (["type", "content"], {"entities": [], "taskId": None, "outcome": None, "metadata": None, "sensitive": False, "agentId": None, "sessionId": None}),
    "episode_recall": (["query"], {"agentId": None, "taskId": None, "types": None, "entities": [], "limit": 5, "since": None}),
    "decision_query": (["query"], {"affectedFiles": [], "taskId": None, "agentId": None, "limit": 5}),
    "reflect": ([], {"taskId": None, "agentId": None, "limit": 20}),
    "agent_claim": (["targetId", "intent"], {"claimType": "task", "taskId": None, "agentId": None, "sessionId": None}),
    "agent_release": (["claimId"], {"outcome": None}),
    "agent_status": ([], {"agentId": None}),
    "coordination_overview": ([], {}),
}
#: Other names of arguments.
ALIASES = {"files": "changedFiles", "element_id": "elementId", "target": "targetId", "task_id": "taskId", "agent_id": "agentId", "workspacePath": "workspaceRoot"}
OUT_OF_SCOPE = {"test_run", "setup_copilot_instructions"}


class BadArguments(ValueError):
    """Arguments that break a contract."""


def validate(tool: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """(valid, missing, extra) of arguments against a contract."""
    if tool not in CONTRACTS:
        return {"valid": False, "error": f"unknown tool {tool}"}
    required, optional = CONTRACTS[tool]
    missing = [a for a in required if arguments.get(a) is None]
    extra = [a for a in arguments if a not in required and a not in optional and a != "profile"]
    return {"valid": not missing, "missing": missing, "extra": extra}


def guard_text(value: Any, name: str, most: int = 10_000) -> str:
    """A non-empty text of bounded length."""
    if not isinstance(value, str) or not value.strip():
        raise BadArguments(f"{name} must be a non-empty text")
    if len(value) > most:
        raise BadArguments(f"{name} is longer than {most} characters")
    return value


def guard_project(value: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", value) or ".." in value:
        raise BadArguments("a project id has up to 128 letters, digits, dots, dashes and underscores")
    return value


def guard_limit(value: Any, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise BadArguments("a limit is a number")
    return max(low, min(high, int(value)))


#: A table that grows row by row is cut from its lineage after so many calls.
CUT_EVERY = 20


@dataclass
class Engine:
    """The tables of a project and the time of its calls (epoch milliseconds)."""

    spark: SparkSession
    graph: PropertyGraph
    project: str = "demo"
    now: int = 0
    tables: dict[str, DataFrame] = field(default_factory=dict)
    added: dict[str, int] = field(default_factory=dict)
    profile: str = "compact"
    layers: list[layers.Layer] = field(default_factory=lambda: list(layers.DEFAULT_LAYERS))

    def table(self, name: str) -> DataFrame:
        schemas = {"episodes": EPISODE, "claims": CLAIM, "tasks": TASK, "features": FEATURE, "vectors": VECTOR, "transactions": TX, "learnings": "id string, content string, confidence double", "applies": "src string, dst string", "files": "relative_path string, text string", "digests": "relative_path string, hash string"}
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], schemas[name])

    def add(self, name: str, row: dict[str, Any]) -> None:
        old = self.table(name)
        new = self.spark.createDataFrame([tuple(row.get(c) for c in old.columns)], old.schema)
        self.added[name] = self.added.get(name, 0) + 1
        table = old.unionByName(new)
        self.tables[name] = cut_lineage(table) if self.added[name] % CUT_EVERY == 0 else table

    def call(self, tool: str, arguments: dict[str, Any] | None = None, profile: str = "compact") -> dict[str, Any]:
        """The envelope of one call; errors are envelopes too."""
        given = dict(arguments or {})
        profile = given.pop("profile", profile)
        if tool in CONTRACTS:
            names = set(CONTRACTS[tool][0]) | set(CONTRACTS[tool][1])
            given = {ALIASES[k] if k not in names and ALIASES.get(k) in names else k: v for k, v in given.items()}
        checked = validate(tool, given)
        if not checked["valid"]:
            return budget.error("INVALID_ARGUMENTS", checked.get("error") or f"missing: {', '.join(checked['missing'])}", profile=profile)
        if tool in OUT_OF_SCOPE:
            return budget.error("OUT_OF_SCOPE", f"{tool} runs programs or writes files outside of the data, which this engine doesn't do", False, profile)
        args = CONTRACTS[tool][1] | given
        self.profile = profile
        try:
            summary, data = HANDLERS[tool](self, args)
        except (BadArguments, KeyError, ValueError) as e:
            return budget.error("FAILED", str(e).strip("'\"") or type(e).__name__, profile=profile)
        return budget.envelope(summary, data, profile)


def rows(df: DataFrame, most: int = 100) -> list[dict[str, Any]]:
    """At most `most` rows as dictionaries."""
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


HANDLERS: dict[str, Callable[[Engine, dict[str, Any]], tuple[str, Any]]] = {}


def tool(f: Callable[[Engine, dict[str, Any]], tuple[str, Any]]) -> Callable:
    HANDLERS[f.__name__] = f
    return f


def _one(df: DataFrame, what: str) -> dict[str, Any]:
    found = rows(df, 1)
    if not found:
        raise KeyError(f"{what} not found")
    return found[0]


@tool
def graph_query(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    text, limit = guard_text(a["query"], "query", 50_000 if a["language"] == "cypher" else 10_000), guard_limit(a["limit"], 1, 1000)
    at = temporal_ms(e, a["asOf"])
    if a["language"] == "cypher":
        found = rows(cypher(e.graph, text, as_of=at, project=e.project, now=e.now), limit)
    else:
        found = []
        if a["mode"] in ("global", "hybrid"):
            found += [{"section": "communities"} | r for r in rows(retrieve.communities_for(_communities(e), text, limit), limit)]
        if a["mode"] in ("local", "hybrid"):
            hits = retrieve.hybrid(e.graph, e.table("vectors"), text, code_vector(text), "hybrid", min(limit, 100))
            hits = hits if at is None else temporal.as_of_rows(hits, e.graph.nodes, at)
            found += rows(hits, limit)
    return f"{len(found)} rows", {"intent": _intent(text), "count": len(found), "results": found}


def temporal_ms(e: Engine, text: str | None) -> int | None:
    if text is None:
        return None
    found = temporal.anchor(e.spark, e.table("transactions"), str(text)).first()
    if found is None:
        raise BadArguments(f"unknown time {text}")
    return found["since"]


def _intent(text: str) -> str:
    from graphloom.functions.text import INTENTS

    return next((n for n, p in INTENTS if re.search(p, text.lower())), "general")


def _communities(e: Engine) -> DataFrame:
    return community.summaries(community.directory_communities(e.graph.label(*model.CODE)))


def _changed_only(e: Engine, files: DataFrame) -> tuple[DataFrame, PropertyGraph, DataFrame]:
    """The files to read again (new, changed, or importing a changed or vanished one), the graph of the others, and the open nodes there were of them."""
    found = temporal.changes(files.select("relative_path", "hash"), e.table("digests"), "relative_path").persist()
    paths = e.graph.nodes.select("id", F.col("path").alias("relative_path"))
    ids = paths.join(found, "relative_path", "left_semi").select("id")
    using = e.graph.edges_of("DEPENDS_ON").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    touched = found.select("relative_path").unionByName(paths.join(using, "id", "left_semi").select("relative_path")).distinct().persist()
    old = e.graph.nodes.join(touched, F.col("path") == F.col("relative_path"), "left_semi").filter("valid_to is null")
    rest = e.graph.nodes.join(old.select("id"), "id", "left_anti")
    edges = e.graph.edges.join(old.select(F.col("id").alias("src")), "src", "left_anti")
    return files.join(touched, "relative_path", "left_semi"), PropertyGraph(rest, edges), old


@tool
def graph_rebuild(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    """Incremental rebuilds parse changed files and their importers only; nodes that vanished are closed, not removed."""
    from graphloom.sources import build, discovery
    from graphloom.sources.store import sync

    root = guard_text(a["workspaceRoot"], "workspaceRoot", 4096)
    files = cut_lineage(discovery.read_files(e.spark, root + (f"/{a['sourceDir']}" if a["sourceDir"] else "")).withColumn("hash", F.sha2("text", 256)))
    read, base, old = (files, None, None) if a["mode"] == "full" else _changed_only(e, files)
    known = None if base is None else base.nodes
    code = build.code_graph(discovery.source_files(read), e.project, e.now, known)
    if a["indexDocs"]:
        named = code.nodes if known is None else code.nodes.unionByName(known)
        documents = build.document_graph(discovery.markdown_files(read), named, e.project, e.now)
        code = PropertyGraph(code.nodes.unionByName(documents.nodes), code.edges.unionByName(documents.edges))
    if base is not None:
        closed = old.join(code.nodes.select("id"), "id", "left_anti").withColumn("valid_to", F.lit(e.now).cast("long"))
        code = sync(PropertyGraph(base.nodes.unionByName(closed), base.edges), code)
    e.graph = PropertyGraph(cut_lineage(code.nodes), cut_lineage(code.edges))
    e.tables["files"], e.tables["digests"] = files.select("relative_path", "text"), files.select("relative_path", "hash")
    e.add("transactions", {"id": f"tx-{e.project}-{e.now}", "timestamp": e.now})
    e.tables["claims"] = claims.invalidate_stale(e.table("claims"), e.graph.nodes.filter("valid_to is null"), e.now)
    return "COMPLETED", {"status": "COMPLETED", "mode": a["mode"], "transaction": f"tx-{e.project}-{e.now}", "filesProcessed": read.count()}


@tool
def index_docs(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    from graphloom.sources import build, discovery
    from graphloom.sources.store import sync

    files = discovery.markdown_files(discovery.read_files(e.spark, guard_text(a["workspaceRoot"], "workspaceRoot", 4096)))
    if a["incremental"]:
        known = e.graph.label("DOCUMENT").select(F.col("path").alias("relative_path"), F.element_at("props", "hash").alias("_gl_h"))
        now = files.withColumn("_gl_h", F.sha2("text", 256))
        files = now.join(known, ["relative_path", "_gl_h"], "left_anti").drop("_gl_h")
    found = build.document_graph(files, e.graph.nodes, e.project, e.now)
    n = traverse.census(found.nodes).collect()
    e.graph = sync(e.graph, found)
    return "indexed", {r["type"].lower() + "s": r["n"] for r in n}


@tool
def graph_set_workspace(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    from graphloom.functions.text import project_of

    root = guard_text(a["workspaceRoot"], "workspaceRoot", 4096)
    e.project = guard_project(a["projectId"]) if a["projectId"] else e.spark.range(1).select(project_of(F.lit(root))).first()[0]
    return f"workspace {e.project}", {"projectId": e.project, "workspaceRoot": root, "sourceDir": a["sourceDir"]}


@tool
def init_project_setup(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    steps = [graph_set_workspace(e, a)[0], graph_rebuild(e, a | {"mode": a["rebuildMode"], "indexDocs": a["withDocs"]})[0]]
    return "ready", {"projectId": e.project, "steps": steps}


@tool
def graph_health(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    data = _one(traverse.health(e.graph, e.table("vectors")), "graph")
    return data["status"], data


@tool
def diff_since(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    if not a["types"]:
        raise BadArguments("types must name a label")
    since = temporal_ms(e, guard_text(a["since"], "since"))
    found = temporal.diff_since(e.graph.nodes, since, a["types"])
    data: dict[str, Any] = {"since": since, "counts": {r["change"]: r["n"] for r in temporal.diff_counts(found).collect()}}
    for change in ("added", "removed", "modified"):
        data[change] = rows(found.filter(F.col("change") == change).orderBy(F.desc("at"), "id").drop("change"), 500)
    data["transactions"] = [r["id"] for r in rows(temporal.transactions_since(e.table("transactions"), since), 500)]
    return f"{sum(data['counts'].values())} changes", data


@tool
def code_explain(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = rows(traverse.explain(e.graph, guard_text(a["element"], "element", 512), guard_limit(a["depth"], 1, 3)), 60)
    if not found:
        raise KeyError(f"{a['element']} not found")
    return f"{len(found)} relationships", {"element": a["element"], "relationships": found}


@tool
def find_pattern(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    kind = a["type"]
    if kind == "circular":
        found = rows(traverse.cycles(traverse.file_dependencies(e.graph), 4), 20) or [{"status": "none-found"}]
    elif kind == "unused":
        found = rows(traverse.unused(e.graph).select("id", "path").orderBy("id"), 20)
    elif kind == "violation":
        found = rows(_violations(e), 10)
    else:
        found = rows(retrieve.pattern_search(e.graph.nodes, guard_text(a["pattern"], "pattern", 512)).select("id", "type", "name", "path"), 20)
    return f"{len(found)} matches", {"type": kind, "matches": found}


def _violations(e: Engine, files: list[str] | None = None) -> DataFrame:
    path = e.graph.label("FILE").select("id", "path")
    pairs = traverse.file_dependencies(e.graph).join(path.select(F.col("id").alias("src"), F.col("path").alias("file")), "src").join(path.select(F.col("id").alias("dst"), F.col("path").alias("target")), "dst")
    pairs = pairs.filter(F.col("file").isin(*files)) if files else pairs
    return layers.violations(pairs.select("file", "target"), e.layers)


@tool
def tools_list(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    return f"{len(CONTRACTS)} tools", {"tools": sorted(CONTRACTS)}


@tool
def contract_validate(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = validate(a["tool"], a["arguments"] or {})
    return "valid" if found["valid"] else "invalid", found


@tool
def semantic_search(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = rows(retrieve.knn(e.table("vectors"), code_vector(guard_text(a["query"], "query")), guard_limit(a["limit"], 1, 100), types=[a["type"]], project=e.project), 100)
    if not found:
        raise KeyError("no symbols are embedded")
    return f"{len(found)} results", {"results": found}


@tool
def find_similar_code(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = rows(retrieve.similar_to(e.table("vectors"), a["elementId"], a["threshold"], guard_limit(a["limit"], 1, 100)), 100)
    return f"{len(found)} similar", {"elementId": a["elementId"], "results": found}


@tool
def code_clusters(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = rows(retrieve.clusters(e.graph.label(a["type"].upper()), guard_limit(a["count"], 1, 100)), 100)
    return f"{len(found)} clusters", {"clusters": found}


@tool
def semantic_diff(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    ends = [_one(retrieve.resolve_element(e.graph.nodes, guard_text(a[k], k, 512), e.project).select("id"), a[k])["id"] for k in ("elementId1", "elementId2")]
    return "compared", _one(retrieve.property_diff(e.graph.nodes, *ends), "elements")


def _suites(e: Engine) -> DataFrame:
    p = lambda k: F.element_at("props", k)
    return e.graph.label("TEST_SUITE").select("path", F.coalesce(p("avgDuration").try_cast("double"), F.lit(0.0)).alias("duration"))


def _paths(e: Engine, paths: list[str]) -> DataFrame:
    return e.spark.createDataFrame([(p,) for p in paths], "path string")


@tool
def suggest_tests(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    element = guard_text(a["elementId"], "elementId", 512)
    path = element if "/" in element and ":" not in element else _one(retrieve.resolve_element(e.graph.nodes, element, e.project).select("path"), element)["path"]
    found = impact.select_tests(_suites(e), impact.dependencies(e.graph), _paths(e, [path]), mode="transitive")
    return "tests", {"tests": rows(found.orderBy("how", "test"), guard_limit(a["limit"], 1, 100))}


@tool
def test_select(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = impact.select_tests(_suites(e), impact.dependencies(e.graph), _paths(e, list(a["changedFiles"])), mode=a["mode"])
    return "selected", {"tests": rows(found.orderBy("test"), 500), "summary": _one(impact.selection_summary(found, _suites(e)), "tests")}


@tool
def test_categorize(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    return "categories", {"categories": rows(impact.statistics(_suites(e)), 10)}


@tool
def impact_analyze(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    files = list(a["files"] or a["changedFiles"] or [])
    if not files:
        return "no files", {"files": [], "importers": [], "tests": [], "warning": "no files given"}
    changed = _paths(e, files)
    found = impact.select_tests(_suites(e), impact.dependencies(e.graph), changed, mode="transitive" if a["depth"] > 1 else "direct")
    summary = _one(impact.blast_radius(impact.selection_summary(found, _suites(e))), "tests")
    return summary["advice"], {"files": files, "importers": [r["path"] for r in rows(traverse.importers(e.graph, changed), 50)], "tests": rows(found.orderBy("test"), 50), "summary": summary}


@tool
def arch_validate(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = _violations(e, a["files"])
    one = _one(layers.statistics(found, e.graph.label("FILE")), "files")
    return "ok" if one["success"] else "violations", {"strict": a["strict"], "statistics": one, "violations": rows(found.orderBy("severity", "file", "target"), 20)}


@tool
def arch_suggest(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = layers.suggest(guard_text(a["name"], "name", 512), a["type"], a["dependencies"], e.layers)
    return ("suggested", {"success": True, "layer": found[0], "path": found[1]}) if found else ("no layer fits", {"success": False})


@tool
def search_docs(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    limit = guard_limit(a["limit"], 1, 50)
    if a["symbol"]:
        return "by symbol", {"results": rows(retrieve.sections_about(e.graph, a["symbol"], limit), limit)}
    parts = e.graph.label("SECTION").select("id", F.col("name").alias("heading"), F.col("summary").alias("content"))
    found = rows(retrieve.search_sections(parts, guard_text(a["query"], "query"), limit), limit)
    return f"{len(found)} sections", {"results": [r | {"excerpt": (r["excerpt"] or "")[:200]} for r in found]}


@tool
def ref_query(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    from graphloom.functions.text import REF_MODES
    from graphloom.operators import docs
    from graphloom.sources import discovery

    files, limit = discovery.read_files(e.spark, guard_text(a["repoPath"], "repoPath", 4096)), guard_limit(a["limit"], 1, 20)
    mode = a["mode"] if a["mode"] != "auto" else "code" if a["symbol"] else next((n for n, p in REF_MODES if re.search(p, a["query"].lower())), "all")
    out: list[dict[str, Any]] = []
    if mode in ("docs", "architecture", "patterns", "all"):
        parts = docs.sections(discovery.reference_documents(files)).select(F.concat_ws("#", "relative_path", "section").alias("id"), "heading", "content")
        out += rows(retrieve.ref_doc_scores(parts, a["query"], a["symbol"]).orderBy(F.desc("score"), "id"), limit)
    if mode in ("code", "patterns", "all"):
        code = discovery.reference_files(files).select(F.col("relative_path").alias("path"), F.col("text").alias("content"))
        scored = retrieve.ref_code_scores(code, a["query"], a["symbol"]).join(code, "path")
        best = scored.select("path", "score", retrieve.excerpt(F.col("content"), query_tokens(a["query"]), a["symbol"]).alias("excerpt"))
        out += rows(best.orderBy(F.desc("score"), "path"), limit)
    out = sorted(out, key=lambda r: -r["score"])[:limit]
    if mode in ("structure", "architecture"):
        out.append({"structure": rows(discovery.folder_tree(files).orderBy("folder", "entry"), 200)})
    return f"{len(out)} findings", {"mode": mode, "findings": out}


def _live(e: Engine) -> DataFrame:
    """Code nodes as they are now, without closed versions."""
    return e.graph.label(*model.CODE).filter(F.col("valid_to").isNull() | (F.col("valid_to") > e.now))


def _bodies(e: Engine, nodes: DataFrame, most: int | None = 800) -> dict[str, str]:
    """The source lines of a few nodes by id, cut to `most` characters; nodes of unknown files are left out."""
    line = lambda k: F.element_at("props", k).try_cast("int")
    at = nodes.select("id", F.col("path").alias("relative_path"), line("startLine").alias("a"), line("endLine").alias("z")).filter("a is not null")
    found = e.table("files").join(F.broadcast(at), "relative_path").select("id", lines_between(F.col("text"), F.col("a"), F.coalesce("z", "a")).alias("body"))
    return {r["id"]: r["body"] if most is None else r["body"][:most] for r in found.collect()}


def _around(e: Engine, ids: DataFrame, reverse: bool) -> dict[str, list[str]]:
    """What a few nodes call, or what calls them: at most 10 each, by id."""
    near = e.graph.hop(ids.select(F.col("id").alias("a")), "a", ["CALLS", "CALLS_TO"], "b", reverse).distinct()
    top = near.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter("n <= 10")
    out: dict[str, list[str]] = {}
    for r in top.orderBy("a", "b").collect():
        out.setdefault(r["a"], []).append(r["b"])
    return out


@tool
def context_pack(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    task = guard_text(a["task"], "task")
    code = _live(e)
    seeds = retrieve.find_seeds(code, task).persist()
    # interfaces among the seeds bring what implements them
    wider = seeds.unionByName(e.graph.hop(seeds.withColumnRenamed("id", "i"), "i", ["IMPLEMENTS"], "id", reverse=True).select("id")).distinct()
    top = rank.personalised_pagerank(e.graph, wider, limit=60).join(code.select("id", "type", "name", "path", "summary"), "id").orderBy(F.desc("score"), "id").limit(8).persist()
    ids = top.select("id").unionByName(seeds).distinct()
    bodies = _bodies(e, top.select("id").join(e.graph.nodes, "id"))
    calls, callers = _around(e, top, False), _around(e, top, True)
    core = [r | {"code": bodies.get(r["id"]), "calls": calls.get(r["id"], []), "callers": callers.get(r["id"], [])} for r in rows(top.orderBy(F.desc("score"), "id"), 8)]
    data: dict[str, Any] = {"task": task, "coreSymbols": core}
    near = e.graph.hop(top.select(F.col("id").alias("a")), "a", ["CALLS", "CALLS_TO", "IMPORTS", "DEPENDS_ON"], "b")
    data["dependencies"] = rows(near.distinct().orderBy("a", "b"), 40)
    data["activeBlockers"] = rows(claims.blockers(claims.latest(e.table("claims")), ids, a["agentId"] or "").select("id", "agentId", "targetId", "intent"), 20)
    if a["includeDecisions"]:
        data["decisions"] = rows(memory.decisions_about(e.table("episodes"), ids).select("id", "content", "timestamp"), 10)
    if a["includeLearnings"]:
        data["learnings"] = rows(memory.learnings_about(e.table("learnings"), e.table("applies"), ids), 10)
    if a["includeEpisodes"]:
        data["episodes"] = rows(memory.recent(e.table("episodes"), a["taskId"], a["agentId"]).select("id", "type", "content", "timestamp"), 10)
    # every slot has its share of the profile's budget; the first symbol stays in any case
    slots = {"coreSymbols": "coreCode", "dependencies": "dependencies", "decisions": "decisions", "learnings": "plan", "episodes": "episodeHistory"}
    fitting = budget.allot({slot: data.get(k, []) for k, slot in slots.items()}, budget.BUDGETS[e.profile])
    data |= {k: fitting[slot] or (data[k][:1] if k == "coreSymbols" else []) for k, slot in slots.items() if k in data}
    return f"{len(data['coreSymbols'])} symbols", data


@tool
def semantic_slice(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    asked = a["symbol"] or a["file"] or a["query"]
    if not asked:
        raise BadArguments("one of file, symbol and query is needed")
    found = rows(retrieve.resolve_element(_live(e), asked, e.project), 1)
    if not found and a["query"]:
        found = rows(retrieve.find_seeds(_live(e), a["query"], 1).join(e.graph.nodes, "id"), 1)
    if not found:
        raise KeyError(f"{asked} not found")
    node = found[0]
    data: dict[str, Any] = {"id": node["id"], "name": node["name"], "path": node["path"], "summary": node["summary"], "lines": {k: (node.get("props") or {}).get(k) for k in ("startLine", "endLine")}}
    body = _bodies(e, e.graph.node(node["id"]), None).get(node["id"])
    if body is not None:
        data["code"] = body.split("\n", 1)[0] if a["context"] == "signature" else body
    if a["context"] in ("with-deps", "full"):
        data["outgoing"] = rows(e.graph.outgoing(node["id"]).select("dst", "type").orderBy("type", "dst"), 10)
        data["incoming"] = rows(e.graph.incoming(node["id"]).select("src", "type").orderBy("type", "src"), 10)
    if a["context"] == "full":
        one = e.spark.createDataFrame([(node["id"],)], "id string")
        data["decisions"] = rows(memory.decisions_about(e.table("episodes"), one).select("id", "content"), 10)
    return f"slice of {node['id']}", data


@tool
def progress_query(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    name = "features" if "feature" in a["query"].lower() else "tasks"
    found = progress.items(e.table(name), a["status"])
    return name, {"type": name, "items": rows(found.orderBy("id"), 100), "counts": _one(progress.status_counts(found), name)}


@tool
def task_update(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    _one(e.table("tasks").filter(F.col("id") == a["taskId"]), f"task {a['taskId']}")
    e.tables["tasks"] = progress.update_task(e.table("tasks"), a["taskId"], a["status"], e.now)
    for column in ("assignee", "dueDate"):
        if a[column] is not None:
            e.tables["tasks"] = e.tables["tasks"].withColumn(column, F.when(F.col("id") == a["taskId"], F.lit(a[column])).otherwise(F.col(column)))
    data: dict[str, Any] = {"taskId": a["taskId"], "status": a["status"]}
    if a["status"] == "completed":
        e.tables["claims"] = claims.complete_task(e.table("claims"), a["taskId"], e.now)
        data["reflection"] = reflect(e, {"taskId": a["taskId"], "agentId": a["agentId"], "limit": 20})[1]
        _episode(e, {"type": "DECISION", "content": a["notes"] or f"Task {a['taskId']} completed.", "outcome": "success", "metadata": '{"rationale": "task completed"}', "taskId": a["taskId"], "agentId": a["agentId"]})
    return "updated", data


@tool
def feature_status(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    features = e.table("features")
    if a["featureId"] in ("*", "list", ""):
        return "features", {"features": rows(features.orderBy("id"), 100)}
    found = progress.resolve_feature(features, a["featureId"])
    if not rows(found, 1):
        return "unknown feature", {"success": False, "featureIds": [r["id"] for r in rows(features.select("id").orderBy("id"), 100)]}
    data = _one(progress.feature_rollup(found, e.table("tasks")), a["featureId"]) | _one(progress.implementation(e.graph, found), a["featureId"])
    return f"{data['progress']} %", {"success": True} | data


@tool
def blocking_issues(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    every = progress.blocking(e.table("tasks"), e.table("features"), a["type"], None)
    return "blocked", {"issues": rows(every, 20), "total": every.count()}


def _episode(e: Engine, row: dict[str, Any]) -> str:
    base = {"id": f"ep-{e.project}-{e.now}-{row['type'].lower()}", "timestamp": e.now, "projectId": e.project, "sensitive": False, "entities": [], "agentId": "system", "sessionId": "default"}
    full = base | {k: v for k, v in row.items() if v is not None}
    reason = e.spark.createDataFrame([tuple(full.get(c.split()[0]) for c in EPISODE.split(", "))], EPISODE).select(memory.invalid_because()).first()[0]
    if reason:
        raise BadArguments(reason)
    e.add("episodes", full | {"entities": list(full["entities"])[: memory.MAX_ENTITIES]})
    return full["id"]


@tool
def episode_add(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    import json

    meta = json.dumps(a["metadata"]) if isinstance(a["metadata"], dict) else a["metadata"]
    return "added", {"episodeId": _episode(e, {k: v for k, v in a.items() if k != "metadata"} | {"type": a["type"].upper(), "content": guard_text(a["content"], "content"), "metadata": meta})}


def _recall(e: Engine, a: dict[str, Any], types: list[str] | None, entities: list[str]) -> tuple[str, Any]:
    since = temporal_ms(e, str(a["since"])) if a.get("since") else None
    hints = [r["id"] for r in rows(retrieve.entity_hints(e.table("vectors"), code_vector(a["query"]), a["limit"]), 20)]
    found = memory.recall(e.table("episodes"), a["query"], e.now, e.project, a["agentId"], a["taskId"], types, [*entities, *hints], since, a["limit"])
    out = rows(found.select("id", "type", "content", "timestamp", "relevance"), 50)
    return f"{len(out)} episodes", {"episodes": out}


@tool
def episode_recall(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    return _recall(e, a, a["types"], a["entities"] or [])


@tool
def decision_query(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    return _recall(e, a, ["DECISION"], a["affectedFiles"] or [])


@tool
def reflect(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = memory.recall(e.table("episodes"), a["taskId"] or a["agentId"] or "recent work", e.now, e.project, a["agentId"], a["taskId"], limit=a["limit"]).persist()
    one = _one(memory.reflection(found), "episodes")
    learned = rows(memory.learnings(found), 3)
    for k, r in enumerate(learned):
        key = f"learn-{e.project}-{e.now}-{k}"
        e.add("learnings", {"id": key, "content": f"Recurring focus on {r['entity']}", "confidence": r["confidence"]})
        e.add("applies", {"src": key, "dst": r["entity"]})
    _episode(e, {"type": "REFLECTION", "content": one["insight"], "entities": [r["entity"] for r in learned], "outcome": "partial", "taskId": a["taskId"], "agentId": a["agentId"]})
    return one["insight"], {"insight": one["insight"], "learnings": learned}


@tool
def agent_claim(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    agent = a["agentId"] or "agent"
    rival = rows(claims.rival_of(e.table("claims"), a["targetId"], agent), 1)
    if rival:
        return "CONFLICT", {"status": "CONFLICT", "conflict": {k: rival[0][k] for k in ("id", "agentId", "intent", "validFrom")}}
    version = rows(claims.target_version(e.graph.node(a["targetId"])), 1)
    claim = f"claim-{e.project}-{e.now}-{agent}"
    e.add("claims", {"id": claim, "agentId": agent, "sessionId": a["sessionId"], "taskId": a["taskId"], "claimType": a["claimType"], "targetId": a["targetId"], "intent": guard_text(a["intent"], "intent"), "validFrom": e.now, "targetVersionSHA": version[0]["version"] if version else None, "projectId": e.project})
    return "ok", {"status": "ok", "claimId": claim}


@tool
def agent_release(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    found = _one(claims.release_status(e.table("claims"), a["claimId"]), a["claimId"])
    if not found["found"]:
        raise KeyError(f"claim {a['claimId']} not found")
    e.tables["claims"] = claims.release(e.table("claims"), a["claimId"], e.now, a["outcome"])
    return "released", {"claimId": a["claimId"], "alreadyClosed": found["alreadyClosed"]}


@tool
def agent_status(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    if not a["agentId"]:
        return coordination_overview(e, a)
    return "status", {"agentId": a["agentId"], "items": rows(claims.agent_status(e.table("claims"), e.table("episodes"), a["agentId"]), 100)}


@tool
def coordination_overview(e: Engine, a: dict[str, Any]) -> tuple[str, Any]:
    own = claims.latest(e.table("claims")).persist()
    stale = claims.stale(own, e.graph.nodes)
    return "overview", _one(claims.totals(own), "claims") | {"stale": rows(stale.select("id", "targetId"), 50), "conflicts": rows(claims.conflicts(own).orderBy("targetId"), 50), "agents": rows(claims.agent_summary(own), 50)}
