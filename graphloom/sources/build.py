"""From parsed files to the nodes and edges of the graph.

Ids are scoped: project:kind:path[:name:line]. Every builder is a projection of symbols(), so a
rebuild is one parse and a union of selects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import basename, dirname
from graphloom.graph import PropertyGraph
from graphloom.operators import docs as D
from graphloom.operators.impact import category, is_test
from graphloom.sources.code import file_facts, symbols
from graphloom.sources.imports import resolve_imports

CLASS_KINDS = ["class", "interface", "type", "enum"]


def summary(kind: str, name: Column, path: Column, loc: Column) -> Column:
    """The template sentence of a function, class or import."""
    size = F.when(loc > 0, F.concat(F.lit(" ("), loc.cast("string"), F.lit(" LOC)"))).otherwise("")
    if kind == "import":
        return F.concat(F.lit("Import "), name, F.lit(" used in "), path, F.lit("."))
    return F.concat(F.lit("Function " if kind == "function" else "Class/interface "), name, F.lit(" in "), path, size, F.lit("."))


def file_summary(language: Column, path: Column, loc: Column, functions: Column, classes: Column, imports: Column) -> Column:
    n = lambda c: c.cast("string")
    return F.concat(F.coalesce(language, F.lit("source")), F.lit(" file "), path, F.lit(" with "), n(loc), F.lit(" LOC, "), n(functions), F.lit(" function(s), "), n(classes), F.lit(" class(es), and "), n(imports), F.lit(" import(s)."))


def _rows(df: DataFrame, kind: str, node_id: Column, name: Column, path: Column, text: Column | None, project: str, now: int, /, **props: Column) -> DataFrame:
    pairs = [x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]
    bag = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(node_id.alias("id"), F.lit(kind).alias("type"), F.lit(project).alias("project_id"), name.alias("name"), path.alias("path"), (F.lit(None).cast("string") if text is None else text).alias("summary"), F.lit(now).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), bag.alias("props"))


def _edges(df: DataFrame, src: Column, dst: Column, kind: str, /, **props: Column) -> DataFrame:
    pairs = [x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]
    bag = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), bag.alias("props")).filter("src is not null and dst is not null")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def folders(paths: DataFrame, project: str, now: int) -> tuple[DataFrame, DataFrame]:
    """FOLDER nodes of all folders above files (path), and CONTAINS edges between them and to the files."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    every = paths.select(F.explode(up).alias("folder")).distinct()
    fid = lambda c: F.concat(F.lit(f"{project}:folder:"), c)
    nodes = _rows(every, "FOLDER", fid(F.col("folder")), F.when(F.col("folder") == "/", "/").otherwise(basename(F.col("folder"))), F.col("folder"), None, project, now)
    above = lambda c: F.when(F.contains(c, F.lit("/")), dirname(c)).otherwise("/")
    inner = _edges(every.filter("folder <> '/'"), fid(above(F.col("folder"))), fid(F.col("folder")), "CONTAINS")
    files = _edges(paths, fid(above(F.col("path"))), F.concat(F.lit(f"{project}:file:"), "path"), "CONTAINS")
    return nodes, inner.unionByName(files)


def code_graph(files: DataFrame, project: str, now: int, known: DataFrame | None = None) -> PropertyGraph:
    """The graph of source files (relative_path, text, language); `known` are the nodes of other files, which imports and tests may lead to."""
    facts = file_facts(files)
    parsed = symbols(files).join(facts.select("relative_path", "language"), "relative_path").persist()
    path, name = F.col("relative_path"), F.col("name")
    fid = lambda c: F.concat(F.lit(f"{project}:file:"), c)
    sid = lambda kind: F.concat(F.lit(f"{project}:{kind}:"), path, F.lit(":"), name, F.lit(":"), F.col("start_line").cast("string"))
    of = lambda *kinds: parsed.filter(F.col("kind").isin(*kinds))
    loc = F.col("end_line") - F.col("start_line") + 1
    lines = {"startLine": F.col("start_line"), "endLine": F.col("end_line")}

    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    counts = parsed.groupBy("relative_path").agg(n("function").alias("f"), n(*CLASS_KINDS).alias("c"), n("import").alias("i"))
    counted = facts.join(counts, "relative_path", "left").na.fill(0, ["f", "c", "i"])
    folder_nodes, folder_edges = folders(facts.select(path.alias("path")), project, now)
    functions, classes, imports, exports, variables, suites, cases, calls = (of(*k) for k in (["function"], CLASS_KINDS, ["import"], ["export"], ["variable"], ["test_suite"], ["test_case"], ["call"]))
    iid = F.concat(F.lit(f"{project}:import:"), path, F.lit(":"), name, F.lit(":"), F.col("start_line").cast("string"))
    stub = F.concat(F.lit(f"{project}:func-stub:"), name)
    nodes = [
        folder_nodes,
        _rows(counted, "FILE", fid(path), basename(path), path, file_summary(F.col("language"), path, F.col("loc"), F.col("f"), F.col("c"), F.col("i")), project, now, language=F.col("language"), LOC=F.col("loc"), hash=F.col("hash"), isTest=is_test(path)),
        _rows(functions, "FUNCTION", sid("func"), name, path, summary("function", name, path, loc), project, now, LOC=loc, parameters=F.col("detail"), isExported=F.col("exported"), **lines),
        _rows(classes, "CLASS", sid("class"), name, path, summary("class", name, path, loc), project, now, LOC=loc, kind=F.col("kind"), isExported=F.col("exported"), **lines),
        _rows(variables, "VARIABLE", sid("var"), name, path, None, project, now, startLine=F.col("start_line")),
        _rows(imports, "IMPORT", iid, name, path, summary("import", name, path, F.lit(0)), project, now, source=name, specifiers=F.array_join("specifiers", ","), startLine=F.col("start_line")),
        _rows(exports, "EXPORT", sid("export"), name, path, None, project, now, isDefault=F.coalesce(F.col("detail") == "default", F.lit(False)), startLine=F.col("start_line")),
        _rows(suites, "TEST_SUITE", sid("suite"), name, path, None, project, now, category=category(path), **lines),
        _rows(cases, "TEST_CASE", sid("case"), name, path, None, project, now, **lines),
        _rows(calls, "FUNCTION", stub, name, F.lit(None).cast("string"), None, project, now, stub=F.lit(True)),
    ]
    there = facts.select("relative_path")
    if known is not None:
        there = there.unionByName(known.filter("type = 'FILE'").select(F.col("path").alias("relative_path")))
    resolved = resolve_imports(imports.select("relative_path", "language", name.alias("source"), "start_line", "specifiers"), there)
    rid = F.concat(F.lit(f"{project}:import:"), path, F.lit(":"), F.col("source"), F.lit(":"), F.col("start_line").cast("string"))
    parents = classes.withColumn("_gl_i", F.explode(F.transform(F.split(F.coalesce("detail", F.lit("")), ","), lambda x: F.trim(F.get(F.split(x, "<"), F.lit(0))))))
    named = lambda c: F.concat(F.lit(f"{project}:class:"), c)
    at = lambda kind, df: _edges(df, fid(path), sid(kind), "CONTAINS")
    owners = functions.select("relative_path", name.alias("parent"), sid("func").alias("_gl_f"), F.col("start_line").alias("_gl_a"), F.col("end_line").alias("_gl_z"))
    # of functions with one name in a file, the innermost around the call
    placed = calls.join(owners, ["relative_path", "parent"]).filter((F.col("start_line") >= F.col("_gl_a")) & (F.col("start_line") <= F.col("_gl_z")))
    placed = placed.groupBy("relative_path", "name", "start_line").agg(F.max_by("_gl_f", "_gl_a").alias("_gl_f"))
    nested = cases.filter("parent is not null").join(suites.select("relative_path", name.alias("parent"), sid("suite").alias("_gl_s"), F.col("start_line").alias("_gl_a")), ["relative_path", "parent"])
    edges = [
        folder_edges, at("func", functions), at("class", classes), at("var", variables), at("suite", suites), at("case", cases),
        _edges(nested.filter("start_line > _gl_a"), F.col("_gl_s"), sid("case"), "CONTAINS"),
        _edges(imports, fid(path), iid, "IMPORTS"),
        _edges(exports, fid(path), sid("export"), "EXPORTS"),
        _edges(placed, F.col("_gl_f"), stub, "CALLS_TO", line=F.col("start_line")),
        _edges(classes.filter("parent is not null"), sid("class"), named(F.col("parent")), "EXTENDS"),
        _edges(parents.filter("_gl_i <> '' and kind = 'class' and language in ('typescript', 'javascript', 'java')"), sid("class"), named(F.col("_gl_i")), "IMPLEMENTS"),
        _edges(resolved.filter("target is not null"), rid, fid(F.col("target")), "REFERENCES"),
        _edges(resolved.filter("target is not null"), fid(path), fid(F.col("target")), "DEPENDS_ON"),
        tests_edges(parsed, resolved, project, known),
    ]
    return PropertyGraph(_union(nodes).dropDuplicates(["id"]), _union(edges).dropDuplicates(["src", "dst", "type"]))


def tests_edges(parsed: DataFrame, resolved: DataFrame, project: str, others: DataFrame | None = None) -> DataFrame:
    """TESTS edges: the suites of a test file to the files it imports, suites and cases to the imported symbols."""
    path = F.col("relative_path")
    tests = parsed.filter(F.col("kind").isin("test_suite", "test_case") & is_test(path))
    short = F.when(F.col("kind") == "test_suite", "suite").otherwise("case")
    tests = tests.select("relative_path", "kind", F.concat(F.lit(f"{project}:"), short, F.lit(":"), path, F.lit(":"), "name", F.lit(":"), F.col("start_line").cast("string")).alias("_gl_t"))
    uses = tests.join(resolved.filter("target is not null").select("relative_path", "target", "specifiers"), "relative_path")
    files = _edges(uses.filter("kind = 'test_suite'"), F.col("_gl_t"), F.concat(F.lit(f"{project}:file:"), "target"), "TESTS")
    kinds = parsed.filter(F.col("kind").isin("function", *CLASS_KINDS))
    prefix = F.when(F.col("kind") == "function", "func").otherwise("class")
    known = kinds.select(path.alias("target"), F.col("name").alias("_gl_n"), F.concat(F.lit(f"{project}:"), prefix, F.lit(":"), path, F.lit(":"), "name", F.lit(":"), F.col("start_line").cast("string")).alias("_gl_d"))
    if others is not None:
        known = known.unionByName(others.filter("type in ('FUNCTION', 'CLASS')").select(F.col("path").alias("target"), F.col("name").alias("_gl_n"), F.col("id").alias("_gl_d")))
    by_name = uses.withColumn("_gl_n", F.explode("specifiers")).join(known, ["target", "_gl_n"])
    return files.unionByName(_edges(by_name, F.col("_gl_t"), F.col("_gl_d"), "TESTS"))


def resolve_calls(graph: PropertyGraph) -> DataFrame:
    """(src, dst): calls to stubs, led to the functions of that name; an extension for call ranking."""
    stubs = graph.label("FUNCTION").filter("element_at(props, 'stub') = 'true'").select(F.col("id").alias("dst"), "name")
    real = graph.label("FUNCTION").filter("element_at(props, 'stub') is null").select(F.col("id").alias("real"), "name")
    return graph.edges_of("CALLS_TO").join(stubs, "dst").join(real, "name").select("src", F.col("real").alias("dst")).distinct()


def document_graph(files: DataFrame, code: DataFrame, project: str, now: int, stored: int | None = D.STORED) -> PropertyGraph:
    """The graph of markdown files (relative_path, text), with edges to the code nodes they name."""
    parts = D.section_ids(D.sections(files), project).persist()
    about = D.documents(parts).join(files.select("relative_path", F.sha2("text", 256).alias("hash")), "relative_path")
    did = F.concat(F.lit(f"{project}:doc:"), "relative_path")
    doc_nodes = _rows(about, "DOCUMENT", did, F.col("title"), F.col("relative_path"), None, project, now, kind=F.col("kind"), wordCount=F.col("word_count"), hash=F.col("hash"))
    words = D.word_count(F.col("heading"), F.col("content"))
    # a section node keeps the first `stored` characters, all if that is None; parts itself keeps all
    content = F.col("content") if stored is None else F.substring("content", 1, stored)
    section_nodes = _rows(parts, "SECTION", F.col("id"), F.col("heading"), F.col("relative_path"), content, project, now, level=F.col("level"), startLine=F.col("start_line"), wordCount=words, docId=F.col("doc_id"))
    refs = parts.select("id", F.explode(D.backtick_refs(F.col("heading"), F.col("content"))).alias("ref"))
    named = D.describes(refs, code)
    chain = D.section_edges(parts)
    none = F.create_map().cast("map<string,string>").alias("props")
    describing = named.select("src", "dst", F.lit("DOC_DESCRIBES").alias("type"), F.create_map(F.lit("strength"), F.col("strength").cast("string"), F.lit("matchedName"), F.col("matched_name")).alias("props"))
    return PropertyGraph(doc_nodes.unionByName(section_nodes), chain.select("src", "dst", "type", none).unionByName(describing))


# The features every project starts with.
SEED_FEATURES = ["code-graph", "architecture-validation", "test-intelligence", "progress-tracking", "agent-memory"]


def seed_features(stored: DataFrame, project: str, now: int) -> DataFrame:
    """FEATURE nodes to insert: those of the seed list that aren't stored yet."""
    spark = stored.sparkSession
    rows = spark.createDataFrame([(n,) for n in SEED_FEATURES], "name string")
    new = _rows(rows, "FEATURE", F.concat(F.lit(f"{project}:feature:"), "name"), F.col("name"), F.lit(None).cast("string"), None, project, now, status=F.lit("in-progress"))
    return new.join(stored.select("id"), "id", "left_anti")
