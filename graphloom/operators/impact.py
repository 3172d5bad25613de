"""Tests: categories, dependencies, selection by changed files, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import basename, dirname, extname, normal_path
from graphloom.graph import PropertyGraph

# Path parts of each category of tests, first match wins.
CATEGORIES = {
    "integration": [".integration.test.", "_integration_test.", "_integration_spec.", "/integration/", "/integration_", "test_integration_"],
    "performance": [".performance.test.", "_performance_test.", "_bench_test.", "_benchmark", "/benchmarks/"],
    "e2e": ["/e2e/", "/end_to_end/", "_e2e_"],
}
TEST_PARTS = [".test.", ".spec.", "/e2e/", "/__tests__/"]


def _any_part(path: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(path, F.lit(p))
    return out


def category(path: Column) -> Column:
    """integration, performance, e2e or unit."""
    out = F.lit("unit")
    for name in reversed(CATEGORIES):
        out = F.when(_any_part(F.lower(path), CATEGORIES[name]), name).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    return _any_part(path, TEST_PARTS)


def mirror_test(path: Column) -> Column:
    """dir/name.ext becomes dir/__tests__/name.test.ext."""
    ext = extname(path)
    stem = F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")
    return F.concat(dirname(path), F.lit("/__tests__/"), stem, F.lit(".test"), ext)


def dependencies(graph: PropertyGraph) -> DataFrame:
    """(test, file, direct): what the suites and cases of a test path TEST, and what that imports."""
    tests = graph.label("TEST_SUITE", "TEST_CASE").select("id", F.col("path").alias("test"))
    pairs = tests.join(graph.edges_of("TESTS").select(F.col("src").alias("id"), F.col("dst").alias("tested")), "id")
    paths = graph.nodes.select(F.col("id").alias("tested"), F.col("path").alias("file"))
    direct = pairs.join(paths, "tested").select("test", "file", "tested")
    imports = graph.hop(direct.select("test", "tested"), "tested", ["IMPORTS", "DEPENDS_ON"], "_gl_to")
    further = imports.join(graph.nodes.select(F.col("id").alias("_gl_to"), F.col("path").alias("file")), "_gl_to").select("test", "file", F.lit(False).alias("direct"))
    both = direct.select("test", "file", F.lit(True).alias("direct")).unionByName(further)
    return both.filter("file is not null").groupBy("test", "file").agg(F.max("direct").alias("direct"))


def select_tests(suites: DataFrame, depends: DataFrame, changed: DataFrame, integration: bool = True, mode: str = "direct") -> DataFrame:
    """(test, category, duration, how): tests affected by changed (path).

    mode direct takes direct dependencies, transitive indirect ones as well, full every test. Where
    none is affected, tests that mirror a changed file or lie under its folder are taken instead.
    suites: (path, duration).
    """
    tests = suites.groupBy(F.col("path").alias("test")).agg(F.max(F.coalesce("duration", F.lit(0))).alias("duration")).withColumn("category", category(F.col("test")))
    if mode == "full":
        return tests.select("test", "category", "duration", F.lit("full").alias("how"))
    files = changed.select(normal_path(F.col("path")).alias("file")).distinct()
    pool = tests if integration else tests.filter("category <> 'integration'")
    hits = depends.filter("direct") if mode == "direct" else depends
    hit = hits.join(files, "file", "left_semi").groupBy("test").agg(F.max("direct").alias("direct"))
    picked = pool.join(hit, "test").select("test", "category", "duration", F.when(F.col("direct"), "direct").otherwise("transitive").alias("how"))
    none = picked.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(1).alias("_gl_1"))  # one row where nothing was picked
    mirrors = files.select(mirror_test(F.col("file")).alias("test"))
    folders = files.select(dirname(F.col("file")).alias("_gl_f")).distinct()
    parents = tests.filter(F.contains("test", F.lit(".test."))).select("test", F.explode(_folders(F.col("test"))).alias("_gl_f"))
    related = mirrors.unionByName(parents.join(folders, "_gl_f").select("test")).distinct()
    fallback = tests.join(related, "test", "left_semi").withColumn("_gl_1", F.lit(1)).join(F.broadcast(none), "_gl_1", "left_semi")
    return picked.unionByName(fallback.select("test", "category", "duration", F.lit("related").alias("how")))


def _folders(path: Column) -> Column:
    """All folders above a path, so that containment is an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def selection_summary(picked: DataFrame, suites: DataFrame) -> DataFrame:
    """(selected, total, coverage, estimated_time, category): one row; coverage in percent."""
    kinds = [F.max((F.col("category") == c).cast("int")) for c in ("unit", "integration", "performance")]
    n = sum((F.coalesce(k, F.lit(0)) for k in kinds[1:]), F.coalesce(kinds[0], F.lit(0)))
    overall = F.when(n > 1, "mixed").when(kinds[1] == 1, "integration").otherwise("unit")
    one = picked.agg(F.count("*").alias("selected"), F.coalesce(F.sum("duration"), F.lit(0)).alias("estimated_time"), overall.alias("category")).withColumn("_gl_1", F.lit(1))
    total = suites.agg(F.count_distinct("path").alias("total")).withColumn("_gl_1", F.lit(1))
    share = F.when(F.col("total") > 0, F.round(100 * F.col("selected") / F.col("total"), 2)).otherwise(0.0)
    return one.join(total, "_gl_1").select("selected", "total", share.alias("coverage"), "estimated_time", "category")


def statistics(suites: DataFrame) -> DataFrame:
    """(category, tests, average_duration)."""
    return suites.groupBy(category(F.col("path")).alias("category")).agg(F.count("*").alias("tests"), F.round(F.avg("duration"), 2).alias("average_duration"))


def blast_radius(summary: DataFrame) -> DataFrame:
    """The summary with advice: the full suite above half of all tests."""
    return summary.withColumn("advice", F.when(F.col("coverage") > 50, "run full suite").when(F.col("selected") > 0, "run selected tests").otherwise("no tests affected"))


def runner(path: Column) -> Column:
    """The command that runs a test file, by its extension; null for others."""
    # fixed values
    rules = [(r"\.(ts|tsx|js|jsx|mjs|cjs)$", "npx vitest run"), (r"\.py$", "pytest"), (r"\.go$", "go test"), (r"\.rs$", "cargo test"), (r"\.java$", "mvn test"), (r"\.rb$", "bundle exec rspec")]
    out = F.lit(None).cast("string")
    for pattern, command in reversed(rules):
        out = F.when(path.rlike(pattern), command).otherwise(out)
    return out
