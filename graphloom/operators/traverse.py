"""Traversals: degrees, bounded distances, expansion, cycles, unused nodes, neighbourhoods, census.

Null ids match nothing; repeated edges count as given unless said otherwise; empty graphs give empty
results (global counts give zero rows per label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import PropertyGraph
from graphloom.model import CODE, EXPANSION_WEIGHTS, OTHER_WEIGHT
from graphloom.session import cut_lineage, kept

# Score by hop count of the proximity ranking, seeds and further hops.
HOP_SCORES = {1: 1.0, 2: 0.6, 3: 0.3}
SEED_SCORE, FAR_SCORE = 2.0, 0.1


def type_weight(weights: dict[str, float], column: str = "type", other: float = OTHER_WEIGHT) -> Column:
    w = F.lit(other)
    for name, value in weights.items():
        w = F.when(F.col(column) == name, F.lit(value)).otherwise(w)
    return w


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) in one pass over the edges."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("x")).groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def min_hops(graph: PropertyGraph, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(id, hops): the least number of undirected steps from any seed, up to a bound; seeds have 0.

    A step joins the nodes found last with the edges they touch and keeps those not seen before, so no
    node is expanded twice. Every step is cut off from the one before.
    """
    seen = seeds.select("id", F.lit(0).alias("hops")).filter(F.col("id").isNotNull()).distinct()
    if hops < 1:
        return seen
    seen = cut_lineage(seen)
    edges = kept(graph.edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
    try:
        for k in range(1, hops + 1):
            last = seen.filter(F.col("hops") == k - 1).select(F.col("id").alias("_gl_last"))
            out = edges.join(last, F.col("src") == F.col("_gl_last"), "left_semi").select(F.col("dst").alias("id"))
            into = edges.join(last, F.col("dst") == F.col("_gl_last"), "left_semi").select(F.col("src").alias("id"))
            found = out.unionByName(into).distinct().join(seen.select("id"), "id", "left_anti")
            seen = cut_lineage(seen.unionByName(found.select("id", F.lit(k).alias("hops"))))
        return seen
    finally:
        edges.unpersist()


def proximity(graph: PropertyGraph, seeds: DataFrame, hops: int = 3, types: list[str] | None = None) -> DataFrame:
    """(id, hops, score): nodes near the seeds with the score of their distance; only the given labels."""
    score = F.lit(FAR_SCORE)
    for k, v in HOP_SCORES.items():
        score = F.when(F.col("hops") == k, v).otherwise(score)
    near = min_hops(graph, seeds, hops).withColumn("score", F.when(F.col("hops") == 0, SEED_SCORE).otherwise(score))
    wanted = graph.label(*(types or CODE)).select("id", F.lit(True).alias("_gl_w"))
    return near.join(wanted, "id", "left").filter(F.col("_gl_w") | (F.col("hops") == 0)).select("id", "hops", "score")


def expand(graph: PropertyGraph, seeds: DataFrame, limit: int = 10) -> DataFrame:
    """(id, score): neighbours of the seeds in both directions with summed weights; repeated seeds count repeatedly."""
    times = seeds.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("_gl_seed")).agg(F.count("*").alias("_gl_n"))
    near = None
    for here, there in (("src", "dst"), ("dst", "src")):  # edges are filtered by the seeds before anything is shuffled
        hit = graph.edges.join(times, F.col(here) == F.col("_gl_seed")).select(F.col(there).alias("id"), (F.col("_gl_n") * type_weight(EXPANSION_WEIGHTS)).alias("w"))
        near = hit if near is None else near.unionByName(hit)
    out = near.groupBy("id").agg(F.round(F.sum("w"), 6).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def unused(graph: PropertyGraph, label: str = "FILE", direction: str = "out") -> DataFrame:
    """Nodes of a label without edges in the direction: out, in or both."""
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    nodes = graph.label(label)
    for end in ends:
        nodes = nodes.join(graph.edges.select(F.col(end).alias("id")), "id", "left_anti")
    return nodes


def file_dependencies(graph: PropertyGraph) -> DataFrame:
    """(src, dst): FILE to FILE, directly or through IMPORT and REFERENCES."""
    files = graph.label("FILE").select("id")
    direct = graph.edges_of("IMPORTS", "DEPENDS_ON").select("src", "dst")
    through = graph.edges_of("IMPORTS").select("src", F.col("dst").alias("_gl_i")).join(graph.edges_of("REFERENCES").select(F.col("src").alias("_gl_j"), "dst"), F.col("_gl_i") == F.col("_gl_j")).select("src", "dst")
    both = direct.unionByName(through).distinct()
    return both.join(files.withColumnRenamed("id", "src"), "src", "left_semi").join(files.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def two_cycles(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs with an edge each way; a semi-join on swapped keys, not a pair expansion."""
    forward = pairs.filter(F.col("src") < F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    back = pairs.filter(F.col("src") > F.col("dst")).select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return forward.join(back, ["a", "b"], "left_semi")


def on_cycles(pairs: DataFrame, rounds: int = 10) -> DataFrame:
    """Edges left after repeatedly dropping those whose source has no way in or whose target no way out.

    A linear-cost filter: every cycle survives, and path enumeration only sees what may lie on one.
    """
    e = pairs.select("src", "dst").filter("src <> dst").distinct()
    for _ in range(rounds):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return e


def cycles(pairs: DataFrame, longest: int = 4, prune: int = 2) -> DataFrame:
    """(length, cycle): all simple cycles up to a length, once each, starting at their least node.

    Paths start at their least node and only visit greater ones, so each cycle is found once.
    """
    e = on_cycles(pairs, prune).select(F.col("src").alias("_gl_s"), F.col("dst").alias("_gl_d"))
    paths = e.filter("_gl_s < _gl_d").select(F.array("_gl_s", "_gl_d").alias("path"))
    found = None
    for length in range(2, longest + 1):
        ends = paths.join(e, (F.element_at("path", -1) == F.col("_gl_s")) & (F.col("_gl_d") == F.col("path")[0])).select(F.lit(length).alias("length"), F.concat_ws(" -> ", "path").alias("cycle"))
        found = ends if found is None else found.unionByName(ends)
        if length < longest:
            grown = paths.join(e, F.element_at("path", -1) == F.col("_gl_s")).filter((F.col("_gl_d") > F.col("path")[0]) & ~F.array_contains("path", F.col("_gl_d")))
            paths = grown.select(F.concat("path", F.array("_gl_d")).alias("path"))
    return found


def importers(graph: PropertyGraph, changed: DataFrame, limit: int | None = 50) -> DataFrame:
    """(path): files that import a changed file; changed has column path, equal or a suffix after a slash.

    Suffixes join on the base name, so no pairs of unrelated paths arise.
    """
    files = graph.label("FILE").select("id", "path").withColumn("_gl_base", F.substring_index("path", "/", -1))
    change = changed.select(F.regexp_replace("path", r"^\./", "").alias("_gl_c")).distinct().withColumn("_gl_base", F.substring_index("_gl_c", "/", -1))
    hit = files.join(change, "_gl_base").filter((F.col("path") == F.col("_gl_c")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("_gl_c"))))
    by = file_dependencies(graph).join(hit.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("id"))
    out = files.join(by, "id", "left_semi").join(hit.select("id"), "id", "left_anti").select("path").distinct().orderBy("path")
    return out if limit is None else out.limit(limit)


def explain(graph: PropertyGraph, element: str, depth: int = 2) -> DataFrame:
    """(direction, type, other, name, n): edges of the first match by path, function or class name; depth*10 each way."""
    lower = element.lower()
    at = F.when((F.col("type") == "FILE") & F.contains(F.lower("path"), F.lit(lower)), 0).when((F.col("type") == "FUNCTION") & F.contains(F.lower("name"), F.lit(lower)), 1).when((F.col("type") == "CLASS") & F.contains(F.lower("name"), F.lit(lower)), 2)
    hit = graph.nodes.withColumn("_gl_p", at).filter(F.col("_gl_p").isNotNull()).orderBy("_gl_p", "id").limit(1).select(F.col("id").alias("_gl_id"))
    hit = F.broadcast(hit)  # one row
    out = graph.edges.join(hit, F.col("src") == F.col("_gl_id"), "left_semi").select(F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    into = graph.edges.join(hit, F.col("dst") == F.col("_gl_id"), "left_semi").select(F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
    rows = out.unionByName(into).join(graph.nodes.select(F.col("id").alias("other"), "name"), "other", "left")
    rank = F.row_number().over(Window.partitionBy("direction").orderBy("type", "other"))
    return rows.distinct().withColumn("n", rank).filter(F.col("n") <= depth * 10).select("direction", "type", "other", "name", "n")


def census(nodes: DataFrame) -> DataFrame:
    """(type, n): rows per label or relationship type."""
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def health(graph: PropertyGraph, embedded: DataFrame, indexed: int | None = None) -> DataFrame:
    """One row: node, edge and label counts, embedding coverage and whether an index has drifted by more than 3."""
    names = {"FILE": "files", "FUNCTION": "functions", "CLASS": "classes", "IMPORT": "imports"}
    counts = graph.nodes.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("type") == t).alias(n) for t, n in names.items()])
    one = counts.withColumn("_gl_1", F.lit(1))
    for df, name in ((graph.edges, "edges"), (embedded, "embeddings")):
        one = one.join(df.agg(F.count("*").alias(name)).withColumn("_gl_1", F.lit(1)), "_gl_1")  # one row each
    code = F.col("files") + F.col("functions") + F.col("classes")
    one = one.drop("_gl_1").withColumn("coverage", F.when(code > 0, F.round(F.col("embeddings") / code, 3)).otherwise(0.0))
    return one.withColumn("status", F.when(F.abs(F.lit(indexed) - F.col("nodes")) > 3, "drift_detected").otherwise("ok"))
