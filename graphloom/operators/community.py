"""Communities: directory heuristic, label propagation, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import PropertyGraph
from graphloom.operators.skew import MIN_ROWS, heavy, local_table
from graphloom.session import cut_lineage, kept

# Source root folders, and folders too general to name a community.
SOURCE_ROOTS = ["src", "lib", "app", "pages", "packages", "components", "services"]
TRIVIAL = ["home", "root", "usr", "var", "tmp", "opt"]


def directory_label(path: Column) -> Column:
    """The folder after the first source root (the root itself before a file), else the last telling folder, else misc."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    roots = F.filter(F.transform(parts, lambda s, k: F.when(s.isin(*SOURCE_ROOTS), k)), lambda k: k.isNotNull())
    at = F.get(roots, F.lit(0))
    following = F.get(parts, at + 1)
    by_root = F.when(F.contains(following, F.lit(".")), F.get(parts, at)).otherwise(following)
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: ~s.isin(*TRIVIAL))
    last = F.get(folders, F.size(folders) - 1)
    return F.coalesce(F.when(following.isNotNull(), by_root), last, F.lit("misc"))


def directory_communities(nodes: DataFrame) -> DataFrame:
    """(id, type, path, label): code nodes with the community of their path."""
    return nodes.select("id", "type", "path", directory_label(F.coalesce("path", F.lit(""))).alias("label"))


def label_propagation(graph: PropertyGraph, rounds: int = 5, min_rows: int = MIN_ROWS) -> DataFrame:
    """(id, community): every round a node takes the most frequent label around it, the least on ties.

    The first label is the node's id. Adjacent nodes are kept partitioned, labels lie partitioned beside
    them, and a round shuffles the votes, counted per node and label before the choice. The neighbours of
    hubs stay spread and get the hub's label by broadcast (at most PARTS hubs).
    """
    own = []
    try:
        own.append(pairs := kept(graph.undirected().filter("here <> there").select("here", "there").distinct()))
        hubs = [(k,) for k, _ in heavy(pairs, ["there"], min_rows)]
        rest = pairs
        if hubs:
            hub = F.broadcast(local_table(pairs.sparkSession, hubs, "_gl_h string"))
            rest, spread = (pairs.join(hub, F.col("there") == F.col("_gl_h"), how) for how in ("left_anti", "left_semi"))
        own.append(beside := kept(rest.repartition("there")))
        labels = graph.nodes.select("id", F.col("id").alias("community")).distinct()
        for k in range(1, rounds + 1):
            votes = beside.join(labels.hint("merge"), F.col("there") == F.col("id")).select("here", "community")
            if hubs:
                few = F.broadcast(labels.join(hub, F.col("id") == F.col("_gl_h"), "left_semi"))
                votes = votes.unionByName(spread.join(few, F.col("there") == F.col("id")).select("here", "community"))
            votes = votes.groupBy("here", "community").agg(F.count("*").alias("n"))
            best = votes.groupBy("here").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("community").alias("c")))["c"].alias("next"))
            labels = labels.join(best.hint("merge"), F.col("id") == F.col("here"), "left").select("id", F.coalesce("next", "community").alias("community"))
            if k % 2 == 0 or k == rounds:
                labels = cut_lineage(labels)
        return labels
    finally:
        for df in own:
            df.unpersist()


def summaries(members: DataFrame, by: str = "label") -> DataFrame:
    """(label, member_count, central_node, summary) per community of members (id, type, by)."""
    per_type = members.groupBy(F.col(by).alias("label"), "type").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("type").alias("t")))), 1, 3)
    out = per_type.groupBy("label").agg(F.sum("n").alias("member_count"), F.coalesce(F.min(F.when(F.col("type") == "FUNCTION", F.col("first"))), F.min("first")).alias("central_node"), top.alias("top"))
    profile = F.array_join(F.transform("top", lambda x: F.concat((-x["k"]).cast("string"), F.lit(" "), F.lower(x["t"]), F.lit(" node(s)"))), ", ")
    text = F.concat(F.lit("Community '"), F.col("label"), F.lit("' groups "), F.col("member_count").cast("string"), F.lit(" code node(s): "), profile, F.lit("."))
    return out.select("label", "member_count", "central_node", text.alias("summary"))


def modal_label(members: DataFrame, group: str) -> DataFrame:
    """(group, label): the most frequent directory label of each group, the least on ties."""
    counts = directory_communities(members).join(members.select("id", group), "id").groupBy(group, "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "label"))
    return counts.withColumn("_gl_r", rank).filter("_gl_r = 1").select(group, "label")
