"""Retrieval: lexical, BM25, vector and graph rankings, their fusion, and searches built on them.

Rankings have (id, score) and break ties by id. Queries are short texts, so their tokens and vectors
are literals of the plan; nothing that grows with the data is broadcast. A query without usable
tokens ranks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import occurrences, query_tokens, tokens
from graphloom.functions.vectors import cosine_to
from graphloom.graph import PropertyGraph
from graphloom.model import CODE
from graphloom.operators.traverse import expand

# Fixed values of the fusion and of BM25.
RRF_K, K1, B = 60, 1.2, 0.75
AREAS = ["tools", "engines", "graph", "parsers", "vector", "config"]


def _haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def lexical(nodes: DataFrame, query: str, limit: int = 10, columns: Sequence[str] = ("id", "name", "path", "summary"), shortest: int = 2) -> DataFrame:
    """(id, score): the number of query tokens (repeats count) contained in the columns, above 0."""
    hay = F.col("_gl_hay")
    score = F.lit(0)
    for t in query_tokens(query, shortest):
        score = score + F.contains(hay, F.lit(t)).cast("int")
    out = nodes.withColumn("_gl_hay", _haystack(*columns)).select("id", score.alias("score")).filter("score > 0")
    return out.orderBy(F.desc("score"), "id").limit(limit)


def find_seeds(nodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(id): the best lexical matches on id, name and path; the first nodes if there is none."""
    hits = lexical(nodes, query, limit, ("id", "name", "path"), 3).select("id", F.lit(0).alias("p"), F.col("score"))
    rest = nodes.select("id", F.lit(1).alias("p"), F.lit(0).alias("score")).orderBy("id").limit(limit)
    both = hits.unionByName(rest).withColumn("best", F.min("p").over(Window.partitionBy(F.lit(1))))  # at most 2 * limit rows
    return both.filter("p = best").orderBy(F.desc("score"), "id").limit(limit).select("id")


def postings(docs: DataFrame, id_col: str, text: Column, shortest: int = 2) -> DataFrame:
    """(term, id, tf, length): the inverted index, counted before its shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), tokens(text, shortest).alias("ts"))
    rows = rows.select("id", F.size("ts").alias("length"), F.explode("ts").alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, id_col: str, text: Column, query: str, limit: int | None = 10, shortest: int = 2) -> DataFrame:
    """(id, score): Okapi BM25 over the texts; repeated query terms count once.

    Only the postings of query terms are made; the statistics are one row.
    """
    terms = sorted(set(query_tokens(query, shortest)))
    rows = docs.select(F.col(id_col).alias("id"), tokens(text, shortest).alias("ts")).withColumn("length", F.size("ts"))
    hits = rows.select("id", "length", F.explode(F.filter("ts", lambda t: t.isin(*terms) if terms else F.lit(False))).alias("term"))
    tf = hits.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # one row per query term
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("avg")).withColumn("_gl_1", F.lit(1))
    weights = df.withColumn("_gl_1", F.lit(1)).join(stats, "_gl_1").select("term", "avg", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    out = tf.join(F.broadcast(weights), "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def knn(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float | None = None, types: Sequence[str] | None = None, project: str | None = None) -> DataFrame:
    """(id, score): the rows (id, vector, type, project_id) most similar to a vector; exact."""
    rows = vectors
    if types:
        rows = rows.filter(F.col("type").isin(*types))
    if project:
        rows = rows.filter(F.col("project_id") == project)
    out = rows.select("id", F.round(cosine_to(F.col("vector"), query), 6).alias("score")).filter(F.col("score").isNotNull())
    if threshold is not None:
        out = out.filter(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), "id").limit(limit)


def vector_of(vectors: DataFrame, element: str) -> list[float]:
    """The stored vector of an element, one row; a query vector of the searches below."""
    row = vectors.filter((F.col("id") == element) & F.col("vector").isNotNull()).select("vector").orderBy("vector").first()
    if row is None:
        raise KeyError(element)
    return [float(x) for x in row[0]]


def similar_to(vectors: DataFrame, element: str, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """(id, score): elements of the same type whose vectors are at least that similar."""
    own = vectors.filter(F.col("id") == element).select("type").first()
    return knn(vectors.filter(F.col("id") != element), vector_of(vectors, element), limit, threshold, [own[0]] if own and own[0] else None)


def vector_list(vectors: DataFrame, query: list[float], limit: int = 10, order: Sequence[str] = ("function", "class", "file"), project: str | None = None) -> DataFrame:
    """(id, rank, score): the nearest of each type, one type after the other, score 1/rank, cut to the limit."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    best = _nearest_per_type(vectors, query, limit, order, project).withColumn("_gl_t", place)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_gl_t", F.desc("score"), "id"))  # at most limit rows a type
    return best.select("id", rank.alias("rank")).filter(F.col("rank") <= limit).select("id", "rank", (1 / F.col("rank")).alias("score"))


def _nearest_per_type(vectors: DataFrame, query: list[float], limit: int, types: Sequence[str], project: str | None = None) -> DataFrame:
    """(type, id, score): the nearest of each type, in one pass; all but limit rows a type are dropped before the shuffle."""
    rows = vectors.filter(F.col("type").isin(*types))
    if project:
        rows = rows.filter(F.col("project_id") == project)
    scored = rows.select("type", "id", F.round(cosine_to(F.col("vector"), query), 6).alias("score")).filter(F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "id"))
    return scored.withColumn("_gl_n", rank).filter(F.col("_gl_n") <= limit).drop("_gl_n")


def ranked(scores: DataFrame) -> DataFrame:
    """(id, rank, score) of a short ranking (id, score)."""
    return scores.select("id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")).alias("rank"), F.col("score").cast("double").alias("score"))


def rrf(lists: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, rrf_score, one column per list): reciprocal rank fusion of short rankings (id, rank, score)."""
    rows = None
    for name, df in lists.items():
        part = df.select("id", "rank", "score", F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    per = [F.max(F.when(F.col("source") == n, F.col("score"))).alias(n) for n in lists]
    return rows.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("rrf_score"), *per)


def hybrid(graph: PropertyGraph, vectors: DataFrame, query: str, query_vector: list[float], mode: str = "hybrid", limit: int = 10, types: Sequence[str] | None = None, k: int = RRF_K) -> DataFrame:
    """(id, type, name, path, rrf_score, ...): vector, lexical and one-hop rankings, fused; mode picks lists.

    Seeds of the expansion are the first `limit` of the vector list followed by the lexical list.
    """
    limit = max(1, min(limit, 100))
    lists: dict[str, DataFrame] = {}
    if mode in ("vector", "hybrid"):
        lists["vector"] = vector_list(vectors, query_vector, limit)
    if mode in ("bm25", "hybrid"):
        lists["bm25"] = ranked(lexical(graph.label(*CODE), query, limit))
    if mode in ("graph", "hybrid"):
        source = {n: lists.get(n) if n in lists else None for n in ("vector", "bm25")}
        given = [df.select("id", "rank", F.lit(p).alias("p")) for p, df in enumerate(source.values()) if df is not None]
        if not given:
            given = [ranked(lexical(graph.label(*CODE), query, limit)).select("id", "rank", F.lit(0).alias("p"))]
        seeds = given[0]
        for g in given[1:]:
            seeds = seeds.unionByName(g)
        lists["graph"] = ranked(expand(graph, seeds.orderBy("p", "rank").limit(limit), limit))
    fused = rrf(lists, k)
    nodes = graph.nodes.filter(F.col("type").isin(*types)) if types else graph.nodes
    # the fused list has at most 3 * limit rows
    return F.broadcast(fused).join(nodes.select("id", "type", "name", "path"), "id").orderBy(F.desc("rrf_score"), "id").limit(limit)


def max_score(graph_hits: DataFrame, vector_hits: DataFrame, limit: int = 10) -> DataFrame:
    """(id, score, sources): name hits count 1.0 and vector hits 0.8; the best per id."""
    rows = graph_hits.select("id", F.lit(1.0).alias("score"), F.lit("graph").alias("source")).unionByName(vector_hits.select("id", F.lit(0.8).alias("score"), F.lit("vector").alias("source")))
    out = rows.groupBy("id").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def across_types(vectors: DataFrame, query: list[float], limit: int = 10, types: Sequence[str] = ("function", "class", "file")) -> DataFrame:
    """(type, id, score): the nearest ceil(limit/3) of each type."""
    return _nearest_per_type(vectors, query, -(-limit // 3), types)


def communities_for(communities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Communities (label, member_count, summary) about a query, largest first; all if none is."""
    words = [t for t in query_tokens(query, 4)][:1]
    hints = [a for a in AREAS if a in query.lower()]
    about = F.lit(False)
    if words:
        about = about | F.contains(F.lower("summary"), F.lit(words[0]))
    if hints:
        about = about | F.col("label").isin(*hints)
    rows = communities.withColumn("_gl_hit", about).withColumn("_gl_n", F.max(about.cast("int")).over(Window.partitionBy(F.lit(1))))  # communities are few
    return rows.filter(F.col("_gl_hit") | (F.col("_gl_n") == 0)).orderBy(F.desc("member_count"), "label").limit(limit).drop("_gl_hit", "_gl_n")


def pattern_search(nodes: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Code nodes whose name or path contains a pattern, in any case."""
    p = F.lit(pattern.lower())
    return nodes.filter(F.col("type").isin(*CODE) & (F.contains(F.lower("name"), p) | F.contains(F.lower("path"), p))).orderBy("id").limit(limit)


def search_sections(sections: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, heading, excerpt, score): sections with every term above two characters in heading or content."""
    terms = [t for t in query.lower().split() if len(t) > 2]
    hay = F.lower(F.concat_ws(" ", "heading", "content"))
    ok = F.lit(bool(terms))
    for t in terms:
        ok = ok & F.contains(hay, F.lit(t))
    return sections.filter(ok).select("id", "heading", F.substring("content", 1, 500).alias("excerpt"), F.lit(1.0).alias("score")).orderBy(F.asc_nulls_last("heading"), "id").limit(max(1, min(limit, 50)))


def sections_about(graph: PropertyGraph, symbol: str, limit: int = 10) -> DataFrame:
    """(id, heading, strength): sections that describe a symbol of that name."""
    named = graph.nodes.filter(F.col("name") == symbol).select(F.col("id").alias("dst"))
    edges = graph.edges_of("DOC_DESCRIBES").join(named, "dst", "left_semi")
    strength = F.coalesce(F.element_at("props", "strength").cast("double"), F.lit(1.0))
    rows = edges.groupBy(F.col("src").alias("id")).agg(F.max(strength).alias("strength"))
    return rows.join(graph.nodes.select("id", F.col("name").alias("heading")), "id").orderBy(F.desc("strength"), "id").limit(limit)


def ref_doc_scores(sections: DataFrame, query: str, symbol: str | None = None) -> DataFrame:
    """(id, score): term counts, threefold for terms in the heading; a symbol adds 10 in backticks, 5 in the text."""
    text, heading = F.lower(F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("content", F.lit("")))), F.lower(F.coalesce("heading", F.lit("")))
    score = F.lit(0)
    for t in query_tokens(query, 2):
        score = score + occurrences(F.col("_gl_text"), F.lit(t)) * F.when(F.contains(F.col("_gl_head"), F.lit(t)), 3).otherwise(1)
    if symbol:
        s = symbol.lower()
        quoted = F.exists(F.regexp_extract_all("_gl_text", F.lit("`([^`\n]+)`"), F.lit(1)), lambda r: F.contains(r, F.lit(s)))
        score = score + F.when(quoted, 10).when(F.contains(F.col("_gl_text"), F.lit(s)), 5).otherwise(0)
    return sections.withColumns({"_gl_text": text, "_gl_head": heading}).select("id", score.alias("score")).filter("score > 0")


def ref_code_scores(files: DataFrame, query: str, symbol: str | None = None) -> DataFrame:
    """(path, score): term counts in the content, 3 per term in the path, 5 per occurrence of a symbol."""
    score = F.lit(0)
    for t in query_tokens(query, 2):
        score = score + occurrences(F.col("_gl_text"), F.lit(t)) + F.contains(F.lower("path"), F.lit(t)).cast("int") * 3
    if symbol:
        score = score + occurrences(F.col("_gl_text"), F.lit(symbol.lower())) * 5
    return files.withColumn("_gl_text", F.lower(F.coalesce("content", F.lit("")))).select("path", score.alias("score")).filter("score > 0")


def excerpt(content: Column, terms: Sequence[str], symbol: str | None = None, around: int = 6) -> Column:
    """The best line with `around` lines each way; the first lines where none matches."""
    lines = F.split(content, "\n")

    def score(line: Column) -> Column:
        low = F.lower(line)
        s = F.when(F.contains(low, F.lit(symbol.lower())), 10).otherwise(0) if symbol else F.lit(0)
        for t in terms:
            s = s + F.contains(low, F.lit(t.lower())).cast("int")
        return s

    scored = F.transform(lines, lambda x, k: F.struct((-score(x)).alias("s"), k.alias("k")))
    best = F.array_min(scored)
    start = F.greatest(F.lit(0), best["k"] - around)
    part = F.slice(lines, start + 1, F.least(F.size(lines), best["k"] + around + 1) - start)
    return F.array_join(F.when(best["s"] == 0, F.slice(lines, 1, around * 2)).otherwise(part), "\n")


def resolve_element(nodes: DataFrame, element: str, project: str = "") -> DataFrame:
    """At most one node: exact id, scoped id, path or base name of a file, name of a function, then of a class."""
    asked = element.strip()
    path = asked.replace("\\", "/")
    parts = asked.split(":")
    tail = parts[-1]
    names = {asked, tail, parts[-2] if len(parts) > 2 and tail.isdigit() else tail, asked.split("::")[-1]}
    p = F.coalesce("path", F.lit(""))
    by_path = (p == path) | ((p != "") & (p.endswith(path) | F.lit(path).endswith(p) | (F.substring_index(p, "/", -1) == path.split("/")[-1]))) | F.col("id").endswith(":" + path)
    by_name = F.col("name").isin(*names) | F.col("id").endswith(":" + asked)
    rank = (
        F.when(F.col("id") == asked, 0)
        .when(F.col("id") == f"{project}:{asked}", 1)
        .when((F.col("type") == "FILE") & by_path, 2)
        .when((F.col("type") == "FUNCTION") & by_name, 3)
        .when((F.col("type") == "CLASS") & by_name, 4)
    )
    return nodes.withColumn("_gl_r", rank).filter(F.col("_gl_r").isNotNull()).orderBy("_gl_r", "id").limit(1).drop("_gl_r")


def clusters(elements: DataFrame, count: int = 5, samples: int = 5) -> DataFrame:
    """(cluster, size, sample): elements (id, path) by the first two segments of their path, root without one."""
    key = F.when(F.length(F.coalesce("path", F.lit(""))) > 0, F.substring_index("path", "/", 2)).otherwise("root")
    rows = elements.select("id", key.alias("cluster"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    some = rows.withColumn("_gl_r", rank).filter(F.col("_gl_r") <= samples).groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("sample"))
    return rows.groupBy("cluster").agg(F.count("*").alias("size")).join(some, "cluster").orderBy(F.desc("size"), "cluster").limit(count)


def property_diff(nodes: DataFrame, left: str, right: str) -> DataFrame:
    """(changed, left_only, right_only): comma-separated property names that differ between two nodes."""
    side = lambda i, n: nodes.filter(F.col("id") == i).limit(1).select(F.col("props").alias(n), F.lit(1).alias("_gl_1"))
    one = side(left, "a").join(side(right, "b"), "_gl_1")
    a, b = F.map_keys("a"), F.map_keys("b")
    changed = F.filter(F.array_intersect(a, b), lambda k: ~F.element_at("a", k).eqNullSafe(F.element_at("b", k)))
    text = lambda keys: F.array_join(F.array_sort(keys), ",")
    return one.select(text(changed).alias("changed"), text(F.array_except(a, b)).alias("left_only"), text(F.array_except(b, a)).alias("right_only"))


def duplicates_by_area(near: DataFrame, elements: DataFrame) -> DataFrame:
    """(area, n, ids): a ranking of neighbours grouped by the second segment of their path."""
    area = F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("root"))
    return near.join(elements.select("id", "path"), "id").groupBy(area.alias("area")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


def refactor_advice(near: DataFrame) -> DataFrame:
    """(neighbours, advice) of the ranking of an element's neighbours: unique below 2, high from 3 on."""
    n = F.count("*")
    return near.agg(n.alias("neighbours"), F.when(n < 2, "unique").when(n >= 3, "high").otherwise("medium").alias("advice"))


def entity_hints(vectors: DataFrame, query: list[float], limit: int = 5) -> DataFrame:
    """(id): the first 2k of the k nearest per type, k = limit within 1 and 10."""
    k = max(1, min(limit, 10))
    return vector_list(vectors, query, 3 * k).filter(F.col("rank") <= 2 * k).select("id")
