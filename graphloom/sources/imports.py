"""Resolution of imports to files, as ranked candidates joined to the known paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import dirname

# What is tried after the path of an import, by language, in order.
SUFFIXES = {
    "typescript": ["", ".ts", ".tsx", "/index.ts", "/index.tsx", ".js", ".jsx"],
    "javascript": ["", ".js", ".jsx", ".mjs", ".cjs", "/index.js", ".ts", ".tsx"],
    "python": [".py", "/__init__.py"],
    "go": ["", ".go"],
    "rust": [".rs", "/mod.rs"],
    "java": [".java"],
}


def joined_path(folder: Column, relative: Column) -> Column:
    """folder/relative with . and .. resolved; never above the root."""
    parts = F.split(F.concat_ws("/", F.when(folder != ".", folder), relative), "/")
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def import_path(file: Column, source: Column, language: Column) -> Column:
    """The path an import stands for, without its suffix; null for packages from elsewhere."""
    plain = F.regexp_replace(source, r"\.(js|jsx)$", "")
    es = F.when(source.startswith("."), joined_path(dirname(file), plain)).when(source.startswith("src/"), plain)
    level = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    dotted = F.replace(F.regexp_replace(source, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(level - 1, F.lit(0))), "/")
    py = F.when(level > 0, joined_path(dirname(file), F.concat_ws("/", F.when(F.length(up) > 0, up), dotted))).otherwise(dotted)
    rust = F.replace(F.regexp_replace(source, r"^crate::", "src::"), F.lit("::"), F.lit("/"))
    return F.when(language.isin("typescript", "javascript"), es).when(language == "python", py).when(language == "rust", rust).when(language == "java", F.replace(source, F.lit("."), F.lit("/"))).otherwise(source)


def resolve_imports(imports: DataFrame, files: DataFrame, guess: bool = False) -> DataFrame:
    """imports (relative_path, language, source, ...) with target, the best candidate among files (relative_path).

    Unresolved imports have a null target, or with `guess` the first candidate. Paths equal exactly.
    """
    tries = F.create_map(*[x for k, v in SUFFIXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    keyed = imports.withColumn("_gl_p", import_path(F.col("relative_path"), F.col("source"), F.col("language")))
    wanted = keyed.filter("_gl_p is not null").select("relative_path", "source", F.posexplode(F.transform(F.element_at(tries, F.col("language")), lambda s: F.concat("_gl_p", s))).alias("_gl_k", "_gl_c")).distinct()
    hits = wanted.join(files.select(F.col("relative_path").alias("_gl_c")).distinct(), "_gl_c")
    best = hits.groupBy("relative_path", "source").agg(F.min_by("_gl_c", "_gl_k").alias("target"))
    out = keyed.join(best, ["relative_path", "source"], "left")
    if guess:
        out = out.withColumn("target", F.coalesce("target", F.concat("_gl_p", F.get(F.element_at(tries, F.col("language")), F.lit(0)))))
    return out.drop("_gl_p")


def import_sources(files: DataFrame) -> DataFrame:
    """(relative_path, language, source): what files import, by expressions alone; each once.

    For rule checks, where line numbers and names aren't needed. Dots of Python modules are slashes.
    """
    text = F.col("text")
    find = lambda p, k=1: F.regexp_extract_all(text, F.lit(p), F.lit(k))
    slashed = lambda a: F.transform(a, lambda x: F.replace(x, F.lit("."), F.lit("/")))
    block = F.flatten(F.transform(find(r"import\s*\(([^)]*)\)"), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1))))
    by_language = (
        F.when(F.col("language").isin("typescript", "javascript"), find(r"(?:import|export)\s+(?:[^\"';]*?\s+)?from\s+['\"]([^'\"]+)['\"]"))
        .when(F.col("language") == "python", F.concat(slashed(find(r"(?m)^from\s+([\w.]+)\s+import\s")), slashed(find(r"(?m)^import\s+([\w.]+)"))))
        .when(F.col("language") == "go", F.concat(block, find(r"import\s+\"([^\"]+)\"")))
    )
    return files.select("relative_path", "language", F.explode(F.array_distinct(by_language)).alias("source"))
