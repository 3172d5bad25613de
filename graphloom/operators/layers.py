"""Architecture layers: assignment of files, import rules, violations and placement.

Layers are a configuration (a few rows), so their globs and permissions become literal expressions
of the plan; files and imports are joined once per end.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layer:
    id: str
    paths: Sequence[str]
    can_import: Sequence[str] = field(default_factory=tuple)
    cannot_import: Sequence[str] = field(default_factory=tuple)
    name: str = ""


# The default layers, bottom up, with the layers they may import.
DEFAULT_LAYERS = (
    Layer("types", ["src/types/**"]),
    Layer("utils", ["src/utils/**", "src/lib/**", "src/helpers/**"], ["types"]),
    Layer("parsers", ["src/parsers/**"], ["types", "utils"]),
    Layer("graph", ["src/graph/**"], ["types", "utils", "parsers"]),
    Layer("vector", ["src/vector/**"], ["types", "utils", "graph"]),
    Layer("engines", ["src/engines/**"], ["types", "utils", "parsers", "graph", "vector"]),
    Layer("tools", ["src/tools/**"], ["types", "utils", "parsers", "graph", "vector", "engines"]),
    Layer("server", ["src/*.ts"], ["types", "utils", "graph", "vector", "engines", "tools"]),
)

# The words in layer ids that suit a kind of code, best first.
AFFINITY = {
    "component": ["component", "ui", "view", "page", "widget", "presentation"],
    "hook": ["hook", "custom"],
    "service": ["service", "api", "engine", "lib", "utils"],
    "context": ["context", "store", "state", "provider"],
    "utility": ["util", "lib", "common", "shared", "helper"],
    "engine": ["engine", "service", "lib"],
    "class": ["engine", "service", "lib", "model"],
    "module": ["lib", "util", "common", "shared"],
}


def glob_regex(glob: str) -> str:
    """** crosses folders, * stays within one, ? is one character; all else is literal."""
    out = []
    for part in re.split(r"(\*\*|\*|\?)", glob):
        out.append({"**": ".*", "*": "[^/]*", "?": "."}.get(part, re.escape(part)))
    return "^" + "".join(out) + "$"


def layer_of(path: Column, layers: Sequence[Layer] = DEFAULT_LAYERS) -> Column:
    """The id of the first layer with a matching path; null without one."""
    out = F.lit(None).cast("string")
    for layer in reversed(layers):
        hit = F.lit(False)
        for g in layer.paths:
            hit = hit | path.rlike(glob_regex(g))
        out = F.when(hit, layer.id).otherwise(out)
    return out


def allowed(source: Column, target: Column, layers: Sequence[Layer] = DEFAULT_LAYERS) -> Column:
    """Whether a layer may import another: itself, anything with *, else those listed."""
    ok = source == target
    for layer in layers:
        if "*" in layer.can_import:
            ok = ok | (source == layer.id)
        elif layer.can_import:
            ok = ok | ((source == layer.id) & target.isin(*layer.can_import))
    return ok


def forbidden(source: Column, target: Column, layers: Sequence[Layer] = DEFAULT_LAYERS) -> Column:
    out = F.lit(False)
    for layer in layers:
        if layer.cannot_import:
            out = out | ((source == layer.id) & target.isin(*layer.cannot_import))
    return out


def violations(imports: DataFrame, layers: Sequence[Layer] = DEFAULT_LAYERS) -> DataFrame:
    """(file, target, kind, severity, source_layer, target_layer) for imports (file, target) of paths.

    Imports that aren't allowed and imports that are forbidden are errors of their own; a file
    without layer gives one warning.
    """
    rows = imports.select("file", "target", layer_of(F.col("file"), layers).alias("source_layer"), layer_of(F.col("target"), layers).alias("target_layer"))
    s, t = F.col("source_layer"), F.col("target_layer")
    return check_layers(rows, allowed(s, t, layers), forbidden(s, t, layers))


def check_layers(rows: DataFrame, may: Column, must_not: Column) -> DataFrame:
    """violations() of rows whose layers are known by other means."""
    s, t = F.col("source_layer"), F.col("target_layer")
    known = s.isNotNull() & t.isNotNull()
    kinds = F.array_compact(F.array(F.when(known & ~may, "not-allowed"), F.when(known & must_not, "forbidden")))
    errors = rows.withColumn("kind", F.explode(kinds)).select("file", "target", "kind", F.lit("error").alias("severity"), "source_layer", "target_layer")
    none = F.lit(None).cast("string")
    homeless = rows.filter(s.isNull()).select("file", none.alias("target"), F.lit("no-layer").alias("kind"), F.lit("warn").alias("severity"), none.alias("source_layer"), none.alias("target_layer"))
    return errors.distinct().unionByName(homeless.distinct())


def statistics(found: DataFrame, files: DataFrame) -> DataFrame:
    """(files, violations, errors, warnings, success): one row."""
    v = found.agg(F.count("*").alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings")).withColumn("_gl_1", F.lit(1))
    n = files.agg(F.count("*").alias("files")).withColumn("_gl_1", F.lit(1))
    return n.join(v, "_gl_1").drop("_gl_1").withColumn("success", F.col("errors") == 0)


def rule_edges(found: DataFrame, now: int) -> DataFrame:
    """VIOLATES_RULE edges (src, dst, type, severity, message, timestamp); the rule is named by the kind."""
    message = F.concat_ws(" ", F.col("source_layer"), F.when(F.col("target").isNotNull(), "imports"), F.col("target_layer"), F.when(F.col("target").isNull(), "file belongs to no layer"))
    return found.select(F.col("file").alias("src"), F.concat(F.lit("rule:"), F.col("kind")).alias("dst"), F.lit("VIOLATES_RULE").alias("type"), "severity", message.alias("message"), F.lit(now).alias("timestamp")).distinct()


def suggest(name: str, kind: str, dependencies: Sequence[str] = (), layers: Sequence[Layer] = DEFAULT_LAYERS, extension: str = ".ts") -> tuple[str, str] | None:
    """(layer, path) for new code: of the layers that may import every dependency the one with the best affinity.

    Works on the configuration alone. Dependencies that are no layers are ignored.
    """
    known = {x.id for x in layers}
    needed = set(dependencies) & known

    def can(layer: Layer) -> bool:
        return all(d == layer.id or "*" in layer.can_import or d in layer.can_import for d in needed)

    words = AFFINITY.get(kind, [])

    def affinity(layer: Layer) -> int:
        return next((len(words) - k for k, w in enumerate(words) if w in layer.id.lower()), 0)

    fit = [x for x in layers if can(x)]
    if not fit:
        return None
    best = max(fit, key=affinity)  # the first of equals
    stem = name
    if kind == "hook" and not name.startswith("use"):
        stem = "use" + name
    has_extension = re.search(r"\.[^/\\]+$", stem) is not None
    if kind == "service" and not has_extension and not name.endswith("Service"):
        stem += "Service"
    folder = re.sub(r"/\*$", "", best.paths[0].replace("/**", ""))
    return best.id, f"{folder}/{stem if has_extension else stem + extension}"
