"""Finding source and markdown files, reading their texts, configuration files."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.layers import DEFAULT_LAYERS, Layer

# Extensions of source files with their languages, folders that hold documents, and folders left out.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java"}
DOC_FOLDERS = ["docs", "doc", "adr", "adrs", "decisions", "rfcs", "wiki", ".github"]
EXCLUDED = ["node_modules", "dist", ".git", "build", "coverage", ".next", "vendor"]
DOC_DEPTH, REF_DEPTH, REF_FILES, REF_DOCS = 6, 7, 120, 60


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All files at or below the given entries."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            system, path = fs.FileSystem.from_uri(uri)
            scheme = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
            info = system.get_file_info(path)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
            rows += [(scheme + f.path, f.size, f.mtime_ns // 1_000_000 if f.mtime_ns else None) for f in found if f.type == fs.FileType.File]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["uri", "bytes", "modified"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for k, uri in enumerate(batch.column(0).to_pylist()):  # a batch per file, so that large ones don't pile up
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), pa.array([text], pa.string())], ["uri", "bytes", "modified", "text"])


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, text, bytes, modified) of all files below a folder.

    Spark's own file sources hide names that begin with a dot or an underscore, which test folders
    and packages do. So the driver lists the top of the folder, and tasks list below and read.
    """
    from pyarrow import fs

    uri = root.rstrip("/") if "://" in root else "file://" + str(Path(root).resolve())
    system, path = fs.FileSystem.from_uri(uri)
    scheme = uri[: len(uri) - len(path)]
    top = [(scheme + f.path,) for f in system.get_file_info(fs.FileSelector(path, recursive=False))]
    tasks = max(1, spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame(top, "uri string").repartition(tasks).mapInArrow(_list, "uri string, bytes long, modified long")
    return listed.repartition(tasks * 2).mapInArrow(_read, "uri string, bytes long, modified long, text string").select(F.substring("uri", len(uri) + 2, 1 << 20).alias("relative_path"), "text", "bytes", "modified")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """The language by extension; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def _glob(pattern: str) -> str:
    from graphloom.operators.layers import glob_regex

    return glob_regex(pattern).replace(".*/", "(?:.*/)?")


def source_files(files: DataFrame, exclude: Sequence[str] = EXCLUDED) -> DataFrame:
    """Source files without those whose path contains an excluded part; parts with * are globs."""
    rows = files.filter(extension(F.col("relative_path")).isin(*LANGUAGES))
    for part in exclude:
        hit = F.col("relative_path").rlike(_glob(part)) if "*" in part else F.contains("relative_path", F.lit(part))
        rows = rows.filter(~hit)
    return rows.withColumn("language", language(F.col("relative_path")))


def markdown_files(files: DataFrame, exclude: Sequence[str] = EXCLUDED) -> DataFrame:
    """.md and .mdx files to a depth of 6: in the root and its folders, deeper only below document folders."""
    folders = F.split("relative_path", "/")
    inner = F.slice(folders, 2, F.greatest(F.size(folders) - 2, F.lit(0)))
    deeper_ok = (F.size(inner) == 0) | F.get(inner, F.size(inner) - 1).isin(*DOC_FOLDERS) | F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, DOC_FOLDERS)))
    rows = files.filter(extension(F.col("relative_path")).isin("md", "mdx") & (depth(F.col("relative_path")) <= DOC_DEPTH) & deeper_ok)
    return rows.filter(~F.arrays_overlap(F.split("relative_path", "/"), F.array(*map(F.lit, exclude))))


def _first(files: DataFrame, most: int | None) -> DataFrame:
    rows = files.orderBy("relative_path")
    return rows if most is None else rows.limit(most)


def reference_files(files: DataFrame, most: int | None = REF_FILES, deepest: int = REF_DEPTH) -> DataFrame:
    """The first source files of a reference repository by path, to a depth; all of them if `most` is None."""
    return _first(source_files(files).filter(depth(F.col("relative_path")) <= deepest), most)


def reference_documents(files: DataFrame, most: int | None = REF_DOCS) -> DataFrame:
    return _first(markdown_files(files), most)


def folder_tree(files: DataFrame, levels: int = 3, entries: int = 40) -> DataFrame:
    """(folder, entry): the first entries of each folder, a few levels deep."""
    from pyspark.sql.window import Window

    parts = F.split("relative_path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.least(F.lit(levels), F.size(parts))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n - 1), "/").alias("folder"), F.get(parts, n - 1).alias("entry")))
    rows = files.select(F.explode(steps).alias("x")).select("x.*").distinct()
    rank = F.row_number().over(Window.partitionBy("folder").orderBy("entry"))
    return rows.withColumn("_gl_n", rank).filter(F.col("_gl_n") <= entries).drop("_gl_n")


def load_layers(path: str | None) -> list[Layer]:
    """Layers of a JSON configuration ({architecture: {layers: [...]}}); the defaults if the file doesn't exist."""
    if path is None or not Path(path).exists():
        return list(DEFAULT_LAYERS)
    rows = json.loads(Path(path).read_text())["architecture"]["layers"]
    return [Layer(r["id"], r["paths"], r.get("canImport", []), r.get("cannotImport", []), r.get("name", "")) for r in rows]
