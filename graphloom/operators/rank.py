"""PageRank family: personalised power iteration, global rank and their blend with proximity.

Edges stay where they are read: a task packs them into units, each with its own numbers for the nodes it
meets, so no edge is ever shuffled, a hub's edges lie in as many units as they fill, and an edge takes
about four bytes. Nodes lie in blocks by the hash of their id; a block knows the places of its nodes in
each unit. A round sends every unit the ranks of its sources and every block the sums of its nodes, as
arrays of numbers in the order of those places; arrays of zeros aren't sent. Units and blocks are bucketed
tables in the checkpoint folder, which the rounds read as they are partitioned. The messages after a round
are written there too, the shuffle files are freed and the messages before are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.model import CODE, RANK_WEIGHTS
from graphloom.operators.skew import local_table
from graphloom.operators.traverse import proximity, type_weight
from graphloom.session import removed, shared_path, shuffles_freed, written

#: Edges of a unit.
UNIT_ROWS = 1 << 21

# part 0, a row a unit: edges per place of a source, the place of each edge's target, its weight (or one for all), and the
# blocks in order of the places with the places each has; part 1, a row for each block of a unit: the ids at its places, as bytes with their sizes
UNITS = "unit long, part int, block int, counts binary, to binary, w binary, src_blocks binary, src_places binary, dst_blocks binary, dst_places binary, srcs binary, srcs_sizes binary, dsts binary, dsts_sizes binary, t binary"
# of unit -1: the nodes of a block, which of them count, restart, first rank (or NaN) and 1 / weight that leaves; of others, in a row each: the nodes at the places of its sources, and of its targets
BLOCKS = "block int, unit long, n int, names array<string>, counted binary, base binary, rank binary, inverse binary, src binary, dst binary"
MESSAGES = "block int, unit long, v binary"
SENT = pa.schema([("block", pa.int32()), ("unit", pa.int64()), ("v", pa.binary())])
NODES = -1


def _edges(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(src, dst, w), a row an edge."""
    return edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst", type_weight(weights).alias("w"))


def _weighted(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(src, dst, w): the weight of each pair; parallel edges add up."""
    return _edges(edges, weights).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _array(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _text(names: pa.Array, begin: int, end: int) -> tuple[bytes, bytes]:
    """The bytes of some of the names, and the size of each."""
    names = names.slice(begin, end - begin)
    ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]
    data = names.buffers()[2]
    return b"" if data is None or not len(names) else data[int(ends[0]) : int(ends[-1])].to_pybytes(), np.diff(ends).tobytes()


def _names(text: pa.Scalar, sizes: pa.Scalar) -> pa.Array:
    sizes = _array(sizes, np.int32)
    ends = np.cumsum(np.concatenate([[0], sizes])).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), text.as_buffer())


def _places(ids: pa.ChunkedArray, blocks: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The place of each id among the different ids, which are ordered by block; these, and their blocks."""
    coded = ids.cast(pa.string()).combine_chunks().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    at = np.zeros(len(names), np.int32)
    at[codes] = blocks
    order = np.argsort(at, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[codes], names.take(pa.array(order)), at[order]


def _unit(rows: pa.Table, unit: int) -> Iterator[pa.RecordBatch]:
    src, srcs, src_at = _places(rows["src"], rows["src_block"].to_numpy())
    dst, dsts, dst_at = _places(rows["dst"], rows["dst_block"].to_numpy())
    order = np.argsort(src, kind="stable")
    w = rows["w"].to_numpy()[order]
    t = np.bincount(src[order], w, len(srcs))
    if len(w) and (w == w[0]).all():
        w = w[:1]
    counts = np.bincount(src, minlength=len(srcs)).astype(np.int32)
    out = {c: [] for c in ("unit", "part", "block", "counts", "to", "w", "src_blocks", "src_places", "dst_blocks", "dst_places", "srcs", "srcs_sizes", "dsts", "dsts_sizes", "t")}

    def add(**row) -> None:
        for c, values in out.items():
            values.append(row.get(c))

    (sb, sn), (db, dn) = (np.unique(x, return_counts=True) for x in (src_at, dst_at))
    byte = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    add(unit=unit, part=0, block=NODES, counts=byte(counts, np.int32), to=byte(dst[order], np.int32), w=byte(w, np.float64), src_blocks=byte(sb, np.int32), src_places=byte(sn, np.int32), dst_blocks=byte(db, np.int32), dst_places=byte(dn, np.int32))
    for b in np.union1d(sb, db):
        (s, s_end), (d, d_end) = ((int(np.searchsorted(x, b)), int(np.searchsorted(x, b, "right"))) for x in (src_at, dst_at))
        (src_text, src_sizes), (dst_text, dst_sizes) = _text(srcs, s, s_end), _text(dsts, d, d_end)
        add(unit=unit, part=1, block=int(b), srcs=src_text, srcs_sizes=src_sizes, dsts=dst_text, dsts_sizes=dst_sizes, t=byte(t[s:s_end], np.float64))
    kinds = {"unit": pa.int64(), "part": pa.int32(), "block": pa.int32()}
    yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()], list(out))


def _packed(rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= rows:
                table = pa.Table.from_batches(held)
                yield from _unit(table.slice(0, rows), unit)
                held, n, unit = table.slice(rows).to_batches(), n - rows, unit + 1
        if n:
            yield from _unit(pa.Table.from_batches(held), unit)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def _block(everyone: bool) -> Callable:
    """The nodes of a block: those given, and those of the units, which count if everyone does."""

    def run(key: tuple, units: pa.Table, nodes: pa.Table) -> pa.Table:
        lists = [nodes["id"].combine_chunks().cast(pa.string())]
        order = np.argsort(units["unit"].to_numpy(), kind="stable")
        for k in order:
            lists += [_names(units[c][int(k)], units[f"{c}_sizes"][int(k)]) for c in ("srcs", "dsts")]
        coded = pa.concat_arrays(lists).dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
        ends = np.cumsum([len(x) for x in lists])
        given = codes[: ends[0]]
        counted = np.full(len(names), everyone, np.uint8)
        base, rank, t = np.zeros(len(names)), np.full(len(names), np.nan), np.zeros(len(names))
        counted[given] = 1
        base[given] = nodes["base"].to_numpy()
        rank[given] = nodes["rank"].to_numpy(zero_copy_only=False)
        out = []
        for i, k in enumerate(order):
            src, dst = (codes[ends[2 * i + j] : ends[2 * i + j + 1]] for j in (0, 1))
            t[src] += _array(units["t"][int(k)], np.float64)
            out.append((int(units["unit"][int(k)].as_py()), src.tobytes(), dst.tobytes()))
        inverse = np.divide(1.0, t, out=np.zeros(len(t)), where=t > 0)
        one = {"unit": NODES, "n": int(counted.sum()), "counted": counted.tobytes(), "base": base.tobytes(), "rank": rank.tobytes(), "inverse": inverse.tobytes()}
        rows = [one, *({"unit": u, c: x} for u, s, d in out for c, x in (("src", s), ("dst", d)) if x)]
        kinds = {"block": pa.int32(), "unit": pa.int64(), "n": pa.int32()}
        column = lambda c: pa.array([key[0].as_py() if c == "block" else r.get(c) for r in rows], kinds.get(c, pa.binary()))
        kept = names.filter(pa.array(counted.astype(bool)))
        listed = pa.ListArray.from_arrays(pa.array([0] + [len(kept)] * len(rows), pa.int32()), kept)
        return pa.table({c: listed if c == "names" else column(c) for c in ("block", "unit", "n", "names", "counted", "base", "rank", "inverse", "src", "dst")})

    return run


def _sums(key: tuple, unit: pa.Table, ranks: pa.Table) -> pa.Table:
    """What flows out of a unit, summed per target."""
    if not unit.num_rows or not ranks.num_rows:
        return SENT.empty_table()
    row = {c: unit[c][0] for c in unit.column_names}
    counts = _array(row["counts"], np.int32)
    begins = dict(zip(_array(row["src_blocks"], np.int32).tolist(), np.cumsum([0, *_array(row["src_places"], np.int32)])[:-1].tolist()))
    sent = np.zeros(len(counts))
    for b, v in zip(ranks["block"], ranks["v"]):
        v = _array(v, np.float64)
        sent[(at := begins[b.as_py()]) : at + len(v)] = v
    dst_places = _array(row["dst_places"], np.int32)
    sums = np.bincount(_array(row["to"], np.int32), np.repeat(sent, counts) * _array(row["w"], np.float64), int(dst_places.sum()))
    parts = np.split(sums, np.cumsum(dst_places)[:-1])
    rows = [(b, v.tobytes()) for b, v in zip(_array(row["dst_blocks"], np.int32).tolist(), parts) if v.any()]
    return pa.table([[b for b, _ in rows], [row["unit"].as_py()] * len(rows), [v for _, v in rows]], schema=SENT)


def _ranks(damping: float, start: float | None, last: bool) -> Callable:
    """The ranks of a block, sent to its units, or at last returned; at the start, the first ranks."""

    def run(key: tuple, block: pa.Table, sums: pa.Table) -> pa.Table:
        units = block["unit"].to_pylist()
        if NODES not in units:
            return SENT.empty_table()
        of = lambda c, kind: _array(block[c][units.index(NODES)], kind)
        counted = of("counted", np.uint8)
        if start is not None:
            rank = np.nan_to_num(of("rank", np.float64), nan=start)
        else:
            inflow = np.zeros(len(counted))
            at = {u: k for k, (u, d) in enumerate(zip(units, block["dst"])) if d.is_valid}
            for u, v in sorted(zip(sums["unit"].to_pylist(), sums["v"]), key=lambda x: x[0]):
                inflow[_array(block["dst"][at[u]], np.int32)] += _array(v, np.float64)
            rank = (1 - damping) * of("base", np.float64) + damping * inflow
        rank = rank * counted
        if last:
            rows = [(NODES, rank[counted > 0])]
        else:
            sent = rank * of("inverse", np.float64)
            rows = [(u, v) for u, s in zip(units, block["src"]) if s.is_valid and (v := sent[_array(s, np.int32)]).any()]
        return pa.table([[key[0].as_py()] * len(rows), [u for u, _ in rows], [v.tobytes() for _, v in rows]], schema=SENT)

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, v in zip(batch["names"], batch["v"]):
            yield pa.RecordBatch.from_arrays([names.values, pa.array(_array(v, np.float64))], ["id", "rank"])


def _iterate(nodes: DataFrame, weighted: DataFrame, damping: float, rounds: int, min_rows: int = UNIT_ROWS, everyone: bool = False) -> DataFrame:
    """rank' = (1 - damping) * base + damping * inflow over nodes (id, base, rank); an edge carries its part of the weight that leaves its source.

    If everyone counts, all ends of edges are nodes too, and nodes without a rank start with 1 / their number.
    A unit has at most min_rows edges. There are as many blocks as shuffle partitions.
    """
    spark = nodes.sparkSession
    parts = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    folder = shared_path(spark, "rank")
    names = [f"gl_{k}_{uuid.uuid4().hex}" for k in ("units", "blocks")]

    def bucketed(df: DataFrame, k: int, by: str, *apart: str) -> DataFrame:
        with shuffles_freed(spark):
            writer = df.write.option("path", f"{folder}/{names[k]}").option("compression", "zstd").bucketBy(parts, by)
            (writer.partitionBy(*apart) if apart else writer).saveAsTable(names[k])
        return spark.table(names[k])

    try:
        numbered = weighted.select("src", "dst", F.col("w").cast("double").alias("w"), block_of("src").alias("src_block"), block_of("dst").alias("dst_block"))
        both = bucketed(numbered.mapInArrow(_packed(min_rows), UNITS), 0, "unit", "part")
        units = both.filter("part = 0").select("unit", "counts", "to", "w", "src_blocks", "src_places", "dst_blocks", "dst_places")
        met = both.filter("part = 1").select("block", "unit", "srcs", "srcs_sizes", "dsts", "dsts_sizes", "t")
        given = nodes.select(F.col("id").cast("string").alias("id"), F.col("base").cast("double").alias("base"), F.col("rank").cast("double").alias("rank")).withColumn("block", block_of("id"))
        every = bucketed(met.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_block(everyone), BLOCKS), 1, "block")
        removed(spark, f"{folder}/{names[0]}/part=1")
        n = every.agg(F.sum("n")).first()[0] or 1
        blocks = lambda active: every.filter(F.col("dst").isNull() | F.col("unit").isin(active)).select("block", "unit", "counted", "base", "rank", "inverse", "src", "dst").groupBy("block")
        nothing = local_table(spark, [], MESSAGES)
        sent = written(blocks([]).cogroup(nothing.groupBy("block")).applyInArrow(_ranks(damping, 1 / n, False), MESSAGES), f"{folder}/0")
        for k in range(1, rounds + 1):
            active = [u for (u,) in sent.select("unit").distinct().collect()]  # an entry for min_rows edges
            sums = units.filter(F.col("unit").isin(active)).groupBy("unit").cogroup(sent.groupBy("unit")).applyInArrow(_sums, MESSAGES)
            sent = written(blocks(active).cogroup(sums.groupBy("block")).applyInArrow(_ranks(damping, None, k == rounds), MESSAGES), f"{folder}/{k}")
            removed(spark, f"{folder}/{k - 1}")
        ranks = every.filter(F.col("unit") == NODES).select("block", "names").join(sent.select("block", "v").hint("merge"), "block").select("names", "v")
        return written(ranks.mapInArrow(_named, "id string, rank double"), shared_path(spark, "ranks"))
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(spark, folder)


def personalised_pagerank(graph: PropertyGraph, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, weights: dict[str, float] | None = None, limit: int | None = 50) -> DataFrame:
    """(id, score): power iteration from a uniform start with restarts at the seeds; mass at sinks is lost.

    Nodes are the ends of edges and the seeds. Without seeds there is no result.
    """
    rounds = max(1, min(100, rounds))
    starts = seeds.select("id").filter(F.col("id").isNotNull()).distinct()
    s = starts.count()
    if not s:
        return local_table(seeds.sparkSession, [], "id string, score double")
    nodes = starts.select("id", F.lit(1.0 / s).alias("base"), F.lit(None).cast("double").alias("rank"))
    out = _iterate(nodes, _edges(graph.edges, {**RANK_WEIGHTS, **(weights or {})}), damping, rounds, everyone=True).select("id", F.round("rank", 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(max(1, min(500, limit)))


def pagerank(graph: PropertyGraph, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank): unweighted global PageRank of all nodes with a uniform restart; parallel edges count once."""
    ids = graph.nodes.select("id").distinct().withColumn("_gl_1", F.lit(1))
    n = ids.agg(F.count("*").alias("n")).withColumn("_gl_1", F.lit(1))
    nodes = ids.join(F.broadcast(n), "_gl_1").select("id", (1 / F.col("n")).alias("base"), (1 / F.col("n")).alias("rank"))
    return _iterate(nodes, _edges(graph.edges.select("src", "dst", F.lit("").alias("type")).distinct(), {}), damping, rounds).select("id", F.round("rank", 9).alias("rank"))


def blended_rank(graph: PropertyGraph, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, limit: int = 50, ranks: DataFrame | None = None) -> DataFrame:
    """(id, score): rank * (1 - damping) + proximity * damping over code nodes and seeds."""
    ranks = pagerank(graph, damping, rounds) if ranks is None else ranks
    ranks = ranks.join(graph.label(*CODE).select("id"), "id", "left_semi")
    near = proximity(graph, seeds).select("id", F.col("score").alias("near"))
    score = F.coalesce("rank", F.lit(0.0)) * (1 - damping) + F.coalesce("near", F.lit(0.0)) * damping
    return ranks.join(near, "id", "full_outer").select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(max(1, min(500, limit)))
