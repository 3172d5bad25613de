"""The k most similar vectors of every vector, by cosine: an inverted index with adaptive scans.

Vectors are normalised, rotated by a fixed random rotation and quantised to 16 bits; equal ones form
a class, whatever their ids and lengths, so copies are searched once. Cells are centroids trained on
a bounded sample (TRAIN vectors; dense regions get as many more centroids as they have vectors, and
a centroid with much more than its share is split). Every class is a member of its nearest cell and
a query in those of its PROBES nearest ones whose centroid is at most MARGIN less similar than the nearest.
A cell with more than PART_ROWS members, by the sample, is divided into parts by class; queries ask all
parts, so no group grows with the data.

Within a cell, members are organised in lists. A query scans its nearest lists in column blocks of
BLOCK dimensions: because the rotation spreads the distance evenly, the partial distance estimates
the whole, and a candidate whose estimate exceeds the query's current k-th distance by a test at
EPSILON / sqrt(dimensions) is abandoned. The partial results of the cells are merged per class.

All vectors are indexed; only the centroids and the numbers of parts depend on the sample. Recall is
measured in tests. exact=True asks every cell and abandons nothing.

Defined results: vectors of another length, with null, NaN or infinite numbers, or all zero, take no
part; rows without id neither; repeated rows count once; ties go to the smaller id; copies are each
other's most similar; fewer than k others give fewer rows; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.skew import MIN_ROWS, PARTS

DIM = 128
TRAIN = 65_536
CELL_ROWS = 2_048
MAX_CELLS = 8_192
PART_ROWS = 32_768
PROBES = 6
MARGIN = 0.12
LIST_ROWS = 256
LIST_SHARE = 0.6
BLOCK = 32
EPSILON = 2.1
SEED = 11
SCALE = 32_767


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: str, dim: int = DIM) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _coded(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16-bit codes of the rotated unit vectors, their scales, and the class keys."""
    top = np.abs(vectors).max(1, keepdims=True)  # first, so that norms neither overflow nor vanish
    unit = vectors / top
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True) @ turn
    scale = np.abs(unit).max(1, keepdims=True)
    code = np.rint(unit / scale * SCALE).astype(np.int16)
    odd = np.random.default_rng(SEED + 1).integers(-(2**63), 2**63 - 1, size=(2, vectors.shape[1] + 1), dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        x = np.hstack([code.astype(np.int64), np.rint(scale * 1e6).astype(np.int64)])
        key = (x * odd[0]).sum(1)
        key = (key ^ (key >> 31)) * odd[1][0] + (x * odd[1]).sum(1)
    return code, (scale[:, 0] / SCALE).astype(np.float32), key


def _kmeans(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    """k unit centroids by spherical k-means; fewer if x has fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def train_cells(sample: np.ndarray, cells: int, seed: int = SEED) -> np.ndarray:
    """Centroids of the cells; one that takes over four times its share of the sample is split."""
    if not len(sample):
        return np.zeros((1, DIM), np.float32)
    c = _kmeans(sample, cells, 8, seed)
    for turn in range(4):
        near = np.concatenate([(sample[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(sample), 8192)])
        counts = np.bincount(near, minlength=len(c))
        large = np.flatnonzero(counts > 4 * max(8, len(sample) / len(c)))
        if not len(large):
            break
        parts = [_kmeans(sample[near == g], int(np.ceil(counts[g] / max(8, len(sample) / len(c)))), 4, seed + turn) for g in large]
        c = np.vstack([np.delete(c, large, 0), *parts])
    return c.astype(np.float32)


def _scan(queries: np.ndarray, q_keys: np.ndarray, members: np.ndarray, m_keys: np.ndarray, k: int, share: float = LIST_SHARE, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(nearest member numbers, squared distances) of each query, -1 and inf where there are fewer."""
    dim = members.shape[1]
    lists = _kmeans(members, max(1, round(len(members) / LIST_ROWS)), 3, SEED)
    of = (members @ lists.T).argmax(1)
    order = np.argsort(of, kind="stable")  # so that a list is a slice
    members, m_keys, begins = members[order], m_keys[order], np.searchsorted(of[order], np.arange(len(lists) + 1))
    rank = np.argsort(-(queries @ lists.T), axis=1)[:, : max(1, int(np.ceil(share * len(lists))))]
    best_d = np.full((len(queries), k), np.inf, np.float32)
    best_m = np.full((len(queries), k), -1, np.int64)
    blocks = [slice(a, min(a + BLOCK, dim)) for a in range(0, dim, BLOCK)]
    for r in range(rank.shape[1]):  # nearest lists first, so that thresholds are tight early
        asking = np.argsort(rank[:, r], kind="stable")
        bounds = np.searchsorted(rank[asking, r], np.arange(len(lists) + 1))
        for l in range(len(lists)):
            rows, ids = asking[bounds[l] : bounds[l + 1]], np.arange(begins[l], begins[l + 1])
            for a in range(0, len(rows) if len(ids) else 0, 1024):
                part = rows[a : a + 1024]
                limit = best_d[part, -1]
                i, j, dist = _adaptive(queries[part], members[ids[0] : ids[-1] + 1], limit, blocks, k + 1, epsilon)
                other = (q_keys[part[i]] != m_keys[ids[j]]) & (dist < limit[i])
                i, j, dist = i[other], ids[j[other]], dist[other]
                _merge(best_d, best_m, part, i, j, dist, k)
    return np.where(best_m >= 0, order[best_m], -1), best_d


def _adaptive(q: np.ndarray, m: np.ndarray, limit: np.ndarray, blocks: list[slice], keep: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, squared distance) of the pairs that no test abandons; where few are, of the `keep` nearest.

    keep is one more than the neighbours wanted, as a query may find itself.
    """
    dim = q.shape[1]
    first = blocks[0]
    part = (q[:, first] ** 2).sum(1)[:, None] + (m[:, first] ** 2).sum(1)[None, :] - 2 * q[:, first] @ m[:, first].T
    seen = first.stop
    i, j = np.nonzero(part <= (limit * (seen / dim) * (1 + epsilon / np.sqrt(seen)) ** 2)[:, None])
    if len(i) > 0.25 * part.size:  # no threshold yet: the rest at once
        rest = slice(first.stop, dim)
        part = part + (q[:, rest] ** 2).sum(1)[:, None] + (m[:, rest] ** 2).sum(1)[None, :] - 2 * q[:, rest] @ m[:, rest].T
        n = min(keep, part.shape[1])
        near = np.argpartition(part, n - 1, axis=1)[:, :n]
        i = np.repeat(np.arange(len(part)), n)
        return i, near.ravel(), np.maximum(part[i, near.ravel()], 0)
    dist = part[i, j]
    for b in blocks[1:]:
        dist = dist + ((q[i, b] - m[j, b]) ** 2).sum(1)
        seen = b.stop
        test = (1 + epsilon / np.sqrt(seen)) ** 2 if seen < dim else 1.0
        stay = dist <= limit[i] * (seen / dim) * test
        i, j, dist = i[stay], j[stay], dist[stay]
    return i, j, np.maximum(dist, 0)


def _merge(best_d: np.ndarray, best_m: np.ndarray, part: np.ndarray, i: np.ndarray, j: np.ndarray, dist: np.ndarray, k: int) -> None:
    """Put the k nearest of the found pairs and of the best so far in place."""
    if not len(i):
        return
    order = np.lexsort((j, dist, i))
    i, j, dist = i[order], j[order], dist[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    top = place < k
    hit, at = np.unique(i[top], return_inverse=True)
    d = np.full((len(hit), 2 * k), np.inf, np.float32)
    m = np.full((len(hit), 2 * k), -1, np.int64)
    d[at, place[top]], m[at, place[top]] = dist[top], j[top]
    d[:, k:], m[:, k:] = best_d[part[hit]], best_m[part[hit]]
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    best_d[part[hit]], best_m[part[hit]] = np.take_along_axis(d, order, 1), np.take_along_axis(m, order, 1)


ROUTED = "cell int, part int, member boolean, key long, scale float, code binary"
NEAR = "key long, others array<long>, dots array<double>"


def _route(turn: np.ndarray, cells: np.ndarray, parts: np.ndarray, dim: int, probes: int, margin: float):
    schema = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("member", pa.bool_()), ("key", pa.int64()), ("scale", pa.float32()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, scale, key = _coded(_matrix(batch.column(0), dim), turn)
            new = np.unique(key, return_index=True)[1]  # copies further apart meet in their cell
            code, scale, key = code[new], scale[new], key[new]
            near = (code.astype(np.float32) * scale[:, None]) @ cells.T
            n = min(probes, near.shape[1])
            top = np.argpartition(-near, n - 1, axis=1)[:, :n]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1), 1)
            score = np.take_along_axis(near, top, 1)
            row, place = np.nonzero(score >= score[:, :1] - margin)
            cell = top[row, place]
            times = parts[cell]  # every part of a cell is asked, one has the member
            row, place, cell = (np.repeat(v, times) for v in (row, place, cell))
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            member = (place == 0) & (part == key[row] % parts[cell])
            data = [c.tobytes() for c in code]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(member), pa.array(key[row]), pa.array(scale[row]), pa.array([data[r] for r in row], pa.binary())], schema=schema
            )

    return run


def _search(dim: int, k: int, share: float, epsilon: float):
    schema = pa.schema([("key", pa.int64()), ("others", pa.list_(pa.int64())), ("dots", pa.list_(pa.float64()))])

    def run(rows: pa.Table) -> pa.Table:
        key = rows.column("key").to_numpy()
        member = rows.column("member").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((~member, key))  # of copies from several partitions one stays
        order = order[np.unique(key[order], return_index=True)[1]]
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int16).reshape(-1, dim)[order]
        x = code.astype(np.float32) * rows.column("scale").to_numpy()[order][:, None]
        key, member = key[order], member[order]
        if not member.any():
            return schema.empty_table()
        m_keys = key[member]
        near, dist = _scan(x, key, x[member], m_keys, k, share, epsilon)
        got = near >= 0
        others = [m_keys[r[g]].tolist() for r, g in zip(near, got)]
        dots = [(1 - d[g].astype(np.float64) / 2).tolist() for d, g in zip(dist, got)]
        return pa.Table.from_arrays([pa.array(key), pa.array(others, schema.field(1).type), pa.array(dots, schema.field(2).type)], schema=schema)

    return run


def _keys(turn: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_coded(_matrix(batch.column(1), dim), turn)[2]), batch.column(0)], ["key", "id"])

    return run


def nearest(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 5,
    dim: int = DIM,
    cell_rows: int = CELL_ROWS,
    train: int = TRAIN,
    probes: int = PROBES,
    margin: float = MARGIN,
    list_share: float = LIST_SHARE,
    epsilon: float = EPSILON,
    max_cells: int = MAX_CELLS,
    part_rows: int = PART_ROWS,
    exact: bool = False,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(id, other, similarity): for every usable vector the k other ids most similar to it.

    exact costs the square of the number of vectors, in blocks of a part's members.
    """
    if exact:
        probes, margin, list_share, epsilon = max_cells * 8, 4.0, 1.0, float("inf")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable("v", dim))
    turn = rotation(dim)
    total = df.count()
    share = max(1, int(min(1.0, 0.8 * train / max(1, total)) * (1 << 20)))
    # a share of the values, so copies don't add to the sample
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), F.col("v")), F.lit(1 << 20)) < share).select("v").distinct().toArrow().column(0).combine_chunks()
    code, scale, key = _coded(_matrix(sample, dim), turn) if len(sample) else (np.zeros((0, dim), np.int16), np.zeros(0, np.float32), np.zeros(0, np.int64))
    once = np.unique(key, return_index=True)[1]
    known = code[once].astype(np.float32) * scale[once][:, None]
    cells = train_cells(known, min(max_cells, max(1, -(-total // cell_rows)), max(1, len(once) // 8)))
    near = np.concatenate([(known[i : i + 8192] @ cells.T).argmax(1) for i in range(0, len(known), 8192)] or [np.zeros(0, np.int64)])
    members = np.bincount(near, minlength=len(cells)) * (1 << 20) / share
    parts = np.maximum(1, np.ceil(members / part_rows)).astype(np.int64)
    routed = rows.select("v").mapInArrow(_route(turn, cells, parts, dim, probes, margin), ROUTED)
    found = routed.groupBy("cell", "part").applyInArrow(_search(dim, k, list_share, epsilon), NEAR)
    # the k best classes of each class, out of a list of k for each part asked
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("others", "dots"), lambda p: F.struct(F.round(-p["dots"], 7).alias("d"), p["others"].alias("other")))))
    classes_near = found.groupBy("key").agg(F.slice(F.sort_array(F.array_distinct(pairs)), 1, k).alias("near"))
    ids = rows.mapInArrow(_keys(turn, dim), "key long, id string").distinct()
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # per class, the k nearest ids of other classes
    edges = classes_near.select("key", F.explode("near").alias("near")).select("key", F.col("near.d").alias("d"), F.col("near.other").alias("_gl_o"))
    edges = edges.join(classes.withColumnRenamed("key", "_gl_ck"), F.col("_gl_o") == F.col("_gl_ck"))
    entries = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d"), i.alias("id")))))
    outside = edges.groupBy("key").agg(F.slice(F.sort_array(entries), 1, k).alias("outside"))
    per_class = classes.join(outside, "key", "left")
    members = _joined(ids, per_class, min_rows)
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id")))
    ranked = F.slice(F.concat(own, F.coalesce("outside", F.array().cast("array<struct<d:double,id:string>>"))), 1, k)
    out = members.select("id", F.explode(ranked).alias("_gl_x"))
    return out.select("id", F.col("_gl_x.id").alias("other"), (-F.col("_gl_x.d")).alias("similarity"))


def _joined(ids: DataFrame, per_class: DataFrame, min_rows: int) -> DataFrame:
    """ids with the row of their class; the largest classes (at most PARTS) by broadcast, so that none makes a hot task."""
    hot = ids.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > min_rows).orderBy(F.desc("n"), "key").limit(PARTS).select(F.col("key").alias("_gl_h"))
    hot = F.broadcast(hot)
    large = ids.join(F.broadcast(per_class.join(hot, F.col("key") == F.col("_gl_h"), "left_semi")), "key")
    return large.unionByName(ids.join(hot, F.col("key") == F.col("_gl_h"), "left_anti").join(per_class, "key"))


def similar_pairs(found: DataFrame) -> DataFrame:
    """(idA, idB), idA < idB: each pair of which at least one is among the nearest of the other."""
    return found.select(F.least("id", "other").alias("idA"), F.greatest("id", "other").alias("idB")).distinct()
