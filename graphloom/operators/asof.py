"""Attributes as known at event time: bitemporal rectangles and point location.

The reports about a key split the plane (valid time, recorded time) into disjoint rectangles, in
each of which one report is the current version: inserting reports in the order of their recording
closes the rectangle of the predecessor in valid time (or of the report replaced) and opens at most
two, so m reports give at most 2 m rectangles. The rectangles of a key are indexed by a grid whose
lines are quantiles of their corners, and every event is looked up in its grid cell only.

Keys with many reports are cut into cells along (valid time, recorded time). An event then asks its
own cell and the last earlier one of which anything was recorded by its time. Cells in which many
events ask are salted and their reports, at most a cell's worth, repeated for each salt. So a task
holds at most the reports of one cell and a cell's worth of events, whatever the skew.

The rectangles themselves are the same however keys are cut: a report that is the earliest of its
cell so far in valid time is a guest in the cell before, where it ends rectangles like any other.

Defined results: reports without key or recorded time, events without key or either time, and
events before the first report give no row; a null valid time is the recorded time; of reports with
equal times the greatest payload counts; repeated rows count once; an empty side gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.skew import CELL, MIN_ROWS, PARTS, HotKeys, at_points, heavy, hot_keys, local_table, with_cells

FOREVER = 9223372036854775807
#: Rectangles a grid cell should hold; fewer rectangles than this need no grid.
GRID_FILL = 16
SALT = 23


def rectangles_of(reports: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, int, int, int]]:
    """(valid from, valid to, recorded from, recorded to, report number) of one key's current-version regions.

    reports: (recorded at, valid from, payload, removed), in this order. Intervals are half open.
    """
    starts: list[int] = []
    current: list[int] = []  # number of the open rectangle of each start
    out: list[list[int]] = []
    for n, (tx, vf, _, _) in enumerate(reports):
        at = bisect_left(starts, vf)
        if at < len(starts) and starts[at] == vf:
            old = out[current[at]]
            old[3] = tx
            current[at] = len(out)
            out.append([vf, old[1], tx, FOREVER, n])
            continue
        until = starts[at] if at < len(starts) else FOREVER
        if at:
            old = out[current[at - 1]]
            old[3] = tx
            current[at - 1] = len(out)
            out.append([old[0], vf, tx, FOREVER, old[4]])
        starts.insert(at, vf)
        current.insert(at, len(out))
        out.append([vf, until, tx, FOREVER, n])
    return [tuple(r) for r in out if r[2] < r[3]]


class Grid:
    """Disjoint rectangles, indexed by a grid with quantiles of their lower corners as lines."""

    def __init__(self, rects: list[tuple[int, int, int, int, int]]):
        self.rects = rects
        side = max(1, int((len(rects) / GRID_FILL) ** 0.5))
        valid, known = (sorted(r[k] for r in rects) for k in (0, 2))
        self.lines = [sorted({v[len(v) * i // side] for i in range(1, side)}) for v in (valid, known)]
        self.cells: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
        for r in rects:
            xs = range(bisect_right(self.lines[0], r[0]), bisect_left(self.lines[0], r[1]) + 1)
            ys = range(bisect_right(self.lines[1], r[2]), bisect_left(self.lines[1], r[3]) + 1)
            for x in xs:
                for y in ys:
                    self.cells.setdefault((x, y), []).append(r)

    def locate(self, valid_at: int, known_at: int) -> int | None:
        """The number of the report that is current at this point."""
        at = (bisect_right(self.lines[0], valid_at), bisect_right(self.lines[1], known_at))
        for r in self.cells.get(at, ()):
            if r[0] <= valid_at < r[1] and r[2] <= known_at < r[3]:
                return r[4]
        return None


IN = ["_gl_key", CELL, "_gl_salt", "_gl_kind", "_gl_a", "_gl_b", "_gl_text", "_gl_removed"]
OUT = pa.schema([("_gl_event", pa.string()), ("_gl_key", pa.string()), ("_gl_valid_at", pa.int64()), ("_gl_known_at", pa.int64()), ("_gl_vf", pa.int64()), ("_gl_tx", pa.int64()), ("_gl_text", pa.string()), ("_gl_removed", pa.bool_())])
OUT_SQL = "_gl_event string, _gl_key string, _gl_valid_at long, _gl_known_at long, _gl_vf long, _gl_tx long, _gl_text string, _gl_removed boolean"
RECT = pa.schema([("key", pa.string()), ("validFrom", pa.int64()), ("validTo", pa.int64()), ("recordedFrom", pa.int64()), ("recordedTo", pa.int64()), ("payload", pa.string()), ("removed", pa.bool_())])
RECT_SQL = "key string, validFrom long, validTo long, recordedFrom long, recordedTo long, payload string, removed boolean"


def _groups(batches: Iterator[pa.RecordBatch]):
    """(key, reports), then the group's events one at a time, over rows sorted by group and kind."""
    group, reports, grid = None, [], None
    for batch in batches:
        for key, cell, salt, kind, a, b, text, removed in zip(*(batch.column(c).to_pylist() for c in IN)):
            if (key, cell, salt) != group:
                if reports and grid is None:
                    yield group, reports, None, None
                group, reports, grid = (key, cell, salt), [], None
            if kind == 0:
                reports.append((a, b, text, removed))
            elif reports:
                if grid is None:
                    grid = Grid(rectangles_of(reports))
                yield group, reports, grid, (a, b, text)
    if reports and grid is None:
        yield group, reports, None, None


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for (key, _, _), reports, grid, event in _groups(batches):
        if event is None:
            continue
        known_at, valid_at, name = event
        n = grid.locate(valid_at, known_at)
        if n is not None:
            tx, vf, text, removed = reports[n]
            rows.append((name, key, valid_at, known_at, vf, tx, text, removed))
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


def _rectangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for (key, _, _), reports, _, _ in _groups(batches):
        rows += [(key, v0, v1, r0, r1, reports[n][2], reports[n][3]) for v0, v1, r0, r1, n in rectangles_of(reports) if reports[n][2] is not None]
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECT)], schema=RECT)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECT)], schema=RECT)


def _reports(reports: DataFrame, key: str, valid_from: str, recorded_at: str, payload: str, removed: Column) -> DataFrame:
    return reports.select(
        F.col(key).cast("string").alias("_gl_key"),
        F.col(recorded_at).cast("long").alias("_gl_a"),
        F.coalesce(F.col(valid_from), F.col(recorded_at)).cast("long").alias("_gl_b"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("_gl_text"),
        F.coalesce(removed, F.lit(False)).alias("_gl_removed"),
    ).filter(F.col("_gl_key").isNotNull() & F.col("_gl_a").isNotNull())


ROW = ["_gl_id", CELL, "_gl_a", "_gl_b", "_gl_text", "_gl_removed"]


def _celled(rows: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame | None, HotKeys]:
    """The reports of ordinary keys (cell 0), those of hot keys with their cells or None, and the hot keys."""
    place = F.struct("_gl_b", "_gl_a")
    hot = hot_keys(rows, "_gl_id", place, min_rows)
    rest = hot.but(rows, "_gl_id").withColumn(CELL, F.lit(0)).select(*ROW)
    if not hot:
        return rest, None, hot
    theirs = rows
    if hot.points:
        same, theirs = at_points(theirs, hot, "_gl_id", place)
        same = same.groupBy("_gl_id", "_gl_a", "_gl_b").agg(F.max(F.struct("_gl_text", "_gl_removed")).alias("_gl_v"))
        theirs = theirs.unionByName(same.select("_gl_id", "_gl_a", "_gl_b", "_gl_v._gl_text", "_gl_v._gl_removed"))
    return rest, with_cells(theirs, hot, "_gl_id", place).select(*ROW), hot


def _firsts(theirs: DataFrame) -> DataFrame:
    """(_gl_fk, _gl_first): of each hot key the first recording of each of its cells, by cell. As large as the table of cells."""
    cells = theirs.groupBy("_gl_id", CELL).agg(F.min("_gl_a").alias("tx"))
    per = cells.groupBy(F.col("_gl_id").alias("_gl_fk")).agg(F.map_from_entries(F.collect_list(F.struct(CELL, "tx"))).alias("m"))
    every = F.sequence(F.lit(0), F.array_max(F.map_keys("m")))
    return per.select("_gl_fk", F.transform(every, lambda c: F.coalesce(F.try_element_at("m", c), F.lit(FOREVER))).alias("_gl_first"))


def _last_before(rows: DataFrame, firsts: DataFrame, hot: HotKeys, name: str) -> DataFrame:
    """rows with the last cell before their own of which anything was recorded by _gl_a; null if there is none.

    Found in a tree of minima over the cells: up by the bits of the cell, and down again.
    """
    depth = max(map(len, hot.edges.values())).bit_length()
    n = F.size("_gl_first")

    def minima(size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda j: F.array_min(F.slice("_gl_first", j * size + 1, size)))

    levels = [minima(2**k).alias(f"_gl_m{k}") for k in range(depth + 1)]
    rows = rows.join(F.broadcast(firsts.select("_gl_fk", *levels)), F.col("_gl_id") == F.col("_gl_fk"), "left")
    known = lambda k, at: F.coalesce(F.get(f"_gl_m{k}", at) <= F.col("_gl_a"), F.lit(False))
    rows = rows.withColumns({"_gl_p": F.col(CELL), "_gl_level": F.lit(None).cast("int"), name: F.lit(None).cast("int")})
    for k in range(depth + 1):
        p = F.col("_gl_p")
        rows = rows.withColumn("_gl_hit", F.col("_gl_level").isNull() & (p % 2 == 1) & known(k, p - 1))
        rows = rows.withColumns({"_gl_level": F.when(F.col("_gl_hit"), k).otherwise(F.col("_gl_level")), name: F.when(F.col("_gl_hit"), p - 1).otherwise(F.col(name)), "_gl_p": F.floor(p / 2).cast("int")})
    for k in reversed(range(depth)):
        right = F.col(name) * 2 + 1
        rows = rows.withColumn(name, F.when(F.col("_gl_level") > k, F.when(known(k, right), right).otherwise(right - 1)).otherwise(F.col(name)))
    return rows.drop("_gl_fk", "_gl_p", "_gl_level", "_gl_hit", *[f"_gl_m{k}" for k in range(depth + 1)])


def _guests(theirs: DataFrame, firsts: DataFrame, hot: HotKeys) -> DataFrame:
    """The reports of later cells that end rectangles of a cell, without payload.

    Those are reports that lower the least valid time of their cell. Each ends rectangles of the last
    cell before that is not empty then; and a cell starts with the least valid time after it.
    """
    by_recording = Window.partitionBy("_gl_id", CELL).orderBy("_gl_a", "_gl_b")
    low = theirs.withColumn("_gl_low", F.min("_gl_b").over(by_recording.rowsBetween(Window.unboundedPreceding, -1)))
    low = low.filter(F.col("_gl_low").isNull() | (F.col("_gl_b") < F.col("_gl_low"))).select("_gl_id", CELL, "_gl_a", "_gl_b")
    nothing = {"_gl_text": F.lit(None).cast("string"), "_gl_removed": F.lit(False)}
    sent = _last_before(low, firsts, hot, "_gl_to").filter(F.col("_gl_to").isNotNull())
    sent = sent.select("_gl_id", F.col("_gl_to").alias(CELL), "_gl_a", "_gl_b").withColumns(nothing)
    # of every cell, the next one that was begun before it
    begun = firsts.select("_gl_fk", F.posexplode("_gl_first").alias("_gl_d", "_gl_t"), "_gl_first")
    later = F.sequence(F.col("_gl_d") + 1, F.size("_gl_first") - 1)
    begun = begun.filter(F.col("_gl_d") < F.size("_gl_first") - 1).withColumn("_gl_e", F.array_min(F.filter(later, lambda e: F.get("_gl_first", e) <= F.col("_gl_t"))))
    begun = F.broadcast(begun.filter(F.col("_gl_e").isNotNull()).select("_gl_fk", "_gl_d", "_gl_e", "_gl_t"))
    until = low.withColumn("_gl_next", F.lead("_gl_a").over(by_recording))
    there = (F.col("_gl_id") == F.col("_gl_fk")) & (F.col(CELL) == F.col("_gl_e")) & (F.col("_gl_a") <= F.col("_gl_t"))
    start = until.join(begun, there & (F.col("_gl_next").isNull() | (F.col("_gl_next") > F.col("_gl_t"))))
    return sent.unionByName(start.select("_gl_id", F.col("_gl_d").alias(CELL), F.lit(-FOREVER).alias("_gl_a"), "_gl_b").withColumns(nothing))


def rectangles(reports: DataFrame, key: str, valid_from: str, recorded_at: str, payload: str, removed: Column, min_rows: int = MIN_ROWS) -> DataFrame:
    """(key, validFrom, validTo, recordedFrom, recordedTo, payload, removed): the disjoint current-version regions; an end of FOREVER is open."""
    rows, theirs, hot = _celled(_reports(reports, key, valid_from, recorded_at, payload, removed).withColumnRenamed("_gl_key", "_gl_id"), min_rows)
    if theirs is not None:
        theirs = theirs.repartition("_gl_id", CELL)
        rows = rows.unionByName(theirs).unionByName(_guests(theirs, _firsts(theirs), hot))
    rows = rows.select(F.col("_gl_id").alias("_gl_key"), CELL, F.lit(0).alias("_gl_salt"), F.lit(0).alias("_gl_kind"), "_gl_a", "_gl_b", "_gl_text", "_gl_removed")
    return rows.repartition("_gl_key", CELL).sortWithinPartitions("_gl_key", CELL, "_gl_a", "_gl_b", "_gl_text", "_gl_removed").mapInArrow(_rectangles, RECT_SQL)


def known_at_event(
    reports: DataFrame,
    events: DataFrame,
    key: str,
    valid_from: str,
    recorded_at: str,
    payload: str,
    removed: Column,
    event_id: str = "eventId",
    event_key: str = "key",
    valid_at: str = "validAt",
    known_at: str = "knownAt",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(eventId, key, validAt, knownAt, validFrom, recordedAt, payload): per event and key the version current then."""
    told, theirs, hot = _celled(_reports(reports, key, valid_from, recorded_at, payload, removed).withColumnRenamed("_gl_key", "_gl_id"), min_rows)
    ev = events.select(
        F.col(event_key).cast("string").alias("_gl_id"),
        F.col(known_at).cast("long").alias("_gl_a"),
        F.col(valid_at).cast("long").alias("_gl_b"),
        F.col(event_id).cast("string").alias("_gl_text"),
    ).filter(F.col("_gl_id").isNotNull() & F.col("_gl_a").isNotNull() & F.col("_gl_b").isNotNull())
    asking = hot.but(ev, "_gl_id").withColumn(CELL, F.lit(0))
    if theirs is not None:
        own = with_cells(ev, hot, "_gl_id", F.struct("_gl_b", "_gl_a"))
        own = _last_before(own, _firsts(theirs), hot, "_gl_earlier").withColumn(CELL, F.explode(F.array_compact(F.array(CELL, "_gl_earlier"))))
        told, asking = told.unionByName(theirs), asking.unionByName(own.drop("_gl_earlier"))
    crowded = heavy(asking, ["_gl_id", CELL], min_rows)
    told, asking = (x.withColumn("_gl_salt", F.lit(0)) for x in (told, asking))
    if crowded:
        most = max(min_rows, sum(n for *_, n in crowded) / PARTS)
        salts = local_table(ev.sparkSession, [(k, c, max(1, round(n / most))) for k, c, n in crowded], "_gl_ek string, _gl_ec int, _gl_salts int")
        here = (F.col("_gl_id") == F.col("_gl_ek")) & (F.col(CELL) == F.col("_gl_ec"))
        n = F.coalesce("_gl_salts", F.lit(1))
        told = told.join(F.broadcast(salts), here, "left").withColumn("_gl_salt", F.explode(F.sequence(F.lit(0), n - 1)))
        asking = asking.join(F.broadcast(salts), here, "left").withColumn("_gl_salt", F.floor(F.rand(SALT) * n).cast("int"))
    columns = [F.col("_gl_id").alias("_gl_key"), CELL, "_gl_salt", "_gl_kind", "_gl_a", "_gl_b", "_gl_text", "_gl_removed"]
    told = told.withColumn("_gl_kind", F.lit(0)).select(*columns)
    asking = asking.withColumns({"_gl_kind": F.lit(1), "_gl_removed": F.lit(False)}).select(*columns)
    both = told.unionByName(asking).repartition("_gl_key", CELL, "_gl_salt")
    found = both.sortWithinPartitions("_gl_key", CELL, "_gl_salt", "_gl_kind", "_gl_a", "_gl_b", "_gl_text", "_gl_removed").mapInArrow(_locate, OUT_SQL)
    # one row per event and key: repeated events agree, of two cells the later version counts
    best = found.groupBy("_gl_event", "_gl_key", "_gl_valid_at", "_gl_known_at").agg(F.max(F.struct("_gl_vf", "_gl_tx", "_gl_text", "_gl_removed")).alias("_gl_v"))
    return best.filter(~F.col("_gl_v._gl_removed")).select(
        F.col("_gl_event").alias("eventId"),
        F.col("_gl_key").alias("key"),
        F.col("_gl_valid_at").alias("validAt"),
        F.col("_gl_known_at").alias("knownAt"),
        F.col("_gl_v._gl_vf").alias("validFrom"),
        F.col("_gl_v._gl_tx").alias("recordedAt"),
        F.col("_gl_v._gl_text").alias("payload"),
    )


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO 8601 instant (Z, an offset, or UTC if neither), a date (its midnight UTC) or digits; else null."""
    t = F.trim(text)
    day = F.concat(t, F.lit("T00:00:00Z"))
    zoned = F.when(t.rlike(r"(Z|z|[+-]\d\d(:?\d\d)?)$"), F.regexp_replace(t, r"([+-]\d\d):?(\d\d)?$", "$1:$2")).otherwise(F.concat(t, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r":$", ":00")
    stamp = F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), day).when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]"), zoned)
    return F.when(t.rlike(r"^-?\d+$"), t.try_cast("long")).otherwise(F.unix_millis(stamp.try_cast("timestamp")))
