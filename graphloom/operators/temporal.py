"""Time: as-of filters, anchors, differences, incremental change detection, decay, closing of versions.

Times are epoch milliseconds; intervals are half open, a null end is open; `now` is always given.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import alive_at
from graphloom.model import CODE
from graphloom.operators.asof import instant_ms

DECAY, DAY_MS = 0.05, 86_400_000


def as_of(nodes: DataFrame, at: int) -> DataFrame:
    """The rows valid at an instant; rows without valid_from are not."""
    return nodes.filter(alive_at(at))


def as_of_rows(rows: DataFrame, nodes: DataFrame, at: int) -> DataFrame:
    """Retrieval rows (id, ...) whose node is valid at an instant; unknown nodes and null times pass."""
    times = nodes.select("id", "valid_from", "valid_to").dropDuplicates(["id"])
    ok = F.col("valid_from").isNull() | alive_at(at)
    return rows.join(times, "id", "left").filter(ok).drop("valid_from", "valid_to")


def anchor(spark: SparkSession, transactions: DataFrame, since: str) -> DataFrame:
    """(since, mode): one row, or none if the anchor is unknown.

    A UUID or tx-... names a transaction, then a time or date, then 7 to 40 hex digits a commit,
    then anything an agent; of several transactions the latest counts.
    """
    text = since.strip()
    uuid = r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
    last = F.max("timestamp").alias("since")
    by = lambda c, mode: transactions.filter(F.col(c) == text).agg(last).filter("since is not null").withColumn("mode", F.lit(mode))
    if not text:
        return by("id", "txId").limit(0)
    if re.fullmatch(uuid, text, re.IGNORECASE) or text.startswith("tx-"):
        return by("id", "txId")
    if re.fullmatch(r"\d+|\d{4}-\d\d-\d\d([T ].*)?", text):
        return spark.range(1).select(instant_ms(F.lit(text)).alias("since"), F.lit("timestamp").alias("mode")).filter("since is not null")
    if re.fullmatch(r"[a-f0-9]{7,40}", text, re.IGNORECASE):
        return by("gitCommit", "gitCommit")
    return by("agentId", "agentId")


def diff_since(nodes: DataFrame, since: int, types: list[str] | None = None) -> DataFrame:
    """(change, id, type, at): added (begun since), removed (ended since) and modified (both, for one id).

    One pass over the nodes and one aggregation per id.
    """
    rows = nodes.filter(F.col("type").isin(*(types or CODE)))
    changed = rows.filter((F.col("valid_from") >= since) | (F.col("valid_to") >= since))
    per = changed.groupBy("id").agg(
        F.max(F.when(F.col("valid_from") >= since, F.struct(F.col("valid_from").alias("at"), "type"))).alias("added"),
        F.max(F.when(F.col("valid_to") >= since, F.struct(F.col("valid_to").alias("at"), "type"))).alias("removed"),
    )
    both = F.when(F.col("added").isNotNull() & F.col("removed").isNotNull(), F.col("added"))
    kinds = F.array(*[F.struct(F.lit(n).alias("change"), c.alias("what")) for n, c in (("added", F.col("added")), ("removed", F.col("removed")), ("modified", both))])
    return per.select("id", F.explode(kinds).alias("x")).filter("x.what is not null").select("x.change", "id", "x.what.type", "x.what.at")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def transactions_since(transactions: DataFrame, since: int) -> DataFrame:
    return transactions.filter(F.col("timestamp") >= since).select("id", "timestamp").orderBy("timestamp", "id")


def changes(current: DataFrame, cached: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, change): new, changed and gone keys between two tables of digests; equal ones are left out."""
    c = current.select(F.col(key).alias("k"), F.col(digest).alias("now"), F.lit(1).alias("c"))
    o = cached.select(F.col(key).alias("k"), F.col(digest).alias("then"), F.lit(1).alias("o"))
    kind = F.when(F.col("o").isNull(), "new").when(F.col("c").isNull(), "gone").when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    return c.join(o, "k", "full_outer").withColumn("change", kind).filter("change is not null").select(F.col("k").alias(key), "change")


def decay(at: Column, now: int) -> Column:
    """exp(-0.05 * age in days), 1 for the future; null for null."""
    return F.when(at.isNotNull(), F.exp(-DECAY * F.greatest(F.lit(0.0), (F.lit(now) - at) / DAY_MS)))


def close(rows: DataFrame, condition: Column, now: int, reason: str, end: str = "validTo", why: str = "invalidationReason") -> DataFrame:
    """Rows with the open ones that meet a condition ended now."""
    hit = F.col(end).isNull() & F.coalesce(condition, F.lit(False))
    return rows.withColumns({why: F.when(hit, reason).otherwise(F.col(why)), end: F.when(hit, F.lit(now)).otherwise(F.col(end))})


def merge_versions(stored: DataFrame, current: DataFrame, now: int, key: str = "id", digest: str = "hash") -> DataFrame:
    """Versioned nodes after a rebuild: changed and vanished open versions are closed, new ones opened.

    stored and current share their columns, among them valid_from and valid_to; current has one row a key.
    """
    columns = stored.columns
    seen = current.select(F.col(key).alias("_gl_k"), F.col(digest).alias("_gl_now"), F.lit(True).alias("_gl_seen"))
    is_open = F.col("valid_to").isNull()
    joined = stored.join(seen, F.col(key) == F.col("_gl_k"), "left")
    same = F.col("_gl_seen").isNotNull() & F.col("_gl_now").eqNullSafe(F.col(digest))
    kept = joined.withColumn("valid_to", F.when(is_open & ~same, F.lit(now)).otherwise(F.col("valid_to"))).select(*columns)
    alive = stored.filter(is_open).select(F.col(key).alias("_gl_k"), F.col(digest).alias("_gl_then"))
    fresh = current.join(alive, (F.col(key) == F.col("_gl_k")) & F.col(digest).eqNullSafe(F.col("_gl_then")), "left_anti")
    return kept.unionByName(fresh.withColumns({"valid_from": F.lit(now).cast("long"), "valid_to": F.lit(None).cast("long")}).select(*columns))
