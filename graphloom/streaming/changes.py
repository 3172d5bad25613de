"""Streams: changed files, claims with a lifetime, sessions of episodes, windowed activity.

Structured Streaming keeps the state; batches are merged by the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def file_changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of files as they appear or change below a folder."""
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(root)


def on_changes(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "500 milliseconds") -> StreamingQuery:
    """Calls handle(batch, id) with the newest state of each changed path; without an interval, once for all there is.

    Batches never overlap, and changes that arrive meanwhile wait for the next one.
    """

    def run(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("modificationTime", "length", "content"), "modificationTime").alias("x"))
        handle(newest.select("path", "x.*"), number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def deletions(known: DataFrame, listing: DataFrame) -> DataFrame:
    """(path): known paths that a fresh listing lacks; file streams don't tell of them."""
    return known.select("path").join(listing.select("path"), "path", "left_anti")


def expired_claims(claims: DataFrame, ttl: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """A stream (id, targetId, expired_at) of claims not closed within their lifetime of opening.

    claims: a stream of (id, targetId, event, at), event open or close, at a timestamp. The state of
    a claim is one row and is dropped when its lifetime and the allowed delay have passed.
    """

    def step(key, frames, state):
        import pandas as pd

        target, opened, closed = state.get if state.exists else (None, None, False)
        for f in frames:
            for event, tgt, at in zip(f["event"], f["targetId"], f["at"]):
                if event == "close":
                    closed = True
                elif opened is None or at.timestamp() * 1000 < opened:
                    opened, target = int(at.timestamp() * 1000), tgt
        if state.hasTimedOut:
            state.remove()
            if not closed and opened is not None:
                yield pd.DataFrame({"id": [key[0]], "targetId": [target], "expired_at": [opened + span]})
            return
        state.update((target, opened, closed))
        state.setTimeoutTimestamp(max((opened or state.getCurrentWatermarkMs()) + span, state.getCurrentWatermarkMs() + 1))

    span = _milliseconds(ttl)
    keyed = claims.withWatermark("at", delay).groupBy("id")
    return keyed.applyInPandasWithState(step, "id string, targetId string, expired_at long", "targetId string, opened long, closed boolean", "append", "EventTimeTimeout")


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def episode_links(episodes: DataFrame) -> DataFrame:
    """A stream (src, dst): each episode after the one before it of its project, agent and session, in the order of arrival.

    Only the last id and time of a session are kept; within a batch episodes are ordered by time.
    """

    def step(key, frames, state):
        import pandas as pd

        rows = pd.concat(list(frames)).drop_duplicates("id").sort_values(["timestamp", "id"])
        last = state.get[0] if state.exists else None
        ids = rows["id"].tolist()
        pairs = [(a, b) for a, b in zip([last, *ids], ids) if a is not None and a != b]
        if ids:
            state.update((ids[-1],))
        yield pd.DataFrame(pairs, columns=["src", "dst"])

    keyed = episodes.filter("agentId is not null and sessionId is not null").groupBy("projectId", "agentId", "sessionId")
    return keyed.applyInPandasWithState(step, "src string, dst string", "last string", "append", "NoTimeout")


def activity(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """A stream (start, kind, n): events per window, late ones within the delay included."""
    rows = events.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "kind", "n")
