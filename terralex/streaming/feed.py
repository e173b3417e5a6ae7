"""The discovery feed: live rows of a room, snapshot and stream together, first writer wins, rosters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terralex.operators.filters import constraint
from terralex.sources import sinks

FOUND = "room STRING, key STRING, name STRING, la DOUBLE, lo DOUBLE, by STRING, color STRING, ts TIMESTAMP"
KEYS = ["room", "key"]


def feed(spark: SparkSession, path: str, schema: str = FOUND, files_per_trigger: int = 1000) -> DataFrame:
    """Rows as they are appended to the table's folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live(rows: DataFrame, room: str) -> DataFrame:
    """One room's rows, marked as live."""
    return rows.where(F.col("room") == room).withColumn("live", F.lit(True))


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(constraint(*[F.col(c) for c in ("room", "key", "name", "la", "lo", "by", "color")]))


def with_history(history: DataFrame, arrived: DataFrame) -> DataFrame:
    """Snapshot and live rows of a batch as one set: what both hold counts once, the snapshot's first."""
    both = history.withColumn("live", F.lit(False)).unionByName(arrived.withColumn("live", F.lit(True)))
    return both.groupBy(*KEYS).agg(F.min_by(F.struct(*[c for c in both.columns if c not in KEYS]), F.struct("live", "ts")).alias("r")).select(*KEYS, "r.*")


def first_of_key(rows: DataFrame, keys: list[str] = KEYS, delay: str | None = None, event_time: str = "ts") -> DataFrame:
    """First arrival of each key. With ``delay``, keys are forgotten so long after; without, state grows with the keys."""
    if delay is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def upsert(rows: DataFrame, target: str, checkpoint: str, keys: list[str] = KEYS, order: tuple[str, ...] = ("ts",), **trigger) -> StreamingQuery:
    """Insert what the target doesn't have, batch by batch. A replayed batch changes nothing, so each key lands once."""
    write = lambda batch, _: sinks.insert_new(batch, target, keys, list(order))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def notify(rows: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hand each batch to a listener; the batch id tells a replay from news."""
    return rows.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def notify_updates(rows: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """As ``notify``, for rows that change, such as a roster."""
    return rows.writeStream.outputMode("update").foreachBatch(call).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def finish(query: StreamingQuery, seconds: float = 30) -> bool:
    """Wait for the end, no longer than a deadline; stop the query if it is missed."""
    done = query.awaitTermination(int(seconds))
    if not done:
        query.stop()
    return bool(done)


def roster(rows: DataFrame, who: str = "by", state: tuple[str, ...] = ("name", "color"), at: str = "ts", idle: str = "10 minutes") -> DataFrame:
    """(who, state, gone): the latest state of each player as it changes; ``gone`` once idle for so long."""
    columns = [f"{c} STRING" for c in state]
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            last = held.get
            held.remove()
            yield pd.DataFrame([[key[0], *last[:-1], True]], columns=[who, *state, "gone"])
            return
        best = held.get if held.exists else None
        for frame in frames:
            for row in frame.sort_values(at, kind="stable").itertuples(index=False):
                seen = getattr(row, at).value // 1000
                if best is None or seen >= best[-1]:
                    best = (*(getattr(row, c) for c in state), seen)
        held.update(best)
        held.setTimeoutTimestamp(max(best[-1] // 1000, held.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame([[key[0], *best[:-1], False]], columns=[who, *state, "gone"])

    marked = rows.withWatermark(at, "0 seconds").groupBy(who)
    return marked.applyInPandasWithState(follow, f"{who} STRING, {', '.join(columns)}, gone BOOLEAN", f"{', '.join(columns)}, seen LONG", "update", GroupStateTimeout.EventTimeTimeout)
