"""Joining and leaving a room: a live stream first, then its history, fenced by epochs."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terralex.operators.graph import compact_index
from terralex.sources import sinks
from terralex.staging import shared_dir, stage
from terralex.streaming import feed

T = TypeVar("T")
CODE = re.compile("[A-Z0-9]{1,12}")


def retried(call: Callable[[], T], tries: int = 3, first_wait: float = 0.5, wanted: Callable[[], bool] = lambda: True, sleep: Callable[[float], None] = time.sleep) -> T | None:
    """The call's result; after a failure it is made again, twice as late each time. The last failure is raised; None once
    the result isn't ``wanted`` any more."""
    for attempt in range(tries):
        try:
            return call()
        except Exception:
            if not wanted():
                return None
            if attempt == tries - 1:
                raise
            sleep(first_wait * 2**attempt)
    return None


class Room:
    """One player's view of a room. ``found`` gets each batch or page of rows and whether it is live; as both may hold the
    same row, it should keep a set of keys.

    Every join and leave begins a new epoch, and what an older one still delivers is dropped.
    """

    def __init__(self, spark: SparkSession, path: str, found: Callable[[DataFrame, bool], None], schema: str = feed.FOUND, page: int = 500):
        self.spark, self.path, self.found, self.schema, self.page = spark, path, found, schema, page
        self.epoch, self.code = 0, None
        self.query: StreamingQuery | None = None

    def join(self, code: str | None, sleep: Callable[[float], None] = time.sleep, **trigger) -> bool:
        """Whether the room was joined and its history read. A code that is none changes nothing."""
        room = (code or "").strip().upper()
        if not CODE.fullmatch(room):
            return False
        self.leave()
        own, self.code = self.epoch, room
        current = lambda: self.epoch == own
        state = f"{shared_dir(self.spark)}/{self.spark.sparkContext.applicationId}-room-{uuid.uuid4().hex[:12]}"
        deliver = lambda batch, _: self.found(batch, True) if current() else None
        try:
            self.query = feed.notify(feed.live(feed.feed(self.spark, self.path, self.schema), room), deliver, state, **(trigger or {"processingTime": "1 second"}))
            # only now: what comes meanwhile is live
            done = retried(lambda: self.history(room, current), wanted=current, sleep=sleep)
        except Exception:
            if current():
                self.leave()
            raise
        return bool(done) and current()

    def history(self, room: str, current: Callable[[], bool]) -> bool:
        """Hand on the room's rows page by page, in order of their keys; False once another epoch has begun.

        The rows are staged once and numbered, so pages don't see what comes meanwhile, and none passes through the driver.
        From the third on, a page is as large as all before it: their number grows with the logarithm of the rows.
        """
        if not current():
            return False
        rows = sinks.table(self.spark, self.path, self.schema).where(F.col("room") == room)
        held = stage(compact_index(rows, "key", name="_n"), "history")
        total, done = held.count(), 0
        while current() and done < total:
            upto = done + max(self.page, done)
            self.found(held.where(F.col("_n").between(done, upto - 1)).drop("_n").select(*rows.columns), False)
            done = upto
        return current()

    def leave(self) -> None:
        self.epoch += 1
        self.code = None
        if self.query is not None:
            self.query.stop()
            self.query = None
