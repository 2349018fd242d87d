"""The sliding windows as a stream in event time: for each display of an article, what was shown and clicked of it just before.

Rows may come out of order within the watermark's delay. A row waits in its article's state until the watermark has passed it,
so that all rows before it are there; a timer then takes what is settled, in the order of time. A row that comes behind the
watermark is late: it goes to a second output, and is never counted in. State is kept by article: rows that wait, and those of the longest
window before the watermark; a timer clears what leaves that window, and an article without rows in it has no state.
Exactly once, from the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import BACKFILL_HOURS, CLICK_LAG_MINUTES, MICROS_HOUR, MICROS_MINUTE, POOL_HOURS

OUT = "event_id bigint, art bigint, t bigint, shown bigint, shown_back bigint, clicked bigint, late boolean"
_COLUMNS = [x.split()[0] for x in OUT.split(", ")]


class _Windows(StatefulProcessor):
    def __init__(self, window: int, back: int, lag: int):
        self.window, self.back, self.lag = window, back, lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id bigint, t bigint, click int")
        self.seen = handle.getListState("seen", "t bigint, click int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        own = pd.concat(list(rows))
        late = (own.t // 1000 <= now) & (now > 0)  # 0: there is none yet
        fresh = own[~late]
        if len(fresh):
            self.waiting.appendList([(int(e), int(t), int(c)) for e, t, c in zip(fresh.event_id, fresh.t, fresh.click, strict=True)])
            self.handle.registerTimer(int(fresh.t.min()) // 1000)
        if late.any():
            yield own[late].assign(art=key[0], shown=None, shown_back=None, clicked=None, late=True)[_COLUMNS].astype({c: "Int64" for c in ("shown", "shown_back", "clicked")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, seen = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])), list(self.seen.get())
        ready = [r for r in waiting if r[1] // 1000 <= now]
        rest = waiting[len(ready) :]
        seen += [r[1:] for r in ready]
        # Rows to come lie behind the watermark's millisecond.
        kept = sorted(r for r in seen if r[0] >= (now + 1) * 1000 - self.back)
        for state, rows in ((self.waiting, rest), (self.seen, kept)):
            if rows:
                state.put([tuple(r) for r in rows])
            else:
                state.clear()
        nxt = [rest[0][1] // 1000] if rest else []
        if kept:  # when its newest row has left the window
            nxt.append((kept[-1][0] + self.back) // 1000)
        for at in {x for x in nxt if x > now}:
            self.handle.registerTimer(at)
        if ready:
            shown = np.sort(np.array([r[0] for r in seen]))
            clicked = np.sort(np.array([r[0] for r in seen if r[1]], dtype=np.int64))
            t = np.array([r[1] for r in ready])
            upto = lambda a, x: np.searchsorted(a, x, side="left")  # noqa: E731  rows of the same time don't see each other
            n = upto(shown, t)
            out = {"event_id": [r[0] for r in ready], "art": key[0], "t": t, "shown": n - upto(shown, t - self.window), "shown_back": n - upto(shown, t - self.back)}
            out["clicked"] = np.maximum(upto(clicked, t - self.lag) - upto(clicked, t - self.window), 0)
            yield pd.DataFrame(out | {"late": False}).astype({c: "Int64" for c in ("shown", "shown_back", "clicked")})


def windows(displays: DataFrame, hours: float = POOL_HOURS, backfill: float = BACKFILL_HOURS, lag: float = CLICK_LAG_MINUTES, delay: str = "0 seconds") -> DataFrame:
    """displays: a stream of event_id, art, t, click. Counts in [t - hours, t), [t - backfill, t) and, of clicks, [t - hours, t - lag); late rows have none. delay: how far behind
    the newest row another may come."""
    # The watermark is the source's; its column goes, or the engine would drop late rows before they can be told.
    timed = displays.withColumn("_ts", F.timestamp_micros("t")).withWatermark("_ts", delay).select("event_id", "art", "t", "click")
    own = _Windows(int(hours * MICROS_HOUR), int(max(hours, backfill) * MICROS_HOUR), int(lag * MICROS_MINUTE))
    return timed.groupBy("art").transformWithStateInPandas(own, OUT, "Append", "EventTime")


def check_sorted(log: DataFrame, ranges: int = 64) -> None:
    """A log given as one ordered sequence (place, t) must not go back in time. Looked at in ranges of places, and then at the ranges' ends."""
    edges = log.agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    by = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda x: x < F.col("place"))) if edges else F.lit(0)
    parted = log.select("place", "t", by.alias("_p"))
    back = parted.withColumn("_d", F.col("t") - F.lag("t").over(Window.partitionBy("_p").orderBy("place"))).where("_d < 0")
    ends = parted.groupBy("_p").agg(F.min_by("t", "place").alias("first"), F.max_by("t", "place").alias("last"))  # a row a range
    between = ends.withColumn("_d", F.col("first") - F.lag("last").over(Window.orderBy("_p"))).where("_d < 0")
    if not (back.isEmpty() and between.isEmpty()):
        raise ValueError("the log goes back in time")
