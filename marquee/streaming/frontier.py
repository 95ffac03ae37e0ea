"""Page frontier as a keyed stateful stream (inc_04).

Input rows are links that a source listed: source, url and seen (a timestamp with a watermark). The state
of a source is its queue (a list in the order of discovery), the URLs it ever queued (a map, which keeps
a page from being read twice) and the day's use. The end of a day is an event-time timer: when it fires,
the next reads within the budget are given out, the rest of the queue waits for the next day's timer.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marquee.functions import values as V

OUTPUT = "source string, day date, url string"
DAY_MS = 86_400_000


def day_end(ms: int) -> int:
    return (ms // DAY_MS + 1) * DAY_MS


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source", "day", "url"], dtype=object)


def budget_left(cap: int, reserved: int, used: int) -> int:
    return max(0, cap - reserved - used)


class FrontierProcessor(StatefulProcessor):
    """``legacy``: sources whose older state had no budget; their first day is reserved whole."""

    def __init__(self, cap: int = V.DAILY_PAGE_BUDGET, legacy: frozenset[str] = frozenset()):
        self.cap, self.legacy = cap, legacy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "url string, ms bigint")
        self.known = handle.getMapState("known", "url string", "day date")
        self.first = handle.getValueState("first", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows))
        at = seen["seen"].min()
        ms = int(at.timestamp() * 1000)
        if not self.first.exists():
            self.first.update((ms,))
        fresh = [u for u in dict.fromkeys(seen.sort_values("seen", kind="stable")["url"]) if not self.known.containsKey((u,))]
        for url in fresh:
            self.known.updateValue((url,), (at.date(),))
        if fresh:
            self.queue.appendList([(u, ms) for u in fresh])
        if self.queue.exists():
            self.handle.registerTimer(day_end(max(ms, timerValues.getCurrentWatermarkInMs())))
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        queue = [tuple(r) for r in self.queue.get()] if self.queue.exists() else []
        migration = key[0] in self.legacy and day_end(self.first.get()[0]) == end
        left = budget_left(self.cap, self.cap if migration else 0, 0)
        # A batch can hold links of the next day when the timer fires; those wait for their own.
        due = [u for u, ms in queue if ms < end]
        reads, given = due[:left], set(due[:left])
        rest = [x for x in queue if x[0] not in given]
        if rest:
            self.queue.put(rest)
        elif queue:
            self.queue.clear()
        if len(reads) < len(due):
            self.handle.registerTimer(end + DAY_MS)
        day = datetime.datetime.fromtimestamp(end / 1000 - 1, datetime.timezone.utc).date()
        yield _rows([(key[0], day, url) for url in reads])

    def close(self) -> None:
        pass


def reads_stream(listed: DataFrame, cap: int = V.DAILY_PAGE_BUDGET, legacy: frozenset[str] = frozenset()) -> DataFrame:
    """(source, day, url): the reads of every source and day; ``listed`` needs a watermark on ``seen``."""
    return listed.groupBy("source").transformWithStateInPandas(
        statefulProcessor=FrontierProcessor(cap, legacy), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
