"""Status machine as a keyed stateful stream (inc_02).

Input rows are one listing of an event on one day: id, day, fact (its sessions as text), open_until
(its last session day) and, where the crawl reports one, crawl (its status). The state keeps the last listing and its status. A row older
than the state's last day is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marquee.operators import status as S

OUTPUT = "id string, day date, status string"
STATE = "day date, fact string, open_until date, status string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def next_status(last: tuple | None, day, fact, crawl: str = "scheduled") -> str:
    """Status of a listing given the previous one (day, fact, open_until, status)."""
    if last is None:
        return crawl
    last_day, last_fact, open_until, status = last
    before = S.STATES.index(status)
    if (day - last_day).days > 1:
        before = S.unlisted_state(before, open_until > last_day)
    return S.STATES[S.next_state(before, fact != last_fact, S.STATES.index(crawl))]


class StatusProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        # One row per event and day: a batch holds at most as many rows of a key as it has days.
        days = {}
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                days[r.day] = r
        out = []
        for day in sorted(days):
            if last is not None and day <= last[0]:
                continue
            r = days[day]
            status = next_status(last, day, r.fact, getattr(r, "crawl", None) or "scheduled")
            last = (day, r.fact, r.open_until, status)
            out.append((key[0], day, status))
        if out:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["id", "day", "status"])

    def close(self) -> None:
        pass


def status_stream(listings: DataFrame) -> DataFrame:
    return listings.groupBy("id").transformWithStateInPandas(
        statefulProcessor=StatusProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
