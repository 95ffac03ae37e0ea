"""Race calendar rows (ext_12, agg_15, fn_07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import dates as D, values as V


def unpivot_sessions(fields: list[tuple[Column, str]]) -> Column:
    """ext_12: optional (date, time) structs to an array of struct(label, date, time); absent ones drop."""
    return F.array_compact(
        F.array(*[
            F.when(c.isNotNull(), F.struct(F.lit(label).alias("label"), c["date"].alias("date"), c["time"].alias("time")))
            for c, label in fields
        ])
    )


def races(raw: DataFrame, season: str | Column) -> DataFrame:
    """Calendar rows with sorted UTC sessions, missing-time labels, weekend bounds and validity."""
    fields = [(F.col(f), label) for f, label in V.CALENDAR_FIELDS]
    fields.append((F.struct("date", "time"), "Race"))
    items = unpivot_sessions(fields)
    timed = F.filter("_items", lambda s: F.coalesce(F.length(s["time"]) > 0, F.lit(False)))
    missing = F.transform(
        F.filter("_items", lambda s: F.coalesce(F.length(s["time"]) == 0, F.lit(True))), lambda s: s["label"]
    )
    sessions = F.array_sort(
        F.transform(
            "_timed",
            lambda s: F.struct(
                D.utc_stamp(s["date"], s["time"]).alias("start"),
                F.concat(s["label"], F.lit(" - "), F.col("raceName")).alias("name"),
            ),
        )
    )
    key = F.regexp_replace("raceName", " Grand Prix$", "")
    slugs = F.create_map(*[F.lit(x) for kv in V.RACE_SLUGS.items() for x in kv])
    out = (
        raw.withColumn("_items", items)
        .withColumn("_timed", timed)
        .withColumn("missingTimes", missing)
        .withColumn("sessions", sessions)
        .withColumn("id", F.coalesce(slugs[key], F.col("Circuit.circuitId")))
        .withColumn("weekendStart", weekend_start(F.col("date"), F.transform("sessions", lambda s: F.substring(s["start"], 1, 10))))
        .withColumn("weekendEnd", F.col("date"))
    )
    valid = (
        (F.col("season") == season)
        & (F.length("raceName") > 0)
        & F.col("Circuit.circuitId").isNotNull()
        & F.col("date").try_cast("date").isNotNull()
        & ~F.exists("sessions", lambda s: s["start"].isNull())
    )
    return out.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_items", "_timed")


def weekend_start(day: Column, session_days: Column) -> Column:
    """agg_15: the earlier of the race day and the first session day."""
    return F.least(day, F.array_min(session_days))
