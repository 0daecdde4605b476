"""Handles of the two kinds of log.

A traditional log is one DataFrame of events (case_id, activity, ts, event_id and optionally resource, lifecycle), in
total order by ``ts`` (nulls last) and ``event_id`` within a case, with an optional DataFrame of all cases (case_id),
which may include cases without events. An object-centric log has six relations.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventLog:
    events: DataFrame
    cases: DataFrame | None = None

    def all_cases(self) -> DataFrame:
        return self.cases if self.cases is not None else self.events.select("case_id").distinct()


@dataclass(frozen=True)
class OCEL:
    """events(event_id, activity, ts), objects(object_id, object_type), e2o(event_id, object_id, qualifier),
    o2o(source_id, target_id, qualifier), event_attr(event_id, name, value), object_attr(object_id, name, value, ts)."""

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame | None = None
    event_attr: DataFrame | None = None
    object_attr: DataFrame | None = None

    def with_(self, **relations: DataFrame) -> OCEL:
        return replace(self, **relations)


def in_order(*keys: str) -> WindowSpec:
    """Events of each key in log order."""
    return Window.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_last(), F.col("event_id"))


def micros(ts: Column | str) -> Column:
    """Whole microseconds since 1970 of a timestamp, session time zone UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
