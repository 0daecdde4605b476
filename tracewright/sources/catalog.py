"""Named relations, pages, guarded loads, validation and sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import OCEL, EventLog

#: Logical names of relations, by the fields that hold them.
LOGICAL = {"events": "events", "objects": "objects", "event_object": "e2o", "object_object": "o2o", "event_attributes": "event_attr", "object_attributes": "object_attr", "cases": "cases"}


class Catalog:
    """Logs by role; relations are scanned as ``{role.relation}``."""

    def __init__(self, logs: dict[str, OCEL | EventLog]):
        self.logs = logs

    def scan(self, reference: str) -> DataFrame:
        m = re.fullmatch(r"\{(\w+)\.(\w+)\}", reference)
        if not m or m[1] not in self.logs:
            raise KeyError(reference)
        relation = getattr(self.logs[m[1]], LOGICAL.get(m[2], m[2]), None)
        if relation is None:
            raise KeyError(reference)
        return relation

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which ``{role.relation}`` stands for a relation."""
        names: dict[str, DataFrame] = {}

        def named(m: re.Match) -> str:
            name = f"{m[1]}__{m[2]}"
            names[name] = self.scan(m[0])
            return "{" + name + "}"

        query = re.sub(r"\{(\w+)\.(\w+)\}", named, text)
        return next(iter(self.logs.values())).events.sparkSession.sql(query, **names)


def page(df: DataFrame, columns: list[str], order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows of a stable page, all values as text."""
    return df.orderBy(*order).offset(offset).limit(limit).select(*[F.col(c).cast("string").alias(c) for c in columns])


def load_guarded(log: OCEL, most: int = 25_000) -> DataFrame:
    """Events in order, if there are no more than ``most``; else an error."""
    n = log.events.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} events")
    return log.events.orderBy(F.col("ts").asc_nulls_last(), "event_id")


def infer_types(attrs: DataFrame) -> DataFrame:
    """(name, kind): the narrowest of integer, float, boolean, time and string that all values of a name have."""
    v = F.col("value")
    can = lambda kind: F.bool_and(v.try_cast(kind).isNotNull())
    return attrs.where(v.isNotNull()).groupBy("name").agg(
        F.when(can("bigint"), "integer").when(can("double"), "float").when(F.bool_and(F.lower(v).isin("true", "false")), "boolean").when(can("timestamp"), "time").otherwise("string").alias("kind")
    )


def validate(log: OCEL) -> DataFrame:
    """(issue, affected) of every kind of issue that occurs."""
    def issue(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("affected")).select(F.lit(name).alias("issue"), "affected")

    twice = lambda df, key: df.groupBy(key).count().where("count > 1")
    found = [
        issue("duplicate-event-id", twice(log.events, "event_id")),
        issue("duplicate-object-id", twice(log.objects, "object_id")),
        issue("dangling-event", log.e2o.join(log.events, "event_id", "left_anti")),
        issue("dangling-object", log.e2o.join(log.objects, "object_id", "left_anti")),
        issue("event-without-object", log.events.join(log.e2o, "event_id", "left_anti")),
        issue("object-without-event", log.objects.join(log.e2o, "object_id", "left_anti")),
        issue("missing-time", log.events.where("ts is null")),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionAll(df)
    return out.where("affected > 0")


def prefix_scan(events: DataFrame, most: int) -> DataFrame:
    """The first ``most`` timed events, with the total and whether any were left out."""
    timed = events.where("ts is not null")
    total = F.broadcast(timed.agg(F.count("*").alias("total")))  # one row
    return timed.orderBy("ts", "event_id").limit(most).crossJoin(total).withColumn("truncated", F.col("total") > most)


def tally(responses: DataFrame) -> DataFrame:
    """(step, answer, n) of arrays of (step, answer)."""
    return responses.select(F.explode("responses").alias("r")).groupBy(F.col("r.step").alias("step"), F.col("r.answer").alias("answer")).agg(F.count("*").alias("n"))


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with counts, most frequent first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def sample_rows(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """A reproducible sample of ``rows`` rows: those of the smallest hashes of the key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(rows)


def write_ocel(log: OCEL, path: str, meta: dict | None = None) -> None:
    """One Parquet folder for each relation, and the metadata as JSON text beside them."""
    for name in ("events", "objects", "e2o", "o2o", "event_attr", "object_attr"):
        if (df := getattr(log, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    log.events.sparkSession.createDataFrame([(json.dumps(meta or {}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_ocel(spark, path: str) -> OCEL:
    """What ``write_ocel`` wrote; relations that are absent stay so."""
    got = {}
    for name in ("events", "objects", "e2o", "o2o", "event_attr", "object_attr"):
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path):
            got[name] = spark.read.parquet(f"{path}/{name}")
    return OCEL(**got)


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """Rows as CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def utc(text: Column) -> Column:
    """A time of ISO 8601, with fractions and offset if it has them, as UTC without a zone; one without offset is UTC."""
    zoned = text.rlike(r"T.*(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp").cast("timestamp_ntz"))


def read_xes(spark, path: str) -> EventLog:
    """Events of an XES file's traces: concept:name, time:timestamp, org:resource."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(
        "string array<struct<_key:string,_value:string>>, event array<struct<string:array<struct<_key:string,_value:string>>,date:array<struct<_key:string,_value:string>>>>"
    ).load(path)
    value = lambda col, key: F.get(F.filter(col, lambda x: x["_key"] == key), 0)["_value"]
    flat = traces.select(value("string", "concept:name").alias("case_id"), F.posexplode("event").alias("n", "e"))
    return EventLog(flat.select(
        "case_id", value("e.string", "concept:name").alias("activity"), utc(value("e.date", "time:timestamp")).alias("ts"),
        F.concat_ws("#", "case_id", F.lpad(F.col("n").cast("string"), 10, "0")).alias("event_id"), value("e.string", "org:resource").alias("resource"),
    ))
