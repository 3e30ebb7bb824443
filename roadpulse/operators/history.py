"""The daily history and the questions asked of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.functions.telemetry import DAY_MS, event_date, geo_point, index_name, once
from roadpulse.operators.routing import visible_to
from roadpulse.schemas import CANONICAL, CANONICAL_JSON, JSON_NAMES, WRITE_ORDER

CORRUPT = "corrupt"


def parse_canonical(records: DataFrame) -> DataFrame:
    """Adds the canonical columns and ``skipped``, true for a value without a usable event.

    Members that are missing get the empty value of their type, as the message format has no null.
    """
    parsed = F.from_json(
        F.col("value").cast("string"),
        T.StructType([*CANONICAL_JSON.fields, T.StructField(CORRUPT, T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    with_event = records.withColumn("event", once(parsed))
    columns = []
    for field in CANONICAL.fields:
        value = F.col(f"event.{JSON_NAMES[field.name]}")
        empty = "" if field.dataType.simpleString() == "string" else 0
        columns.append(F.coalesce(value, F.lit(empty).cast(field.dataType)).alias(field.name))
    skipped = (
        F.col("event").isNull()
        | F.col(f"event.{CORRUPT}").isNotNull()
        | (F.coalesce(F.col("event.eventId"), F.lit("")) == "")
    )
    kept = [c for c in records.columns if c not in CANONICAL.fieldNames()]
    return with_event.select(*kept, *columns, skipped.alias("skipped"))


def with_location(canonical: DataFrame) -> DataFrame:
    return canonical.withColumn("location", geo_point(F.col("lat"), F.col("lng")))


def without_location(history: DataFrame) -> DataFrame:
    return history.drop("location")


def with_event_date(canonical: DataFrame) -> DataFrame:
    ts = F.col("device_timestamp")
    return canonical.withColumn("event_date", event_date(ts)).withColumn("index_name", index_name(ts))


def history_outcomes(records: DataFrame) -> DataFrame:
    """Counts of stored values by outcome; a position off the globe is refused by the store."""
    parsed = parse_canonical(records)
    on_globe = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    outcome = (
        F.when(F.col("skipped"), "skipped").when(~on_globe, "rejected").otherwise("indexed")
    )
    return parsed.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def storable(records: DataFrame) -> DataFrame:
    """The events of a log that the history accepts, with their location."""
    parsed = parse_canonical(records).where(~F.col("skipped")).drop("skipped")
    on_globe = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    return with_location(parsed.where(on_globe))


def last_24h(history: DataFrame, now_ms: int) -> DataFrame:
    """Reports of the last 24 hours, with no upper bound.

    The day is implied by the time, but not to the optimizer: naming it lets whole daily partitions
    be skipped.
    """
    since = now_ms - DAY_MS
    recent = F.col("device_timestamp") >= since
    if "event_date" in history.columns:
        recent &= F.col("event_date") >= event_date(F.lit(since))
    return history.where(recent)


def newest_per_vehicle(events: DataFrame, *tie_breakers: str) -> DataFrame:
    rest = [c for c in events.columns if c != "vin"]
    newest = F.max_by(F.struct(*rest), F.struct("device_timestamp", *tie_breakers))
    return events.groupBy("vin").agg(newest.alias("newest")).select("vin", "newest.*").select(*events.columns)


def latest_positions(
    history: DataFrame, grants: DataFrame, now_ms: int, limit: int | None = None
) -> DataFrame:
    """Newest report of every vehicle that the holder of ``grants`` may see, newest first.

    The scope is applied to each report before the newest is picked: it goes by the fleet that the
    report was made in, not by today's. All such vehicles are returned unless the caller sets a ``limit``.
    """
    seen = visible_to(last_24h(history, now_ms), grants)
    newest = newest_per_vehicle(seen, "ingest_timestamp")
    newest = newest.orderBy(F.desc("device_timestamp"), "vin")
    return newest if limit is None else newest.limit(limit)


def merge_newest(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Newest report per vehicle of both; at equal device times the later ``arrival_seq`` wins."""
    return newest_per_vehicle(snapshot.unionByName(events), "arrival_seq")


def upsert_history(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per event id and day: the newest write."""
    return newest_writes(existing.unionByName(incoming))


def newest_writes(rows: DataFrame) -> DataFrame:
    """The day is a grouping key, so a filter on it reaches the partitions of the scan."""
    keys = ["event_date", "event_id"]
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*WRITE_ORDER))
    return rows.groupBy(*keys).agg(newest.alias("newest")).select(*keys, "newest.*").select(*rows.columns)
