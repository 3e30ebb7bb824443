"""From raw records to canonical events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.telemetry import event_id, ingest_timestamp, status_name
from roadpulse.operators.lookup import grouped, sized
from roadpulse.schemas import (
    CANONICAL,
    HEADERS,
    JSON_NAMES,
    REPORT,
    SCHEMA_VERSION,
    UNASSIGNED,
)

FUTURE_TOLERANCE_MS = 5 * 60 * 1000

# Reasons for rejecting a report.
INVALID_VIN = "invalid VIN "
OUT_OF_RANGE = "coordinates out of range"
BATTERY_OUT_OF_RANGE = "batterySOC out of range"
MISSING_TIME = "missing deviceTimestamp"
FUTURE_TIME = "deviceTimestamp in the future"
# A reason of our own, see validate().
NOT_FINITE = "not a finite number"

EVENT_KEY = ["vin", "device_timestamp"]
LOG_ORDER = ["partition", "offset"]


def _quoted(text: Column) -> Column:
    """Text in double quotes with backslash escapes, as it appears in rejection reasons."""
    for char, escape in [("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")]:
        text = F.replace(text, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), text, F.lit('"'))


def validate(decoded: DataFrame, now_ms: int) -> DataFrame:
    """Adds ``validate_error``: the first broken rule, or null.

    NaN is rejected on purpose: it passes every range test but has no JSON form, so it would block
    the log for good. Spark orders NaN above all numbers, hence the test before the ranges.
    """
    lat, lng, soc, ts = (F.col(c) for c in ["lat", "lng", "battery_soc", "device_timestamp"])
    error = (
        F.when(F.octet_length("vin") != 17, F.concat(F.lit(INVALID_VIN), _quoted(F.col("vin"))))
        .when(F.isnan(lat) | F.isnan(lng), NOT_FINITE)
        .when(~lat.between(-90, 90) | ~lng.between(-180, 180), OUT_OF_RANGE)
        .when(F.isnan(soc), NOT_FINITE)
        .when(~soc.between(0, 100), BATTERY_OUT_OF_RANGE)
        .when(ts <= 0, MISSING_TIME)
        .when(ts > now_ms + FUTURE_TOLERANCE_MS, FUTURE_TIME)
    )
    return decoded.withColumn("validate_error", error)


def checked(decoded: DataFrame, now_ms: int) -> DataFrame:
    """Validates and names one ``error`` per record: ``decode: …``, ``validate: …`` or null."""
    return validate(decoded, now_ms).withColumn(
        "error",
        F.coalesce(
            F.concat(F.lit("decode: "), "decode_error"),
            F.concat(F.lit("validate: "), "validate_error"),
        ),
    )


def valid_only(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.where(F.col("error").isNull())


def dead_letter(checked_rows: DataFrame) -> DataFrame:
    """Rejected records as they came, with three more headers saying why and from where."""

    def header(name, value):
        return F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))

    extra = F.array(
        header("error", F.col("error")),
        header("source_partition", F.col("partition").cast("string")),
        header("source_offset", F.col("offset").cast("string")),
    )
    return checked_rows.where(F.col("error").isNotNull()).select(
        "key",
        "value",
        F.concat(F.coalesce("headers", F.array().cast(HEADERS)), extra).alias("headers"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.col("error").alias("reason"),
    )


def report_columns(valid: DataFrame) -> DataFrame:
    """Only what the rest of the pipeline reads, so that payloads never enter a shuffle."""
    return valid.select(
        *LOG_ORDER,
        "timestamp",
        *[f.name for f in REPORT.fields],
        ingest_timestamp(F.col("headers"), F.col("timestamp")).alias("ingest_timestamp"),
    )


def dedup_in_batch(reports: DataFrame) -> DataFrame:
    """Keeps the first record in log order of each vehicle and device time.

    ``min_by`` is combined before the shuffle, so however many copies one report has, each task
    sends one of them.
    """
    rest = [c for c in reports.columns if c not in EVENT_KEY]
    first = F.min_by(F.struct(*rest), F.struct(*LOG_ORDER)).alias("first")
    return reports.groupBy(*EVENT_KEY).agg(first).select(*EVENT_KEY, "first.*").select(*reports.columns)


def drop_seen(reports: DataFrame, seen: DataFrame) -> DataFrame:
    """Removes reports that were published before.

    Both sides grow with the reports, so they are shuffled by the key that the reports were
    de-duplicated by.
    """
    return reports.join(seen.select(*EVENT_KEY), EVENT_KEY, "left_anti")


def enrich_fleet(events: DataFrame, vehicle_fleet: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """Adds the fleet of each vehicle, ``UNASSIGNED`` where it has none.

    A map that repeats a VIN gives its first fleet by name, never a second event.
    """
    fleets = sized(grouped(vehicle_fleet, ["vin"], fleet_id=F.min("fleet_id")), limit_bytes)
    joined = events.join(fleets, "vin", "left")
    return joined.withColumn("fleet_id", F.coalesce("fleet_id", F.lit(UNASSIGNED)))


def canonicalize(reports: DataFrame, processed_ms: int | Column) -> DataFrame:
    """The canonical columns; ``fleet_id`` only if the input was enriched before.

    Log position and record time stay on when present: later steps order by them.
    """
    processed = processed_ms if isinstance(processed_ms, Column) else F.lit(processed_ms)
    made = reports.select(
        event_id(F.col("vin"), F.col("device_timestamp")).alias("event_id"),
        F.lit(SCHEMA_VERSION).cast("int").alias("schema_version"),
        "vin",
        *[c for c in ["fleet_id"] if c in reports.columns],
        "lng",
        "lat",
        status_name(F.col("status_code")).alias("status"),
        F.col("battery_soc").cast("double").alias("battery_soc"),
        "device_timestamp",
        "ingest_timestamp",
        processed.cast("long").alias("processed_timestamp"),
        *[c for c in [*LOG_ORDER, "timestamp"] if c in reports.columns],
    )
    return made


def canonical_json() -> Column:
    """The event as JSON, members in message order."""
    members = [F.col(c).alias(JSON_NAMES[c]) for c in CANONICAL.fieldNames()]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def write_canonical(canonical: DataFrame) -> DataFrame:
    """Events as log records: keyed by VIN, JSON value, the fleet as a header."""
    fleet = F.struct(
        F.lit("fleet_id").alias("key"), F.encode("fleet_id", "UTF-8").alias("value")
    )
    return canonical.select(
        F.encode("vin", "UTF-8").alias("key"),
        F.encode(canonical_json(), "UTF-8").alias("value"),
        F.array(fleet).alias("headers"),
        *[c for c in [*LOG_ORDER, "timestamp"] if c in canonical.columns],
    )


def processing_outcomes(
    checked_rows: DataFrame, vehicle_fleet: DataFrame, seen: DataFrame | None = None
) -> DataFrame:
    """Record counts by outcome. ``unassigned_vin`` is a part of ``published``.

    One pass: counting per report first leaves one narrow row per report, whatever its copies.
    """
    valid = F.col("error").isNull()
    per_report = checked_rows.groupBy(
        valid.alias("valid"), *[F.when(valid, F.col(c)).alias(c) for c in EVENT_KEY]
    ).agg(F.count(F.lit(1)).alias("n"))
    if seen is None:
        per_report = per_report.withColumn("seen", F.lit(False))
    else:
        known = seen.select(*EVENT_KEY).distinct().withColumn("seen", F.lit(True))
        per_report = per_report.join(known, EVENT_KEY, "left").withColumn(
            "seen", F.coalesce("seen", F.lit(False))
        )
    per_report = enrich_fleet(per_report, vehicle_fleet)
    fresh = F.col("valid") & ~F.col("seen")
    one = F.lit(1).cast("long")
    totals = per_report.agg(
        *[
            F.coalesce(F.sum(value), F.lit(0)).alias(name)
            for name, value in {
                "invalid": F.when(~F.col("valid"), F.col("n")),
                "duplicate": F.when(F.col("valid"), F.col("n") - F.when(fresh, one).otherwise(0)),
                "unassigned_vin": F.when(fresh & (F.col("fleet_id") == UNASSIGNED), one),
                "published": F.when(fresh, one),
            }.items()
        ]
    )
    return totals.unpivot([], totals.columns, "outcome", "n")
