"""Columns of the report-to-event pipeline."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 24 * 60 * 60 * 1000

# Wire number and name of each vehicle status.
STATUS_NAMES = {
    0: "UNSPECIFIED",
    1: "PARKED",
    2: "DRIVING",
    3: "CHARGING",
    4: "IDLE",
    5: "FAULT",
}


def lookup(table: dict, key: Column) -> Column:
    """Value of a small literal table; null for a key it does not hold."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def status_name(code: Column) -> Column:
    """Name of a status number; numbers this version does not know stay as their digits."""
    return F.coalesce(lookup(STATUS_NAMES, code), code.cast("string"))


def event_id(vin: Column, device_timestamp: Column) -> Column:
    return F.concat(vin, F.lit("-"), device_timestamp.cast("string"))


def ingest_timestamp(headers: Column, timestamp: Column) -> Column:
    """First ``ingest_ts`` header that is an integer, else the record time in ms.

    The pattern comes first because a cast alone would accept surrounding spaces.
    """
    texts = F.transform(
        F.filter(headers, lambda h: h["key"] == "ingest_ts"),
        lambda h: F.try_validate_utf8(h["value"].cast("string")),
    )
    numbers = F.transform(
        F.filter(texts, lambda t: t.rlike(r"^[+-]?[0-9]+\z")), lambda t: t.try_cast("bigint")
    )
    usable = F.filter(numbers, lambda n: n.isNotNull())
    return F.coalesce(F.get(usable, F.lit(0)), F.unix_millis(timestamp))


def event_date(device_timestamp: Column) -> Column:
    """UTC day of an epoch-ms value, whatever the session's time zone is."""
    return F.date_from_unix_date(F.floor(device_timestamp / F.lit(DAY_MS)).try_cast("int"))


def index_name(device_timestamp: Column, prefix: str = "telemetry") -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(event_date(device_timestamp), "yyyy.MM.dd"))


def geo_point(lat: Column, lng: Column) -> Column:
    return F.struct(lat.alias("lat"), lng.alias("lon"))


def once(value: Column) -> Column:
    """The same value from a generator of one row, which filters cannot be pushed through.

    Without it a filter on a parsed document is moved below the projection, with a copy of the parse
    for every mention.
    """
    return F.explode(F.array(value))
