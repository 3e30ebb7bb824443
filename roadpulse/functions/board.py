"""Columns of the vehicle board."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.functions.telemetry import lookup
from roadpulse.schemas import UNASSIGNED

STALE_AFTER_MS = 60_000

# The display order, labels and colours of the statuses.
STATUS_ORDER = ["FAULT", "DRIVING", "CHARGING", "IDLE", "PARKED"]
STATUS_LABELS = {
    "DRIVING": "Driving",
    "CHARGING": "Charging",
    "PARKED": "Parked",
    "IDLE": "Idle",
    "FAULT": "Fault",
    "UNSPECIFIED": "Unknown",
}
STATUS_COLORS = {
    "DRIVING": "#1f5fd1",
    "CHARGING": "#0a8a62",
    "PARKED": "#5c6975",
    "IDLE": "#b7791f",
    "FAULT": "#c62f3b",
    "UNSPECIFIED": "#8d99a3",
}
STALE_COLOR = "#8d99a3"


def _nearest(x: Column) -> Column:
    """Nearest integer with halves going up, for negative numbers too."""
    return F.floor(x + F.lit(0.5))


def is_stale(device_timestamp: Column, now_ms: int) -> Column:
    return F.lit(now_ms) - device_timestamp > F.lit(STALE_AFTER_MS)


def ago_text(device_timestamp: Column, now_ms: int) -> Column:
    seconds = F.greatest(F.lit(0), _nearest((F.lit(now_ms) - device_timestamp) / F.lit(1000)))
    minutes = _nearest(seconds / F.lit(60))
    hours = _nearest(minutes / F.lit(60))
    return (
        F.when(seconds < 5, F.lit("just now"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" h ago")))
    )


def fleet_name(fleet_id: Column) -> Column:
    """``fleet-north`` becomes ``North``; only an initial ASCII word character is raised."""
    bare = F.regexp_replace(fleet_id, "^fleet-", "")
    raised = F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))
    return F.when(fleet_id == UNASSIGNED, F.lit("Unassigned")).otherwise(
        F.when(bare.rlike(r"^\w"), raised).otherwise(bare)
    )


def status_label(status: Column) -> Column:
    return lookup(STATUS_LABELS, status)


def status_color(status: Column, stale: Column) -> Column:
    known = F.coalesce(lookup(STATUS_COLORS, status), F.lit(STATUS_COLORS["UNSPECIFIED"]))
    return F.when(stale, F.lit(STALE_COLOR)).otherwise(known)


def status_rank(status: Column) -> Column:
    """Place in the display order; 0, so before all others, for a status outside it."""
    return F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)


def battery_band(soc: Column) -> Column:
    return F.when(soc < 15, F.lit("low")).when(soc < 35, F.lit("mid")).otherwise(F.lit("ok"))


def battery_cells(soc: Column) -> Column:
    """How many of the ten cells are filled."""
    return _nearest(soc / F.lit(10))


def battery_percent(soc: Column) -> Column:
    return F.concat(_nearest(soc).cast("string"), F.lit("%"))


def pipeline_delay_ms(processed_timestamp: Column, device_timestamp: Column) -> Column:
    """Null when either time is missing or 0."""
    return F.when(
        (processed_timestamp != 0) & (device_timestamp != 0), processed_timestamp - device_timestamp
    )


def position_text(lat: Column, lng: Column) -> Column:
    return F.format_string("%.5f, %.5f", lat, lng)


def scope_text(all_fleets: Column, fleet_ids: Column, vins: Column) -> Column:
    n = F.size(vins)
    vehicles = F.when(n > 1, F.concat(n.cast("string"), F.lit(" individual vehicles"))).when(
        n == 1, F.lit("1 individual vehicle")
    )
    parts = F.concat(F.transform(fleet_ids, fleet_name), F.array(vehicles))
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), ", ")
    return (
        F.when(all_fleets, F.lit("All fleets"))
        .when(text == "", F.lit("No vehicles assigned"))
        .otherwise(text)
    )
