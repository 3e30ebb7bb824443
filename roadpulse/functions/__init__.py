"""Column functions: one derived value each, all built from Spark's own expressions."""

from roadpulse.functions.board import (
    ago_text,
    battery_band,
    battery_cells,
    battery_percent,
    fleet_name,
    is_stale,
    pipeline_delay_ms,
    position_text,
    scope_text,
    status_color,
    status_label,
    status_rank,
)
from roadpulse.functions.telemetry import (
    event_date,
    event_id,
    geo_point,
    index_name,
    ingest_timestamp,
    status_name,
)

__all__ = [
    "ago_text",
    "battery_band",
    "battery_cells",
    "battery_percent",
    "event_date",
    "event_id",
    "fleet_name",
    "geo_point",
    "index_name",
    "ingest_timestamp",
    "is_stale",
    "pipeline_delay_ms",
    "position_text",
    "scope_text",
    "status_color",
    "status_label",
    "status_name",
    "status_rank",
]
