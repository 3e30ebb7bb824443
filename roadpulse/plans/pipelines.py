"""The batch form of the dataflows, over any tables of the right shape."""

from pyspark.sql import Column, DataFrame

from roadpulse.operators.board import fleet_board
from roadpulse.operators.history import latest_positions
from roadpulse.operators.pipeline import (
    canonicalize,
    checked,
    dedup_in_batch,
    drop_seen,
    enrich_fleet,
    report_columns,
    valid_only,
)


def canonical_events(
    decoded: DataFrame,
    vehicle_fleet: DataFrame,
    now_ms: int,
    processed_ms: int | Column,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Decoded records to canonical events: check, de-duplicate, add the fleet, project.

    The only shuffle is the one by report; the fleet lookup is broadcast while it fits.
    """
    firsts = dedup_in_batch(report_columns(valid_only(checked(decoded, now_ms))))
    if seen is not None:
        firsts = drop_seen(firsts, seen)
    return canonicalize(enrich_fleet(firsts, vehicle_fleet), processed_ms)


def board_for_user(
    history: DataFrame, grants: DataFrame, now_ms: int, fleet: str = "all", query: str = ""
) -> DataFrame:
    """The vehicle list as one user sees it."""
    return fleet_board(latest_positions(history, grants, now_ms), now_ms, fleet, query)
