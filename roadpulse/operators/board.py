"""What the vehicle board and the map show."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse import functions as C
from roadpulse.functions.board import STATUS_ORDER

# Upper bounds in seconds of the latency buckets.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def board_filter(latest: DataFrame, fleet: str = "all", query: str = "") -> DataFrame:
    """Vehicles of a fleet whose VIN contains the trimmed, upper-cased search text."""
    shown = latest
    if fleet != "all":
        shown = shown.where(F.col("fleet_id") == fleet)
    text = query.strip().upper()
    if text:
        shown = shown.where(F.contains("vin", F.lit(text)))
    return shown


def board_order(board: DataFrame) -> DataFrame:
    return board.orderBy(C.status_rank(F.col("status")), "vin")


def vehicle_detail(latest: DataFrame, vin: str) -> DataFrame:
    return latest.where(F.col("vin") == vin)


def status_tally(board: DataFrame) -> DataFrame:
    """Vehicles by status in display order; ``shown`` tells which the board displays."""
    rank = C.status_rank(F.col("status"))
    counted = board.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("shown", rank > 0).orderBy(
        F.when(rank > 0, rank).otherwise(len(STATUS_ORDER) + 1), "status"
    )


def visible_fleets(latest: DataFrame) -> DataFrame:
    return latest.select("fleet_id").distinct().orderBy("fleet_id")


def map_extent(board: DataFrame) -> DataFrame:
    return board.agg(
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lng").alias("min_lng"),
        F.max("lng").alias("max_lng"),
    )


def update_rate(events: DataFrame, window_ms: int = 5000, slide_ms: int = 250) -> DataFrame:
    """Events per second at each tick: those strictly less than ``window_ms`` old at that tick.

    Events are first counted per tick interval; only these counts are spread over the ticks that
    see them, so no event row is multiplied.
    """
    if window_ms % slide_ms:
        raise ValueError("the window must be a whole number of slides")
    first_tick = F.ceil(F.unix_millis("timestamp") / F.lit(slide_ms)) * F.lit(slide_ms)
    per_tick = events.groupBy(first_tick.alias("first_tick")).agg(F.count(F.lit(1)).alias("n"))
    ticks = F.sequence(
        F.col("first_tick"), F.col("first_tick") + F.lit(window_ms - slide_ms), F.lit(slide_ms)
    )
    spread = per_tick.select(F.explode(ticks).alias("tick_ms"), "n")
    return spread.groupBy("tick_ms").agg((F.sum("n") / F.lit(window_ms / 1000.0)).alias("rate"))


def latency_histogram(canonical: DataFrame, buckets=LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts of the pipeline delay in seconds; the last bucket has no bound."""
    delay = C.pipeline_delay_ms(F.col("processed_timestamp"), F.col("device_timestamp")) / F.lit(1000.0)
    counts = [F.count_if(delay <= F.lit(b)).alias(str(b)) for b in buckets]
    totals = canonical.agg(*counts, F.count(delay).alias("+Inf"))
    return totals.unpivot([], [F.col(f"`{c}`") for c in totals.columns], "le", "n")


def fleet_board(
    latest: DataFrame, now_ms: int, fleet: str = "all", query: str = ""
) -> DataFrame:
    """The vehicle list in display order, with every text and colour it shows."""
    device, status, soc = F.col("device_timestamp"), F.col("status"), F.col("battery_soc")
    stale = C.is_stale(device, now_ms)
    return board_order(board_filter(latest, fleet, query)).select(
        "vin",
        "fleet_id",
        "status",
        C.fleet_name(F.col("fleet_id")).alias("fleet_name"),
        C.status_label(status).alias("status_label"),
        C.status_color(status, stale).alias("status_color"),
        stale.alias("is_stale"),
        C.ago_text(device, now_ms).alias("ago_text"),
        C.battery_band(soc).alias("battery_band"),
        C.battery_cells(soc).alias("battery_cells"),
        C.battery_percent(soc).alias("battery_percent"),
        C.position_text(F.col("lat"), F.col("lng")).alias("position_text"),
        C.pipeline_delay_ms(F.col("processed_timestamp"), device).alias("pipeline_delay_ms"),
    )
