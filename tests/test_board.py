import pytest
from pyspark.sql import functions as F

from roadpulse import functions as C
from roadpulse.operators import board
from tests.conftest import rows
from tests.samples import NOW, VIN_A, VIN_B, VIN_C, event, events


def one(spark, column, *values, type="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_ago(spark):
    ages = {
        -5000: "just now", 4499: "just now", 4500: "5s ago", 59_499: "59s ago", 59_500: "1 min ago",
        89_499: "1 min ago", 90_000: "2 min ago", 59.4 * 60_000: "59 min ago", 3_600_000: "1 h ago",
        5_400_000: "2 h ago", 90_000_000: "25 h ago",
    }
    got = one(spark, lambda c: C.ago_text(c, NOW), *[int(NOW - a) for a in ages], type="long")
    assert got == list(ages.values())


def test_stale(spark):
    got = one(spark, lambda c: C.is_stale(c, NOW), NOW - 60_000, NOW - 60_001, NOW + 1, type="long")
    assert got == [False, True, False]


def test_fleet_names(spark):
    assert one(
        spark, C.fleet_name, "UNASSIGNED", "fleet-north", "north", "fleet-", "fleet-fleet-x", "-x", "fleet-école", "a fleet-b"
    ) == ["Unassigned", "North", "North", "", "Fleet-x", "-x", "école", "A fleet-b"]


def test_labels_and_colours(spark):
    assert one(spark, C.status_label, "DRIVING", "UNSPECIFIED", "7") == ["Driving", "Unknown", None]
    plain = one(spark, lambda c: C.status_color(c, F.lit(False)), "FAULT", "7")
    assert plain == ["#c62f3b", "#8d99a3"]
    assert one(spark, lambda c: C.status_color(c, F.lit(True)), "FAULT") == ["#8d99a3"]


def test_battery(spark):
    soc = [0.0, 14.99, 15.0, 34.99, 35.0, 100.0, 54.9, 55.0]
    assert one(spark, C.battery_band, *soc, type="double") == ["low", "low", "mid", "mid", "ok", "ok", "ok", "ok"]
    assert one(spark, C.battery_cells, *soc, type="double") == [0, 1, 2, 3, 4, 10, 5, 6]
    assert one(spark, C.battery_percent, 0.5, 99.4, type="double") == ["1%", "99%"]


def test_delay_and_position(spark):
    df = spark.createDataFrame([(10, 3), (0, 3), (10, 0), (None, 3)], "p long, d long")
    got = [r[0] for r in df.select(C.pipeline_delay_ms(F.col("p"), F.col("d"))).collect()]
    assert got == [7, None, None, None]
    assert one(spark, lambda c: C.position_text(c, -c), 1.234567, type="double") == ["1.23457, -1.23457"]


@pytest.mark.parametrize(
    "sees_all, fleets, vins, text",
    [
        (True, [], [], "All fleets"),
        (False, ["fleet-north", "UNASSIGNED"], [], "North, Unassigned"),
        (False, ["fleet-north"], ["v"], "North, 1 individual vehicle"),
        (False, [], ["v", "w"], "2 individual vehicles"),
        (False, [], [], "No vehicles assigned"),
        (False, ["fleet-"], [], "No vehicles assigned"),
    ],
)
def test_scope_text(spark, sees_all, fleets, vins, text):
    df = spark.createDataFrame(
        [(sees_all, fleets, vins)], "a boolean, f array<string>, v array<string>"
    )
    assert df.select(C.scope_text(F.col("a"), F.col("f"), F.col("v"))).first()[0] == text


def test_board_order_filter_and_tally(spark):
    made = events(
        spark,
        event(VIN_A, status="PARKED"),
        event(VIN_B, status="FAULT", fleet="fleet-2"),
        event(VIN_C, status="7"),
        event("a" * 17, status="UNSPECIFIED"),
        event("E" * 17, status="FAULT"),
    )
    assert [r["vin"] for r in board.board_order(made).collect()] == [
        VIN_C, "a" * 17, VIN_B, "E" * 17, VIN_A
    ]
    assert rows(board.board_filter(made, query=" aa "), "vin") == [(VIN_A,)]
    assert rows(board.board_filter(made, "fleet-2"), "vin") == [(VIN_B,)]
    assert board.board_filter(made, query="  ").count() == 5
    assert [tuple(r) for r in board.status_tally(made).collect()] == [
        ("FAULT", 2, True), ("PARKED", 1, True), ("7", 1, False), ("UNSPECIFIED", 1, False)
    ]
    assert [r[0] for r in board.visible_fleets(made).collect()] == ["fleet-1", "fleet-2"]
    assert board.vehicle_detail(made, VIN_B).count() == 1
    listed = board.fleet_board(made, NOW + 120_000).collect()
    assert [r["vin"] for r in listed][:2] == [VIN_C, "a" * 17]
    assert listed[2]["fleet_name"] == "2" and listed[2]["ago_text"] == "2 min ago"


def test_extent(spark):
    made = events(spark, event(VIN_A, lat=1.0, lng=-5.0), event(VIN_B, lat=3.0, lng=-7.0))
    assert rows(board.map_extent(made)) == [(1.0, 3.0, -7.0, -5.0)]


def test_rate_against_brute_force(spark):
    times = [0, 1, 249, 250, 251, 4999, 5000, 5001, 12_345]
    made = spark.createDataFrame([(t,) for t in times], "t long").select(
        F.timestamp_millis("t").alias("timestamp")
    )
    expected = {}
    for tick in range(0, 20_000, 250):
        n = sum(1 for t in times if t <= tick and tick - t < 5000)
        if n:
            expected[tick] = n / 5
    assert dict(rows(board.update_rate(made), "tick_ms", "rate")) == expected


def test_latency_histogram(spark):
    df = spark.createDataFrame(
        [(100, 95), (100, 90), (20_100, 100), (0, 5)], "processed_timestamp long, device_timestamp long"
    )
    got = dict(rows(board.latency_histogram(df)))
    assert (got["0.005"], got["0.01"], got["10.0"], got["+Inf"]) == (1, 2, 2, 3)
