import random

from pyspark.sql import functions as F

from roadpulse.operators import board, history
from roadpulse.operators.pipeline import write_canonical
from roadpulse.sources.files import tier_start
from roadpulse.sources.history import (
    compact_history,
    day_batches,
    fold_batches,
    merge_days,
    read_history,
    read_writes,
    write_history,
)
from tests.conftest import rows
from tests.samples import NOW, VIN_A, VIN_B, VIN_C, event, events

DAY = 86_400_000


def held(spark, *topics):
    return spark.createDataFrame([("u", t) for t in topics], "user_id string, topic string")


def test_scope_goes_by_the_fleet_of_the_report(spark):
    moved = events(spark, event(VIN_A, NOW - 10, "old"), event(VIN_A, NOW, "new"))
    for topic, ts in [("fleet:old", NOW - 10), ("fleet:new", NOW), ("*", NOW), (f"vin:{VIN_A}", NOW)]:
        got = history.latest_positions(moved, held(spark, topic), NOW)
        assert rows(got, "device_timestamp") == [(ts,)]
    assert history.latest_positions(moved, held(spark), NOW).count() == 0


def test_last_day_has_no_upper_bound_and_a_limit(spark):
    made = events(
        spark, event(VIN_A, NOW - DAY), event(VIN_B, NOW - DAY - 1), event(VIN_C, NOW + 10**9)
    )
    got = history.latest_positions(made, held(spark, "*"), NOW)
    assert [r["vin"] for r in got.collect()] == [VIN_C, VIN_A]
    assert [r["vin"] for r in history.latest_positions(made, held(spark, "*"), NOW, 1).collect()] == [VIN_C]


def test_order_of_rows_does_not_matter(spark):
    made = [event(v, NOW - i * 1000, offset=i) for i in range(40) for v in (VIN_A, VIN_B)]
    expected = None
    for seed in range(3):
        random.Random(seed).shuffle(made)
        got = rows(history.latest_positions(events(spark, *made), held(spark, "*"), NOW))
        expected = expected or got
        assert got == expected


def test_merge_newest_ties_and_late_events(spark):
    def arriving(seq, *made):
        return events(spark, *made).withColumn("arrival_seq", F.lit(seq).cast("long"))

    snapshot = arriving(0, event(VIN_A, NOW, status="PARKED"), event(VIN_B, NOW, status="PARKED"))
    live = arriving(1, event(VIN_A, NOW, status="IDLE"), event(VIN_B, NOW - 1, status="IDLE"))
    assert rows(history.merge_newest(snapshot, live), "vin", "status") == [
        (VIN_A, "IDLE"), (VIN_B, "PARKED")
    ]


def values(spark, *texts):
    return spark.createDataFrame(
        [(i, t) for i, t in enumerate(texts)], "offset long, text string"
    ).select("offset", F.lit(0).alias("partition"), F.encode("text", "UTF-8").alias("value"))


def test_parse_and_outcomes(spark):
    good = '{"eventId":"e","vin":"v","lat":1.5,"lng":2.5,"batterySOC":55,"deviceTimestamp":5}'
    log = values(
        spark,
        good,
        '{"eventId":"","vin":"v"}',
        '{"vin":"v"}',
        "{",
        '{"eventId":"e2","lat":"north"}',
        '{"eventId":"e3","lat":91}',
        '{"eventId":"e4","unknown":true}',
    )
    parsed = history.parse_canonical(log).orderBy("offset").collect()
    assert [r["skipped"] for r in parsed] == [False, True, True, True, True, False, False]
    assert (parsed[0]["battery_soc"], parsed[0]["fleet_id"], parsed[0]["schema_version"]) == (55.0, "", 0)
    assert dict(rows(history.history_outcomes(log))) == {"indexed": 2, "skipped": 4, "rejected": 1}
    stored = history.storable(log).orderBy("offset").collect()
    assert [r["event_id"] for r in stored] == ["e", "e4"]
    assert (stored[0]["location"]["lat"], stored[0]["location"]["lon"]) == (1.5, 2.5)


def test_json_round_trip(spark):
    made = events(spark, event(VIN_A, NOW, soc=55.29999923706055), event(VIN_B, NOW + 1))
    back = history.parse_canonical(write_canonical(made))
    names = [c for c in made.columns if c in back.columns]
    assert rows(back, *names) == rows(made, *names)


def test_history_is_idempotent_and_newest_write_wins(spark, tmp_path):
    path = str(tmp_path / "history")
    assert read_history(spark, path).count() == 0
    first = events(spark, event(VIN_A, NOW, "old", 0), event(VIN_B, NOW - 3 * DAY, "f", 1))
    second = events(spark, event(VIN_A, NOW, "new", 2), event(VIN_A, NOW, "mid", 1), event(VIN_C, NOW, "f", 3))
    write_history(first, path, 0)
    write_history(second, path, 1)
    once = rows(read_history(spark, path), "event_id", "fleet_id", "event_date")
    write_history(second, path, 1)
    write_history(first, path, 0)
    assert rows(read_history(spark, path), "event_id", "fleet_id", "event_date") == once
    assert [r[1] for r in once] == ["new", "f", "f"]
    assert len({r[2] for r in once}) == 2
    assert read_writes(spark, path).count() == 5
    compacted = str(tmp_path / "compacted")
    compact_history(spark, path, compacted, 1)
    assert read_writes(spark, compacted).count() == 3
    assert rows(read_history(spark, compacted), "event_id", "fleet_id", "event_date") == once


def test_tiers_leave_as_many_folders_as_the_digits_add_up_to():
    for fan_in in (2, 8, 10):
        folders = []
        for n in range(600):
            first = tier_start(n, fan_in)
            if first is not None:
                folders = [f for f in folders if f < first] + [n - 1]
            digits, m = 0, n
            while m:
                digits, m = digits + m % fan_in, m // fan_in
            assert len(folders) == digits
            folders.append(n)


def test_merged_batches_hold_the_newest_writes_in_few_folders(spark, tmp_path):
    path = str(tmp_path / "history")
    for n in range(5):
        made = [event(VIN_A, NOW, f"f{n}", n), event(VIN_A, NOW, f"g{n}", n + 10), event(VIN_B, NOW - n % 2 * DAY, "b", n)]
        write_history(events(spark, *made), path, n)
    want = rows(read_history(spark, path), "event_id", "fleet_id")
    fold_batches(spark, path, 0, 2)
    assert [own for own in day_batches(spark, path).values()] == [[2, 3], [2, 3, 4]]
    assert rows(read_history(spark, path), "event_id", "fleet_id") == want
    fold_batches(spark, path, 0, 2)
    write_history(events(spark, *made), path, 4)  # a repeated batch finds its own folders
    fold_batches(spark, path, 0, 3)
    assert [own for own in day_batches(spark, path).values()] == [[3], [3, 4]]
    merge_days(spark, path, 4)
    assert [own for own in day_batches(spark, path).values()] == [[4], [4]]
    found = read_history(spark, path)
    assert rows(found, "event_id", "fleet_id") == want and read_writes(spark, path).count() == len(want)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("ReusedExchange", "")
    write_history(events(spark, event(VIN_A, NOW, "late", 0)), path, 5)
    assert ("late" in {r[1] for r in rows(read_history(spark, path), "event_id", "fleet_id")})


def test_last_day_reads_only_recent_partitions(spark, tmp_path):
    path = str(tmp_path / "history")
    write_history(events(spark, event(VIN_A, NOW), event(VIN_B, NOW - 5 * DAY)), path, 0)
    recent = history.last_24h(read_history(spark, path), NOW)
    text = recent._jdf.queryExecution().executedPlan().toString()
    filters = text[text.index("PartitionFilters"):]
    assert "event_date" in filters[: filters.index("PushedFilters")]
    assert rows(recent, "vin") == [(VIN_A,)]


def test_upsert_of_tables(spark, tmp_path):
    path = str(tmp_path / "history")
    write_history(events(spark, event(VIN_A, NOW, "old"), event(VIN_B, NOW)), path, 0)
    old = read_history(spark, path)
    write_history(events(spark, event(VIN_A, NOW, "new")), str(tmp_path / "more"), 1)
    new = read_history(spark, str(tmp_path / "more"))
    for _ in range(2):
        assert rows(history.upsert_history(old, new), "vin", "fleet_id") == [
            (VIN_A, "new"), (VIN_B, "fleet-1")
        ]
    assert "location" not in history.without_location(old).columns


def test_no_vehicle_is_left_out_of_a_large_board(spark):
    made = events(spark, *[event(f"{i:017d}", NOW) for i in range(6001)])
    latest = history.latest_positions(made, held(spark, "*"), NOW)
    assert latest.count() == 6001
    assert board.status_tally(latest).agg(F.sum("n")).first()[0] == 6001
