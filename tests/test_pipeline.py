import math
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from roadpulse import functions as C
from roadpulse.operators import access, master, pipeline, routing
from roadpulse.plans.pipelines import canonical_events
from roadpulse.schemas import HEADERS, RAW_LOG
from tests.conftest import rows
from tests.samples import NOW, VIN_A, VIN_B, decoded, report


def errors(spark, *reports):
    out = pipeline.checked(decoded(spark, *reports), NOW)
    return [r["error"] for r in out.orderBy("offset").collect()]


def test_validation_order_and_bounds(spark):
    nan, inf = math.nan, math.inf
    assert errors(
        spark,
        report(0),
        report(1, vin="BAD", lat=95.0, soc=-1.0),
        report(2, lat=90.0, lng=-180.0, soc=0.0),
        report(3, lat=-90.0, lng=180.0, soc=100.0),
        report(4, lat=90.0001, soc=-1.0),
        report(5, soc=100.1, ts=0),
        report(6, ts=0),
        report(7, ts=NOW + 300_000),
        report(8, ts=NOW + 300_001),
        report(9, lat=nan),
        report(10, soc=nan),
        report(11, lng=inf),
        report(12, soc=-inf),
        report(13, vin="é" + "A" * 16),
        report(14, vin="é" + "A" * 15),
        report(15, vin=None, lat=None, lng=None, status=None, soc=None, ts=None, error="truncated"),
        report(16, vin='a"\\b'),
    ) == [
        None,
        'validate: invalid VIN "BAD"',
        None,
        None,
        "validate: coordinates out of range",
        "validate: batterySOC out of range",
        "validate: missing deviceTimestamp",
        None,
        "validate: deviceTimestamp in the future",
        "validate: not a finite number",
        "validate: not a finite number",
        "validate: coordinates out of range",
        "validate: batterySOC out of range",
        'validate: invalid VIN "é' + "A" * 16 + '"',
        None,
        "decode: truncated",
        'validate: invalid VIN "a\\"\\\\b"',
    ]


def test_dead_letter_keeps_the_record_and_adds_headers(spark):
    checked = pipeline.checked(decoded(spark, report(7, vin="BAD"), report(8)), NOW)
    only = pipeline.dead_letter(checked).collect()
    assert len(only) == 1
    assert bytes(only[0]["key"]) == b"BAD" and bytes(only[0]["value"]) == b"payload"
    assert [(h["key"], bytes(h["value"]).decode()) for h in only[0]["headers"]] == [
        ("ingest_ts", "1"),
        ("error", 'validate: invalid VIN "BAD"'),
        ("source_partition", "0"),
        ("source_offset", "7"),
    ]


def test_first_in_log_order_wins(spark):
    reports = decoded(
        spark,
        report(5, soc=1.0),
        report(3, soc=2.0),
        report(4, soc=3.0, ts=NOW - 1),
        report(1, vin=VIN_B, soc=4.0),
    )
    firsts = pipeline.dedup_in_batch(pipeline.report_columns(reports))
    assert rows(firsts, "offset", "battery_soc") == [(1, 4.0), (3, 2.0), (4, 3.0)]


def test_ingest_timestamp_headers(spark):
    cases = {
        (("ingest_ts", b"x"), ("ingest_ts", b"42")): 42,
        (("ingest_ts", b" 5 "),): NOW,
        (("ingest_ts", b"+5"),): 5,
        (("ingest_ts", b"-5"),): -5,
        (("ingest_ts", b"5.5"),): NOW,
        (("ingest_ts", b"5\n"),): NOW,
        (("ingest_ts", b"99999999999999999999"),): NOW,
        (("ingest_ts", b"\xff"), ("other", b"3")): NOW,
        (): NOW,
    }
    df = spark.createDataFrame(
        [(i, list(h)) for i, h in enumerate(cases)],
        "i int, headers array<struct<key:string,value:binary>>",
    ).withColumn("timestamp", F.timestamp_millis(F.lit(NOW)))
    made = df.select("i", C.ingest_timestamp(F.col("headers"), F.col("timestamp")).alias("t"))
    assert [r["t"] for r in made.orderBy("i").collect()] == list(cases.values())


def test_status_names_and_unknown_numbers(spark):
    df = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 4, 5, 7, -1]], "c int")
    names = [r[0] for r in df.select(C.status_name(F.col("c"))).collect()]
    assert names == ["UNSPECIFIED", "PARKED", "DRIVING", "CHARGING", "IDLE", "FAULT", "7", "-1"]


def test_event_date_is_utc_in_any_session_zone(spark):
    ts = 1_700_000_000_000 - 1_700_000_000_000 % 86_400_000
    df = spark.createDataFrame([(ts,), (ts - 1,), (0,), (-1,)], "t long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = [
            tuple(r)
            for r in df.select(
                C.event_date(F.col("t")).cast("string"), C.index_name(F.col("t"))
            ).collect()
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [
        ("2023-11-14", "telemetry-2023.11.14"),
        ("2023-11-13", "telemetry-2023.11.13"),
        ("1970-01-01", "telemetry-1970.01.01"),
        ("1969-12-31", "telemetry-1969.12.31"),
    ]


def test_canonical_event(spark):
    fleets = spark.createDataFrame([(VIN_A, "fleet-1")], "vin string, fleet_id string")
    made = canonical_events(
        decoded(spark, report(0, soc=55.3), report(1, vin=VIN_B, status=7)), fleets, NOW, 99
    )
    a, b = made.orderBy("vin").collect()
    assert a["event_id"] == f"{VIN_A}-{NOW}" and a["schema_version"] == 1
    assert a["battery_soc"] == 55.29999923706055
    assert (a["fleet_id"], b["fleet_id"], b["status"]) == ("fleet-1", "UNASSIGNED", "7")
    assert (a["ingest_timestamp"], a["processed_timestamp"]) == (1, 99)


def test_json_form_has_fixed_order(spark):
    fleets = spark.createDataFrame([(VIN_A, "fleet-1")], "vin string, fleet_id string")
    made = canonical_events(decoded(spark, report(0)), fleets, NOW, 99)
    record = pipeline.write_canonical(made).first()
    assert bytes(record["value"]).decode() == (
        f'{{"eventId":"{VIN_A}-{NOW}","schemaVersion":1,"vin":"{VIN_A}","fleetId":"fleet-1",'
        f'"lng":-122.41,"lat":37.77,"status":"DRIVING","batterySOC":55.0,"deviceTimestamp":{NOW},'
        '"ingestTimestamp":1,"processedTimestamp":99}'
    )
    assert bytes(record["key"]).decode() == VIN_A
    assert [(h["key"], bytes(h["value"])) for h in record["headers"]] == [("fleet_id", b"fleet-1")]


def test_outcomes(spark):
    checked = pipeline.checked(
        decoded(
            spark,
            report(0),
            report(1),
            report(2, vin=VIN_B),
            report(3, vin="BAD"),
            report(4, vin="BAD"),
            report(5, ts=NOW - 5),
            report(6, ts=NOW - 5),
        ),
        NOW,
    )
    fleets = spark.createDataFrame([(VIN_A, "fleet-1")], "vin string, fleet_id string")
    seen = spark.createDataFrame([(VIN_A, NOW - 5)], "vin string, device_timestamp long")
    assert dict(rows(pipeline.processing_outcomes(checked, fleets))) == {
        "invalid": 2, "duplicate": 2, "unassigned_vin": 1, "published": 3
    }
    assert dict(rows(pipeline.processing_outcomes(checked, fleets, seen))) == {
        "invalid": 2, "duplicate": 3, "unassigned_vin": 1, "published": 2
    }


def test_fleet_lookup_too_large_to_broadcast(spark):
    reports = decoded(spark, report(0), report(1, vin=VIN_B))
    fleets = spark.createDataFrame([(VIN_A, "fleet-1")], "vin string, fleet_id string")
    big = pipeline.enrich_fleet(reports, fleets, limit_bytes=0)
    assert rows(big, "vin", "fleet_id") == [(VIN_A, "fleet-1"), (VIN_B, "UNASSIGNED")]


@contextmanager
def small_partitions(spark, **more):
    """No broadcasts, and partitions of a few kilobytes that the skew join may split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    } | more
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark):
    n = F.col("id")
    vin = F.when(n % 3 == 0, "HOT").otherwise(F.concat(F.lit("V"), (n % 1000).cast("string")))
    return spark.range(0, 60_000, 1, 8).select(vin.alias("vin"), F.sha2(n.cast("string"), 256).alias("x"))


def is_split(joined):
    joined.collect()
    return "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_hot_vehicle_is_split_by_the_skew_join(spark):
    """With a lookup too large to broadcast, one VIN with most of the rows ends in several tasks."""
    with small_partitions(spark):
        lookup = spark.range(1000).select(
            F.concat(F.lit("V"), F.col("id").cast("string")).alias("vin"), F.lit("f").alias("fleet_id")
        )
        joined = pipeline.enrich_fleet(hot(spark), lookup, limit_bytes=0)
        assert joined.where("fleet_id = 'UNASSIGNED'").count() == 20_000
        assert is_split(joined)


@pytest.mark.parametrize("column", ["vin", "fleet_id"])
@pytest.mark.parametrize("operator", [routing.unrouted_events, routing.visible_to])
def test_hot_vehicle_or_fleet_is_split_when_events_meet_grants(spark, operator, column):
    with small_partitions(spark):
        other = "vin" if column == "fleet_id" else "fleet_id"
        events = hot(spark).withColumnRenamed("vin", column).withColumn(other, F.substring("x", 1, 6))
        prefix = "vin:" if column == "vin" else "fleet:"
        held = spark.range(500).select(F.concat(F.lit(prefix + "V"), F.col("id").cast("string")).alias("topic"))
        kept = operator(events, held.unionByName(held), limit_bytes=0)
        n = 60_000 - events.where(f"{column} rlike '^V' AND cast(substring({column}, 2) AS int) < 500").count()
        assert kept.count() == (n if operator is routing.unrouted_events else 60_000 - n)
        assert is_split(kept)


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    n = F.col("id")
    rows = spark.range(0, 60_000, 1, 8).select(
        n.alias("seq"),
        F.concat(F.lit("u"), (n % 5000).cast("string")).alias("user_id"),
        F.when(n % 10 == 0, F.concat(F.lit("f"), (n % 700).cast("string"))).when(n % 10 < 5, "").alias("fleet_id"),
        F.when(n % 10 == 1, F.concat(F.lit("v"), (n % 900).cast("string"))).alias("vin"),
    )
    users, fleets, vehicles = (rows.select(c).where(f"{c} <> ''").distinct() for c in ("user_id", "fleet_id", "vin"))
    grants = users.select("user_id", F.concat(F.lit("fleet:f"), F.lit("70")).alias("topic"))
    fixed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false"}
    with small_partitions(spark, **fixed, **{"spark.sql.shuffle.partitions": "16"}):
        checked = master.check_grants(rows, users, fleets, vehicles)
        assert checked.where("error IS NULL").count() == 12_000
        allowed = access.check_access(rows, grants, limit_bytes=0)
        assert allowed.where("allowed").count() == rows.where("fleet_id = 'f70'").count() > 0
        changes = master.check_vehicle_changes(rows, fleets)
        for made in (checked, allowed, changes):
            sizes = sorted(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect())
            assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]


def test_a_text_that_stands_for_no_key_meets_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "seq int, fleet_id string").withColumn("vin", F.lit("V" * 17))
    found = master.check_vehicle_changes(rows, spark.createDataFrame([("a",), ("a",), ("",), (None,)], "fleet_id string"))
    assert [(r.seq, r.error) for r in found.orderBy("seq").collect()] == [(1, "bad_request"), (2, "bad_request"), (3, None)]


def test_copies_are_combined_before_the_shuffle(spark):
    """The first report is picked map-side, so copies never travel."""
    plan = pipeline.dedup_in_batch(pipeline.report_columns(decoded(spark, report(0))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in text[text.index("Exchange"):]


def test_raw_log_schema_is_that_of_the_topic_reader():
    assert RAW_LOG.fieldNames() == ["key", "value", "headers", "partition", "offset", "timestamp"]
    assert RAW_LOG["headers"].dataType == HEADERS


def test_a_map_that_repeats_a_vin_repeats_no_event(spark):
    reports = spark.createDataFrame([("v", 1)], "vin string, n int")
    fleets = spark.createDataFrame([("v", "f2"), ("v", "f1")], "vin string, fleet_id string")
    assert [r.fleet_id for r in pipeline.enrich_fleet(reports, fleets).collect()] == ["f1"]
