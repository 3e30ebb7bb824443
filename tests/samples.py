"""Small hand-written frames in the shape of the reports and events."""

from pyspark.sql import functions as F

from roadpulse.functions.wire import report_class
from roadpulse.schemas import HEADERS

NOW = 1_700_000_000_000
VIN_A, VIN_B, VIN_C = "A" * 17, "B" * 17, "C" * 17

DECODED = (
    "partition int, offset long, vin string, lng double, lat double, status_code int, "
    "battery_soc float, device_timestamp long, decode_error string"
)
EVENT = (
    "event_id string, schema_version int, vin string, fleet_id string, lng double, lat double, "
    "status string, battery_soc double, device_timestamp long, ingest_timestamp long, "
    "processed_timestamp long, partition int, offset long, timestamp timestamp"
)


def report(offset=0, vin=VIN_A, lng=-122.41, lat=37.77, status=2, soc=55.0, ts=NOW, partition=0, error=None):
    return (partition, offset, vin, lng, lat, status, soc, ts, error)


def decoded(spark, *reports, ingest="1", record_ms=NOW):
    header = F.struct(F.lit("ingest_ts").alias("key"), F.lit(ingest.encode()).alias("value"))
    return (
        spark.createDataFrame(list(reports), DECODED)
        .withColumn("key", F.encode("vin", "UTF-8"))
        .withColumn("value", F.lit(b"payload"))
        .withColumn("headers", F.array(header).cast(HEADERS))
        .withColumn("timestamp", F.timestamp_millis(F.lit(record_ms)))
    )


def event(vin=VIN_A, ts=NOW, fleet="fleet-1", offset=0, status="DRIVING", soc=55.0, lat=1.0, lng=2.0, id=None):
    return (
        id or f"{vin}-{ts}", 1, vin, fleet, lng, lat, status, soc, ts, ts + 1, ts + 2, 0, offset, None
    )


def events(spark, *made):
    return spark.createDataFrame(list(made), EVENT).withColumn(
        "timestamp", F.timestamp_millis("ingest_timestamp")
    )


def wire(vin=VIN_A, lng=-122.41, lat=37.77, status=2, soc=55.0, ts=NOW) -> bytes:
    return report_class()(
        vin=vin, lng=lng, lat=lat, status=status, battery_soc=soc, device_timestamp=ts
    ).SerializeToString()


def raw(spark, *values, start=0):
    made = [(b"k", v, 0, start + i) for i, v in enumerate(values)]
    return (
        spark.createDataFrame(made, "key binary, value binary, partition int, offset long")
        .withColumn("headers", F.array().cast(HEADERS))
        .withColumn("timestamp", F.timestamp_millis(F.lit(NOW)))
    )
