"""Every table and message shape, declared once; nothing is ever inferred."""

from pyspark.sql import types as T

HEADERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
)

# The columns of the Kafka source, so that a file log and a topic are interchangeable.
RAW_LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# The six fields of a vehicle report after decoding.
REPORT = T.StructType(
    [
        T.StructField("vin", T.StringType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("battery_soc", T.FloatType()),
        T.StructField("device_timestamp", T.LongType()),
    ]
)

CANONICAL = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("vin", T.StringType()),
        T.StructField("fleet_id", T.StringType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("battery_soc", T.DoubleType()),
        T.StructField("device_timestamp", T.LongType()),
        T.StructField("ingest_timestamp", T.LongType()),
        T.StructField("processed_timestamp", T.LongType()),
    ]
)

# JSON member of each canonical column, in message order.
JSON_NAMES = {
    "event_id": "eventId",
    "schema_version": "schemaVersion",
    "vin": "vin",
    "fleet_id": "fleetId",
    "lng": "lng",
    "lat": "lat",
    "status": "status",
    "battery_soc": "batterySOC",
    "device_timestamp": "deviceTimestamp",
    "ingest_timestamp": "ingestTimestamp",
    "processed_timestamp": "processedTimestamp",
}

CANONICAL_JSON = T.StructType(
    [T.StructField(JSON_NAMES[f.name], f.dataType) for f in CANONICAL.fields]
)

LOCATION = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])

# Where a stored row came from; the greatest value is the newest write.
WRITE_ORDER = ["write_batch", "write_partition", "write_offset"]

HISTORY = T.StructType(
    CANONICAL.fields
    + [
        T.StructField("location", LOCATION),
        T.StructField("write_partition", T.IntegerType()),
        T.StructField("write_offset", T.LongType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("write_batch", T.LongType()),
    ]
)

SCHEMA_VERSION = 1
UNASSIGNED = "UNASSIGNED"

VEHICLE_FLEET = T.StructType(
    [T.StructField("vin", T.StringType()), T.StructField("fleet_id", T.StringType())]
)
