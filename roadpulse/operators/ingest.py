"""Payloads to raw log records, and raw log records to typed reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.wire import (
    REPORT_MESSAGE,
    REPORT_PACKAGE,
    decode_report,
    normalize_payload,
    report_file,
)
from roadpulse.schemas import REPORT


def normalize_ingest(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits payloads into log records and refused payloads with a reason code and the full reason.

    Takes ``payload`` and ``received_ms``; other columns stay on both outputs. A code is the step that
    failed and stays the same whatever the detail.
    """
    rest = [c for c in payloads.columns if c not in ("payload", "received_ms")]
    done = payloads.withColumn("made", normalize_payload("payload"))
    received = F.struct(
        F.lit("ingest_ts").alias("key"),
        F.encode(F.col("received_ms").cast("string"), "UTF-8").alias("value"),
    )
    records = done.where(F.col("made.reason").isNull()).select(
        F.encode("made.vin", "UTF-8").alias("key"),
        F.col("made.value").alias("value"),
        F.array(received).alias("headers"),
        *rest,
    )
    refused = done.where(F.col("made.reason").isNotNull()).select(
        "payload",
        F.substring_index("made.reason", ":", 1).alias("reason_code"),
        F.col("made.reason").alias("reason"),
        *rest,
    )
    return records, refused


def has_protobuf_package(spark) -> bool:
    """Whether Spark's own protobuf reader is on the class path."""
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.protobuf.ProtobufDataToCatalyst",
            False,
            spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader(),
        )
        return True
    except Exception:
        return False


def _decoded_in_jvm(value: Column) -> Column:
    from google.protobuf import descriptor_pb2
    from pyspark.sql.protobuf.functions import from_protobuf

    contract = descriptor_pb2.FileDescriptorSet(file=[report_file()]).SerializeToString()
    message = from_protobuf(
        value,
        f"{REPORT_PACKAGE}.{REPORT_MESSAGE}",
        options={"mode": "PERMISSIVE", "enums.as.ints": "true", "emit.default.values": "true"},
        binaryDescriptorSet=contract,
    )
    renamed = [
        message["status" if f.name == "status_code" else f.name].alias(f.name)
        for f in REPORT.fields
    ]
    error = F.when(message.isNull(), F.lit("malformed message")).alias("decode_error")
    return F.struct(*renamed, error)


def decode_telemetry(raw: DataFrame) -> DataFrame:
    """Adds the report fields; a record that cannot be decoded gets ``decode_error`` instead."""
    value = F.coalesce("value", F.lit(b""))
    if has_protobuf_package(raw.sparkSession):
        decoded = _decoded_in_jvm(value)
    else:
        decoded = decode_report(value)
    return raw.withColumn("report", decoded).select(*raw.columns, "report.*")
