"""The raw and the canonical log, as a Kafka topic or as a folder of Parquet files.

Both have the same columns, so everything after the reader is the same. The Kafka form needs Spark's
Kafka package on the class path.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.schemas import HEADERS, RAW_LOG
from roadpulse.sources.files import path_exists


HOUR_MS = 60 * 60 * 1000


@dataclass
class LogSource:
    """Where a log lives: ``path`` for files, or Kafka ``options`` (servers, topic, security).

    ``batch_size`` bounds a micro-batch: in records for Kafka, in files for a folder. Without it a batch takes
    all that has arrived, so that a reader never falls behind a log that grows faster than a fixed size.
    ``by_hour`` says that the files lie in folders of so many hours of record time, as :func:`write_hourly` leaves them.
    """

    path: str | None = None
    options: dict = field(default_factory=dict)
    batch_size: int | None = None
    schema: T.StructType = field(default_factory=lambda: RAW_LOG)
    by_hour: int = 0


def _from_kafka(spark: SparkSession, source: LogSource, start: str) -> DataFrame:
    reader = (
        spark.readStream.format("kafka")
        .options(**source.options)
        .option("startingOffsets", start)
        .option("includeHeaders", "true")
    )
    if source.batch_size:
        reader = reader.option("maxOffsetsPerTrigger", source.batch_size)
    return reader.load().select(*[f.name for f in RAW_LOG.fields])


def _from_files(spark: SparkSession, source: LogSource, newest_first: bool, since_ms: int | None = None) -> DataFrame:
    schema = T.StructType([*source.schema.fields, T.StructField("hour", T.LongType())]) if source.by_hour else source.schema
    reader = spark.readStream.schema(schema).option("latestFirst", str(newest_first).lower())
    if source.batch_size:
        reader = reader.option("maxFilesPerTrigger", source.batch_size)
    rows = reader.parquet(source.path)
    if source.by_hour and since_ms is not None:
        rows = rows.where(F.col("hour") >= since_ms // HOUR_MS // source.by_hour * source.by_hour)
    return rows.select(*source.schema.fieldNames())


def read_raw_stream(spark: SparkSession, source: LogSource) -> DataFrame:
    """The raw log from its beginning; progress is kept by the query's checkpoint."""
    if source.path:
        return _from_files(spark, source, newest_first=False)
    return _from_kafka(spark, source, "earliest")


def read_live_stream(spark: SparkSession, source: LogSource, since_ms: int | None = None) -> DataFrame:
    """The canonical log from its end.

    Files have no end to start from. Of a log by hour no file is opened whose hour ended before ``since_ms``, the oldest record
    time that can be fresh when the reader starts; the newest are read first and old records are left to ``fresh_only``.
    """
    if source.path:
        return _from_files(spark, source, newest_first=True, since_ms=since_ms)
    return _from_kafka(spark, source, "latest")


def write_hourly(records: DataFrame, path: str, hours: int = 1) -> None:
    """Appends log records to a file log laid out by hour of record time, ``hours`` to a folder, named by its first hour.

    Busy hours are split and quiet ones share a task. A quiet log wants more hours to a folder, so that files do not get too small.
    """
    hour = (F.floor(F.unix_millis("timestamp") / F.lit(hours * HOUR_MS)) * hours).cast("long")
    rows = records.withColumn("hour", hour).hint("rebalance", "hour")
    rows.write.mode("append").partitionBy("hour").parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Writes one micro-batch to a folder of its own.

    The whole folder is replaced, so a repeated batch leaves nothing of its first attempt, also when it now has
    no rows.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_partitions(
    spark: SparkSession, path: str, schema: T.StructType, partitions: list[str]
) -> DataFrame:
    """Only the named partition folders, those that exist; the others are not even listed."""
    found = [f"{path}/{p}" for p in partitions if path_exists(spark, f"{path}/{p}")]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*found)


def read_batch(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    return read_partitions(spark, path, with_batch(schema), [f"batch_id={batch_id}"])


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every written micro-batch; no rows if nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], with_batch(schema))
    return spark.read.schema(with_batch(schema)).parquet(path)


def with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def send_to_topic(records: DataFrame, options: dict) -> None:
    """Appends a batch of log records to a Kafka topic."""
    records.select("key", "value", F.col("headers").cast(HEADERS)).write.format("kafka").options(
        **options
    ).option("includeHeaders", "true").save()
