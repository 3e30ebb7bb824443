"""The daily history as partitioned Parquet.

Each micro-batch adds one partition per day it touches, named by day and batch. Nothing stored is
read or rewritten, so a late report costs as much as a recent one, and a repeated batch replaces its
own partitions. "The same event id overwrites" is settled on reading: the newest write wins. Batches are merged in tiers, by
the job that writes them, so the folders of a day grow with the logarithm of the number of batches at most.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.telemetry import event_date
from roadpulse.operators.history import newest_writes, with_location
from roadpulse.schemas import HISTORY
from roadpulse.sources.files import (
    delete_matching,
    keep_words,
    kept_words,
    named_folders,
    numbered_files,
    path_exists,
    replace_folder,
)
from roadpulse.sources.logs import read_partitions

LAYOUT = ["event_date", "write_batch"]


def _write(rows: DataFrame, path: str) -> None:
    # Rebalancing splits a busy day and merges quiet ones into files of the advisory size.
    (
        rows.select(*HISTORY.fieldNames())
        .hint("rebalance", "event_date")
        .write.mode("append")
        .partitionBy(*LAYOUT)
        .parquet(path)
    )


def _days_file(path: str, batch_id: int) -> str:
    return f"{path}/_batches/{batch_id}"


def _folder(path: str, day: str, batch_id: int) -> str:
    return f"{path}/event_date={day}/write_batch={batch_id}"


def _days(rows: DataFrame) -> list[str]:
    found = rows.select(F.col("event_date").cast("string").alias("day")).distinct().collect()
    return sorted(r.day or "__HIVE_DEFAULT_PARTITION__" for r in found)


def write_history(canonical: DataFrame, path: str, batch_id: int) -> None:
    """Stores canonical events under the UTC day of their device time.

    Writers must not share a batch id; ``streaming.jobs.start`` gives every batch of every run its own. The days of a batch are
    noted before it is written, so an attempt that repeats it removes what the earlier one stored on whatever day,
    and looks at no other folder.
    """
    spark = canonical.sparkSession
    for day in kept_words(spark, _days_file(path, batch_id)):
        delete_matching(spark, _folder(path, day, batch_id))
    rows = canonical
    if "location" not in rows.columns:
        rows = with_location(rows)
    rows = (
        rows.withColumn("event_date", event_date(F.col("device_timestamp")))
        .withColumn("write_batch", F.lit(batch_id).cast("long"))
        .withColumnRenamed("partition", "write_partition")
        .withColumnRenamed("offset", "write_offset")
    )
    keep_words(spark, _days_file(path, batch_id), _days(rows))
    _write(rows, path)


def read_writes(spark: SparkSession, path: str) -> DataFrame:
    """Every stored write; no rows if there is no history yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per event: its newest write. Days that were compacted since their last write are only scanned."""
    merged = dict(w.split("=") for w in kept_words(spark, f"{path}/_merged"))
    folders = day_batches(spark, path) if merged else {}
    done = [_folder("", day, n)[1:] for day, (n, *more) in folders.items() if not more and merged.get(day) == str(n)]
    if not done:
        return newest_writes(read_writes(spark, path))
    whole = read_partitions(spark, path, HISTORY, done)
    rest = {_folder("", day, n)[1:] for day, batches in folders.items() for n in batches} - set(done)
    if not rest:
        return whole
    return whole.unionByName(newest_writes(read_partitions(spark, path, HISTORY, sorted(rest))))


def day_batches(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The stored batches of each day."""
    found: dict[str, list[int]] = {}
    for day, batch in named_folders(spark, path, LAYOUT):
        found.setdefault(day, []).append(int(batch))
    return {day: sorted(batches) for day, batches in sorted(found.items())}


def _fold(spark: SparkSession, path: str, batches: dict[str, list[int]], into: int, even_alone: bool = False) -> None:
    """Replaces the given batches of each day by one of their newest writes.

    The rows are written beside and moved into place before the older folders go: a reader, or a failure in between, finds
    some rows twice and none missing, and the newest write wins as before. It can be repeated.
    """
    batches = {day: own for day, own in batches.items() if own and (even_alone or own != [into])}
    if not batches:
        return
    rows = read_partitions(spark, path, HISTORY, [_folder("", d, n)[1:] for d, own in batches.items() for n in own])
    beside = f"{path}/_folded/{into}"
    delete_matching(spark, beside)
    _write(newest_writes(rows).withColumn("write_batch", F.lit(into).cast("long")), beside)
    for day, own in batches.items():
        replace_folder(spark, _folder(beside, day, into), _folder(path, day, into))
        for n in own:
            if n != into:
                delete_matching(spark, _folder(path, day, n))
    delete_matching(spark, beside)


def fold_batches(spark: SparkSession, path: str, first: int, last: int) -> None:
    """Merges the finished batches of a range, on the days that they wrote."""
    numbers = [n for n in numbered_files(spark, f"{path}/_batches") if first <= n <= last]
    days = sorted({day for n in numbers for day in kept_words(spark, _days_file(path, n))})
    _fold(spark, path, {d: [n for n in numbers if path_exists(spark, _folder(path, d, n))] for d in days}, last)
    if numbers:
        keep_words(spark, _days_file(path, last), days)
    for n in numbers:
        if n < last:
            delete_matching(spark, _days_file(path, n))


def merge_days(spark: SparkSession, path: str, up_to_batch: int) -> None:
    """Leaves one folder per day of all finished batches up to one, and notes it, so that the day need not be merged on reading."""
    days = {d: [n for n in own if n <= up_to_batch] for d, own in day_batches(spark, path).items()}
    days = {d: own for d, own in days.items() if own}
    # A single folder may hold one event twice, so it is merged with itself.
    _fold(spark, path, days, up_to_batch, even_alone=True)
    noted = dict(w.split("=") for w in kept_words(spark, f"{path}/_merged")) | {d: str(up_to_batch) for d in days}
    keep_words(spark, f"{path}/_merged", [f"{d}={n}" for d, n in sorted(noted.items())])


def compact_history(spark: SparkSession, path: str, target: str, up_to_batch: int) -> None:
    """Copies the newest writes of all batches up to one to another folder, one partition per day.

    The target plus the later batches hold the same events as the source. :func:`merge_days` does it in place.
    """
    rows = read_writes(spark, path).where(F.col("write_batch") <= up_to_batch)
    delete_matching(spark, f"{target}/event_date=*/write_batch={up_to_batch}")
    newest = newest_writes(rows).withColumn("write_batch", F.lit(up_to_batch).cast("long"))
    _write(newest, target)
