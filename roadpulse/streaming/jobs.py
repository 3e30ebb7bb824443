"""The four streaming jobs. Each is one query with its own checkpoint.

A micro-batch is written to folders named after its batch number before Spark commits its offsets, so a
failure at any point repeats the batch and replaces what it wrote. Batch numbers lead with the run, which
lives in the checkpoint: a new checkpoint on an old target adds to it and never replaces what an earlier
run stored. Tables that may change while a query runs are passed as functions and read again for every batch.
"""

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roadpulse.operators.access import without_covered
from roadpulse.operators.audiences import AUDIENCE
from roadpulse.operators.history import newest_per_vehicle, parse_canonical, storable
from roadpulse.operators.ingest import decode_telemetry
from roadpulse.operators.lookup import dealt_out
from roadpulse.operators.pipeline import (
    EVENT_KEY,
    LOG_ORDER,
    canonicalize,
    checked,
    dead_letter,
    dedup_in_batch,
    drop_seen,
    enrich_fleet,
    report_columns,
    valid_only,
    write_canonical,
)
from roadpulse.operators.routing import MAX_AGE_MS, audience_feed, feed_of_users, fresh_only, routing_keys
from roadpulse.schemas import CANONICAL, RAW_LOG, UNASSIGNED
from roadpulse.sources.files import (
    claimed_number,
    delete_matching,
    kept_number,
    numbered_folders,
    path_exists,
    replace_folder,
    tier_start,
)
from roadpulse.sources.history import fold_batches, write_history
from roadpulse.sources.logs import read_batch, read_batches, read_partitions, with_batch, write_batch
from roadpulse.streaming.dedup import DEDUP_TTL_MS

Table = Callable[[], DataFrame]
Clock = Callable[[], int]
Sink = Callable[[DataFrame], None]

EVENTS_WITH_POSITION = T.StructType(
    [
        *CANONICAL.fields,
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
DEAD_LETTER = T.StructType(
    [
        *RAW_LOG.fields[:3],
        T.StructField("source_partition", T.IntegerType()),
        T.StructField("source_offset", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
SEEN = T.StructType(
    [
        T.StructField("vin", T.StringType()),
        T.StructField("device_timestamp", T.LongType()),
        T.StructField("published_ms", T.LongType()),
        T.StructField("hour", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
OUTCOMES = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("received", "invalid", "unassigned_vin", "published")
    ]
)
HOUR_MS = 60 * 60 * 1000
BATCHES_PER_RUN = 1_000_000_000
#: Folders of one tier that are merged into one of the next.
FAN_IN = 8
FLUSH = "250 milliseconds"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def wall_clock_ms() -> int:
    return int(time.time() * 1000)


def start(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    output_mode: str = "append",
    target: str | None = None,
) -> StreamingQuery:
    """Starts a query that ends when the available data is done, unless given another trigger.

    ``each_batch`` gets numbers that grow over all runs that write to ``target``, later runs after earlier ones: each new
    checkpoint claims the next run there. No clock is asked.
    """
    trigger = trigger or {"availableNow": True}
    spark, runs = stream.sparkSession, f"{target or checkpoint}/_runs"
    run = kept_number(spark, f"{checkpoint}/run", lambda: claimed_number(spark, runs))

    def numbered(batch: DataFrame, batch_id: int) -> None:
        each_batch(batch, run * BATCHES_PER_RUN + batch_id)

    writer = (
        stream.writeStream.foreachBatch(numbered)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
    )
    if "availableNow" not in trigger:
        return writer.start()
    # State that expires by the clock asks for one more empty batch for ever, so a run over the
    # available data would not end. A query takes its settings when it starts.
    conf = stream.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, "false")
    try:
        return writer.start()
    finally:
        conf.set(EMPTY_BATCHES, before)


def _seen_before(spark: SparkSession, path: str, now_ms: int, ttl_ms: int, batch_id: int) -> DataFrame:
    """Keys published within the TTL by other batches.

    Only the hours that can hold them are opened, however long the job has run. The hour after now
    is among them in case the clock of an earlier driver was ahead.
    """
    since = now_ms - ttl_ms
    hours = [f"hour={h}" for h in range(since // HOUR_MS, now_ms // HOUR_MS + 2)]
    return read_partitions(spark, path, SEEN, hours).where(
        (F.col("published_ms") > since) & (F.col("batch_id") != batch_id)
    )


def _remember(published: DataFrame, path: str, now_ms: int, batch_id: int) -> None:
    (
        published.select(
            *EVENT_KEY,
            F.lit(now_ms).cast("long").alias("published_ms"),
            F.lit(now_ms // HOUR_MS).cast("long").alias("hour"),
            F.lit(batch_id).cast("long").alias("batch_id"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("hour", "batch_id")
        .parquet(path)
    )


def canonical_stream(
    raw: DataFrame,
    vehicle_fleet: Table,
    out: str,
    clock: Clock = wall_clock_ms,
    processed_ms=None,
    ttl_ms: int = DEDUP_TTL_MS,
    publish: Sink | None = None,
    publish_rejects: Sink | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Raw log to canonical events and dead letters, at least once and without repeats.

    Per batch: publish, then remember the keys, then let Spark commit the offsets. The keys live in a
    table partitioned by hour rather than in operator state, which keeps the whole batch inside
    the JVM: one anti join against the last hours instead of a Python call per report.

    ``publish`` and ``publish_rejects`` get the written rows as log records, for example to
    send them to a topic.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A repeated batch judges its reports by the time of its first attempt.
        now = kept_number(spark, f"{out}/clock/{batch_id}", clock)
        delete_matching(spark, f"{out}/clock/{batch_id - 2}")
        rows = checked(decode_telemetry(batch), now).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = Observation()
            counted = rows.observe(
                counts,
                F.count(F.lit(1)).alias("received"),
                F.count_if(F.col("error").isNotNull()).alias("invalid"),
            )
            write_batch(dead_letter(counted), f"{out}/dead_letters", batch_id)
            firsts = dedup_in_batch(report_columns(valid_only(rows)))
            fresh = drop_seen(firsts, _seen_before(spark, f"{out}/seen", now, ttl_ms, batch_id))
            events = canonicalize(
                enrich_fleet(fresh, vehicle_fleet()), now if processed_ms is None else processed_ms
            )
            write_batch(events, f"{out}/canonical", batch_id)
        finally:
            rows.unpersist()
        written = read_batch(spark, f"{out}/canonical", EVENTS_WITH_POSITION, batch_id)
        if publish is not None:
            publish(log_records(written))
        if publish_rejects is not None:
            publish_rejects(read_batch(spark, f"{out}/dead_letters", DEAD_LETTER, batch_id))
        _remember(written, f"{out}/seen", now, batch_id)
        outcomes = written.agg(
            *[F.lit(counts.get[name]).cast("long").alias(name) for name in ("received", "invalid")],
            F.count_if(F.col("fleet_id") == UNASSIGNED).alias("unassigned_vin"),
            F.count(F.lit(1)).alias("published"),
        )
        write_batch(outcomes, f"{out}/outcomes", batch_id)

    return start(raw, each_batch, f"{out}/checkpoint/canonical", trigger, target=out)


def read_canonical(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/canonical", EVENTS_WITH_POSITION)


def read_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """Record counts by outcome over all batches, as ``processing_outcomes`` gives for a table."""
    rows = read_batches(spark, f"{out}/outcomes", OUTCOMES)
    duplicate = F.col("received") - F.col("invalid") - F.col("published")
    totals = rows.withColumn("duplicate", duplicate).agg(
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in ("invalid", "duplicate", "unassigned_vin", "published")
        ]
    )
    return totals.unpivot([], totals.columns, "outcome", "n")


def read_dead_letters(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/dead_letters", DEAD_LETTER)


_KEYED = [T.StructField("vin", T.StringType()), T.StructField("fleet_id", T.StringType())]
_FOR = [T.StructField(AUDIENCE, T.StringType()), T.StructField("members", T.StringType())]
FEED = T.StructType([*_FOR, *RAW_LOG.fields, *_KEYED])
CONFLATED_FEED = T.StructType(
    [*FEED.fields, T.StructField("trigger_ms", T.LongType()), T.StructField("n", T.LongType())]
)
MEMBERS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField(AUDIENCE, T.StringType())])


def _keep_members(grants: DataFrame, out: str) -> str:
    """Stores who is in which audience under a name made from the rows, once for as long as nothing changes."""
    spark = grants.sparkSession
    members = grants.select("user_id", F.col("topic").alias(AUDIENCE))
    total = F.sum(F.xxhash64(*MEMBERS.fieldNames()).cast("decimal(38,0)"))
    found = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(total, F.lit(0)).alias("total")).first()
    name = f"{found['n']}_{found['total']}".replace("-", "m")
    path = f"{out}/members/members={name}"
    if not path_exists(spark, path):
        members.write.mode("overwrite").parquet(f"{out}/members-partial/{name}")
        replace_folder(spark, f"{out}/members-partial/{name}", path)
    return name


def live_feed_stream(
    log: DataFrame,
    grants: Table,
    out: str,
    connections: Table | None = None,
    clock: Clock = wall_clock_ms,
    max_age_ms: int = MAX_AGE_MS,
    trigger: dict | None = None,
    conflate_ms: int | None = None,
) -> StreamingQuery:
    """Canonical log to one row per audience and event: fresh records only, matched to grants.

    The holders of a topic are one audience, so an event is stored three times at most, whatever the number of users; ``read_feed``
    gives one row per user and event. With ``connections``, only users who are connected are in any. Routing to their pods first
    would change nothing but the work done (see ``two_stage_feed``), so audiences are matched directly.

    With ``conflate_ms`` a slow consumer is not sent every event: state keeps the newest event per vehicle,
    fleet and interval of record time, and how many it stands for; each trigger matches and stores those that changed, and
    ``read_conflated_feed`` gives the newest of each. An interval's state goes once ``max_age_ms`` have passed.
    """

    def each_batch(events: DataFrame, batch_id: int) -> None:
        held = grants()
        if connections is not None:
            held = held.join(connections().select("user_id").distinct(), "user_id", "left_semi")
        held = without_covered(held, "user_id").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fresh = fresh_only(events, clock(), max_age_ms)
            if conflate_ms is None:
                fresh = routing_keys(fresh)
            rows = audience_feed(fresh, held).withColumn("members", F.lit(_keep_members(held, out)))
            schema = FEED if conflate_ms is None else CONFLATED_FEED
            write_batch(rows.select(*schema.fieldNames()), f"{out}/feed", batch_id)
        finally:
            held.unpersist()

    if conflate_ms is None:
        return start(log, each_batch, f"{out}/checkpoint/feed", trigger, target=out)
    newest = newest_per_interval(routing_keys(log), conflate_ms, max_age_ms)
    return start(newest, each_batch, f"{out}/checkpoint/feed", trigger, output_mode="update", target=out)


def newest_per_interval(keyed: DataFrame, conflate_ms: int, max_age_ms: int) -> DataFrame:
    """The newest record of each vehicle, fleet and interval, in log order, with the number of records ``n``."""
    keys = ["vin", "fleet_id"]
    rest = [c for c in keyed.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("timestamp", *LOG_ORDER)).alias("newest")
    within = F.window("timestamp", f"{conflate_ms} milliseconds").alias("within")
    kept = keyed.withWatermark("timestamp", f"{max_age_ms} milliseconds").groupBy(within, *keys)
    found = kept.agg(newest, F.count(F.lit(1)).alias("n"))
    return found.select(*keys, "newest.*", F.unix_millis("within.start").alias("trigger_ms"), "n")


def _to_users(spark: SparkSession, rows: DataFrame, out: str) -> DataFrame:
    schema = T.StructType([*MEMBERS.fields, _FOR[1]])
    if not path_exists(spark, f"{out}/members"):
        return feed_of_users(rows, spark.createDataFrame([], schema))
    return feed_of_users(rows, spark.read.schema(schema).parquet(f"{out}/members"))


def read_feed(spark: SparkSession, out: str) -> DataFrame:
    """One row per user and event."""
    rows = dealt_out(read_batches(spark, f"{out}/feed", FEED), *LOG_ORDER)
    return _to_users(spark, rows, out)


def read_conflated_feed(spark: SparkSession, out: str) -> DataFrame:
    """One row per user, vehicle and interval: the newest event that the user may see, and how many others there were.

    A user gets one row of an interval in which the vehicle stayed in one fleet and the grants did not change, so
    only the others are compared per user.
    """
    cell = ["vin", "trigger_ms"]
    rows = dealt_out(read_batches(spark, f"{out}/feed", CONFLATED_FEED), *cell)
    last = F.max("batch_id").over(W.partitionBy(*cell, AUDIENCE, "fleet_id"))
    newest = rows.withColumn("last", last).where(F.col("batch_id") == F.col("last")).drop("last")
    within = W.partitionBy(*cell)

    def one(column):
        return F.min(column).over(within) == F.max(column).over(within)

    found = newest.withColumn("plain", one("fleet_id") & one("members"))
    plain = _to_users(spark, found.where("plain").drop("plain", "batch_id").withColumn("n", F.col("n") - 1), out)
    mixed = _to_users(spark, found.where(~F.col("plain")).drop("plain"), out)
    keys = ["user_id", *cell]
    rest = [c for c in mixed.columns if c not in (*keys, "fleet_id")]
    by_fleet = mixed.groupBy(*keys, "fleet_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("newest")).select(*keys, "fleet_id", "newest.*")
    kept = [c for c in by_fleet.columns if c not in (*keys, "n", "batch_id")]
    merged = by_fleet.groupBy(*keys).agg(
        F.max_by(F.struct(*kept), F.struct("timestamp", *LOG_ORDER)).alias("newest"), (F.sum("n") - 1).alias("n")
    )
    return plain.unionByName(merged.select(*keys, "newest.*", "n")).withColumnRenamed("n", "dropped")


def history_stream(log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Canonical log to the daily history, apart from the live feed so neither delays the other.

    Finished batches are merged in tiers in passing, so a reader opens few folders per day however long the job has run.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        first, last = _finished(batch_id)
        if last is not None:
            fold_batches(batch.sparkSession, path, first, last)
        write_history(storable(batch), path, batch_id)

    return start(log, each_batch, checkpoint, trigger, target=path)


def latest_state_stream(log: DataFrame, out: str, trigger: dict | None = None) -> StreamingQuery:
    """Newest report per vehicle, kept as state; each flush writes the vehicles that changed.

    At equal device times the later record in the log wins. Finished flushes are merged in tiers in passing.
    """
    events = parse_canonical(log).where(~F.col("skipped"))
    latest = newest_per_vehicle(
        events.select(*CANONICAL.fieldNames(), *LOG_ORDER, "timestamp"), *LOG_ORDER
    )

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        first, last = _finished(batch_id)
        if last is not None:
            fold_latest_state(batch.sparkSession, out, first, last)
        write_batch(batch, f"{out}/latest", batch_id)

    return start(
        latest,
        each_batch,
        f"{out}/checkpoint/latest",
        trigger or {"processingTime": FLUSH},
        output_mode="update",
        target=out,
    )


def _newest_flushes(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c != "vin"]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("newest")
    return rows.groupBy("vin").agg(newest).select("vin", "newest.*")


def read_latest_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest flush of every vehicle; after a compaction one folder and the flushes since."""
    return _newest_flushes(read_batches(spark, f"{out}/latest", EVENTS_WITH_POSITION)).drop("batch_id")


def _finished(batch_id: int) -> tuple[int, int | None]:
    """The batches before this one that are to be merged now; those of earlier runs with the first ones of this.

    They were committed before this batch began, so none of them will be repeated.
    """
    run, n = divmod(batch_id, BATCHES_PER_RUN)
    begin = tier_start(n, FAN_IN)
    if begin is None:
        return 0, None
    return (run * BATCHES_PER_RUN + begin if begin else 0), batch_id - 1


def fold_latest_state(spark: SparkSession, out: str, first: int, last: int) -> None:
    """Merges the finished flushes of a range into the folder of the last one.

    The merged rows are written beside it and moved into place before the older flushes go, so a reader or a
    failure in between sees some rows twice and none missing.
    """
    path = f"{out}/latest"
    own = [n for n in numbered_folders(spark, path, "batch_id=") if first <= n <= last]
    if own in ([], [last]):
        return
    rows = read_partitions(spark, path, with_batch(EVENTS_WITH_POSITION), [f"batch_id={n}" for n in own])
    write_batch(_newest_flushes(rows).drop("batch_id"), f"{out}/latest-folded", last)
    replace_folder(spark, f"{out}/latest-folded/batch_id={last}", f"{path}/batch_id={last}")
    for older in own:
        if older < last:
            delete_matching(spark, f"{path}/batch_id={older}")


def compact_latest_state(spark: SparkSession, out: str, up_to_batch: int) -> None:
    """Folds all flushes up to a finished batch into one. Run it when the job does not."""
    fold_latest_state(spark, out, 0, up_to_batch)


def log_records(canonical: DataFrame) -> DataFrame:
    """Canonical events as the records of a file log, ready for the jobs that read it."""
    return write_canonical(canonical).select(*RAW_LOG.fieldNames())
