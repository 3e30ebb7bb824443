"""Every operator as a query over the given tables, with plain result columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse import functions as C
from roadpulse.operators import access, board, history, ingest, master, pipeline, routing
from roadpulse.plans import pipelines
from roadpulse.plans import tables as t
from roadpulse.schemas import CANONICAL, RAW_LOG
from roadpulse.session import shared_dir, ship_package
from roadpulse.sources import history as stored
from roadpulse.sources.files import path_exists
from roadpulse.sources.logs import (
    LogSource,
    read_batches,
    read_live_stream,
    read_raw_stream,
    write_batch,
    write_hourly,
)
from roadpulse.streaming import jobs
from roadpulse.streaming.dedup import dedup_ttl

NOW = t.NOW_MS
VIEWER = "u-5"
ADMIN = "u-0"
EVENT_COLUMNS = CANONICAL.fieldNames()
REPORT_COLUMNS = ["partition", "offset", "vin", "lng", "lat", "status_code", "battery_soc", "device_timestamp"]


# --- inputs shared by the queries ------------------------------------------------------------


def processed():
    """A reproducible processing time: 7 ms after the record time."""
    return F.unix_millis("timestamp") + 7


def checked(spark, sf):
    return pipeline.checked(t.reports(spark, sf), NOW)


def firsts(spark, sf):
    return pipeline.dedup_in_batch(pipeline.report_columns(pipeline.valid_only(checked(spark, sf))))


def vehicle_fleet(spark, sf):
    return master.vehicle_fleet_map(t.vehicles(spark, sf))


def canonical(spark, sf):
    return pipelines.canonical_events(t.reports(spark, sf), vehicle_fleet(spark, sf), NOW, processed())


def seen(spark, sf):
    """Reports taken as published before: a fifth of the valid ones."""
    rows = pipeline.valid_only(checked(spark, sf)).where(F.floor(F.col("offset") / 2) % 5 == 0)
    return rows.select("vin", "device_timestamp").distinct()


def grants(spark, sf):
    return access.user_grants(
        t.users(spark, sf), t.user_fleet_grants(spark, sf), t.user_vehicle_grants(spark, sf)
    )


def grants_of(spark, sf, user_id):
    def own(df):
        return df.where(F.col("user_id") == user_id)

    return access.user_grants(
        own(t.users(spark, sf)),
        own(t.user_fleet_grants(spark, sf)),
        own(t.user_vehicle_grants(spark, sf)),
    )


def scopes(spark, sf):
    return access.user_scopes(
        t.users(spark, sf), t.user_fleet_grants(spark, sf), t.user_vehicle_grants(spark, sf)
    )


def interest(spark, sf, admins=False):
    return access.pod_grants(t.connections(spark, sf, admins), grants(spark, sf))


_SETTLED: dict[tuple[str, str, str], str] = {}


def settled_at(spark, sf, name, write):
    """A folder of the shared place that ``write`` fills, once in a session: what many queries read is worked out once."""
    key = spark.sparkContext.applicationId, sf, name
    if key not in _SETTLED or not path_exists(spark, _SETTLED[key]):
        path = shared_dir(spark, name)
        write(path)
        _SETTLED[key] = path
    return _SETTLED[key]


def settled(spark, sf, name, make):
    df = make()
    path = settled_at(spark, sf, name, df.write.parquet)
    return spark.read.schema(df.schema).parquet(path)


def daily_history(spark, sf):
    """The canonical events as the history that the jobs keep, its days merged."""

    def write(path):
        stored.write_history(canonical(spark, sf), path, 0)
        stored.merge_days(spark, path, 0)

    return stored.read_history(spark, settled_at(spark, sf, "daily-history", write))


def latest(spark, sf, user_id=ADMIN):
    return history.latest_positions(daily_history(spark, sf), grants_of(spark, sf, user_id), NOW)


def lists_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("fleet_ids", F.array_join("fleet_ids", ",")).withColumn(
        "vins", F.array_join("vins", ",")
    )


def as_ms(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, F.unix_millis(column))
    return df


def event_log(spark, sf):
    """Every report as a canonical JSON record, also those the pipeline would have stopped.

    Reports of a bad VIN get an empty event id and those without a time a cut-off value, so that
    each storage outcome occurs.
    """
    rows = pipeline.enrich_fleet(pipeline.report_columns(t.reports(spark, sf)), vehicle_fleet(spark, sf))
    events = pipeline.canonicalize(rows, processed()).withColumn(
        "event_id", F.when(F.col("vin") == "BADVIN", "").otherwise(F.col("event_id"))
    )
    value = pipeline.canonical_json()
    cut_off = F.when(F.col("device_timestamp") == 0, F.lit('{"eventId": "')).otherwise(value)
    return events.select("partition", "offset", "timestamp", F.encode(cut_off, "UTF-8").alias("value"))


# --- projections, filters, pipeline ----------------------------------------------------------


def q_validate(spark, sf):
    return checked(spark, sf).select(
        "partition", "offset", F.coalesce("error", F.lit("ok")).alias("result")
    )


def q_dedup_in_batch(spark, sf):
    return firsts(spark, sf).select(*REPORT_COLUMNS, "ingest_timestamp").withColumn(
        "battery_soc", F.col("battery_soc").cast("double")
    )


def q_drop_seen(spark, sf):
    return pipeline.drop_seen(firsts(spark, sf), seen(spark, sf)).select(
        "partition", "offset", "vin", "device_timestamp"
    )


def q_enrich_fleet(spark, sf):
    return pipeline.enrich_fleet(firsts(spark, sf), vehicle_fleet(spark, sf)).select(
        "partition", "offset", "vin", "fleet_id"
    )


def q_canonicalize(spark, sf):
    return canonical(spark, sf).select(*EVENT_COLUMNS)


def q_status_name(spark, sf):
    rows = t.reports(spark, sf)
    return rows.groupBy(C.status_name(F.col("status_code")).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )


def q_event_id(spark, sf):
    return t.reports(spark, sf).select(
        "partition", "offset", C.event_id(F.col("vin"), F.col("device_timestamp")).alias("event_id")
    )


def q_ingest_timestamp(spark, sf):
    return t.reports(spark, sf).select(
        "partition",
        "offset",
        C.ingest_timestamp(F.col("headers"), F.col("timestamp")).alias("ingest_timestamp"),
    )


def q_dead_letter(spark, sf):
    return pipeline.dead_letter(checked(spark, sf)).select(
        F.col("source_partition").alias("partition"), F.col("source_offset").alias("offset"), "reason"
    )


def q_processing_outcomes(spark, sf):
    return pipeline.processing_outcomes(checked(spark, sf), vehicle_fleet(spark, sf), seen(spark, sf))


def q_fresh_only(spark, sf):
    rows = routing.fresh_only(t.reports(spark, sf), NOW, 24 * 60 * 60 * 1000)
    return rows.select("partition", "offset", F.unix_millis("timestamp").alias("record_ts"))


def q_parse_canonical(spark, sf):
    return history.parse_canonical(event_log(spark, sf)).where(~F.col("skipped")).select(
        *EVENT_COLUMNS
    )


def q_routing_keys(spark, sf):
    return routing.routing_keys(event_log(spark, sf)).select("partition", "offset", "vin", "fleet_id")


def q_geo_point(spark, sf):
    return history.with_location(canonical(spark, sf)).select(
        "event_id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon")
    )


def q_event_date(spark, sf):
    return history.with_event_date(canonical(spark, sf)).select(
        "event_id", F.col("event_date").cast("string").alias("event_date"), "index_name"
    )


def q_without_location(spark, sf):
    return history.without_location(history.with_location(canonical(spark, sf))).select(
        *EVENT_COLUMNS
    )


def q_last_24h(spark, sf):
    return history.last_24h(daily_history(spark, sf), NOW).select(*EVENT_COLUMNS)


# --- access and routing ----------------------------------------------------------------------


def q_user_scopes(spark, sf):
    return lists_as_text(scopes(spark, sf))


def q_check_access(spark, sf):
    return access.check_access(t.access_requests(spark, sf), grants(spark, sf)).drop("error")


def q_pod_interest(spark, sf):
    return lists_as_text(access.pod_interest(t.connections(spark, sf, False), grants(spark, sf)))


def q_pod_interest_all(spark, sf):
    return lists_as_text(access.pod_interest(t.connections(spark, sf), grants(spark, sf)))


def q_connected_users(spark, sf):
    return access.connected_users(t.connections(spark, sf))


def routing_inputs(spark, sf, admins=False):
    """Canonical events, grants and pod interest, each settled."""
    held = settled(spark, sf, "grants", lambda: grants(spark, sf))
    connections = t.connections(spark, sf, admins)
    wanted = settled(spark, sf, f"interest-{admins}", lambda: access.pod_grants(connections, held))
    return settled(spark, sf, "events", lambda: canonical(spark, sf)), held, wanted


def q_route_events(spark, sf):
    events, _, wanted = routing_inputs(spark, sf)
    return routing.route_events(events, wanted).select("pod", "event_id")


def q_route_events_all(spark, sf):
    events, _, wanted = routing_inputs(spark, sf, admins=True)
    return routing.route_events(events, wanted).select("pod", "event_id")


def q_unrouted_events(spark, sf):
    events, _, wanted = routing_inputs(spark, sf)
    return routing.unrouted_events(events, wanted).select(*EVENT_COLUMNS)


def q_unrouted_events_all(spark, sf):
    events, _, wanted = routing_inputs(spark, sf, admins=True)
    return routing.unrouted_events(events, wanted).select(*EVENT_COLUMNS)


def q_board_filter_fleet(spark, sf):
    return board.board_filter(latest(spark, sf), "fleet-nation_3", "").select(*EVENT_COLUMNS)


def q_authorize_events(spark, sf):
    return routing.authorize_events(canonical(spark, sf), grants(spark, sf)).select(
        "user_id", "event_id"
    )


def q_two_stage_feed(spark, sf):
    events, held, wanted = routing_inputs(spark, sf, admins=True)
    fed = routing.two_stage_feed(events, held, t.connections(spark, sf), wanted)
    return fed.select("pod", "user_id", "event_id")


TRIGGER_MS = 6 * 60 * 60 * 1000


def q_routing_outcomes(spark, sf):
    events, _, wanted = routing_inputs(spark, sf)
    dropped = routing.conflated_feed(events, wanted, "pod", TRIGGER_MS)
    return routing.routing_outcomes(events, wanted, dropped)


def q_routing_outcomes_all(spark, sf):
    events, _, wanted = routing_inputs(spark, sf, admins=True)
    dropped = routing.conflated_feed(events, wanted, "pod", TRIGGER_MS)
    return routing.routing_outcomes(events, wanted, dropped)


def q_conflate(spark, sf):
    events, _, wanted = routing_inputs(spark, sf)
    made = routing.conflated_feed(events, wanted, "pod", TRIGGER_MS)
    return made.select("pod", "vin", "trigger_ms", "event_id", "dropped")


def q_conflate_all(spark, sf):
    events, _, wanted = routing_inputs(spark, sf, admins=True)
    made = routing.conflated_feed(events, wanted, "pod", TRIGGER_MS)
    return made.select("pod", "vin", "trigger_ms", "event_id", "dropped")


def q_interest_versions(spark, sf):
    connected = t.interest_snapshots(spark, sf)
    per_hour = connected.select(F.concat_ws("@", "pod", "as_of").alias("pod"), "user_id")
    snapshots = access.pod_interest(per_hour, grants(spark, sf)).select(
        F.substring_index("pod", "@", 1).alias("pod"),
        F.substring_index("pod", "@", -1).cast("long").alias("as_of"),
        "all_fleets",
        "fleet_ids",
        "vins",
    )
    return lists_as_text(access.interest_versions(snapshots))


# --- history ---------------------------------------------------------------------------------


def q_write_history(spark, sf):
    path = shared_dir(spark, "history")
    stored.write_history(canonical(spark, sf), path, 0)
    days = stored.read_writes(spark, path).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.col("event_date").cast("string").alias("event_date"), "n")


def q_read_history(spark, sf):
    path = shared_dir(spark, "history")
    events = canonical(spark, sf)
    stored.write_history(events, path, 0)
    # The same reports again, as after a repeat under a new batch: still one row per event.
    stored.write_history(events, path, 1)
    return stored.read_history(spark, path).select(
        *EVENT_COLUMNS, F.col("event_date").cast("string").alias("event_date")
    )


def q_upsert_history(spark, sf):
    def writes(df, batch):
        dated = history.with_event_date(df).drop("index_name", "timestamp")
        return (
            dated.withColumn("write_batch", F.lit(batch).cast("long"))
            .withColumnRenamed("partition", "write_partition")
            .withColumnRenamed("offset", "write_offset")
        )

    events = canonical(spark, sf)
    again = events.where(F.col("offset") % 4 == 0).withColumn("fleet_id", F.lit("fleet-moved"))
    return history.upsert_history(writes(events, 0), writes(again, 1)).select(*EVENT_COLUMNS)


def q_latest_positions(spark, sf):
    return latest(spark, sf, VIEWER).select(*EVENT_COLUMNS)


def q_latest_positions_all(spark, sf):
    return latest(spark, sf, ADMIN).select(*EVENT_COLUMNS)


def q_merge_newest(spark, sf):
    events = canonical(spark, sf)
    snapshot = events.where(F.col("offset") % 3 == 0).withColumn("arrival_seq", F.lit(0).cast("long"))
    live = events.withColumn("arrival_seq", F.col("offset") + 1)
    return history.merge_newest(snapshot, live).select(*EVENT_COLUMNS, "arrival_seq")


def q_history_outcomes(spark, sf):
    return history.history_outcomes(event_log(spark, sf))


# --- board -----------------------------------------------------------------------------------


def board_column(make):
    def query(spark, sf):
        return canonical(spark, sf).select("event_id", *make())

    return query


def q_scope_text(spark, sf):
    text = C.scope_text(F.col("all_fleets"), F.col("fleet_ids"), F.col("vins"))
    return scopes(spark, sf).select("user_id", text.alias("scope_text"))


def q_fleet_name(spark, sf):
    return canonical(spark, sf).select(
        "event_id", C.fleet_name(F.col("fleet_id")).alias("fleet_name")
    )


def q_fleet_board(spark, sf):
    return pipelines.board_for_user(daily_history(spark, sf), grants_of(spark, sf, ADMIN), NOW)


def q_board_filter(spark, sf):
    return board.board_filter(latest(spark, sf), "all", " ra1023 ").select(*EVENT_COLUMNS)


def q_board_order(spark, sf):
    return board.board_order(latest(spark, sf)).select(
        "vin", C.status_rank(F.col("status")).cast("long").alias("status_rank")
    )


def q_vehicle_detail(spark, sf):
    newest = history.newest_per_vehicle(canonical(spark, sf))
    return board.vehicle_detail(newest, "7H4T9K2L5RA102304").select(*EVENT_COLUMNS)


def q_status_tally(spark, sf):
    return board.status_tally(latest(spark, sf))


def q_visible_fleets(spark, sf):
    return board.visible_fleets(latest(spark, sf))


def q_map_extent(spark, sf):
    return board.map_extent(latest(spark, sf))


def q_update_rate(spark, sf):
    return board.update_rate(canonical(spark, sf), 60 * 60 * 1000, 15 * 60 * 1000)


def q_latency_histogram(spark, sf):
    return board.latency_histogram(canonical(spark, sf))


# --- master data -----------------------------------------------------------------------------


def q_vehicle_fleet_map(spark, sf):
    return vehicle_fleet(spark, sf)


def q_apply_fleet_map_changes(spark, sf):
    published = t.published_map(spark, sf)
    changes = master.fleet_map_changes(vehicle_fleet(spark, sf), published)
    return master.apply_fleet_map_changes(published, changes)


def q_delete_master_data(spark, sf):
    tables = [
        make(spark, sf)
        for make in (t.fleets, t.vehicles, t.users, t.user_fleet_grants, t.user_vehicle_grants)
    ]
    left = master.delete_master_data(*tables, t.deletions(spark, sf))
    keys = [("fleet_id", None), ("vin", "fleet_id"), ("user_id", None), ("user_id", "fleet_id"), ("user_id", "vin")]
    names = ["fleets", "vehicles", "users", "user_fleet_grants", "user_vehicle_grants"]
    rows = None
    for name, table, (key, other) in zip(names, left, keys, strict=True):
        second = F.col(other) if other else F.lit(None).cast("string")
        part = table.select(F.lit(name).alias("table_name"), F.col(key).alias("key"), second.alias("other"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def q_fleet_map_changes(spark, sf):
    return master.fleet_map_changes(vehicle_fleet(spark, sf), t.published_map(spark, sf))


def q_upsert_fleets(spark, sf):
    done = master.upsert_fleets(t.fleets(spark, sf), t.fleet_changes(spark, sf), NOW)
    return as_ms(done, "created_at")


def q_upsert_vehicles(spark, sf):
    done = master.upsert_vehicles(
        t.vehicles(spark, sf), t.vehicle_changes(spark, sf), t.fleets(spark, sf), NOW
    )
    return as_ms(done, "updated_at")


def q_check_vehicle_changes(spark, sf):
    done = master.check_vehicle_changes(t.vehicle_changes(spark, sf), t.fleets(spark, sf))
    return done.select("seq", F.coalesce("error", F.lit("ok")).alias("result"))


def q_upsert_users(spark, sf):
    return as_ms(master.upsert_users(t.users(spark, sf), t.user_changes(spark, sf), NOW), "created_at")


def _grant_inputs(spark, sf):
    return (
        t.grant_requests(spark, sf),
        t.users(spark, sf),
        t.fleets(spark, sf),
        t.vehicles(spark, sf),
    )


def q_check_grants(spark, sf):
    done = master.check_grants(*_grant_inputs(spark, sf))
    return done.select("seq", F.coalesce("error", F.lit("ok")).alias("result"))


def q_apply_grants(spark, sf):
    by_fleet, by_vin = master.apply_grants(
        t.user_fleet_grants(spark, sf), t.user_vehicle_grants(spark, sf), *_grant_inputs(spark, sf)
    )
    return by_fleet.select("user_id", F.lit("fleet").alias("kind"), F.col("fleet_id").alias("id")).unionByName(
        by_vin.select("user_id", F.lit("vin").alias("kind"), F.col("vin").alias("id"))
    )


def q_seed_insert_if_absent(spark, sf):
    """Vehicles of the published map as the seed: those that exist keep their fleet."""
    seed = t.published_map(spark, sf).select(
        "vin", "fleet_id", F.lit("Demo EV").alias("model"), F.timestamp_millis(F.lit(NOW)).alias("updated_at")
    )
    done = master.seed_insert_if_absent(t.vehicles(spark, sf), seed, "vin")
    return as_ms(done, "updated_at")


def q_master_data_violations(spark, sf):
    return master.master_data_violations(*t.broken_master_data(spark, sf))


# --- wire ------------------------------------------------------------------------------------


def typed(df):
    return df.select(*REPORT_COLUMNS).withColumn("battery_soc", F.col("battery_soc").cast("double"))


def q_decode_telemetry(spark, sf):
    return typed(ingest.decode_telemetry(t.raw_log(spark, sf)))


def q_normalize_ingest(spark, sf):
    records, _ = ingest.normalize_ingest(t.payloads(spark, sf))
    decoded = ingest.decode_telemetry(records)
    ingest_ts = C.ingest_timestamp(F.col("headers"), F.col("timestamp"))
    return decoded.select(
        *REPORT_COLUMNS[:-2],
        F.col("battery_soc").cast("double").alias("battery_soc"),
        "device_timestamp",
        F.col("key").cast("string").alias("key"),
        ingest_ts.alias("ingest_timestamp"),
    )


def q_normalize_ingest_errors(spark, sf):
    _, refused = ingest.normalize_ingest(t.payloads(spark, sf))
    return refused.select("partition", "offset", "reason_code")


def q_write_canonical(spark, sf):
    records = pipeline.write_canonical(canonical(spark, sf))
    text = F.col("value").cast("string")
    number = r'"lng":[^,]*,"lat":[^,]*,|"batterySOC":[^,]*,'
    return records.select(
        F.col("key").cast("string").alias("key"),
        # Engines print doubles differently, so these are compared as numbers.
        F.regexp_replace(text, number, "").alias("value_text"),
        F.get_json_object(text, "$.lng").cast("double").alias("lng"),
        F.get_json_object(text, "$.lat").cast("double").alias("lat"),
        F.get_json_object(text, "$.batterySOC").cast("double").alias("battery_soc"),
        F.col("headers")[0]["value"].cast("string").alias("fleet_header"),
    )


# --- streams ---------------------------------------------------------------------------------

PARTS = 4


def raw_log_files(spark, sf, batches: int = PARTS) -> LogSource:
    """The raw log as files in log order, the repeats last, so that they meet across batches."""
    bounds = t.table(spark, sf, "events").agg(F.max("event_id").alias("top")).first()
    step = 2 * ((bounds["top"] or 0) // (PARTS - 1) + 1)
    part = F.when(F.col("offset") % 2 == 1, PARTS - 1).otherwise(F.floor(F.col("offset") / step))
    # Encoded once; the parts are copies, one after the other, as files are read in the order of their times.
    encoded = settled(spark, sf, "encoded-log", lambda: t.raw_log(spark, sf).withColumn("part", part.cast("int")))
    path = shared_dir(spark, "raw-log")
    for n in range(PARTS):
        encoded.where(F.col("part") == n).drop("part").write.mode("append").parquet(path)
    return LogSource(path=path, batch_size=files_per_batch(spark, path, batches))


def files_per_batch(spark, path, batches: int = PARTS) -> int:
    return max(1, -(-len(spark.read.schema(RAW_LOG).parquet(path).inputFiles()) // batches))


def run(query):
    query.awaitTermination()


def canonical_log_files(spark, sf) -> LogSource:
    path = shared_dir(spark, "canonical-log")
    events = settled(spark, sf, "events", lambda: canonical(spark, sf))
    jobs.log_records(events).write.parquet(path)
    return LogSource(path=path, batch_size=files_per_batch(spark, path))


#: Hours in a folder of the live log.
HOURS = 6


def hourly_log(spark, sf) -> LogSource:
    """The canonical log by hour, as a live reader finds it."""
    events = settled(spark, sf, "events", lambda: canonical(spark, sf))
    path = settled_at(spark, sf, "hourly-log", lambda path: write_hourly(jobs.log_records(events), path, HOURS))
    return LogSource(path=path, batch_size=files_per_batch(spark, path), by_hour=HOURS)


def q_read_raw_stream(spark, sf):
    out = shared_dir(spark, "raw-copy")
    stream = read_raw_stream(spark, raw_log_files(spark, sf))
    run(jobs.start(stream, lambda b, i: write_batch(b, f"{out}/raw", i), f"{out}/checkpoint"))
    rows = ingest.decode_telemetry(read_batches(spark, f"{out}/raw", RAW_LOG))
    return typed(rows)


def q_dedup_ttl(spark, sf):
    out = shared_dir(spark, "dedup")
    stream = read_raw_stream(spark, raw_log_files(spark, sf, batches=2))
    rows = pipeline.checked(ingest.decode_telemetry(stream), NOW)
    kept = dedup_ttl(pipeline.report_columns(pipeline.valid_only(rows)))
    run(jobs.start(kept, lambda b, i: write_batch(b, f"{out}/kept", i), f"{out}/checkpoint"))
    return read_batches(spark, f"{out}/kept", kept.schema).select(
        "partition", "offset", "vin", "device_timestamp", "ingest_timestamp"
    )


def _canonical_job(spark, sf):
    out = shared_dir(spark, "canonical-job")
    stream = read_raw_stream(spark, raw_log_files(spark, sf))
    run(
        jobs.canonical_stream(
            stream,
            lambda: vehicle_fleet(spark, sf),
            out,
            clock=lambda: NOW,
            processed_ms=processed(),
        )
    )
    return out


def q_canonical_stream(spark, sf):
    return jobs.read_canonical(spark, _canonical_job(spark, sf)).select(*EVENT_COLUMNS)


def q_dead_letter_stream(spark, sf):
    rows = jobs.read_dead_letters(spark, _canonical_job(spark, sf))
    last = F.transform(F.slice("headers", -3, 3), lambda h: h["value"].cast("string"))
    return rows.select(
        F.col("key").cast("string").alias("key"),
        F.get(last, F.lit(0)).alias("reason"),
        F.get(last, F.lit(1)).cast("int").alias("partition"),
        F.get(last, F.lit(2)).cast("long").alias("offset"),
    )


def q_processing_outcomes_stream(spark, sf):
    return jobs.read_outcomes(spark, _canonical_job(spark, sf))


def q_history_stream(spark, sf):
    out = shared_dir(spark, "history-job")
    log = read_raw_stream(spark, canonical_log_files(spark, sf))
    run(jobs.history_stream(log, f"{out}/history", f"{out}/checkpoint"))
    return stored.read_history(spark, f"{out}/history").select(
        *EVENT_COLUMNS, F.col("event_date").cast("string").alias("event_date")
    )


def q_latest_state_stream(spark, sf):
    out = shared_dir(spark, "latest-job")
    log = read_raw_stream(spark, canonical_log_files(spark, sf))
    run(jobs.latest_state_stream(log, out, {"availableNow": True}))
    return jobs.read_latest_state(spark, out).select(*EVENT_COLUMNS)


def q_read_live_stream(spark, sf):
    out = shared_dir(spark, "live-copy")
    log = read_live_stream(spark, hourly_log(spark, sf), NOW - 24 * 60 * 60 * 1000)
    fresh = routing.fresh_only(log, NOW, 24 * 60 * 60 * 1000)
    run(jobs.start(fresh, lambda b, i: write_batch(b, f"{out}/live", i), f"{out}/checkpoint"))
    rows = read_batches(spark, f"{out}/live", RAW_LOG)
    return rows.select("partition", "offset", F.col("key").cast("string").alias("vin"))


def q_live_feed_stream(spark, sf):
    out = shared_dir(spark, "feed-job")
    log = read_live_stream(spark, hourly_log(spark, sf), NOW - 24 * 60 * 60 * 1000)
    query = jobs.live_feed_stream(
        log,
        lambda: grants(spark, sf),
        out,
        connections=lambda: t.connections(spark, sf),
        clock=lambda: NOW,
        max_age_ms=24 * 60 * 60 * 1000,
    )
    run(query)
    return jobs.read_feed(spark, out).select("user_id", "partition", "offset", "vin", "fleet_id")


def q_conflated_live_feed(spark, sf):
    out = shared_dir(spark, "conflated-job")
    log = read_live_stream(spark, hourly_log(spark, sf))
    query = jobs.live_feed_stream(
        log,
        lambda: grants(spark, sf),
        out,
        connections=lambda: t.connections(spark, sf),
        clock=lambda: NOW,
        max_age_ms=30 * 24 * 60 * 60 * 1000,
        conflate_ms=TRIGGER_MS,
    )
    run(query)
    made = jobs.read_conflated_feed(spark, out)
    return made.select("user_id", "vin", "trigger_ms", "partition", "offset", "fleet_id", "dropped")


def _stale():
    return C.is_stale(F.col("device_timestamp"), NOW)


QUERIES = {
    name[2:]: make for name, make in list(globals().items()) if name.startswith("q_")
} | {
    "is_stale": board_column(lambda: [_stale().alias("is_stale")]),
    "ago_text": board_column(lambda: [C.ago_text(F.col("device_timestamp"), NOW).alias("ago_text")]),
    "status_label": board_column(lambda: [C.status_label(F.col("status")).alias("status_label")]),
    "status_color": board_column(
        lambda: [C.status_color(F.col("status"), _stale()).alias("status_color")]
    ),
    "battery_band": board_column(
        lambda: [C.battery_band(F.col("battery_soc")).alias("battery_band")]
    ),
    "battery_cells": board_column(
        lambda: [
            C.battery_cells(F.col("battery_soc")).alias("battery_cells"),
            C.battery_percent(F.col("battery_soc")).alias("battery_percent"),
        ]
    ),
    "pipeline_delay_ms": board_column(
        lambda: [
            C.pipeline_delay_ms(F.col("processed_timestamp"), F.col("device_timestamp")).alias(
                "pipeline_delay_ms"
            )
        ]
    ),
    "position_text": board_column(
        lambda: [C.position_text(F.col("lat"), F.col("lng")).alias("position_text")]
    ),
}


def with_package(make):
    """The query, after the Python workers were given this package."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return make(spark, sf_dir)

    return query


def all_queries():
    return {name: with_package(make) for name, make in QUERIES.items()}
