"""Matching events to the subscribers that want them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.telemetry import once
from roadpulse.operators import audiences
from roadpulse.operators.access import ALL, FLEET, VIN, topic, without_covered
from roadpulse.operators.lookup import dealt_out, fits_broadcast, grouped, sized

MAX_AGE_MS = 30_000


def fresh_only(records: DataFrame, now_ms: int | Column, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """Drops records whose record time is more than ``max_age_ms`` before now."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return records.where(F.unix_millis("timestamp") >= now - F.lit(max_age_ms))


def routing_keys(records: DataFrame) -> DataFrame:
    """Adds ``vin`` and ``fleet_id`` from the JSON value and leaves the value as it is.

    Only two members are parsed. A record that is not a JSON object is left out; an object without
    one of the members gets an empty id.
    """
    ids = F.from_json(
        F.col("value").cast("string"),
        "vin string, fleetId string, bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"},
    )
    return (
        records.withColumn("ids", once(ids))
        .where(F.col("ids").isNotNull() & F.col("ids.bad").isNull())
        .withColumn("vin", F.coalesce("ids.vin", F.lit("")))
        .withColumn("fleet_id", F.coalesce("ids.fleetId", F.lit("")))
        .drop("ids")
    )


def match(
    events: DataFrame,
    grants: DataFrame,
    subscriber: str,
    within: str | None = None,
    limit_bytes: int | None = None,
) -> DataFrame:
    """One row per event and subscriber that wants it, each pair once.

    "Sees all, or the fleet, or the VIN" as a join condition has no equality and would compare every
    event with every subscriber. Instead each event names the three topics it can be reached by
    and equality joins find the lists of their holders.

    ``within`` names a column that events and grants share, such as the pod an event was sent to.

    When the grants are too large to broadcast, ``*`` would be the join key of half of the
    rows, so it is spread over as many keys as there are shuffle partitions; other hot topics
    are left to the adaptive skew join.
    """
    shared = [within] if within else []
    # Who holds * needs no other topic, and would get an event once for each.
    grants = without_covered(grants, *shared, subscriber)
    small = fits_broadcast(grants, limit_bytes)
    lists = audiences.listed(grants, subscriber, *shared, "topic")
    everything = F.lit(ALL)
    if not small:
        spread = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place = F.pmod(F.xxhash64(*events.columns), F.lit(spread))
        everything = F.concat(F.lit(ALL), place.cast("string"))
        places = F.transform(
            F.sequence(F.lit(0), F.lit(spread - 1)),
            lambda i: F.concat(F.lit(ALL), i.cast("string")),
        )
        lists = lists.withColumn(
            "topic",
            F.explode(F.when(F.col("topic") == ALL, places).otherwise(F.array("topic"))),
        )
    by_fleet = events.withColumn("topic", F.explode(F.array(topic(FLEET, "fleet_id"), everything)))
    by_vin = events.withColumn("topic", topic(VIN, "vin"))
    fed = audiences.of_holders(by_fleet, by_vin, lists, grants, subscriber, shared, small)
    return fed.select(*shared, subscriber, *[c for c in events.columns if c not in shared])


def route_events(events: DataFrame, interest: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """(pod, event) for every pod whose interest, given as grants, the event meets."""
    return match(events, interest, "pod", limit_bytes=limit_bytes)


def audience_feed(events: DataFrame, grants: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """(audience, event) for each of the event's topics that someone holds, three at most."""
    held = sized(grouped(grants, ["topic"]), limit_bytes)
    topics = F.array(F.lit(ALL), topic(FLEET, "fleet_id"), topic(VIN, "vin"))
    return events.withColumn("topic", F.explode(topics)).join(held, "topic", "left_semi").withColumnRenamed("topic", audiences.AUDIENCE)


def feed_of_users(fed: DataFrame, members: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """The rows of :func:`audience_feed` as rows of users.

    ``members`` has the ``user_id`` and ``audience`` of all grants without covered ones, and both sides name in ``members`` the
    grants that were valid.
    """
    grants = members.withColumnRenamed(audiences.AUDIENCE, "topic")
    rows = fed.withColumnRenamed(audiences.AUDIENCE, "topic")
    small = fits_broadcast(grants, limit_bytes)
    lists = audiences.listed(grants, "user_id", "members", "topic")
    by_vin = F.startswith("topic", F.lit(VIN))
    users = audiences.of_holders(rows.where(~by_vin), rows.where(by_vin), lists, grants, "user_id", ["members"], small)
    return users.drop("topic", "members")


def authorize_events(events: DataFrame, grants: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """(user_id, event) for every user whose own grants allow it; the authoritative filter."""
    return match(dealt_out(events), grants, "user_id", limit_bytes=limit_bytes)


def two_stage_feed(
    events: DataFrame, grants: DataFrame, connections: DataFrame, interest: DataFrame
) -> DataFrame:
    """Events routed to pods first, then checked per user of the pod."""
    wanted = connections.select("pod", "user_id").distinct().join(grants, "user_id")
    return match(route_events(events, interest), wanted, "user_id", within="pod")


def held_ids(grants: DataFrame, prefix: str, column: str, small: bool) -> DataFrame:
    """Distinct fleets or VINs named in grants, with a broadcast hint if the grants are small."""
    bare = F.substr("topic", F.lit(len(prefix) + 1)).alias(column)
    ids = grouped(grants.where(F.startswith("topic", F.lit(prefix))).select(bare), [column])
    return F.broadcast(ids) if small else ids


def unrouted_events(events: DataFrame, interest: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """Events that no subscriber wants."""
    small = fits_broadcast(interest, limit_bytes)
    someone_sees_all = interest.where(F.col("topic") == ALL).exists()
    return (
        events.where(~someone_sees_all)
        .join(held_ids(interest, FLEET, "fleet_id", small), "fleet_id", "left_anti")
        .join(held_ids(interest, VIN, "vin", small), "vin", "left_anti")
        .select(*events.columns)
    )


def visible_to(events: DataFrame, grants: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """Events that one subscriber, the holder of all ``grants``, may see."""
    small = fits_broadcast(grants, limit_bytes)
    fleets = held_ids(grants, FLEET, "fleet_id", small).withColumn("by_fleet", F.lit(True))
    vins = held_ids(grants, VIN, "vin", small).withColumn("by_vin", F.lit(True))
    sees_all = grants.where(F.col("topic") == ALL).exists()
    return (
        events.join(fleets, "fleet_id", "left")
        .join(vins, "vin", "left")
        .where(sees_all | F.col("by_fleet").isNotNull() | F.col("by_vin").isNotNull())
        .select(*events.columns)
    )


def routing_outcomes(
    events: DataFrame, interest: DataFrame, dropped: DataFrame | None = None
) -> DataFrame:
    """Counts of delivered, dropped and unrouted events.

    Whether an event is wanted depends on its fleet and VIN alone, so these are counted first and
    only the distinct pairs are routed. ``dropped`` is the result of :func:`conflate` or
    :func:`conflated_feed`.
    """
    kinds = events.groupBy("fleet_id", "vin").agg(F.count(F.lit(1)).alias("n"))

    def total(rows, column, name):
        n = F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("n")
        return rows.agg(n).select(F.lit(name).alias("outcome"), "n")

    routed = total(route_events(kinds, interest), "n", "routed")
    unrouted = total(unrouted_events(kinds, interest), "n", "unrouted")
    if dropped is None:
        lost = routed.select(F.lit("dropped").alias("outcome"), F.lit(0).cast("long").alias("n"))
    else:
        lost = total(dropped, "dropped", "dropped")
    sent = routed.unionByName(lost).agg(
        F.sum(F.when(F.col("outcome") == "dropped", -F.col("n")).otherwise(F.col("n"))).alias("n")
    )
    delivered = sent.select(F.lit("delivered").alias("outcome"), "n")
    return delivered.unionByName(lost).unionByName(unrouted)


def conflated_feed(events: DataFrame, interest: DataFrame, subscriber: str, trigger_ms: int) -> DataFrame:
    """What :func:`conflate` makes of the routed events, without routing events that it would drop.

    Events of one vehicle, fleet and trigger interval reach the same subscribers, so only the newest of them is
    routed, with the number it stands for.
    """
    keys = ["vin", "fleet_id", "trigger_ms"]
    rest = [c for c in events.columns if c not in keys]
    trigger = F.floor(F.unix_millis("timestamp") / F.lit(trigger_ms)) * F.lit(trigger_ms)
    order = F.struct("device_timestamp", "event_id")
    first = events.withColumn("trigger_ms", trigger).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("newest"), F.count(F.lit(1)).alias("n")
    )
    routed = match(first.select(*keys, "newest.*", "n"), interest, subscriber)
    kept = [c for c in routed.columns if c not in (subscriber, "vin", "trigger_ms", "n")]
    return (
        routed.groupBy(subscriber, "vin", "trigger_ms")
        .agg(F.max_by(F.struct(*kept), order).alias("newest"), (F.sum("n") - F.lit(1)).alias("dropped"))
        .select(subscriber, "vin", "trigger_ms", "newest.*", "dropped")
    )


def conflate(deliveries: DataFrame, subscriber: str, trigger_ms: int) -> DataFrame:
    """Per subscriber, vehicle and trigger interval keeps the newest event and counts the others.

    A consumer that reads once per interval needs no more: newer positions supersede older ones.
    """
    rest = [c for c in deliveries.columns if c not in (subscriber, "vin")]
    newest = F.max_by(F.struct(*rest), F.struct("device_timestamp", "event_id"))
    trigger = F.floor(F.unix_millis("timestamp") / F.lit(trigger_ms)) * F.lit(trigger_ms)
    return (
        deliveries.groupBy(subscriber, "vin", trigger.alias("trigger_ms"))
        .agg(newest.alias("newest"), (F.count(F.lit(1)) - F.lit(1)).alias("dropped"))
        .select(subscriber, "vin", "trigger_ms", "newest.*", "dropped")
    )
