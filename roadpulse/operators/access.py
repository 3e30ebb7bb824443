"""Who may see which vehicle.

Two forms of the same thing. *Scopes* and *interest* are one row per user or pod with two lists, as
they are shown and sent. *Grants* are one row per (subscriber, topic) and are what the joins use; a
topic is ``*``, ``fleet:<id>`` or ``vin:<vin>``. Grants are derived from the tables directly, so no
join has to gather a user's or a pod's lists first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.operators.lookup import grouped, sized, spread

ALL = "*"
FLEET = "fleet:"
VIN = "vin:"


def topic(prefix: str, column: str | Column):
    return F.concat(F.lit(prefix), F.col(column) if isinstance(column, str) else column)


def user_grants(users: DataFrame, fleet_grants: DataFrame, vehicle_grants: DataFrame) -> DataFrame:
    """(user_id, topic) of every user that exists; an admin holds only ``*``."""
    admins = users.where(F.col("role") == "admin").select("user_id", F.lit(ALL).alias("topic"))
    others = users.where(F.col("role") != "admin").select("user_id")
    listed = fleet_grants.select("user_id", topic(FLEET, "fleet_id").alias("topic")).unionByName(
        vehicle_grants.select("user_id", topic(VIN, "vin").alias("topic"))
    )
    return admins.unionByName(listed.join(others, "user_id", "left_semi").distinct())


def without_covered(grants: DataFrame, *subscriber: str) -> DataFrame:
    """Distinct grants; of a subscriber that holds ``*`` only that one."""
    rows = grants.select(*subscriber, "topic").distinct()
    everything = rows.where(F.col("topic") == ALL)
    listed = rows.where(F.col("topic") != ALL)
    return everything.unionByName(listed.join(everything.select(*subscriber), list(subscriber), "left_anti"))


def _lists(grants: DataFrame, key: str) -> DataFrame:
    """One row per key with sorted lists. The rows are distinct, so the lists are the result."""

    def held(prefix):
        bare = F.substr("topic", F.lit(len(prefix) + 1))
        kept = F.collect_list(F.when(F.startswith("topic", F.lit(prefix)), bare))
        return F.array_sort(kept)

    return grants.groupBy(key).agg(
        F.bool_or(F.col("topic") == ALL).alias("all_fleets"),
        held(FLEET).alias("fleet_ids"),
        held(VIN).alias("vins"),
    )


def user_scopes(
    users: DataFrame,
    fleet_grants: DataFrame,
    vehicle_grants: DataFrame,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Scope per user, or per id asked for; an id without a user sees nothing."""
    wanted = (users if ids is None else ids).select("user_id").distinct()
    lists = _lists(user_grants(users, fleet_grants, vehicle_grants), "user_id")
    nothing = F.array().cast("array<string>")
    return wanted.join(lists, "user_id", "left").select(
        "user_id",
        F.coalesce("all_fleets", F.lit(False)).alias("all_fleets"),
        F.coalesce("fleet_ids", nothing).alias("fleet_ids"),
        F.coalesce("vins", nothing).alias("vins"),
    )


def scope_grants(scopes: DataFrame, key: str) -> DataFrame:
    """(key, topic) of scopes or interest; the lists of a row that sees all are dropped."""
    fleets = F.transform("fleet_ids", lambda f: F.concat(F.lit(FLEET), f))
    vins = F.transform("vins", lambda v: F.concat(F.lit(VIN), v))
    topics = F.when(F.col("all_fleets"), F.array(F.lit(ALL))).otherwise(F.concat(fleets, vins))
    return scopes.select(key, F.explode(topics).alias("topic")).distinct()


USER_REQUIRED = "user_required"


def check_access(requests: DataFrame, grants: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """Adds ``allowed`` and ``error``; a question without a user is an error and has no answer.

    A request is joined to the grants that exist on user and topic, for ``*``, its fleet and its VIN, so no list is
    searched and a busy user is as many keys as there are topics asked for. An empty fleet or VIN is no key
    and never matches, nor do rows without one meet in one task; no VIN's fleet is looked up.
    """
    held = sized(grouped(grants, ["user_id", "topic"]), limit_bytes)
    rows = requests
    asked = {"all": F.lit(ALL)} | {
        c: spread(topic(prefix, F.nullif(F.col(c), F.lit(""))), *requests.columns)
        for prefix, c in ((FLEET, "fleet_id"), (VIN, "vin"))
    }
    for name, wanted in asked.items():
        own = held.select(
            F.col("user_id").alias("holder"), F.col("topic").alias("held"), F.lit(True).alias(f"by_{name}")
        )
        meets = (F.col("user_id") == F.col("holder")) & (wanted == F.col("held"))
        rows = rows.join(own, meets, "left").drop("holder", "held")
    named = F.coalesce(F.col("user_id"), F.lit("")) != ""
    allowed = F.coalesce(*(f"by_{name}" for name in asked), F.lit(False))
    return rows.select(
        *requests.columns,
        F.when(named, allowed).alias("allowed"),
        F.when(~named, USER_REQUIRED).alias("error"),
    )


def connected_users(connections: DataFrame) -> DataFrame:
    return connections.select("pod", "user_id").distinct()


def _held_at_pod(connections: DataFrame, grants: DataFrame) -> DataFrame:
    return connected_users(connections).join(grants, "user_id").select("pod", "topic").distinct()


def pod_grants(connections: DataFrame, grants: DataFrame) -> DataFrame:
    """(pod, topic): the union of the grants of each pod's users; ``*`` replaces all others."""
    return without_covered(_held_at_pod(connections, grants), "pod")


def pod_interest(connections: DataFrame, grants: DataFrame) -> DataFrame:
    """Interest per pod; the lists are empty when it sees all, or when its users see nothing."""
    pods = connections.select("pod").distinct()
    lists = _lists(pod_grants(connections, grants), "pod")
    nothing = F.array().cast("array<string>")
    return pods.join(lists, "pod", "left").select(
        "pod",
        F.coalesce("all_fleets", F.lit(False)).alias("all_fleets"),
        F.coalesce("fleet_ids", nothing).alias("fleet_ids"),
        F.coalesce("vins", nothing).alias("vins"),
    )


def interest_versions(snapshots: DataFrame, bucket_ms: int = 24 * 60 * 60 * 1000) -> DataFrame:
    """Keeps the snapshots that change a pod's interest and numbers them from 1.

    ``snapshots`` holds ``pod, as_of, all_fleets, fleet_ids, vins`` with sorted lists. Before the
    first one a pod has no interest, so an empty first snapshot changes nothing.

    A pod's snapshots are cut into time buckets so that no task sorts all of a busy pod: each
    bucket compares within itself, and only one row per bucket is compared across buckets.
    """
    nothing = F.array().cast("array<string>")
    no_interest = F.struct(
        F.lit(False).alias("all_fleets"), nothing.alias("fleet_ids"), nothing.alias("vins")
    )
    in_bucket = W.partitionBy("pod", "bucket").orderBy("as_of")
    across = W.partitionBy("pod").orderBy("bucket")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)

    previous = F.lag("state").over(in_bucket)
    steps = snapshots.select(
        "pod",
        "as_of",
        F.floor(F.col("as_of") / F.lit(bucket_ms)).alias("bucket"),
        F.struct("all_fleets", "fleet_ids", "vins").alias("state"),
    ).select("*", previous.isNull().alias("opens"), (F.col("state") != previous).alias("changed"))

    buckets = steps.groupBy("pod", "bucket").agg(
        F.min_by("state", "as_of").alias("first"),
        F.max_by("state", "as_of").alias("last"),
        F.count_if("changed").alias("inner_changes"),
    )
    opened = F.col("first") != F.coalesce(F.lag("last").over(across), no_interest)
    chain = buckets.withColumn("opened", opened).select(
        "pod",
        "bucket",
        "opened",
        F.coalesce(
            F.sum(F.col("inner_changes") + F.col("opened").cast("long")).over(earlier), F.lit(0)
        ).alias("start"),
    )
    changed = F.when(F.col("opens"), F.col("opened")).otherwise(F.col("changed"))
    return (
        steps.join(chain, ["pod", "bucket"])
        .withColumn("changed", changed)
        .withColumn("version", F.col("start") + F.count_if("changed").over(in_bucket))
        .where("changed")
        .select("pod", "as_of", "version", "state.*")
    )
