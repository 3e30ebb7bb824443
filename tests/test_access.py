import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadpulse.operators import access, routing
from tests.conftest import rows
from tests.samples import NOW, VIN_A, VIN_B, VIN_C, event, events


def users(spark, **roles):
    return spark.createDataFrame(list(roles.items()), "user_id string, role string")


def grants(spark, fleets=(), vins=(), **roles):
    return access.user_grants(
        users(spark, **roles),
        spark.createDataFrame(list(fleets), "user_id string, fleet_id string"),
        spark.createDataFrame(list(vins), "user_id string, vin string"),
    )


def test_scopes(spark):
    got = access.user_scopes(
        users(spark, boss="admin", ann="viewer", bob="viewer"),
        spark.createDataFrame(
            [("ann", "f2"), ("ann", "f1"), ("boss", "f1"), ("ghost", "f1")],
            "user_id string, fleet_id string",
        ),
        spark.createDataFrame([("ann", VIN_A)], "user_id string, vin string"),
        spark.createDataFrame([("boss",), ("ann",), ("bob",), ("ghost",)], "user_id string"),
    )
    assert rows(got, "user_id", "all_fleets", "fleet_ids", "vins") == [
        ("ann", False, ["f1", "f2"], [VIN_A]),
        ("bob", False, [], []),
        ("boss", True, [], []),
        ("ghost", False, [], []),
    ]


def test_check_access(spark):
    held = spark.createDataFrame(
        [("boss", "*"), ("ann", "fleet:f1"), ("ann", "fleet:"), ("ann", f"vin:{VIN_A}"), ("ann", f"vin:{VIN_A}")],
        "user_id string, topic string",
    )
    asked = [
        ("boss", "", ""),
        ("ann", "f1", ""),
        ("ann", "", VIN_A),
        ("ann", "f2", VIN_B),
        ("ann", "", ""),
        ("ann", None, None),
        ("bob", "f1", VIN_A),
        ("ghost", "f1", VIN_A),
        ("", "f1", ""),
        (None, "f1", ""),
    ]
    requests = spark.createDataFrame(
        [(i, *a) for i, a in enumerate(asked)], "i int, user_id string, fleet_id string, vin string"
    )
    for limit in (None, 0):
        got = access.check_access(requests, held, limit).orderBy("i").collect()
        assert [r["allowed"] for r in got] == [True] * 3 + [False] * 5 + [None] * 2
        assert [r["error"] for r in got] == [None] * 8 + [access.USER_REQUIRED] * 2


def test_pod_interest_is_the_union(spark):
    held = grants(
        spark, boss="admin", ann="viewer", bob="viewer", eve="viewer",
        fleets=[("ann", "f2"), ("bob", "f1"), ("bob", "f2")], vins=[("ann", VIN_A)],
    )
    connections = spark.createDataFrame(
        [("p1", "ann"), ("p1", "ann"), ("p1", "bob"), ("p2", "boss"), ("p2", "bob"), ("p3", "eve")],
        "pod string, user_id string",
    )
    assert rows(access.pod_interest(connections, held), "pod", "all_fleets", "fleet_ids", "vins") == [
        ("p1", False, ["f1", "f2"], [VIN_A]),
        ("p2", True, [], []),
        ("p3", False, [], []),
    ]
    assert access.connected_users(connections).count() == 5
    long_form = access.scope_grants(access.pod_interest(connections, held), "pod")
    assert rows(long_form, "pod", "topic") == rows(
        access.pod_grants(connections, held), "pod", "topic"
    )


def test_fleet_and_vin_grant_deliver_once(spark):
    held = grants(
        spark, boss="admin", ann="viewer", bob="viewer",
        fleets=[("ann", "f1"), ("boss", "f1")], vins=[("ann", VIN_A), ("ann", VIN_B)],
    )
    made = events(
        spark,
        event(VIN_A, fleet="f1"),
        event(VIN_B, fleet="f2"),
        event(VIN_C, fleet="f1"),
        event("D" * 17, fleet="UNASSIGNED"),
    )
    expected = [("ann", v) for v in (VIN_A, VIN_B, VIN_C)] + [
        ("boss", v) for v in (VIN_A, VIN_B, VIN_C, "D" * 17)
    ]
    assert rows(routing.authorize_events(made, held), "user_id", "vin") == expected
    spread = routing.authorize_events(made, held, limit_bytes=0)
    assert rows(spread, "user_id", "vin") == expected
    # A record that is in the log twice is delivered twice, as a record, not as an event id.
    assert routing.authorize_events(made.union(made), held).count() == 2 * len(expected)


def test_unassigned_is_an_ordinary_fleet(spark):
    held = grants(spark, ann="viewer", fleets=[("ann", "UNASSIGNED")])
    made = events(spark, event(VIN_A, fleet="UNASSIGNED"))
    assert routing.authorize_events(made, held).count() == 1


def test_unrouted(spark):
    made = events(spark, event(VIN_A, fleet="f1"), event(VIN_B, fleet="f2"), event(VIN_C, fleet="f3"))

    def interest(*topics):
        return spark.createDataFrame([("p", t) for t in topics], "pod string, topic string")

    some = interest("fleet:f1", f"vin:{VIN_B}")
    for limit in (None, 0):
        assert rows(routing.unrouted_events(made, some, limit), "vin") == [(VIN_C,)]
    assert routing.unrouted_events(made, interest("*")).count() == 0
    assert routing.unrouted_events(made, interest()).count() == 3
    assert dict(rows(routing.routing_outcomes(made, some))) == {
        "delivered": 2, "dropped": 0, "unrouted": 1
    }


TOPICS = ["*", "fleet:f0", "fleet:f1", "fleet:UNASSIGNED", f"vin:{VIN_A}", f"vin:{VIN_B}"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    made=st.lists(
        st.tuples(st.sampled_from([VIN_A, VIN_B, VIN_C]), st.sampled_from(["f0", "f1", "UNASSIGNED"])),
        min_size=1, max_size=12,
    ),
    held=st.sets(st.tuples(st.sampled_from(["u0", "u1", "u2"]), st.sampled_from(TOPICS)), min_size=1),
    pods=st.dictionaries(st.sampled_from(["u0", "u1", "u2"]), st.sampled_from(["p0", "p1"])),
)
def test_two_stages_equal_the_direct_check_and_brute_force(spark, made, held, pods):
    admins = {u for u, topic in held if topic == "*"}
    held = {(u, topic) for u, topic in held if topic == "*" or u not in admins}
    log = [event(v, NOW + i, fleet=f, offset=i) for i, (v, f) in enumerate(made)]
    df = events(spark, *log)
    g = spark.createDataFrame(sorted(held), "user_id string, topic string")
    expected = sorted(
        (u, f"{v}-{NOW + i}")
        for i, (v, f) in enumerate(made)
        for u in ["u0", "u1", "u2"]
        if {"*", f"fleet:{f}", f"vin:{v}"} & {topic for w, topic in held if w == u}
    )
    assert rows(routing.authorize_events(df, g), "user_id", "event_id") == expected
    assert rows(routing.authorize_events(df, g, limit_bytes=0), "user_id", "event_id") == expected
    c = spark.createDataFrame(
        [(p, u) for u, p in pods.items()], "pod string, user_id string"
    )
    staged = routing.two_stage_feed(df, g, c, access.pod_grants(c, g))
    assert rows(staged, "user_id", "event_id") == [e for e in expected if e[0] in pods]


def test_interest_versions(spark):
    hour = 3_600_000
    day = 24 * hour
    made = [
        ("p", 0, False, [], []),
        ("p", hour, False, ["f1"], []),
        ("p", 2 * hour, False, ["f1"], []),
        ("p", day, False, ["f1"], []),
        ("p", day + hour, True, [], []),
        ("p", 3 * day, True, [], []),
        ("p", 3 * day + hour, False, ["f1"], [VIN_A]),
        ("q", day, False, ["f1"], []),
    ]
    df = spark.createDataFrame(
        made, "pod string, as_of long, all_fleets boolean, fleet_ids array<string>, vins array<string>"
    )
    expected = [("p", hour, 1), ("p", day + hour, 2), ("p", 3 * day + hour, 3), ("q", day, 1)]
    for bucket in (hour, day, 100 * day):
        got = access.interest_versions(df.orderBy(F.desc("as_of")), bucket)
        assert rows(got, "pod", "as_of", "version") == expected


def test_conflate_keeps_the_newest_and_counts_the_rest(spark):
    made = events(
        spark, event(VIN_A, NOW), event(VIN_A, NOW + 10), event(VIN_A, NOW + 1000), event(VIN_B, NOW)
    ).withColumn("pod", F.lit("p"))
    got = routing.conflate(made, "pod", 1000)
    assert rows(got, "vin", "device_timestamp", "dropped") == [
        (VIN_A, NOW + 10, 1), (VIN_A, NOW + 1000, 0), (VIN_B, NOW, 0)
    ]
    assert dict(
        rows(
            routing.routing_outcomes(
                made.drop("pod"), spark.createDataFrame([("p", "*")], "pod string, topic string"), got
            )
        )
    ) == {"delivered": 3, "dropped": 1, "unrouted": 0}


def test_fresh_only_and_routing_keys(spark):
    made = [
        (NOW - 30_000, '{"vin":"v","fleetId":"f","x":{"vin":1}}'),
        (NOW - 30_001, '{"vin":"old"}'),
        (NOW, "not json"),
        (NOW, '{"vin":"only"}'),
        (NOW, "[1]"),
    ]
    df = spark.createDataFrame(made, "ms long, text string").select(
        F.timestamp_millis("ms").alias("timestamp"), F.encode("text", "UTF-8").alias("value")
    )
    fresh = routing.fresh_only(df, NOW)
    assert fresh.count() == 4
    got = routing.routing_keys(fresh)
    assert rows(got, "vin", "fleet_id") == [("only", ""), ("v", "f")]
    assert {bytes(r["value"]).decode() for r in got.collect()} == {made[0][1], made[3][1]}


def test_everything_and_a_fleet_deliver_once(spark):
    held = spark.createDataFrame(
        [("boss", "*"), ("boss", "fleet:f1"), ("boss", f"vin:{VIN_A}")], "user_id string, topic string"
    )
    made = events(spark, event(VIN_A, fleet="f1"), event(VIN_B, fleet="f2"))
    for limit in (None, 0):
        got = routing.authorize_events(made, held, limit_bytes=limit)
        assert rows(got, "user_id", "vin") == [("boss", VIN_A), ("boss", VIN_B)]


def test_conflating_before_routing_gives_the_same_feed(spark):
    rng = random.Random(1)
    made = events(
        spark,
        *[event(rng.choice([VIN_A, VIN_B, VIN_C]), NOW + i * 90, f"f{rng.randrange(2)}", i) for i in range(60)],
    )
    held = spark.createDataFrame(
        [("p1", "*"), ("p1", "fleet:f1"), ("p2", "fleet:f0"), ("p2", f"vin:{VIN_A}"), ("p3", f"vin:{VIN_B}")],
        "pod string, topic string",
    )
    after = routing.conflate(routing.route_events(made, held), "pod", 1000)
    before = routing.conflated_feed(made, held, "pod", 1000)
    columns = ["pod", "vin", "trigger_ms", "event_id", "fleet_id", "dropped"]
    assert rows(before, *columns) == rows(after, *columns)
