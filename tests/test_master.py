from datetime import datetime

from pyspark.sql import functions as F

from roadpulse.operators import master
from tests.conftest import rows
from tests.samples import NOW, VIN_A, VIN_B, VIN_C

THEN = datetime(2020, 1, 1)


def fleets(spark):
    return spark.createDataFrame(
        [("f1", "One", THEN), ("f2", "Two", THEN)], "fleet_id string, name string, created_at timestamp"
    )


def vehicles(spark):
    return spark.createDataFrame(
        [(VIN_A, "f1", "M", THEN), (VIN_B, None, None, THEN)],
        "vin string, fleet_id string, model string, updated_at timestamp",
    )


def users(spark):
    return spark.createDataFrame(
        [("ann", "ann1", "Ann", "viewer", THEN)],
        "user_id string, username string, display_name string, role string, created_at timestamp",
    )


def changes(spark, ddl, *made):
    return spark.createDataFrame([(*m, i) for i, m in enumerate(made)], ddl + ", seq long")


def test_fleets(spark):
    change = changes(spark, "fleet_id string, name string", ("f1", "x"), ("f1", "New"), ("f3", "Three"))
    got = master.upsert_fleets(fleets(spark), change, NOW)
    assert rows(got, "fleet_id", "name") == [("f1", "New"), ("f2", "Two"), ("f3", "Three")]
    assert got.where(F.unix_millis("created_at") == NOW).select("fleet_id").first()[0] == "f3"


def test_vehicles(spark):
    change = changes(
        spark,
        "vin string, fleet_id string, model string",
        (VIN_A, "f2", ""),
        (VIN_B, "f1", "X"),
        (VIN_B, "f2", ""),
        (VIN_C, "f1", ""),
        ("short", "f1", ""),
        ("D" * 17, "", ""),
        ("D" * 17, "nowhere", ""),
        ("é" + "D" * 15, "f1", ""),
        (VIN_A, "nowhere", "Y"),
    )
    checked = master.check_vehicle_changes(change, fleets(spark)).orderBy("seq").collect()
    assert [r["error"] is None for r in checked] == [True] * 4 + [False] * 5
    got = master.upsert_vehicles(vehicles(spark), change, fleets(spark), NOW)
    assert rows(got, "vin", "fleet_id", F.coalesce("model", F.lit(""))) == [
        (VIN_A, "f2", "M"), (VIN_B, "f2", "X"), (VIN_C, "f1", "")
    ]


def test_users(spark):
    change = changes(
        spark,
        "user_id string, username string, display_name string, role string",
        ("ann", "other", "Ann B", "admin"),
        ("bob", "bob1", "Bob", "viewer"),
        ("bob", "bob2", "Bobby", "fleet_manager"),
    )
    got = master.upsert_users(users(spark), change, NOW)
    assert rows(got, "user_id", "username", "display_name", "role") == [
        ("ann", "ann1", "Ann B", "admin"), ("bob", "bob1", "Bobby", "fleet_manager")
    ]


def test_grants(spark):
    requests = changes(
        spark,
        "user_id string, fleet_id string, vin string",
        ("ann", "f1", ""),
        ("ann", "f1", None),
        ("ann", "", VIN_A),
        ("ann", "f1", VIN_A),
        ("ann", "", ""),
        ("", "f1", ""),
        ("ghost", "f1", ""),
        ("ann", "f9", ""),
        ("ann", "", VIN_C),
    )
    checked = master.check_grants(requests, users(spark), fleets(spark), vehicles(spark))
    assert [r["error"] is None for r in checked.orderBy("seq").collect()] == [True] * 3 + [False] * 6
    by_fleet, by_vin = master.apply_grants(
        spark.createDataFrame([("ann", "f1"), ("ann", "f2")], "user_id string, fleet_id string"),
        spark.createDataFrame([], "user_id string, vin string"),
        requests, users(spark), fleets(spark), vehicles(spark),
    )
    assert rows(by_fleet) == [("ann", "f1"), ("ann", "f2")]
    assert rows(by_vin) == [("ann", VIN_A)]


def test_seed_keeps_reassignments(spark):
    seed = spark.createDataFrame(
        [(VIN_A, "f2", "Demo", THEN), (VIN_C, "f2", "Demo", THEN)], vehicles(spark).schema
    )
    got = master.seed_insert_if_absent(vehicles(spark), seed, "vin")
    assert rows(got.where("fleet_id is not null"), "vin", "fleet_id") == [(VIN_A, "f1"), (VIN_C, "f2")]
    assert got.count() == 3


def test_map_changes(spark):
    current = master.vehicle_fleet_map(vehicles(spark))
    published = spark.createDataFrame([(VIN_A, "f9"), (VIN_B, "f1")], "vin string, fleet_id string")
    got = master.fleet_map_changes(current, published)
    assert rows(got, "vin", F.coalesce("fleet_id", F.lit("")), "op") == [
        (VIN_A, "f1", "set"), (VIN_B, "", "delete")
    ]


def test_violations(spark):
    none_of = spark.createDataFrame([], "user_id string, fleet_id string")
    clean = master.master_data_violations(
        fleets(spark), vehicles(spark), users(spark), none_of,
        spark.createDataFrame([("ann", VIN_A)], "user_id string, vin string"),
    )
    assert clean.count() == 0
    bad = master.master_data_violations(
        fleets(spark),
        vehicles(spark).union(spark.createDataFrame([("X", "f9", None, THEN)], vehicles(spark).schema)),
        users(spark).union(
            spark.createDataFrame([("bob", "ann1", "B", "owner", THEN)], users(spark).schema)
        ),
        spark.createDataFrame([("ghost", "f9")], "user_id string, fleet_id string"),
        spark.createDataFrame([("ann", VIN_C), ("ann", VIN_C)], "user_id string, vin string"),
    )
    assert rows(bad.distinct()) == [
        ("user_fleet_grants_fleet_id_fkey", "ghost/f9"),
        ("user_fleet_grants_user_id_fkey", "ghost/f9"),
        ("user_vehicle_grants_pkey", f"ann/{VIN_C}"),
        ("user_vehicle_grants_vin_fkey", f"ann/{VIN_C}"),
        ("users_role_check", "bob"),
        ("users_username_key", "ann1"),
        ("vehicles_fleet_id_fkey", "X"),
        ("vehicles_vin_check", "X"),
    ]


def test_missing_values_are_violations_and_deletes_cascade(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    fleets = frame([("f1", "One"), ("f2", None)], "fleet_id string, name string")
    vehicles = frame([("V" * 17, "f1"), (None, "f2"), (None, None)], "vin string, fleet_id string")
    users = frame([("u1", "a", None, None), ("u2", "b", "B", "viewer")], "user_id string, username string, display_name string, role string")
    fg = frame([("u1", "f1"), (None, "f2")], "user_id string, fleet_id string")
    vg = frame([("u1", "V" * 17), ("u2", None)], "user_id string, vin string")
    found = rows(master.master_data_violations(fleets, vehicles, users, fg, vg), "constraint", "row_key")
    assert found == [
        ("fleets_name_not_null", "f2"),
        ("user_fleet_grants_user_id_not_null", "/f2"),
        ("user_vehicle_grants_vin_not_null", "u2/"),
        ("users_display_name_not_null", "u1"),
        ("users_role_not_null", "u1"),
        ("vehicles_vin_not_null", ""),
        ("vehicles_vin_not_null", ""),
    ]
    gone = frame([("fleet", "f1"), ("user", "u2"), ("user", "nobody"), ("vehicle", "W" * 17)], "kind string, id string")
    left = master.delete_master_data(fleets, vehicles, users, fg, vg, gone)
    assert [t.count() for t in left] == [1, 3, 1, 1, 1]
    assert left[1].where("vin IS NOT NULL").first().fleet_id is None


def test_map_changes_lead_to_the_current_map(spark):
    now = spark.createDataFrame([("a", "f1"), ("b", "f2")], "vin string, fleet_id string")
    old = spark.createDataFrame([("a", "f0"), ("c", "f1")], "vin string, fleet_id string")
    done = master.apply_fleet_map_changes(old, master.fleet_map_changes(now, old))
    assert rows(done, "vin", "fleet_id") == rows(now, "vin", "fleet_id")
