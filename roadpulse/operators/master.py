"""Master data: fleets, vehicles, users and grants.

Change sets carry a ``seq`` column, the order in which the changes were asked for. Several changes to
one key are first folded into one, so each job is a single pass over keys.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.lookup import grouped, spread

VIN_LENGTH = 17
# The roles a user can have.
ROLES = ["admin", "fleet_manager", "viewer"]


def vehicle_fleet_map(vehicles: DataFrame) -> DataFrame:
    """(vin, fleet_id) of the vehicles that are assigned."""
    return vehicles.where(F.col("fleet_id").isNotNull()).select("vin", "fleet_id")


def fleet_map_changes(vehicle_fleet: DataFrame, published: DataFrame) -> DataFrame:
    """What brings the published map in line: ``set`` every current pair, ``delete`` the rest."""
    known = published.select("vin", F.lit(True).alias("known"))
    both = vehicle_fleet.select("vin", "fleet_id").join(known, "vin", "full_outer")
    op = F.when(F.col("fleet_id").isNull(), "delete").otherwise("set")
    return both.select("vin", "fleet_id", op.alias("op"))


def upsert_fleets(fleets: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Adds fleets or replaces their name; the creation time of an old one stays."""
    new = changes.groupBy("fleet_id").agg(F.max_by("name", "seq").alias("new_name"))
    return fleets.join(new, "fleet_id", "full_outer").select(
        "fleet_id",
        F.coalesce("new_name", "name").alias("name"),
        F.coalesce("created_at", F.timestamp_millis(F.lit(now_ms))).alias("created_at"),
    )


def check_vehicle_changes(changes: DataFrame, fleets: DataFrame) -> DataFrame:
    """Adds ``error``, null for a change that can be applied."""
    known = grouped(fleets, ["fleet_id"]).select(F.col("fleet_id").alias("known_id"), F.lit(True).alias("known"))
    asked = spread(F.nullif(F.col("fleet_id"), F.lit("")), *changes.columns)
    joined = changes.join(known, asked == F.col("known_id"), "left")
    bad_request = (
        (F.octet_length("vin") != VIN_LENGTH)
        | F.col("vin").isNull()
        | (F.coalesce("fleet_id", F.lit("")) == "")
    )
    error = (
        F.when(bad_request, "bad_request")
        .when(F.char_length("vin") != VIN_LENGTH, "bad_vin")
        .when(F.col("known").isNull(), "unknown_fleet")
    )
    return joined.select(*changes.columns, error.alias("error"))


def upsert_vehicles(
    vehicles: DataFrame, changes: DataFrame, fleets: DataFrame, now_ms: int
) -> DataFrame:
    """Adds vehicles or moves them to a fleet; an empty model leaves the old one."""
    good = check_vehicle_changes(changes, fleets).where(F.col("error").isNull())
    named = F.when(F.col("model") != "", F.col("seq"))
    new = good.groupBy("vin").agg(
        F.max_by("fleet_id", "seq").alias("new_fleet"), F.max_by("model", named).alias("new_model")
    )
    touched = F.col("new_fleet").isNotNull()
    return vehicles.join(new, "vin", "full_outer").select(
        "vin",
        F.coalesce("new_fleet", "fleet_id").alias("fleet_id"),
        F.coalesce("new_model", "model").alias("model"),
        F.when(touched, F.timestamp_millis(F.lit(now_ms))).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upsert_users(users: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Adds users or replaces display name and role; the user name of an old one stays."""
    new = changes.groupBy("user_id").agg(
        F.min_by("username", "seq").alias("first_username"),
        F.max_by(F.struct("display_name", "role"), "seq").alias("new"),
    )
    return users.join(new, "user_id", "full_outer").select(
        "user_id",
        F.coalesce("username", "first_username").alias("username"),
        F.coalesce("new.display_name", "display_name").alias("display_name"),
        F.coalesce("new.role", "role").alias("role"),
        F.coalesce("created_at", F.timestamp_millis(F.lit(now_ms))).alias("created_at"),
    )


def check_grants(
    requests: DataFrame, users: DataFrame, fleets: DataFrame, vehicles: DataFrame
) -> DataFrame:
    """Adds ``error`` to grant requests; empty text counts as not given."""

    def known(table, column):
        return grouped(table, [column]).select(F.col(column).alias("known_id"), F.lit(True).alias("known_" + column))

    def given(column):
        return F.coalesce(F.col(column), F.lit("")) != ""

    rows = requests
    for table, column in [(users, "user_id"), (fleets, "fleet_id"), (vehicles, "vin")]:
        # Text that is not given is no join key, nor is null: either would bring most of the rows to one task.
        asked = spread(F.nullif(F.col(column), F.lit("")), *requests.columns)
        rows = rows.join(known(table, column), asked == F.col("known_id"), "left").drop("known_id")
    error = (
        F.when(
            ~given("user_id") | (given("fleet_id") == given("vin")),
            "bad_request",
        )
        .when(F.col("known_user_id").isNull(), "unknown_user")
        .when(given("fleet_id") & F.col("known_fleet_id").isNull(), "unknown_fleet")
        .when(given("vin") & F.col("known_vin").isNull(), "unknown_vehicle")
    )
    return rows.select(*requests.columns, error.alias("error"))


def apply_grants(
    fleet_grants: DataFrame,
    vehicle_grants: DataFrame,
    requests: DataFrame,
    users: DataFrame,
    fleets: DataFrame,
    vehicles: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Both grant tables with the valid requests added; a grant that exists is left alone."""
    good = check_grants(requests, users, fleets, vehicles).where(F.col("error").isNull())

    def added(table, column):
        new = good.where(F.coalesce(F.col(column), F.lit("")) != "").select("user_id", column)
        return table.select("user_id", column).unionByName(new).distinct()

    return added(fleet_grants, "fleet_id"), added(vehicle_grants, "vin")


def seed_insert_if_absent(table: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Adds the seed rows whose key is new; rows that exist keep later changes."""
    new = seed.join(table.select(key), key, "left_anti")
    return table.unionByName(new.select(*table.columns))


def master_data_violations(
    fleets: DataFrame,
    vehicles: DataFrame,
    users: DataFrame,
    fleet_grants: DataFrame,
    vehicle_grants: DataFrame,
) -> DataFrame:
    """(constraint, row_key) for every row that breaks a constraint of the data model; repeated keys once.

    Each table is read twice: once for its keys, which are counted together, and once for its rules and the keys it refers to,
    which meet the counted keys in one join.
    """

    keys, checks = None, None
    for table, df, required, primary, others, also in (
        ("fleets", fleets, ["fleet_id", "name"], ["fleet_id"], {}, {}),
        ("vehicles", vehicles, ["vin"], ["vin"], {}, {"vin_check": F.char_length("vin") != VIN_LENGTH}),
        ("users", users, ["user_id", "username", "display_name", "role"], ["user_id"], {"users_username_key": ["username"]},
         {"role_check": ~F.col("role").isin(ROLES)}),
        ("user_fleet_grants", fleet_grants, ["user_id", "fleet_id"], ["user_id", "fleet_id"], {}, {}),
        ("user_vehicle_grants", vehicle_grants, ["user_id", "vin"], ["user_id", "vin"], {}, {}),
    ):
        row_key = F.concat_ws("/", *(F.coalesce(c, F.lit("")) for c in primary))
        unique = {f"{table}_pkey": primary} | others
        held = [
            F.when(F.array_position(F.array(*(F.col(c).isNull() for c in own)), True) == 0, _key(name, *own))
            for name, own in unique.items()
        ]
        here = df.select(F.inline(F.array_compact(F.array(*held))))
        keys = here if keys is None else keys.unionByName(here)
        parents = {c: p for (t, c), p in PARENTS.items() if t == table}
        found = [F.when(F.col(c).isNull(), _check(f"{table}_{c}_not_null", row_key)) for c in required]
        found += [F.when(v, _check(f"{table}_{c}", F.col(primary[0]))) for c, v in also.items()]
        found += [
            F.when(F.col(c).isNotNull(), _check(f"{table}_{c}_fkey", F.concat_ws("/", *primary), parent, F.col(c)))
            for c, parent in parents.items()
        ]
        here = df.select(F.inline(F.array_compact(F.array(*found))))
        checks = here if checks is None else checks.unionByName(here)
    counted = grouped(keys, ["kind", "key"], n=F.count(F.lit(1)))
    # A broken rule names no kind of key, so it finds no parent either.
    alone = checks.join(counted, ["kind", "key"], "left_anti").select("constraint", "row_key")
    repeated = counted.where("n > 1").select(F.col("kind").alias("constraint"), F.array_join("key", "/").alias("row_key"))
    return alone.unionByName(repeated)


#: What each foreign key refers to.
PARENTS = {
    ("vehicles", "fleet_id"): "fleets_pkey",
    ("user_fleet_grants", "user_id"): "users_pkey",
    ("user_fleet_grants", "fleet_id"): "fleets_pkey",
    ("user_vehicle_grants", "user_id"): "users_pkey",
    ("user_vehicle_grants", "vin"): "vehicles_pkey",
}


def _key(kind: str, *columns: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(*columns).alias("key"))


def _check(constraint: str, row_key: Column, kind: str = "", key: Column | None = None) -> Column:
    """A row that breaks a rule, or with a ``kind`` of key one that does so unless the key exists."""
    key = F.array(row_key if key is None else key)
    return F.struct(F.lit(constraint).alias("constraint"), row_key.alias("row_key"), F.lit(kind).alias("kind"), key.alias("key"))


def apply_fleet_map_changes(published: DataFrame, changes: DataFrame) -> DataFrame:
    """The published map after the changes of :func:`fleet_map_changes`: set and deleted VINs replaced."""
    kept = published.select("vin", "fleet_id").join(changes.select("vin"), "vin", "left_anti")
    return kept.unionByName(changes.where(F.col("op") == "set").select("vin", "fleet_id"))


def delete_master_data(
    fleets: DataFrame,
    vehicles: DataFrame,
    users: DataFrame,
    fleet_grants: DataFrame,
    vehicle_grants: DataFrame,
    gone: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The five tables after deleting the rows named by ``gone`` (kind, id): fleet, vehicle or user.

    Vehicles of a deleted fleet stay without one; the grants of what is deleted go with it. Ids that do not
    exist delete nothing.
    """

    def ids(kind, column):
        return gone.where(F.col("kind") == kind).select(F.col("id").alias(column)).distinct()

    def without(table, kind, column):
        return table.join(ids(kind, column), column, "left_anti").select(*table.columns)

    lost = ids("fleet", "fleet_id").withColumn("lost", F.lit(True))
    moved = without(vehicles, "vehicle", "vin").join(lost, "fleet_id", "left")
    moved = moved.withColumn("fleet_id", F.when(F.col("lost").isNull(), F.col("fleet_id"))).select(*vehicles.columns)
    return (
        without(fleets, "fleet", "fleet_id"),
        moved,
        without(users, "user", "user_id"),
        without(without(fleet_grants, "user", "user_id"), "fleet", "fleet_id"),
        without(without(vehicle_grants, "user", "user_id"), "vehicle", "vin"),
    )
