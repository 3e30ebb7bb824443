"""The given tables seen as vehicle reports and master data.

``events`` become reports, ``customer`` vehicles, ``nation`` fleets and ``supplier`` users. All
derived columns are plain expressions, so filters and column pruning still reach the Parquet scans.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.wire import encode_report
from roadpulse.schemas import HEADERS

NOW_MS = 1_706_572_800_000
VIN_PREFIX = "7H4T9K2L5RA"
FIRST_SERIAL = 102_301


# Declared, so that reading a table starts no job to look at its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def vin_of(number: Column) -> Column:
    """17 characters for any number: a longer serial takes the place of the prefix's last letters."""
    serial = (number + F.lit(FIRST_SERIAL)).cast("string")
    prefix = F.left(F.lit(VIN_PREFIX), F.least(F.lit(len(VIN_PREFIX)), 17 - F.length(serial)))
    return F.concat(prefix, F.lpad(serial, F.greatest(F.lit(6), F.length(serial)), "0"))


def lost_vin(number: Column) -> Column:
    """A well-formed VIN that no vehicle has, at any scale."""
    return F.concat(F.lit("0L0ST"), F.lpad(number.cast("string"), 12, "0"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with the report fields already typed; one in 33 was sent twice."""
    number, kind = F.col("event_id"), F.col("event_type")
    # Counting from the zone-less epoch keeps the result free of the session's time zone.
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("long")
    code = (
        F.when(number % 503 == 3, 0)
        .when(number % 509 == 4, 7)
        .when(kind == "view", 1)
        .when(kind == "click", 2)
        .when(kind == "purchase", 3)
        .when(kind == "signup", 4)
        .otherwise(5)
    )
    def copy(rep):
        return F.struct(F.lit(rep).alias("rep"), ms.alias("ms"), k.alias("k"))

    copies = F.when(number % 33 == 0, F.array(copy(0), copy(1))).otherwise(F.array(copy(0)))
    sent = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", code.alias("status_code"), F.inline(copies)
    )
    ingest = F.when(number % 97 == 1, F.lit("abc")).otherwise(
        (F.col("ms") + 95 + F.col("k") * 10 + F.col("rep") * 500).cast("string")
    )
    header = F.struct(
        F.lit("ingest_ts").alias("key"), F.encode(ingest, "UTF-8").alias("value")
    )
    step = F.lit(0.0012)
    vin = F.when(number % 211 == 5, "BADVIN").otherwise(vin_of(F.col("user_id")))
    return sent.select(
        F.encode(vin, "UTF-8").alias("key"),
        F.lit(None).cast("binary").alias("value"),
        F.array(header).cast(HEADERS).alias("headers"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        (F.col("event_id") * 2 + F.col("rep")).alias("offset"),
        F.timestamp_millis(F.col("ms") + 100 + F.col("k") * 10 + F.col("rep") * 500).alias(
            "timestamp"
        ),
        vin.alias("vin"),
        (F.lit(-122.4194) + (F.col("user_id") % 100 - 50).cast("double") * step).alias("lng"),
        F.when(number % 307 == 7, F.lit(95.0))
        .otherwise(F.lit(37.7749) + (F.col("k") - 50).cast("double") * step)
        .alias("lat"),
        "status_code",
        F.col("value").cast("float").alias("battery_soc"),
        F.when(number % 401 == 9, F.lit(0)).otherwise(F.col("ms")).cast("long").alias(
            "device_timestamp"
        ),
        F.lit(None).cast("string").alias("decode_error"),
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as wire bytes."""
    fields = ["vin", "lng", "lat", "status_code", "battery_soc", "device_timestamp"]
    return reports(spark, sf_dir).select(
        "key",
        encode_report(*fields).alias("value"),
        "headers",
        "partition",
        "offset",
        "timestamp",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the devices sent: bytes, or every third time a JSON envelope, some of them damaged."""
    event = F.floor(F.col("offset") / 2)
    text = F.base64("value")
    damaged = F.when(event % 2 == 0, F.concat(F.lit("*"), text)).otherwise(text)
    envelope = F.concat(F.lit('{"payload": "'), F.when(event % 11 == 0, damaged).otherwise(text), F.lit('"}'))
    received = F.unix_millis("timestamp") - 5
    return raw_log(spark, sf_dir).select(
        F.when(event % 3 == 0, F.encode(envelope, "UTF-8")).otherwise(F.col("value")).alias("payload"),
        received.alias("received_ms"),
        "partition",
        "offset",
        "timestamp",
    )


def fleets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("fleet-"), F.lower("n_name")).alias("fleet_id"),
        F.col("n_name").alias("name"),
        F.timestamp_millis(F.lit(0)).alias("created_at"),
    )


def _fleet_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat(F.lit("fleet-"), F.lower("n_name")).alias("fleet_id")
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _fleet_of_nation(spark, sf_dir)
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey",
        "c_nationkey",
        vin_of(F.col("c_custkey")).alias("vin"),
        F.when(F.col("c_custkey") % 10 != 9, F.col("fleet_id")).alias("fleet_id"),
        F.col("c_mktsegment").alias("model"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(
        "vin", "fleet_id", "model", F.timestamp_millis(F.lit(0)).alias("updated_at")
    )


def _user_of(key: Column) -> Column:
    return F.concat(F.lit("u-"), key.cast("string"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    role = (
        F.when(key % 10 == 0, "admin").when((key % 10).between(1, 4), "fleet_manager")
        .otherwise("viewer")
    )
    return table(spark, sf_dir, "supplier").select(
        _user_of(key).alias("user_id"),
        _user_of(key).alias("username"),
        F.col("s_name").alias("display_name"),
        role.alias("role"),
        F.timestamp_millis(F.lit(0)).alias("created_at"),
    )


def user_fleet_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = _fleet_of_nation(spark, sf_dir)
    key = F.col("s_suppkey")
    own = (
        supplier.where((key % 10).between(1, 6))
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .select(_user_of(key).alias("user_id"), "fleet_id")
    )
    customer = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    of_vehicle = (
        supplier.where(key % 10 == 5)
        .join(customer, supplier.s_suppkey == customer.c_custkey)
        .select(_user_of(key).alias("user_id"), "fleet_id")
    )
    return own.unionByName(of_vehicle).distinct()


def user_vehicle_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .where((key % 10).between(5, 8))
        .select(_user_of(key).alias("user_id"), vin_of(key).alias("vin"))
    )


def connections(spark: SparkSession, sf_dir: str, admins: bool = True) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    if not admins:
        rows = rows.where(key % 10 != 0)
    pod = F.concat(F.lit("pod-"), (key % 4).cast("string"))
    return rows.select(pod.alias("pod"), _user_of(key).alias("user_id"))


def published_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older VIN to fleet map, with vehicles that are gone by now."""
    old = (
        _customers(spark, sf_dir)
        .where(F.col("c_custkey") % 7 != 0)
        .select("vin", F.coalesce("fleet_id", F.lit("fleet-old")).alias("fleet_id"))
    )
    gone = spark.range(5).select(
        lost_vin(F.col("id")).alias("vin"), F.lit("fleet-old").alias("fleet_id")
    )
    return old.unionByName(gone)


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access questions taken from the reports: one user number asks for that vehicle."""
    rows = table(spark, sf_dir, "events")
    n = F.col("event_id")
    nation = _fleet_of_nation(spark, sf_dir)
    return rows.join(nation, F.col("event_id") % 25 == F.col("n_nationkey")).select(
        n.alias("request_id"),
        _user_of(F.col("user_id")).alias("user_id"),
        F.when(n % 4 == 0, "").otherwise(F.col("fleet_id")).alias("fleet_id"),
        F.when(n % 3 == 0, "").when(n % 3 == 1, vin_of(F.col("user_id")))
        .otherwise(vin_of(F.col("user_id") + 1)).alias("vin"),
    )


def interest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pod, as_of, user_id): users taken to be connected in each hour they appear in."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    hour = F.floor(ms / F.lit(3_600_000)) * F.lit(3_600_000)
    return (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("pod-"), (F.col("user_id") % 4).cast("string")).alias("pod"),
            hour.alias("as_of"),
            _user_of(F.col("user_id")).alias("user_id"),
        )
        .distinct()
    )


def fleet_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    renamed = nation.where(F.col("n_nationkey") % 3 == 0).select(
        F.concat(F.lit("fleet-"), F.lower("n_name")).alias("fleet_id"),
        F.concat("n_name", F.lit(" depot")).alias("name"),
        F.col("n_nationkey").cast("long").alias("seq"),
    )
    new = table(spark, sf_dir, "region").select(
        F.concat(F.lit("fleet-"), F.lower("r_name")).alias("fleet_id"),
        F.col("r_name").alias("name"),
        (F.col("r_regionkey") + 100).cast("long").alias("seq"),
    )
    return renamed.unionByName(new)


def vehicle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves taken from the orders, several per vehicle; some are not acceptable."""
    n, owner = F.col("o_orderkey"), F.col("o_custkey")
    nation = _fleet_of_nation(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").join(nation, n % 25 == F.col("n_nationkey"))
    return orders.select(
        F.when(n % 100 == 4, "BADVIN")
        .when(n % 10 == 3, lost_vin(owner))
        .otherwise(vin_of(owner))
        .alias("vin"),
        F.when(n % 100 == 8, "").when(n % 100 == 12, "fleet-unknown")
        .otherwise(F.col("fleet_id")).alias("fleet_id"),
        F.when(n % 4 != 0, "").otherwise(F.col("o_orderpriority")).alias("model"),
        n.alias("seq"),
    )


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _user_of(key).alias("user_id"),
        F.concat(F.lit("name-"), key.cast("string")).alias("username"),
        F.col("c_name").alias("display_name"),
        F.when(key % 5 == 0, "fleet_manager").otherwise("viewer").alias("role"),
        key.alias("seq"),
    )


def grant_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests taken from the orders: fleets, vehicles, both, neither and unknown ones."""
    n = F.col("o_orderkey")
    nation = _fleet_of_nation(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").join(nation, n % 25 == F.col("n_nationkey"))
    return orders.select(
        n.alias("seq"),
        _user_of(F.col("o_custkey") % 120).alias("user_id"),
        F.when(n % 5 < 2, F.col("fleet_id")).when(n % 50 == 7, "fleet-unknown").otherwise("")
        .alias("fleet_id"),
        F.when(n % 5 > 2, vin_of(F.col("o_custkey"))).when(n % 50 == 1, lost_vin(n))
        .when(n % 50 == 12, lost_vin(F.lit(7))).otherwise("").alias("vin"),
    )


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id) of fleets, vehicles and users to delete; some do not exist."""
    key, owner = F.col("s_suppkey"), F.col("c_custkey")
    nation = _fleet_of_nation(spark, sf_dir).where("n_nationkey % 4 = 1")
    customer = table(spark, sf_dir, "customer").where(owner % 6 == 0)
    supplier = table(spark, sf_dir, "supplier").where(key % 9 == 7)
    parts = [
        nation.select(F.lit("fleet").alias("kind"), F.col("fleet_id").alias("id")),
        customer.select(F.lit("vehicle").alias("kind"), F.when(owner % 12 == 0, lost_vin(owner)).otherwise(vin_of(owner)).alias("id")),
        supplier.select(F.lit("user").alias("kind"), _user_of(key).alias("id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def broken_master_data(spark: SparkSession, sf_dir: str):
    """The five master tables with every constraint broken somewhere."""
    f, v, u = (make(spark, sf_dir) for make in (fleets, vehicles, users))
    fg, vg = (make(spark, sf_dir) for make in (user_fleet_grants, user_vehicle_grants))
    key, owner = F.col("s_suppkey"), F.col("c_custkey")
    supplier = table(spark, sf_dir, "supplier")
    customer = table(spark, sf_dir, "customer")
    none = F.timestamp_millis(F.lit(0))
    more_vehicles = customer.where(owner % 50 == 1).select(
        F.when(owner % 100 == 1, F.lit("SHORT")).otherwise(lost_vin(owner)).alias("vin"),
        F.lit("fleet-unknown").alias("fleet_id"),
        F.col("c_mktsegment").alias("model"),
        none.alias("updated_at"),
    )
    more_users = supplier.where(key % 5 == 1).select(
        F.concat(F.lit("x-"), key.cast("string")).alias("user_id"),
        _user_of(key).alias("username"),
        F.col("s_name").alias("display_name"),
        F.when(key % 10 == 1, "owner").otherwise("viewer").alias("role"),
        none.alias("created_at"),
    )
    more_fg = supplier.where(key % 5 == 2).select(
        F.when(key % 10 == 2, F.concat(F.lit("y-"), key.cast("string"))).otherwise(_user_of(key)).alias("user_id"),
        F.when(key % 10 == 2, F.lit("fleet-nation_1")).otherwise(F.lit("fleet-unknown")).alias("fleet_id"),
    )
    more_vg = supplier.where(key % 10 == 6).select(
        _user_of(key).alias("user_id"), vin_of(key).alias("vin")
    ).unionByName(
        supplier.where(key % 10 == 7).select(
            F.concat(F.lit("z-"), key.cast("string")).alias("user_id"),
            lost_vin(key).alias("vin"),
        )
    )
    more_fleets = f.where(F.col("name") == "NATION_3")
    nothing = F.lit(None).cast("string")
    nameless = u.where(F.col("role") == "admin").withColumns({"user_id": F.concat(F.lit("n-"), "user_id"), "username": nothing, "display_name": nothing})
    without_vin = v.where(F.col("model") == "BUILDING").withColumn("vin", nothing)
    return (
        f.unionByName(more_fleets),
        v.unionByName(more_vehicles).unionByName(without_vin),
        u.unionByName(more_users).unionByName(nameless),
        fg.unionByName(more_fg),
        vg.unionByName(more_vg),
    )
