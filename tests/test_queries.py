"""All registered queries against an independent SQL engine, and the demonstration scenario."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from roadpulse.operators import access, history
from roadpulse.plans.oracle import all_sql
from roadpulse.plans.queries import all_queries
from roadpulse.plans.tables import lost_vin, vin_of
from tests.samples import NOW, event, events

QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def tables(sf):
    import glob
    import os

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(registered.queries()) and set(SQL) <= set(registered.oracle_sql())


def test_vins_of_large_numbers_are_distinct_and_well_formed(spark):
    ids = spark.range(0, 100_000_000, 9_973).union(spark.range(890_000, 930_000))
    made = ids.select(vin_of(F.col("id")).alias("vin"), "id").distinct()
    assert made.where("length(vin) <> 17").count() == 0
    assert made.select("vin").distinct().count() == made.count()
    assert made.join(made.select(lost_vin(F.col("id")).alias("vin")), "vin").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, tables, name):
    made = QUERIES[name](spark, sf)
    columns = sorted(made.columns)
    result = tables.execute(SQL[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    assert Counter(tuple(r) for r in made.select(*columns).collect()) == expected


def test_demonstration_scenario(spark):
    """Twelve vehicles in three fleets, four users: 12, 4, 4 and 2 vehicles are visible."""
    vins = [f"7H4T9K2L5RA{102300 + i:06d}" for i in range(1, 13)]
    assert [r[0] for r in spark.range(12).select(vin_of(F.col("id"))).collect()] == vins
    names = ["fleet-north", "fleet-south", "fleet-east"]
    made = [
        event(v, NOW + 2000 * k, names[i % 3]) for i, v in enumerate(vins) for k in range(3)
    ]
    grants = access.user_grants(
        spark.createDataFrame(
            [("u-admin", "admin"), ("u-north", "fleet_manager"), ("u-south", "viewer"), ("u-vehicle", "viewer")],
            "user_id string, role string",
        ),
        spark.createDataFrame(
            [("u-north", "fleet-north"), ("u-south", "fleet-south")], "user_id string, fleet_id string"
        ),
        spark.createDataFrame(
            [("u-vehicle", vins[2]), ("u-vehicle", vins[5])], "user_id string, vin string"
        ),
    )
    log = events(spark, *made)
    for user, n in {"u-admin": 12, "u-north": 4, "u-south": 4, "u-vehicle": 2, "u-none": 0}.items():
        own = grants.where(F.col("user_id") == user)
        assert history.latest_positions(log, own, NOW).count() == n
