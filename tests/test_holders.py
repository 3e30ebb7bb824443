"""Events matched to the holders of their topics, by lists."""

import random

import pytest

from roadpulse.operators import access, audiences, routing
from tests.conftest import rows
from tests.samples import NOW, VIN_A, VIN_B, VIN_C, event, events


def test_lists_hold_everyone_once_and_stay_short(spark, monkeypatch):
    monkeypatch.setattr(audiences, "LISTED", 8)
    made = [(f"u{i}", "*") for i in range(200)] + [("ann", "fleet:f"), (None, "fleet:f"), ("bob", "vin:v")]
    lists = audiences.listed(spark.createDataFrame(made, "user_id string, topic string"), "user_id", "topic").collect()
    assert sorted(((u, r.topic) for r in lists for u in r.holders), key=str) == sorted(made, key=str)
    assert max(len(r.holders) for r in lists) <= 3 * 8


@pytest.mark.parametrize("limit", [None, 0])
def test_pairs_come_out_of_lists_and_only_vin_hits_are_looked_up_again(spark, monkeypatch, limit):
    monkeypatch.setattr(audiences, "LISTED", 2)
    rng = random.Random(3)
    log = [event(rng.choice([VIN_A, VIN_B, VIN_C]), NOW + i, rng.choice(["f0", "f1", "UNASSIGNED"]), i) for i in range(40)]
    topics = ["fleet:f0", "fleet:f1", f"vin:{VIN_A}", f"vin:{VIN_B}"]
    held = {(f"u{i}", t) for i in range(12) for t in rng.sample(topics, 2)} | {(f"a{i}", "*") for i in range(7)} | {("a0", "fleet:f0")}
    fed = routing.authorize_events(events(spark, *log), spark.createDataFrame(sorted(held), "user_id string, topic string"), limit)
    users = {u for u, _ in held}
    want = sorted((u, e[12]) for u in users for e in log if held & {(u, "*"), (u, f"fleet:{e[3]}"), (u, f"vin:{e[2]}")})
    assert rows(fed, "user_id", "offset") == want
    plan = fed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(holders") == 2 and plan.startswith("Union")


def test_few_events_of_many_viewers_are_dealt_out_to_all_tasks(spark):
    """A small input that the adaptive plan would leave to one task."""
    log = events(spark, *[event(VIN_A, NOW + i, offset=i) for i in range(200)]).coalesce(1)
    held = spark.createDataFrame([(f"u{i}", "*") for i in range(50)], "user_id string, topic string")
    fed = routing.authorize_events(log, held)
    tasks = {r[0] for r in fed.selectExpr("spark_partition_id() AS task").distinct().collect()}
    assert len(tasks) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_two_stages_spread_lists_within_the_pod(spark, monkeypatch):
    monkeypatch.setattr(audiences, "LISTED", 2)
    log = [event(v, NOW + i, f, i) for i, (v, f) in enumerate([(VIN_A, "f0"), (VIN_B, "f1"), (VIN_C, "f0")])]
    held = [(f"u{i}", t) for i in range(9) for t in ("fleet:f0", f"vin:{VIN_A}", f"fleet:own-{i}")] + [("cy", f"vin:{VIN_B}"), ("boss", "*")]
    at = [(f"p{i % 2}", f"u{i}") for i in range(9)] + [("p0", "u1"), ("p0", "cy"), ("p1", "boss"), ("p1", "boss")]
    grants = spark.createDataFrame(held, "user_id string, topic string")
    connections = spark.createDataFrame(at, "pod string, user_id string")
    fed = routing.two_stage_feed(events(spark, *log), grants, connections, access.pod_grants(connections, grants))
    sees = {"cy": (1,), "boss": (0, 1, 2)} | {f"u{i}": (0, 2) for i in range(9)}
    assert rows(fed, "pod", "user_id", "offset") == sorted((p, u, n) for p, u in set(at) for n in sees[u])
    assert "Generate explode(holders" in fed._jdf.queryExecution().optimizedPlan().toString()
