"""What the live feed stores, and what its readers make of it."""

from roadpulse.sources.logs import read_batches, read_raw_stream
from roadpulse.streaming import jobs
from tests.conftest import rows
from tests.samples import NOW, VIN_A, VIN_B, VIN_C, event
from tests.test_streams import canonical_log, finish, one_by_one


def table(spark, made):
    return spark.createDataFrame(made, "user_id string, topic string")


def test_an_event_is_stored_three_times_at_most_whatever_its_viewers_hold_besides(spark, tmp_path):
    """Every user has other grants, so that no two of them are alike."""
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    held = [(f"u{i}", t) for i in range(30) for t in ("fleet:fleet-1", f"vin:{i:017d}", f"fleet:own-{i}")]
    held += [("u3", f"vin:{VIN_A}"), ("cy", f"vin:{VIN_A}"), ("boss", "*")]
    canonical_log(spark, path, [event(VIN_A, NOW, offset=0), event(VIN_B, NOW, offset=1), event(VIN_C, NOW, "other", offset=2)])
    finish(jobs.live_feed_stream(read_raw_stream(spark, one_by_one(path)), lambda: table(spark, held), out, clock=lambda: NOW))
    assert read_batches(spark, f"{out}/feed", jobs.FEED).count() == 3 + 2 + 1
    want = [(f"u{i}", n) for i in range(30) for n in (0, 1)] + [("cy", 0)] + [("boss", n) for n in range(3)]
    assert rows(jobs.read_feed(spark, out), "user_id", "offset") == sorted(want)


def test_one_row_of_an_interval_also_for_a_user_whose_grants_changed(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")

    def run(held, *batch):
        canonical_log(spark, path, batch)
        log = read_raw_stream(spark, one_by_one(path))
        finish(jobs.live_feed_stream(log, lambda: table(spark, held), out, clock=lambda: NOW, conflate_ms=10_000))
        return rows(jobs.read_conflated_feed(spark, out), "user_id", "vin", "offset", "fleet_id", "dropped")

    begin = NOW - NOW % 10_000
    first = [("ann", "fleet:f1"), ("bob", "fleet:f1"), ("bob", "fleet:f2"), ("cy", f"vin:{VIN_A}"), ("boss", "*")]
    assert run(first, event(VIN_A, begin, "f1", 0), event(VIN_B, begin, "f1", 1)) == sorted(
        [(u, VIN_A, 0, "f1", 0) for u in ("ann", "bob", "boss", "cy")] + [(u, VIN_B, 1, "f1", 0) for u in ("ann", "bob", "boss")]
    )
    then = [("ann", "*"), ("bob", "fleet:f1"), ("bob", "fleet:f2"), ("cy", f"vin:{VIN_A}"), ("boss", "*")]
    assert run(then, event(VIN_A, begin + 2, "f1", 2), event(VIN_A, begin + 1, "f2", 3)) == sorted(
        [(u, VIN_A, 2, "f1", 2) for u in ("ann", "bob", "boss", "cy")] + [(u, VIN_B, 1, "f1", 0) for u in ("ann", "bob", "boss")]
    )
