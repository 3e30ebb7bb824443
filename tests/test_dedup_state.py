"""The expiring state of ``dedup_ttl``, a bucket of keys at a time."""

import pandas as pd
from pyspark.sql import functions as F

from roadpulse.streaming import dedup, jobs
from roadpulse.sources import logs
from tests.conftest import rows
from tests.samples import NOW

REPORTS = "partition int, offset long, vin string, device_timestamp long"


class Entries:
    """Map state without an expiry, which counts what it is asked."""

    def __init__(self):
        self.kept, self.asked = {}, 0

    def getMapState(self, name, key, value, ttl_ms):
        return self

    def exists(self):
        return bool(self.kept)

    def containsKey(self, key):
        self.asked += 1
        return key in self.kept

    def updateValue(self, key, value):
        assert key not in self.kept
        self.kept[key] = value


def chunk(*made):
    return pd.DataFrame(made, columns=["partition", "offset", "vin", "device_timestamp"]).assign(bucket=7)


def test_a_group_holds_many_keys_and_asks_once_for_each(monkeypatch):
    monkeypatch.setattr(dedup, "GATHERED", 3)
    state, processor = Entries(), dedup.FirstWithinTtl(1000)
    processor.init(state)

    def emitted(*chunks):
        made = [f for f in processor.handleInputRows((7,), iter(chunks), None)]
        assert len(made) <= 1 and all("bucket" not in f.columns for f in made)
        return sorted(int(n) for f in made for n in f["offset"])

    first = [(0, 9 - i, f"v{i % 3}", i % 2) for i in range(10)]
    assert emitted(chunk(*first[:4]), chunk(*first[4:6]), chunk(*first[6:])) == [0, 1, 2, 3, 4, 5]
    assert state.asked == 0 and len(state.kept) == 6
    assert emitted(chunk((0, 20, "v0", 0), (0, 22, "w", 0)), chunk((0, 21, "w", 0), (0, 23, "v2", 1))) == [21]
    assert state.asked == 3
    assert emitted(chunk((0, 30, "w", 0))) == []
    # A missing vehicle or time is a key like any other.
    assert emitted(chunk((0, 40, None, 5), (0, 41, "v0", None), (0, 42, None, 5))) == [40, 41]
    assert emitted(chunk((0, 50, None, 5), (0, 51, "v0", None))) == []


def test_a_stream_keeps_each_key_once(spark, tmp_path):
    path, out, n = str(tmp_path / "log"), str(tmp_path / "out"), 6_000
    made = spark.range(n).select(
        F.lit(0).alias("partition"), F.col("id").alias("offset"),
        F.when(F.col("id") % 1000 > 0, F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).alias("vin"),
        (F.lit(NOW) + F.floor(F.col("id") / 2)).alias("device_timestamp"),
    )
    again = made.where("offset % 3 = 0").withColumn("offset", F.col("offset") + n)
    made.coalesce(1).write.mode("append").parquet(path)
    again.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", 1).parquet(path)
    kept = dedup.dedup_ttl(stream, 3_600_000)
    query = jobs.start(kept, lambda b, i: logs.write_batch(b, f"{out}/kept", i), f"{out}/checkpoint")
    query.awaitTermination()
    found = logs.read_batches(spark, f"{out}/kept", kept.schema)
    assert rows(found, "offset") == rows(made, "offset")
    assert found.columns == [*kept.columns, "batch_id"] and kept.columns == made.columns
