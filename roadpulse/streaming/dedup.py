"""De-duplication with an expiry counted in processing time from the first publish."""

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadpulse.operators.pipeline import EVENT_KEY, LOG_ORDER
from roadpulse.session import ROCKSDB

DEDUP_TTL_MS = 60 * 60 * 1000

# Spark also loads the processor in a driver-side worker that does not get the shipped package, so
# this module's classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: The state is dealt out by a hash of the key into so many buckets, each one group of a micro-batch.
BUCKETS = 1 << 10
BUCKET = "bucket"
#: Rows of a bucket that are gathered before they are thinned.
GATHERED = 20_000


def _firsts(rows: pd.DataFrame) -> pd.DataFrame:
    """The first row of each key in log order."""
    return rows.sort_values(LOG_ORDER).drop_duplicates(EVENT_KEY)


def _keys(rows: pd.DataFrame) -> list[tuple]:
    vins, times = (rows[c].astype(object).where(rows[c].notna(), None) for c in EVENT_KEY)
    return [(vin, None if t is None else int(t)) for vin, t in zip(vins, times)]


class FirstWithinTtl(StatefulProcessor):
    """Emits the first record of each key in log order and stays silent about the key until it expires.

    A group is a bucket of keys, so rows are thinned in blocks and the state is asked once a key and told once a new one, in
    entries that expire each on its own. A duplicate never touches the state, so it does not extend the expiry.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("vin", T.StringType()), T.StructField("device_timestamp", T.LongType())])
        flag = T.StructType([T.StructField("published", T.BooleanType())])
        self.published = handle.getMapState("published", key, flag, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A bucket's rows come in several chunks, in no set order: the smallest of a key over all is its first.
        parts, n, most = [], 0, GATHERED
        for chunk in rows:
            parts.append(chunk.drop(columns=BUCKET))
            n += len(chunk)
            if n > most:
                parts = [_firsts(pd.concat(parts))]
                n = len(parts[0])
                most = max(most, 2 * n)
        found = _firsts(pd.concat(parts))
        keys = _keys(found)
        if self.published.exists():
            fresh = [not self.published.containsKey(k) for k in keys]
            found, keys = found[fresh], [k for k, new in zip(keys, fresh) if new]
        for k in keys:
            self.published.updateValue(k, (True,))
        if keys:
            yield found

    def close(self) -> None:
        pass


def _first_in_each_batch(batches):
    for batch in batches:
        yield _firsts(batch)


def dedup_ttl(reports: DataFrame, ttl_ms: int = DEDUP_TTL_MS) -> DataFrame:
    """Streaming ``reports`` without those whose vehicle and device time were emitted within the TTL.

    Copies are first thinned within each Arrow batch, before the shuffle to the state, so a report
    sent over and over does not pile up in one task. Keys are dealt out by their hash, so no vehicle is one task either, and
    a batch costs a call of Python per bucket, not per report.
    """
    spark = reports.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    thinned = reports.mapInPandas(_first_in_each_batch, reports.schema)
    bucket = F.pmod(F.xxhash64(*EVENT_KEY), F.lit(BUCKETS)).cast("int")
    return thinned.withColumn(BUCKET, bucket).groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=FirstWithinTtl(ttl_ms),
        outputStructType=reports.schema,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
