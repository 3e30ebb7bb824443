"""Joining a large table to a lookup table without trusting the lookup to be small."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
#: Join keys that rows without a key are spread over.
PLACES = 1 << 14


def fits_broadcast(lookup: DataFrame, limit_bytes: int | None = None) -> bool:
    """Measures the lookup with one aggregation and compares it with the limit."""
    limit = BROADCAST_LIMIT_BYTES if limit_bytes is None else limit_bytes
    if limit <= 0:
        return False
    row_bytes = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    measured = lookup.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("n")).first()["n"]
    return measured <= limit


def sized(lookup: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """The lookup with a broadcast hint if it was measured to fit, else as it is.

    Meant for the right side of a join with a table of events on the left. Without the hint both sides
    are shuffled, and hot keys are split at run time by the adaptive skew join: it covers inner, left,
    left_semi and left_anti joins, the only ones used with events.
    """
    return F.broadcast(lookup) if fits_broadcast(lookup, limit_bytes) else lookup


def grouped(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """One row per key, ready to be the right side of a join on ``keys``.

    An aggregation by the keys alone would already be dealt out as the join wants it and stand between the join and its
    exchange, and the adaptive skew join splits nothing but exchanges of the join's own. Grouping by a hash beside the keys
    makes the join add one over the grouped rows, so a hot key on the left is split whatever the lookup is made from.
    """
    by = rows.groupBy(F.xxhash64(*keys).alias("key_hash"), *keys)
    made = [v.alias(name) for name, v in values.items()] or [F.count(F.lit(1)).alias("n_rows")]
    return by.agg(*made).select(*keys, *values)


def spread(key: Column, *row: str) -> Column:
    """The key, or for a row without one a text by which it meets nothing but is not in one task with all others."""
    place = F.pmod(F.xxhash64(*row), F.lit(PLACES)).cast("string")
    return F.coalesce(key, F.concat(F.lit("\u0000"), place))


def dealt_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as there are shuffle partitions.

    For few bytes that a join makes very many rows of: the adaptive plan goes by the bytes and would leave them to a few tasks.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
