"""Sharding by histogram sort: splitters are found by counting, then the rows are exchanged once.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together and a group of copies that is larger
than a shard is still cut, at its doc_ids. Each round counts the exact bytes and rows below every
candidate boundary, in one aggregation over a narrow table, and places new candidates inside the cells that
hold a wanted boundary. Only those counts, a few hundred rows, reach the driver.
"""

import json
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.shared import free_name, stored, text_or_empty

LOWEST = -(1 << 63)
SHARDS = 24
#: Candidate boundaries counted in one round.
PROBES = 512
#: Bytes that a boundary may lie off its place, as a part of a block.
TOLERANCE = 0.002

Key = tuple[int, int]


@dataclass(frozen=True)
class Splitters:
    """Boundaries in order; a row belongs to the block of as many boundaries as do not exceed its key."""

    keys: list[Key]
    rows_below: list[int]
    rounds: int


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text and 8 for the row; a null text has none."""
    return F.octet_length(text_or_empty(text)).cast("long") + 8


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    return F.struct(
        F.xxhash64(text_or_empty(text)).alias("h"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("d")
    )


def position(key: Column, keys: list[Key]) -> Column:
    """How many of the sorted ``keys`` do not exceed ``key``: first among groups of them, then inside one group."""
    if not keys:
        return F.lit(0)
    width = isqrt(len(keys)) + 1
    groups = [keys[i : i + width] for i in range(0, len(keys), width)]

    def literal(value, kind):
        return F.from_json(F.lit(json.dumps(value)), kind)

    def plain(group):
        return [{"h": h, "d": d} for h, d in group]

    heads = literal(plain([g[0] for g in groups]), "array<struct<h:bigint,d:bigint>>")
    inside = literal([plain(g) for g in groups], "array<array<struct<h:bigint,d:bigint>>>")
    group = F.size(F.filter(heads, lambda x: x <= key))
    rest = F.size(F.filter(F.get(inside, group - 1), lambda x: x <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * width + rest)


def _between(low: Key, high: Key, n: int) -> set[Key]:
    """The two ends, and about ``n`` candidates between them, evenly by hash, or by id within one hash."""
    ends = {low, (high[0], high[1] + 1)}
    if low[0] == high[0]:
        return ends | {(low[0], low[1] + max(1, (high[1] - low[1]) * i // n)) for i in range(1, n + 1)}
    gap = high[0] - low[0]
    return ends | {(low[0] + max(1, gap * i // n), LOWEST) for i in range(1, n + 1)}


def find_splitters(rows: DataFrame, blocks: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> Splitters:
    """Boundaries that cut ``rows`` (columns key and size) into ``blocks`` of nearly equal bytes.

    Rows of one key are never separated. An empty table needs no boundary.
    """
    wanted: list[int] = []
    found: dict[int, tuple[Key, int]] = {}
    total = rounds = 0
    open_cells: dict[int, tuple[Key, Key]] = {}
    candidates = {((1 << 64) * i // probes + LOWEST, LOWEST) for i in range(1, probes)}
    while candidates:
        rounds += 1
        keys = sorted(candidates)
        cells = {
            r.cell: r
            for r in rows.groupBy(position(F.col("key"), keys).alias("cell"))
            .agg(
                F.sum("size").alias("bytes"),
                F.count(F.lit(1)).alias("n"),
                F.min("key").alias("low"),
                F.max("key").alias("high"),
            )
            .collect()
        }
        bytes_to = list(accumulate(cells[i].bytes if i in cells else 0 for i in range(len(keys) + 1)))
        rows_to = list(accumulate(cells[i].n if i in cells else 0 for i in range(len(keys) + 1)))
        if not total:
            total = bytes_to[-1]
            wanted = [total * j // blocks for j in range(1, blocks)] if total else []
            open_cells = dict.fromkeys(range(len(wanted)), ((0, 0), (0, 0)))
        slack = tolerance * total / blocks
        for j in list(open_cells):
            # The first cell whose end passes the wanted bytes.
            i = bisect_right(bytes_to, wanted[j])
            before, after = (bytes_to[i - 1] if i else 0), bytes_to[i]
            cell = cells[i]
            low, high = (cell.low.h, cell.low.d), (cell.high.h, cell.high.d)
            near_start = wanted[j] - before <= after - wanted[j]
            if min(wanted[j] - before, after - wanted[j]) <= slack or low == high:
                # A boundary may be the cell's first key, or the key after its last.
                at, n = (low, rows_to[i] - cell.n) if near_start else ((high[0], high[1] + 1), rows_to[i])
                found[j] = at, n
                del open_cells[j]
            else:
                open_cells[j] = low, high
        cells_left = set(open_cells.values())
        candidates = set().union(*(_between(a, b, max(2, probes // len(cells_left))) for a, b in cells_left))
    order = [found[j] for j in range(len(wanted))]
    return Splitters([k for k, _ in order], [n for _, n in order], rounds)


def histogram_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    blocks_per_shard: int = 4,
    tolerance: float = TOLERANCE,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``: shards of nearly equal bytes, slots from 0 without gaps.

    A shard is a run of ``blocks_per_shard`` blocks of the sort order, each numbered by a task of its own; raise
    it with the table, so that the narrow rows of a block fit a task. Null texts and empty ones are equal
    texts, null ids come first, and rows equal in text and id stay in one shard in any order. Columns named
    size, shard or slot are replaced. An empty table gives an empty result.
    """
    # The sort key of a shard needs this table's text and id only once more, in the exchange.
    narrow = stored(docs.select(row_key(text, doc_id).alias("key"), row_size(text).alias("size")), "shard-keys")
    cut = find_splitters(narrow, shards * blocks_per_shard, tolerance)
    starts = [0, *cut.rows_below]
    base = [n - starts[i - i % blocks_per_shard] for i, n in enumerate(starts)]
    key, block = free_name(docs, "_key"), free_name(docs, "_block")
    placed = docs.withColumn("size", row_size(text)).withColumn(key, row_key(text, doc_id))
    placed = placed.withColumn(block, position(F.col(key), cut.keys))
    within = F.row_number().over(Window.partitionBy(block).orderBy(key)) - 1
    first = F.get(F.from_json(F.lit(json.dumps(base)), "array<bigint>"), F.col(block))
    return (
        placed.withColumn("shard", F.floor(F.col(block) / blocks_per_shard).cast("int"))
        .withColumn("slot", (first + within).cast("long"))
        .drop(key, block)
    )
