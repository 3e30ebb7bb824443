"""Near-duplicates by SimHash, with pigeonring filtering of candidate pairs.

A fingerprint has 64 bits in a ring of five segments. If two fingerprints differ in at most four bits, there is a
segment from which every chain of consecutive segments stays within its share of the differences: its first k
segments differ in at most floor(4k/5) bits. So the first segment of the chain is equal, and one half of
the second. These two parts are the join key; the chain's further budgets prune the candidates, and
what is left gets the full comparison. Only different fingerprints are compared.

A key with many fingerprints would compare them pair by pair. There each fingerprint names instead every value
within two bits of it: two fingerprints within four bits share such a value, and all that share one are within four
bits, so linking each to the smallest is exact and grows with the number of fingerprints.
"""

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm import text as tx
from roadpulse.llm.components import components
from roadpulse.llm.shared import brought_back, free_name, set_aside, stored, with_columns_of

SHINGLE = 4
DISTANCE = 4
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
_STARTS = tuple(accumulate((0, *WIDTHS[:-1])))
#: All values within two bits; a key with more fingerprints than these is linked through them.
_FLIPS = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
DENSE = len(_FLIPS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: -SHINGLE]]
    return [digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=True)]


def _fingerprints(block: tx.Block) -> np.ndarray:
    hashes, counts = [], np.zeros(len(block), np.int64)
    for i in range(len(block)):
        own = _hashes(block.text(i))
        counts[i] = len(own)
        hashes += own
    out = np.zeros(len(block), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        firsts = (np.cumsum(counts) - counts)[full]
        votes = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        major = (2 * votes > counts[full, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fp``, the fingerprint's 64 bits as a long; 0 for a text without words, as for a null one."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [_fingerprints(b) for b in tx.blocks(batch.column(text))]
        return {"fp": pa.array(np.concatenate(found).view(np.int64))}

    return with_columns_of(docs, make, [("fp", T.LongType())])


def _part(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(fps: DataFrame) -> DataFrame:
    """(fp, first, key) for each start of a chain and each half of its second segment."""
    keys = []
    for i, (start, width) in enumerate(zip(_STARTS, WIDTHS, strict=True)):
        after, size = _STARTS[(i + 1) % 5], WIDTHS[(i + 1) % 5]
        own = _part(F.col("fp"), start, width)
        for half, (at, bits) in enumerate(((after, size // 2), (after + size // 2, size - size // 2))):
            key = F.shiftleft(F.lit(2 * i + half).cast("long"), 32) + F.shiftleft(own, 8) + _part(F.col("fp"), at, bits)
            keys.append(F.struct(F.lit(i).alias("first"), key.alias("key")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.first", "k.key")


def _chain_holds(a: Column, b: Column, first: Column) -> Column:
    """Every chain from ``first`` stays within its share, up to the whole ring."""
    differing = a.bitwiseXOR(b)
    apart = F.array(*(F.bit_count(_part(differing, s, w)) for s, w in zip(_STARTS, WIDTHS, strict=True)))
    holds, total = F.lit(True), F.lit(0)
    for k in range(len(WIDTHS)):
        total = total + F.get(apart, (first + k) % len(WIDTHS))
        holds = holds & (total <= (k + 1) * DISTANCE // len(WIDTHS))
    return holds


def _dense_links(keys: DataFrame) -> DataFrame:
    near = F.explode(F.array(*(F.lit(_signed(m)) for m in _FLIPS))).alias("m")
    named = keys.select("fp", "key", near).select("fp", "key", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    least = named.groupBy("key", "v").agg(F.min("fp").alias("a"))
    return named.join(least, ["key", "v"]).where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all pairs within four bits.

    ``fps`` has each fingerprint once. Keys with at most ``dense`` fingerprints give every pair.
    """
    keys = _keys(fps)
    crowded = stored(keys.groupBy("key").count().where(F.col("count") > dense).select("key"), "crowded-keys")
    found = None
    if not crowded.isEmpty():
        found = _dense_links(keys.join(crowded, "key", "left_semi"))
        keys = keys.join(crowded, "key", "left_anti")
    x, y = keys.alias("x"), keys.alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    near = F.bit_count(a.bitwiseXOR(b)) <= DISTANCE
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (a < b) & _chain_holds(a, b, F.col("x.first")) & near)
    pairs = pairs.select(a.alias("a"), b.alias("b"))
    return pairs if found is None else pairs.unionByName(found)


def _named(rows: DataFrame, dense: int) -> DataFrame:
    """(fp, root, component_id) of each fingerprint in the stored ``rows``; root stands for the component."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(links(fps.select("fp"), dense)).withColumnRenamed("node", "fp")
    inner = linked.unionByName(linked.select(F.col("root").alias("fp"), "root").distinct())
    reached = inner.join(fps, "fp").groupBy("root").agg(F.min("least").alias("reached"))
    named = stored(inner.join(reached, "root").select("fp", "root", "reached"), "component-names")
    names = fps.join(named, "fp", "left")
    return stored(
        names.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("reached", "least").alias("component_id")),
        "fingerprint-names",
    )


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id that links reach.

    Null and empty texts share the fingerprint 0 and are linked like others. A null doc_id names no component;
    where a component has no other, component_id is null. Repeated rows stay.
    """
    rows = stored(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "fingerprints")
    return rows.join(_named(rows, dense), "fp").select("doc_id", "fp", "component_id")


def fingerprint_text() -> Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))


def _text_key(a: str, b: str) -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    return {a: F.xxhash64(text), b: F.xxhash64(F.lit(1), text)}


def one_of_each_group(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """One document of each component, with the columns of ``docs``: of its smallest doc_id, the first by hash of text.

    Rows that share a doc_id are told apart by 128 bits of hash of their texts, so unrelated texts stay. No component is
    named after rows without a doc_id: of these one of each component stays too.
    """
    own, (x, y) = set_aside(docs), (free_name(set_aside(docs), n) for n in ("_x", "_y"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(_text_key("x", "y"))
    rows = stored(with_fingerprint(keyed).drop("text"), "fingerprints")
    each = rows.join(_named(rows, dense), "fp").groupBy("root", F.col("doc_id").isNull().alias("no_id"))
    first = each.agg(F.min(F.struct("doc_id", "x", "y")).alias("k")).select("k.*")
    again = rows.groupBy("doc_id", "x", "y").count()
    # Without an id, rows are hashed by their texts alone.
    same = F.col("f.x").eqNullSafe(F.col("r.x")) & (F.col("f.y") == F.col("r.y")) & F.col("f.doc_id").eqNullSafe(F.col("r.doc_id"))
    kept = first.alias("f").join(again.alias("r"), same).select("f.*", (F.col("count") > 1).alias("again"))
    kept = stored(kept.select(F.col("doc_id").alias("_id"), F.col("x").alias(x), F.col("y").alias(y), "again"), "kept-documents")
    # Keys alone are hashed and texts stream past them: nothing sorts a text.
    own = own.withColumns(_text_key(x, y))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    found = own.join(kept.hint("shuffle_hash"), [own[x] == kept[x], own[y] == kept[y], here]).drop(kept[x], kept[y], kept["_id"])
    # Where docs is a union, the join is planned per part, and a grouping by its keys would trust parts whose
    # partitions are merged differently at run time. Another key gives it an exchange of its own.
    names = set_aside(docs).columns
    copies = found.where("again").groupBy(F.bitwise_not(x), F.bitwise_not(y), F.bitwise_not(F.col("doc_id").cast("long")))
    first = copies.agg(F.first(F.struct(*names)).alias("r")).select("r.*")
    rows = found.where("NOT again").select(*names).unionByName(first)
    return rows.select(*brought_back(rows, docs))
