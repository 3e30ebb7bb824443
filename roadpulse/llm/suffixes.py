"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A string of 100 bytes that repeats holds the same smallest q-gram at each place, its anchor. All windows of 100
bytes with one anchor are a segment, a tile of about 40 starts, so segments stand for suffixes and only they are
shuffled:

1. Each task tiles its documents. Equal segments inside a task leave one, the others are marked at once.
2. Segments go to the bucket of their anchor's q-gram. All but the first of equal segments are marked. A bucket
   that holds different segments stays open; all others are finished.
3. The bytes of open segments are refined inside their bucket: suffixes start in buckets of 8 bytes, and are sorted by
   the bucket numbers of the suffixes 8, then 16, 32 and 36 bytes on, each time by the numbers just refined, until
   a number stands for 100 equal bytes. Suffixes alone in their bucket are left out of further sorting.
   All windows of a number but the first are marked.

A bucket of very many different segments is cut into parts; windows that are first in their part meet once more by
their hash. Segments and windows are compared by 128 bits of hash across tasks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm import text as tx
from roadpulse.llm.shared import ROWS_AT_ONCE, brought_back, free_name, set_aside, stored

LENGTH = 100
GRAM = 20
#: Different segments of one bucket that are refined together.
PART = 4096
LOWEST = -(1 << 63)
_AT = np.uint64((1 << 28) - 1)
#: Bytes that a task works on at once; each takes some 200 bytes of arrays.
_CHUNK_BYTES = 1 << 18
_SEGMENT = "doc long, row long, start int, n int, g long, c long, dup boolean"
_SLICE = "g long, part int, hot boolean, doc long, row long, start int, n int, bytes binary"
_FOUND = "doc long, row long, start int, n int, g long, h long"


def document_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))


def row_key(text: str = "text") -> Column:
    """Tells rows that share a doc_id, or have none, apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


# --- segments --------------------------------------------------------------------------------


def _anchors(data: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window start, the place of the smallest q-gram in the window, the leftmost among equals."""
    width = length - gram + 1
    least = (hashes & ~_AT) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    return (least & _AT).astype(np.int64)


def segments(block: tx.Block, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Text number, first start, number of starts, q-gram hash and content hash of each segment."""
    data, offsets = block.data, block.offsets
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "g", "c")}
    if len(data) > int(_AT):
        raise ValueError("a text of over 268 MB")
    hashed, at = tx.SpanHash(data), np.arange(len(data) - gram + 1)
    grams = hashed(at, at + gram)
    anchor = _anchors(data, grams, length, gram)
    text = np.repeat(np.arange(len(block)), np.diff(offsets))[: len(anchor)]
    starts = np.flatnonzero(np.arange(length, len(data) + 1) <= offsets[text + 1])
    near = anchor[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (near[1:] != near[:-1]) | (text[starts[1:]] != text[starts[:-1]])
    begin = np.flatnonzero(first)
    n = np.diff(np.append(begin, len(starts)))
    place = starts[begin]
    return {
        "text": block.first + text[place],
        "start": place - offsets[text[place]],
        "n": n,
        "g": grams[near[begin]].view(np.int64),
        "c": hashed(place, place + n - 1 + length).view(np.int64),
    }


def _tile(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [segments(b, length, gram) for b in tx.blocks(batch.column("text"), _CHUNK_BYTES)]
            if not parts:
                continue
            s = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            doc, row = (batch.column(k).to_numpy()[s["text"]] if len(s["text"]) else s["text"] for k in ("doc", "row"))
            order = np.lexsort((s["start"], row, doc, s["c"], s["g"]))
            doc, row, start, n, g, c = doc[order], row[order], s["start"][order], s["n"][order], s["g"][order], s["c"][order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            dup = (doc != doc[head]) | (row != row[head]) | (start != start[head])
            keep = new | dup  # rows that repeat a document say nothing new
            # Marked segments need no bucket; a bucket of their own spreads them.
            alone = tx.mix(doc.view(np.uint64) ^ tx.mix(row.view(np.uint64) ^ tx.mix(start.astype(np.uint64)))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[keep], pa.int64()),
                    pa.array(row[keep], pa.int64()),
                    pa.array(start[keep], pa.int32()),
                    pa.array(n[keep], pa.int32()),
                    pa.array(np.where(dup, alone, g)[keep], pa.int64()),
                    pa.array(c[keep], pa.int64()),
                    pa.array(dup[keep]),
                ],
                ["doc", "row", "start", "n", "g", "c", "dup"],
            )

    return run


def _bucketed(docs: DataFrame, length: int, gram: int, part: int) -> DataFrame:
    """Segments that are marked, and with ``open`` the first ones of buckets that hold different ones."""
    rows = docs.mapInArrow(_tile(length, gram), _SEGMENT)
    bucket = Window.partitionBy("g")
    equal = Window.partitionBy("g", "c").orderBy("doc", "row", "start")
    here = F.struct("doc", "row", "start")
    rows = (
        rows.withColumn("first", F.first(here).over(equal) == here)
        # Copies of a row in other tasks say nothing new: its segment stays once.
        .withColumn("once", F.row_number().over(equal) == 1)
        .withColumn("rank", F.dense_rank().over(bucket.orderBy("c")))
        .withColumn("ranks", F.max("rank").over(bucket))
    )
    marked = F.col("dup") | ~F.col("first")
    return rows.where(marked | (F.col("once") & (F.col("ranks") > 1))).select(
        "doc",
        "row",
        "start",
        "n",
        "g",
        F.floor((F.col("rank") - 1) / part).cast("int").alias("part"),
        (F.col("ranks") > part).alias("hot"),
        (~marked).alias("open"),
    )


# --- refinement ------------------------------------------------------------------------------


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers by equal keys, and whether a bucket has only one member."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number, count[number] == 1


def refined(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket numbers of all positions: equal exactly if the next ``length`` bytes are.

    ``ends`` is the end of the slice around each position. Positions with fewer bytes left get numbers that
    mean nothing.
    """
    n, depth = len(data), min(8, length)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    first = np.zeros(n, np.uint64)
    for j in range(depth):
        first = first << np.uint64(8) | padded[j : j + n]
    number, alone = _numbered(first)
    left = ends - np.arange(n)
    while depth < length:
        step = min(depth, length - depth)
        open_ = np.flatnonzero(~alone & (left >= depth + step))
        with np.errstate(over="ignore"):
            keys = number[open_].astype(np.uint64) * np.uint64(2 * n + 1) + number[open_ + step].astype(np.uint64)
        fresh, single = _numbered(keys)
        # New numbers lie above all old ones, so that a finished suffix keeps its own.
        number = number.copy()
        number[open_] = fresh + n
        alone[open_] = single
        number = np.unique(number, return_inverse=True)[1]
        depth += step
    return number


def _refine_chunk(rows: dict[str, np.ndarray], slices: list[bytes], length: int) -> list[pa.RecordBatch]:
    """Marks of the windows that are not the first of their bytes, and for hot buckets the first ones."""
    sizes = np.array([len(x) for x in slices])
    data = np.frombuffer(b"".join(slices), np.uint8)
    base = np.cumsum(sizes) - sizes
    number = refined(data, np.repeat(base + sizes, sizes), length)
    owner = np.repeat(np.arange(len(slices)), rows["n"])
    within = np.arange(len(owner)) - np.repeat(np.cumsum(rows["n"]) - rows["n"], rows["n"])
    at = base[owner] + within
    doc, row, start, kind = rows["doc"][owner], rows["row"][owner], rows["start"][owner] + within, number[at]
    order = np.lexsort((start, row, doc, kind))
    kind, doc, row, start, owner, at = (x[order] for x in (kind, doc, row, start, owner, at))
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (doc != doc[head]) | (row != row[head]) | (start != start[head])
    # Marks in a row become one span.
    d, r, s = doc[again], row[again], start[again]
    order = np.lexsort((s, r, d))
    d, r, s = d[order], r[order], s[order]
    cut = np.ones(len(d), bool)
    cut[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] > s[:-1] + 1)
    begin = np.flatnonzero(cut)
    last = np.append(begin[1:], len(d)) - 1
    out = []
    if len(begin):
        out.append(_found(d[begin], r[begin], s[begin], s[last] - s[begin] + 1, None, None))
    meet = new & rows["hot"][owner]
    if meet.any():
        h = tx.SpanHash(data)(at[meet], at[meet] + length).view(np.int64)
        out.append(_found(doc[meet], row[meet], start[meet], np.ones(int(meet.sum())), rows["g"][owner[meet]], h))
    return out


def _found(doc, row, start, n, g, h) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc, pa.int64()),
            pa.array(row, pa.int64()),
            pa.array(start.astype(np.int32)),
            pa.array(n.astype(np.int32)),
            none if g is None else pa.array(g, pa.int64()),
            none if h is None else pa.array(h, pa.int64()),
        ],
        ["doc", "row", "start", "n", "g", "h"],
    )


def _refine(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(upto: int | None) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            now, rest = (table, None) if upto is None else (table.slice(0, upto), table.slice(upto))
            held, size = ([], 0) if rest is None else (rest.to_batches(), rest.nbytes)
            if now.num_rows:
                rows = {k: now[k].to_numpy() for k in ("g", "doc", "row", "start", "n", "hot")}
                yield from _refine_chunk(rows, now["bytes"].to_pylist(), length)

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                held.append(batch.slice(k, ROWS_AT_ONCE))
                size += held[-1].nbytes
                if size >= _CHUNK_BYTES:
                    # Whole buckets only: the last one may go on.
                    table = pa.Table.from_batches(held)
                    g, part = table["g"].to_numpy(), table["part"].to_numpy()
                    whole = np.flatnonzero((g != g[-1]) | (part != part[-1]))
                    if len(whole):
                        yield from flush(int(whole[-1]) + 1)
        if held:
            yield from flush(None)

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out, seen = [], set()
                piece = batch.slice(k, 256)
                for doc, row, text, found in zip(*(piece.column(c) for c in ("doc", "row", "text", "found")), strict=True):
                    if (key := (doc.as_py(), row.as_py())) in seen:
                        continue
                    seen.add(key)
                    data = text.as_py().encode()
                    for s in found.as_py():
                        own = data[s["start"] : s["start"] + s["n"] - 1 + length]
                        if len(own) == s["n"] - 1 + length:
                            out.append((s["g"], s["part"], s["hot"], *key, s["start"], s["n"], own))
                if out:
                    g, part, hot, docs, rows, start, n, own = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g, pa.int64()), pa.array(part, pa.int32()), pa.array(hot), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()),
                         pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(own, pa.binary())],
                        ["g", "part", "hot", "doc", "row", "start", "n", "bytes"],
                    )

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART) -> DataFrame:
    """(doc, row, start, n): runs of starts whose ``length`` bytes also start earlier. ``docs`` has doc, row and text."""
    bucketed = stored(_bucketed(docs, length, gram, part), "segments")
    own = F.struct("start", "n", "g", "part", "hot")
    wanted = bucketed.where("open").groupBy("doc", "row").agg(F.collect_list(own).alias("found"))
    slices = docs.join(wanted, ["doc", "row"]).mapInArrow(_cut(length), _SLICE)
    placed = slices.repartition("g", "part").sortWithinPartitions("g", "part")
    found = stored(placed.mapInArrow(_refine(length), _FOUND), "refined")
    meeting, here = found.where("h IS NOT NULL"), F.struct("doc", "row", "start")
    first = meeting.groupBy("g", "h").agg(F.min(here).alias("first"))
    late = meeting.join(first, ["g", "h"]).where(here != F.col("first"))
    marks = [x.select("doc", "row", "start", "n") for x in (bucketed.where("NOT open"), found.where("h IS NULL"), late)]
    return marks[0].unionByName(marks[1]).unionByName(marks[2])


# --- removal ---------------------------------------------------------------------------------


def _without(data: bytes, starts: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the marked windows, and the removed spans."""
    ends = np.minimum(starts + n - 1 + length, len(data))
    order = np.argsort(starts, kind="stable")
    spans: list[list[int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        elif s < e:
            spans.append([s, e])
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]]), [(s, e) for s, e in spans]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, as_text: bool = False
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``kept`` (bytes) and ``removed``, the removed spans as (start, end) in bytes.

    A byte goes if some ``length`` bytes around it also start earlier: in a smaller doc_id, or earlier in the same
    document. Null texts are empty; texts shorter than ``length`` stay whole. A null doc_id is the smallest.
    Rows that share a doc_id, or have none, are documents of their own if their texts differ, in the order of 64 bits of
    hash; rows equal in both are one document and do not remove each other. Columns named n_bytes, kept or removed are replaced. With ``as_text`` kept is
    text, without the characters that are cut in two.
    """
    key, row, marks_name = free_name(docs, "_doc"), free_name(docs, "_row"), free_name(docs, "_marks")
    plain = docs.select(document_key().alias("doc"), row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    marks = repeated_windows(plain, length, gram, part)
    marks = marks.groupBy(F.col("doc").alias(key), F.col("row").alias(row)).agg(F.collect_list(F.struct("start", "n")).alias(marks_name))
    rows = docs.withColumns({key: document_key(), row: row_key()}).join(marks, [key, row], "left").drop(key, row)
    added = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
    names = {f.name for f in added}
    own = [c for c in docs.columns if c.lower() not in names]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                n_bytes, kept, removed = [], [], []
                for text, found in zip(batch.column("text"), batch.column(marks_name), strict=True):
                    data, marked = (text.as_py() or "").encode(), found.as_py() or []
                    starts = np.array([m["start"] for m in marked], np.int64)
                    left, gone = _without(data, starts, np.array([m["n"] for m in marked], np.int64), length)
                    n_bytes.append(len(data))
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                    removed.append([{"start": s, "end": e} for s, e in gone])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in own), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()),
                     pa.array(removed, spans)],
                    [*own, "n_bytes", "kept", "removed"],
                )

    schema = T.StructType([f for f in docs.schema.fields if f.name in own] + added)
    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut from ``text``; n_chars follows. Characters cut in two are left out."""
    cut = remove_repeats(set_aside(docs), as_text=True)
    done = cut.select(*(F.col("kept").alias(c) if c == "text" else F.col(c) for c in set_aside(docs).columns))
    return done.select(*brought_back(done, docs, n_chars=F.length("text").cast("long")))
