"""Benchmark decontamination by winnowing.

A fingerprint is the smallest k-gram hash among w consecutive k-grams of words. With w + k - 1 = 13, two texts that
share 13 words share a fingerprint, at the same place inside the shared words. Documents are winnowed, their
fingerprints looked up among those of the benchmark, and a hit is extended to each window of 13 words around
it; a window counts if the benchmark has it. An item of fewer words is one window of its own length and
gets fingerprints to match.

The benchmark is a stated query set, so its index goes to the tasks in blocks of a bounded size and documents
are never shuffled. Hashes have 64 bits.
"""

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm import text as tx
from roadpulse.llm.shared import brought_back, free_name, set_aside, with_columns_of

MIN_WORDS = 13
GRAM = 7
#: Benchmark text per broadcast index; an index takes about ten times as much.
INDEX_BYTES = 32 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
ADDED = [
    ("n_words", T.LongType()),
    ("hit_words", T.ArrayType(T.IntegerType())),
    ("hit_items", T.ArrayType(T.StringType())),
]


@dataclass
class Windows:
    """The windows of one length: sorted fingerprints, sorted window hashes, and the items of each window."""

    length: int
    prints: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    names: list[str]
    windows: list[Windows]


def _words(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word."""
    data = tx.lower_ascii(block.data)
    starts, ends = tx.runs(_WORD[data], block.offsets)
    return tx.SpanHash(data)(starts, ends), tx.owners(starts, block.offsets)


def _fingerprints(words: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the k-grams that winnowing keeps for shared spans of ``length`` words."""
    size = min(GRAM, length)
    at = tx.windows(owner, size)
    hashes = tx.gram_hash(words, at, size)
    width = length - size + 1
    frames = tx.windows(owner[at], width)
    if width == 1:
        return at[frames], hashes[frames]
    least = np.argmin(np.stack([hashes[frames + j] for j in range(width)]), axis=0) if len(frames) else frames
    kept = np.unique(frames + least)
    return at[kept], hashes[kept]


def _member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def build_index(items: list[tuple[str, str | None]], min_words: int = MIN_WORDS) -> Index:
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    texts = pa.array([text for _, text in items], pa.large_string())
    by_length: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
    for block in tx.blocks(texts):
        words, owner = _words(block)
        ids = np.array([number[items[block.first + i][0]] for i in range(len(block))])
        counts = np.bincount(owner, minlength=len(block))
        for length in np.unique(np.minimum(counts[counts > 0], min_words)):
            own = counts >= length if length == min_words else counts == length
            w, o = words[own[owner]], owner[own[owner]]
            at = tx.windows(o, int(length))
            prints = _fingerprints(w, o, int(length))[1]
            by_length[int(length)].append((prints, tx.gram_hash(w, at, int(length)), ids[o[at]]))
    windows = []
    for length, parts in sorted(by_length.items()):
        prints, hashes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        pairs = np.unique(np.rec.fromarrays([hashes, ids], names="h,i"))
        unique, first = np.unique(pairs.h, return_index=True)
        windows.append(Windows(length, np.unique(prints), unique, np.append(first, len(pairs)), pairs.i.copy()))
    return Index(names, windows)


def _search(block: tx.Block, index: Index) -> tuple[np.ndarray, list, list]:
    """Words of each text, and for texts with hits the hit words and items."""
    words, owner = _words(block)
    n_words = np.bincount(owner, minlength=len(block))
    hit = np.zeros(len(words), bool)
    found: dict[int, set[int]] = defaultdict(set)
    for w in index.windows:
        at, prints = _fingerprints(words, owner, w.length)
        at = at[_member(prints, w.prints)[0]]
        if not len(at):
            continue
        around = np.unique((at[:, None] - np.arange(w.length - min(GRAM, w.length) + 1)[None, :]).ravel())
        around = around[(around >= 0) & (around + w.length <= len(words))]
        around = around[owner[around] == owner[around + w.length - 1]]
        same, where = _member(tx.gram_hash(words, around, w.length), w.hashes)
        around, where = around[same], where[same]
        hit |= tx.covered(around, w.length, len(words))
        for text, window in set(zip(owner[around].tolist(), where.tolist(), strict=True)):
            found[text].update(w.items[w.first[window] : w.first[window + 1]].tolist())
    starts = np.concatenate([[0], np.cumsum(n_words)])
    hit_words: list = [[]] * len(block)
    hit_items: list = [[]] * len(block)
    for text, ids in found.items():
        hit_words[text] = np.flatnonzero(hit[starts[text] : starts[text + 1]]).astype(np.int32)
        hit_items[text] = [index.names[i] for i in sorted(ids)]
    return n_words, hit_words, hit_items


def _with_hits(docs: DataFrame, text: str, items: DataFrame, min_words: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(
        build_index([(r.name or "", r.text) for r in items.toLocalIterator()], min_words)
    )

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        parts = [_search(b, index.value) for b in tx.blocks(batch.column(text))]
        n_words = np.concatenate([p[0] for p in parts]).astype(np.int64)
        return {
            "n_words": pa.array(n_words),
            "hit_words": pa.array([x for p in parts for x in p[1]], pa.list_(pa.int32())),
            "hit_items": pa.array([x for p in parts for x in p[2]], pa.list_(pa.string())),
        }

    return with_columns_of(docs, make, ADDED)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    text: str = "text",
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, the places of ``hit_words`` in order, and ``hit_items``, the sorted item ids.

    Columns of these names are replaced. Null texts and empty ones have no words and no hits; items without
    words hit nothing; items with a null id count as one item named by the empty string. Repeated
    documents are judged one by one. A benchmark larger than one index is searched in several passes, each
    of which keeps only rows with hits.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // index_bytes) or 1
    if passes == 1:
        return _with_hits(docs, text, items, min_words)
    part = F.pmod(F.xxhash64("name", "text"), F.lit(passes))
    # A text is the key of its hits, by a digest: rows of one text have the same hits.
    key, own = free_name(docs, "_digest"), free_name(docs, "_text")
    texts = docs.select(F.sha2(F.col(text), 256).alias(key), F.col(text).alias(own))
    found = None
    for k in range(passes):
        rows = _with_hits(texts, own, items.where(part == k), min_words).drop(own).where(F.size("hit_items") > 0)
        found = rows if found is None else found.unionByName(rows)
    hits = found.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_items")))).alias("hit_items"),
    )
    counted = _with_hits(docs, text, items.limit(0), min_words).drop("hit_words", "hit_items")
    joined = counted.withColumn(key, F.sha2(F.col(text), 256)).join(hits, key, "left").drop(key)
    return joined.withColumns(
        {c: F.coalesce(c, F.array().cast(dict(hits.dtypes)[c])) for c in ("hit_words", "hit_items")}
    )


def contaminated() -> Column:
    """At least a twentieth of the words lie in windows of the benchmark."""
    n_hit = F.size("hit_words")
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    clean = benchmark_hits(set_aside(docs), benchmark).where(~contaminated())
    return clean.select(*brought_back(clean, docs))
