"""Phrase collocations: frequent phrases by mergeable Misra-Gries summaries, counted exactly in a second pass.

Summaries find which phrases can be frequent, one length after the other: a phrase is summed up only if both phrases one word
shorter survived. A task sums up its texts and sends one row per hash partition; all rows of a partition are merged into a
summary with more counters than the partition's mass divided by the threshold. Merging takes the same
amount off all counters when there are too many; what was taken off is known, stays under the threshold, and is added
back when survivors are chosen, so every phrase that reaches the threshold survives. The second pass counts
survivors exactly, by their words, and everything after it is Spark's.

A hot language or phrase is summed up by every task before anything is shuffled.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm import text as tx
from roadpulse.llm.shared import ROWS_AT_ONCE, stored

THRESHOLD = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
#: Counters that a task gathers before it sends them on, and about as many as one hash partition's summary has.
GATHERED, SUMMARY = 1 << 20, 1 << 20
#: A summary has so many times the counters that the guarantee asks for: the more, the fewer others survive.
SLACK = 10
#: Phrases that a task counts exactly before it sends them on.
PHRASES = 1 << 18
FEWEST_PARTS, MOST_PARTS = 64, 1 << 16
#: Bits of the filter of survivors. It only keeps rows out: with fewer bits more phrases are counted in vain.
FILTER_BITS = 1 << 26
_BORDER = np.zeros(256, bool)
_BORDER[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_BORDER
_WORD[[0x20, 0x09]] = False


class Summary:
    """A Misra-Gries summary over numbered items: counters, and what was taken off every item at most.

    Its capacity is ``slack`` times the mass so far divided by the threshold. No more than threshold - 1 is ever taken
    off, whatever the order of what comes, so an item that reaches the threshold always survives.
    """

    def __init__(self, threshold: int, slack: int | None = None):
        self.threshold, self.off, self.mass = threshold, 0, 0
        self._slack = SLACK if slack is None else slack
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    @property
    def capacity(self) -> int:
        return self._slack * self.mass // self.threshold + 1

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """The counts of other rows."""
        self._held.append((keys, counts))
        self._n += len(keys)
        self.mass += int(counts.sum())
        if self._n > 2 * max(self.capacity, 1 << 12):
            self._merge()

    def _merge(self) -> None:
        if not self._held:
            self._held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        keys, counts = summed(*(np.concatenate(x) for x in zip(*self._held, strict=True)))
        if len(keys) > self.capacity:
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            least = min(least, self.threshold - 1 - self.off)
            self.off += least
            counts = counts - least
            keys, counts = keys[counts > 0], counts[counts > 0]
        self._held, self._n = [(keys, counts)], len(keys)

    def survivors(self) -> np.ndarray:
        """All items that may reach the threshold: every one that does is among them."""
        self._merge()
        keys, counts = self._held[0]
        return keys[counts + self.off >= self.threshold]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Words:
    """The words of a block of texts: where they are, their pieces, and the key of each run of words."""

    def __init__(self, block: tx.Block, lang: np.ndarray):
        self.data = tx.lower_ascii(block.data)
        self.starts, self.ends = tx.runs(_WORD[self.data], block.offsets)
        self.text = tx.owners(self.starts, block.offsets)
        borders = np.cumsum(_BORDER[self.data], dtype=np.int64)
        self._piece = (borders[self.starts] if len(self.starts) else self.starts) + self.text
        with np.errstate(over="ignore"):
            spelt = tx.SpanHash(self.data)(self.starts, self.ends)
            self.word = tx.mix(spelt + lang[self.text])

    def at(self, size: int) -> np.ndarray:
        """The words at which ``size`` words of one piece begin."""
        return tx.windows(self._piece, size)

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.word[at] if size == 1 else tx.gram_hash(self.word, at, size)

    def phrase(self, at: int, size: int) -> str:
        spans = zip(self.starts[at : at + size], self.ends[at : at + size], strict=True)
        return b" ".join(self.data[a:b].tobytes() for a, b in spans).decode("utf-8")


def _marked(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys a filter lets pass."""
    at = keys & np.uint64(len(bits) * 8 - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _filter(survivors: DataFrame, filter_bits: int) -> np.ndarray:
    """The places of all keys as one bit each; Spark sets them, and the driver gets ``filter_bits`` bits at most."""
    place = F.pmod("key", F.lit(filter_bits)) + 1
    marks = F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks")
    rows = survivors.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(marks)
    bits = np.zeros(max(filter_bits // 8, 4096), np.uint8)
    for r in rows.collect():
        bits[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.marks, np.uint8)
    return bits[: filter_bits // 8]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray]]:
    """The words of every block, and the languages of its texts."""
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(k, ROWS_AT_ONCE)
            number = batch.column("number").to_numpy().view(np.uint64)
            lang = np.array(batch.column("lang").to_pylist(), object)
            for block in tx.blocks(batch.column("text")):
                own = slice(block.first, block.first + len(block))
                yield Words(block, number[own]), lang[own]


def _summaries(texts: DataFrame, size: int, bits: np.ndarray | None, parts: int) -> DataFrame:
    """(part, keys, counts): what each task has of each hash partition; parts are ranges of the keys."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    edges = np.array([(1 << 64) * i // parts for i in range(1, parts)], np.uint64)

    def run(batches):
        held, n = [], 0

        def sent():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int32)
            arrays = [
                pa.array(np.arange(parts, dtype=np.int32)),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(counts)),
            ]
            rows = pa.RecordBatch.from_arrays(arrays, ["part", "keys", "counts"])
            return rows.filter(pa.array(np.diff(cuts) > 0))

        for words, _ in _blocks_of(batches):
            at = words.at(size)
            if size > 1:
                near = words.at(size - 1)
                passed = np.zeros(len(words.word) + 1, bool)
                passed[near] = _marked(words.keys(near, size - 1), shared.value)
                at = at[passed[at] & passed[at + 1]]
            keys = words.keys(at, size)
            held.append(summed(keys, np.ones(len(keys), np.int64)))
            n += len(held[-1][0])
            if n >= GATHERED:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])
                if n >= GATHERED // 2:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    return texts.mapInArrow(run, "part int, keys array<long>, counts array<long>")


def frequent(texts: DataFrame, size: int, bits: np.ndarray | None, threshold: int, parts: int) -> DataFrame:
    """(key): every run of ``size`` words that is seen ``threshold`` times or more, and some others."""

    def run(batches):
        part, summary = None, Summary(threshold)
        for batch in batches:
            own, ends = batch.column("part").to_pylist(), batch.column("keys").offsets.to_numpy()
            keys = batch.column("keys").values.to_numpy().view(np.uint64)
            counts = batch.column("counts").values.to_numpy()
            for i, p in enumerate(own):
                if p != part:
                    yield pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], ["key"])
                    part, summary = p, Summary(threshold)
                summary.add(keys[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]])
        yield pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], ["key"])

    rows = _summaries(texts, size, bits, parts).repartition(parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "key long")


_COUNTS = ["lang", "phrase", "size", "f"]


def counted(texts: DataFrame, bits: np.ndarray, threshold: int, longest: int, parts: int) -> DataFrame:
    """(lang, phrase, size, f): exact counts of all phrases of up to ``longest`` words seen ``threshold`` times; size 0 counts words.

    A task tells phrases apart by 64 bits of hash and sends each once, in one row for each hash partition; where
    partitions are summed up the words themselves are the key.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    edges = np.array([(1 << 64) * i // parts for i in range(1, parts)], np.uint64)

    def run(batches):
        total: dict[str, int] = {}
        spelt: dict[int, tuple[str, str, int]] = {}
        held, n_held = [], 0

        def unknown():
            return [np.zeros(0, np.uint64)] * (longest + 1)

        known = unknown()

        def sent(keys, rows, counts):
            cuts = pa.array(np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int32))
            lang, phrase, size = zip(*rows, strict=True) if rows else ((), (), ())
            columns = (pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(size, pa.int32()), pa.array(counts, pa.int64()))
            lists = [pa.ListArray.from_arrays(cuts, x) for x in columns]
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), *lists], ["part", *_COUNTS])
            return rows.filter(pa.array(np.diff(cuts.to_numpy()) > 0))

        def sums():
            return summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for words, lang in _blocks_of(batches):
            for i, n in enumerate(np.bincount(words.text, minlength=len(lang)).tolist()):
                total[lang[i]] = total.get(lang[i], 0) + n
            passed = np.ones(len(words.word) + 1, bool)
            for size in range(1, longest + 1):
                at = words.at(size)
                at = at[passed[at] & passed[at + (size > 1)]]
                keys = words.keys(at, size)
                own = _marked(keys, shared.value)
                at, keys = at[own], keys[own]
                passed = np.zeros(len(words.word) + 1, bool)
                passed[at] = True
                keys, first, n = np.unique(keys, return_index=True, return_counts=True)
                held.append((keys, n))
                n_held += len(keys)
                place = np.searchsorted(known[size], keys)
                new = np.ones(len(keys), bool)
                inside = np.flatnonzero(place < len(known[size]))
                new[inside] = known[size][place[inside]] != keys[inside]
                for key, i in zip(keys[new].tolist(), at[first[new]].tolist(), strict=True):
                    spelt[key] = lang[words.text[i]], words.phrase(i, size), size
                known[size] = np.insert(known[size], place[new], keys[new])
            if n_held >= GATHERED:
                held = [sums()]
                n_held = 0
            if len(spelt) >= PHRASES:
                keys, counts = sums()
                yield sent(keys, [spelt[k] for k in keys.tolist()], counts)
                spelt, known, held, n_held = {}, unknown(), [], 0
        if held:
            keys, counts = sums()
            yield sent(keys, [spelt[k] for k in keys.tolist()], counts)
        place = sorted((zlib.crc32(x.encode()) << 32, x) for x in total)
        yield sent(np.array([k for k, _ in place], np.uint64), [(x, None, 0) for _, x in place], [total[x] for _, x in place])

    def summed_up(batches):
        part, held, n = None, [], 0

        def sums():
            return pa.concat_tables(held).group_by(_COUNTS[:3]).aggregate([("f", "sum")]).rename_columns(_COUNTS)

        def frequent_ones():
            rows = sums()
            return rows.filter((pc.field("size") == 0) | (pc.field("f") >= threshold)).to_batches()

        for batch in batches:
            own = batch.column("part").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
            for i, j in zip(new, [*new[1:], len(own)], strict=True):
                if own[i] != part and held:
                    yield from frequent_ones()
                    held, n = [], 0
                part = own[i]
                rows = batch.slice(i, j - i)
                held.append(pa.table([rows.column(c).flatten() for c in _COUNTS], _COUNTS))
                n += held[-1].num_rows
                if n > GATHERED:
                    held = [sums()]
                    n = held[0].num_rows // 2  # summed up again when it has doubled
        if held:
            yield from frequent_ones()

    rows = texts.mapInArrow(run, "part int, lang array<string>, phrase array<string>, size array<int>, f array<long>")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(summed_up, "lang string, phrase string, size int, f long")


def score() -> Column:
    """floor(1000 * a * n / (l * r)); the products have up to 38 digits, the score fits a long since a <= l and a <= r."""
    wide = {c: f"cast({c} AS decimal(18,0))" for c in "anlr"}
    above = f"cast({wide['a']} * {wide['n']} AS decimal(34,0)) * cast(1000 AS decimal(4,0))"
    return F.expr(f"cast(({above}) div ({wide['l']} * {wide['r']}) AS bigint)")


def collocations(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    longest: int = LONGEST,
    top: int = TOP,
    filter_bits: int = FILTER_BITS,
    summary: int = SUMMARY,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words. ``docs`` has text and lang.

    A null lang counts as ``und``, a null text as empty; rows that repeat count each time; other columns are not read.
    An empty table, and one without frequent phrases, gives no rows.
    """
    lang = F.coalesce("lang", F.lit(UNKNOWN))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("number"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = FEWEST_PARTS
    while parts < MOST_PARTS and parts * threshold * summary < SLACK * n_bytes // 2:
        parts *= 2
    survivors, bits = None, None
    for size in range(1, longest + 1):
        found = stored(frequent(texts, size, bits, threshold, parts), "survivors")
        bits = _filter(found, filter_bits)
        survivors = found if survivors is None else survivors.unionByName(found)
    seen = stored(counted(texts, _filter(survivors, filter_bits), threshold, longest, parts), "phrases")
    parts_of = seen.where("size > 0").select("lang", "phrase", "f")
    candidates = seen.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))

    # Every cut of every candidate; its parts are as frequent as the candidate, so all of them were counted.
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("*", k).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts_of.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = cuts.join(seen.where("size = 0").select("lang", F.col("f").alias("n")), "lang")
    cuts = cuts.withColumn("score", score())
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")

    # Phrases inside a longer candidate that is as frequent.
    spans = F.explode(
        F.expr("""flatten(transform(sequence(2, size - 1), w -> transform(sequence(0, size - w),
                  i -> array_join(slice(split(phrase, ' '), i + 1, w), ' '))))""")
    ).alias("phrase")
    inside = candidates.where("size > 2").select("lang", spans, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
