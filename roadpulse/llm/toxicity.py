"""Toxicity by discounted log-odds of words. ``kneser_ney`` has the class-conditional Kneser-Ney model of the same counts.

As in Kneser-Ney smoothing, an expression counts once for each context it is seen in, here once per document, so a
passage that many copies repeat weighs no more than its words. A word's count in a class is discounted towards
the count that both classes together let expect, by a few standard errors, a half and as much again as was expected; a word that is too rare to
tell backs off to its first letters, and those to the shared counts. A document's score compares the two
log-likelihoods per word.

Expressions are keyed by 64 bits of hash each, in a table that grows with the corpus. Documents meet it in a join,
which each task enters once per expression of a batch, and only with expressions that may have evidence: a bit
filter of one size tells those that surely have none. Labels of a fold that is not counted calibrate the score.
"""

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm import text as tx
from roadpulse.llm.shared import ROWS_AT_ONCE, brought_back, free_name, set_aside, stored
from roadpulse.operators.lookup import grouped

FOLDS = 5
HELD_OUT, CALIBRATION = 0, 1
#: Bits of the filter; with fewer, more expressions enter the join in vain.
FILTER_BITS = 1 << 26
PREFIX = 7
#: Evidence is counted in whole steps, so that sums do not depend on their order.
STEPS = 1 << 20
#: Different expressions that a task gathers before it sends their counts on.
GATHERED = 1 << 20
#: The discount in standard errors and as a share of the expected count. Without the share more data would give slight differences
#: of ordinary words evidence, which copies bring about by chance.
ERRORS, SHARE = 3.0, 1.0
#: Labelled rows of the calibration fold that fit the two weights and the threshold.
CALIBRATION_ROWS = 20_000
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    """(key, steps): each expression's log-likelihood ratio where the classes differ; its filter; the calibration.

    ``counted`` has the counts that the ratios come from, ``calibration`` the labelled rows that the weights come from.
    """

    told: DataFrame | None
    filter: np.ndarray
    filter_bits: int
    weights: np.ndarray
    counted: DataFrame | None = None
    calibration: DataFrame | None = None


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id is in the first fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(0))


def _features(block: tx.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word key and prefix key of each word."""
    starts, ends = tx.runs(_WORD[block.data], block.offsets)
    hashed = tx.SpanHash(block.data)
    word = hashed(starts, ends).view(np.int64)
    prefix = tx.mix(hashed(starts, np.minimum(starts + PREFIX, ends)) + np.uint64(1)).view(np.int64)
    return tx.owners(starts, block.offsets), word, prefix


def _lower_blocks(batch: pa.RecordBatch):
    yield from tx.blocks(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and the places in it where a new combination of keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def counts(labelled: DataFrame) -> DataFrame:
    """(key, n0, n1, c0, c1): how many ordinary and toxic documents have each expression. ``labelled`` has text and toxic.

    ``c0`` and ``c1`` are how often a word occurs in them, repeats included. A prefix has none.
    """

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            key, *ns = (np.concatenate(x) for x in zip(*held, strict=True))
            key, at = np.unique(key, return_inverse=True)
            return key, *(np.bincount(at, n, len(key)).astype(np.int64) for n in ns)

        def sent(found):
            return pa.RecordBatch.from_pydict(dict(zip(("key", "n0", "n1", "c0", "c1"), found, strict=True)))

        for batch in batches:
            toxic = batch.column("toxic").to_numpy() == 1
            for block in _lower_blocks(batch):
                text, word, prefix = _features(block)
                is_word = np.arange(2 * len(word)) < len(word)
                text, key = np.concatenate([text, text]), np.concatenate([word, prefix])
                order, first = _firsts(text, key)
                often = np.add.reduceat(is_word[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                own, key = toxic[block.first + text[order[first]]], key[order[first]]
                held.append((key, (~own).astype(np.int64), own.astype(np.int64), often * ~own, often * own))
                if sum(len(x[0]) for x in held) >= GATHERED:
                    held = [merged()]
                    if len(held[0][0]) >= GATHERED // 2:
                        yield sent(held[0])
                        held = []
        if held:
            yield sent(merged())

    each = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    found = each.mapInArrow(run, "key long, n0 long, n1 long, c0 long, c1 long").groupBy("key")
    return found.agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "c0", "c1")))


def _ratio(docs0: int, docs1: int) -> Column:
    """log of (toxic count / expected) over (ordinary count / expected), after the discount."""
    both, total = F.col("n0") + F.col("n1"), docs0 + docs1

    def part(n: str, docs: int) -> Column:
        expected = both * F.lit(docs / total)
        beyond = F.col(n) - expected
        discount = F.lit(ERRORS) * F.sqrt(expected) + F.lit(0.5) + F.lit(SHARE) * expected
        credited = F.signum(beyond) * F.greatest(F.abs(beyond) - discount, F.lit(0.0))
        return F.log(F.greatest(expected + credited, F.lit(1e-3)) / expected)

    return part("n1", docs1) - part("n0", docs0)


def _marked(keys: DataFrame, at: Column) -> DataFrame:
    """(part, marks): bitmaps of 32,768 places each in which the places ``at`` of the rows are set."""
    rows = keys.select((at + 1).alias("at"))
    marks = F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("marks")
    return rows.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(marks)


def _filter(told: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the places of the expressions with evidence; the driver gets ``bits`` bits at most."""
    marks = np.zeros((bits + 32767) // 32768 * 4096, np.uint8)
    for r in _marked(told, F.pmod("key", F.lit(bits))).collect():
        marks[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.marks, np.uint8)
    return marks


def _perhaps_labelled(texts: DataFrame, known: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """All rows of ``texts`` with a label, and as few others as bitmaps of one size tell, so that few texts are shuffled."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    marks, part, at = F.col("marks"), F.bitmap_bucket_number(place + 1), F.bitmap_bit_position(place + 1)
    byte = F.conv(F.hex(F.substring(marks, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = texts.join(F.broadcast(_marked(known, place)), part == F.col("part"))
    return found.where(F.call_function("bit_get", byte, (at % 8).cast("int")) == 1).select(*texts.columns)


_FOUND = "batch long, w long, p long, i array<short>, n array<int>, a long, b long"


def with_digest(docs: DataFrame, a: str, b: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit(1), text)})


def _sums_of_texts(rows: pa.Table) -> pa.Table:
    """(batch, i, steps) of one batch, from its expressions with their texts and counts."""
    rows = rows.combine_chunks()
    text, n = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in "in")
    steps = np.repeat(rows.column("best").to_numpy(), pc.list_value_length(rows.column("i")).to_numpy()) * n
    total = np.zeros(ROWS_AT_ONCE, np.int64)
    np.add.at(total, text, steps)
    own = np.unique(text)
    batch = np.full(len(own), rows.column("batch")[0].as_py())
    return pa.table({"batch": batch, "i": own.astype(np.int16), "steps": total[own]})


def _text_evidence(texts: DataFrame, model: Model) -> DataFrame:
    """(a, b, steps, n_words) of each different text, named by 128 bits of hash. ``texts`` has a, b and text."""
    shared, bits = texts.sparkSession.sparkContext.broadcast(model.filter), model.filter_bits

    def run(batches):
        marks = shared.value

        def perhaps(key):
            at = key % bits
            return marks[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                a, b = (batch.column(c).to_numpy() for c in "ab")
                order, first = _firsts(a, b)
                once = np.zeros(len(a), bool)  # a copy says nothing new
                once[order[first]] = True
                found, n_words = [], np.zeros(len(a), np.int64)
                for block in _lower_blocks(batch):
                    text, word, prefix = _features(block)
                    text = text + block.first
                    n_words += np.bincount(text, minlength=len(a))
                    own = np.flatnonzero(once[text] & (perhaps(word) | perhaps(prefix)))
                    found.append((word[own], prefix[own], text[own]))
                w, p, text = (np.concatenate(x) for x in zip(*found, strict=True))
                order, at = _firsts(w, p, text)
                n = np.diff(np.append(at, len(w)))
                w, p, text = (x[order[at]] for x in (w, p, text))
                _, start = _firsts(w, p)
                kept = np.flatnonzero(once)
                ends = np.concatenate([start, len(w) + np.arange(len(kept) + 1)]).astype(np.int32)
                none = np.zeros(len(kept), np.int64)
                rows, off = len(ends) - 1, np.arange(len(ends) - 1) < len(start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, int.from_bytes(os.urandom(8), "big", signed=True))),
                        pa.array(np.concatenate([w[start], none]), mask=~off),
                        pa.array(np.concatenate([p[start], none]), mask=~off),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([text, kept]).astype(np.int16))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([n, n_words[kept]]).astype(np.int32))),
                        pa.array(np.concatenate([np.zeros(len(start), np.int64), a[kept]]), mask=off),
                        pa.array(np.concatenate([np.zeros(len(start), np.int64), b[kept]]), mask=off),
                    ],
                    ["batch", "w", "p", "i", "n", "a", "b"],
                )

    # Written once: a batch that is computed again would have another name.
    found = stored(texts.select("a", "b", "text").mapInArrow(run, _FOUND), "document-expressions")
    hits, told = found.where("w IS NOT NULL"), model.told
    words = hits.select("w", "p").distinct()
    for own in ("w", "p"):
        words = words.join(told.select(F.col("key").alias(own), F.col("steps").alias(f"of_{own}")).hint("merge"), own, "left")
    of_w, of_p = F.coalesce("of_w", F.lit(0)), F.coalesce("of_p", F.lit(0))
    best = F.when(F.abs(of_w) >= F.abs(of_p), of_w).otherwise(of_p).alias("best")
    words = words.select("w", "p", best).where("best <> 0")
    each = hits.join(words.hint("merge"), ["w", "p"]).select("batch", "best", "i", "n")
    sums = each.groupBy("batch").applyInArrow(_sums_of_texts, "batch long, i short, steps long")
    texts = found.where("w IS NULL").select("batch", F.col("i")[0].alias("i"), F.col("n")[0].alias("n_words"), "a", "b")
    # Tasks that hold copies of one text all have it. Copies of a text meet its evidence in a join that can be split.
    rows = texts.join(sums.hint("shuffle_hash"), ["batch", "i"], "left")
    return grouped(rows, ["a", "b"], steps=F.max(F.coalesce("steps", F.lit(0))), n_words=F.max("n_words").cast("long"))


def _evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``llr``, the summed log-likelihood ratio of all words, and ``n_words``."""
    if model.told is None:
        return docs.withColumns({"llr": F.lit(0.0), "n_words": F.lit(0).cast("long")})
    a, b = free_name(docs, "_a"), free_name(docs, "_b")
    rows = docs if {"a", "b"} <= set(docs.columns) else with_digest(docs, "a", "b")
    found = _text_evidence(rows, model)
    found = found.select(F.col("a").alias(a), F.col("b").alias(b), (F.col("steps") / F.lit(float(STEPS))).alias("llr"), "n_words")
    return rows.withColumnsRenamed({"a": a, "b": b}).join(found.hint("shuffle_hash"), [a, b]).drop(a, b)


def _inputs(llr, n_words):
    """Per word, and per square root of the words, beside the threshold."""
    n = np.maximum(n_words, 1)
    return np.stack([np.ones(len(n)), 100 * llr / n, llr / np.sqrt(n)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    weights, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + ridge @ weights
        weights = weights - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, slope)
    return weights


def train(docs: DataFrame, labels: DataFrame, filter_bits: int = FILTER_BITS) -> Model:
    """A model from the labelled rows outside the held-out fold.

    Rows without a label or an id teach nothing. Without labels of both classes all scores are one half.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic")
    known = known.where(fold() != HELD_OUT).dropDuplicates(["doc_id"])
    texts = docs.where("doc_id IS NOT NULL").where(fold() != HELD_OUT).select("doc_id", "text")
    texts = with_digest(_perhaps_labelled(texts, known), "a", "b")
    # Labels grow with the documents: one plan for every size. Labels are hashed and texts stream past them.
    labelled = texts.join(known.hint("shuffle_hash"), "doc_id")
    sizes = {int(r.toxic): r.n for r in known.where(fold() != CALIBRATION).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return Model(None, np.zeros(0, np.uint8), filter_bits, np.zeros(3))
    steps = F.round(_ratio(sizes[0], sizes[1]) * F.lit(STEPS)).cast("long")
    counted = stored(counts(labelled.where(fold() != CALIBRATION)), "counts")
    told = stored(counted.select("key", steps.alias("steps")).where("steps <> 0"), "expressions")
    calibration = labelled.where(fold() == CALIBRATION)
    model = Model(told, _filter(told, filter_bits), filter_bits, np.zeros(3), counted, calibration)
    rows = _evidence(calibration, model).select("doc_id", "llr", "n_words", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    seen = rows.select("llr", "n_words", "toxic").toPandas()
    if len(seen):
        model.weights = _fit(_inputs(seen.llr.to_numpy(), seen.n_words.to_numpy()), seen.toxic.to_numpy())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, between 0 and 1, and ``predicted``, 1 from one half on.

    Null and empty texts get the score of no evidence. Columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    w0, w1, w2 = (F.lit(float(w)) for w in model.weights)
    n = F.greatest(F.col("n_words"), F.lit(1))
    total = w0 + w1 * 100 * F.col("llr") / n + w2 * F.col("llr") / F.sqrt(n)
    done = _evidence(set_aside(docs), model).withColumn("score", 1 / (1 + F.exp(-total)))
    return done.select(*brought_back(done, docs), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
