"""Toxicity by class-conditional Kneser-Ney models of words.

The history of a word is its document, of which a class has many. A class gives a word its occurrences there less an absolute
discount, and what the discounts free goes to all words by their continuation counts, the number of different
documents of either class that have them, which both classes share:

    P(word | class) = max(c(class, word) - D, 0) / c(class) + D * types(class) / c(class) * N1+(. word) / N1+(. .)

A document's score compares its two log-likelihoods per word. Beside that mean it takes how many words one class makes
e**2 times likelier than the other, since a few words tell and hundreds of ordinary ones drown them in a mean. Labels
of a fold that is not counted calibrate the three.

All ratios are relative to that of a word which neither class has, whose ratio is the same for all: calibration has a
constant beside them. With a discount of one, a word that no class has twice has that ratio too and needs no row.

The words' table grows with the corpus. Tasks look up its most frequent words in a copy of bounded size; documents meet the
others in a join, which each task enters once per word of a batch. A bit filter of one size tells words without a row.
"""

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm import toxicity
from roadpulse.llm.shared import free_name, stored
from roadpulse.llm.toxicity import CALIBRATION_ROWS, FILTER_BITS, STEPS
from roadpulse.operators.lookup import grouped

DISCOUNT = 1.0
#: A log ratio from which a word is counted as telling.
TELLING = 2.0
#: Words of the copy that every task has. The more it has, the faster at first the join of the others grows with the corpus.
HEAD = 1 << 16
#: Rows of an Arrow batch that enter the join together: the more, the fewer rows a rare word makes there.
BATCH_ROWS = 5000
#: Counts are told apart by this many levels per doubling, to find those of the copy.
LEVELS = 8
_SUMS = ["steps", "toxic", "plain"]


@dataclass
class Model:
    """(key, steps) of the words that the copy lacks; the copy, sorted by key; the filter of the former; the calibration."""

    tail: DataFrame | None
    head: tuple[np.ndarray, np.ndarray]
    filter: np.ndarray
    filter_bits: int
    weights: np.ndarray


def _ratios(counted: DataFrame) -> DataFrame:
    """(key, level, steps): the log ratio of each word's probabilities in the two classes, where it is not an unseen word's."""
    words = counted.where("c0 + c1 > 0")
    sums = [F.sum(c).alias(c) for c in ("c0", "c1")]
    freed = [F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).alias(f"freed_{c}") for c in ("c0", "c1")]
    total = words.agg(*sums, *freed, F.sum(F.col("n0") + F.col("n1")).alias("seen")).first()
    if not (total.c0 and total.c1):
        return words.select("key", F.lit(0).alias("level"), F.lit(0).cast("long").alias("steps")).limit(0)
    shared = (F.col("n0") + F.col("n1")) / F.lit(float(total.seen))

    def p(c: str) -> Column:
        own = F.greatest(F.col(c) - F.lit(DISCOUNT), F.lit(0.0)) / F.lit(float(total[c]))
        return own + F.lit(total[f"freed_{c}"] / total[c]) * shared

    unseen = float(np.log(total.freed_c1 / total.c1) - np.log(total.freed_c0 / total.c0))
    steps = F.round((F.log(p("c1")) - F.log(p("c0")) - F.lit(unseen)) * F.lit(STEPS)).cast("long")
    level = F.floor(F.lit(LEVELS) * F.log2(F.col("n0") + F.col("n1"))).cast("int")
    return words.select("key", level.alias("level"), steps.alias("steps")).where("steps <> 0")


def _head_level(told: DataFrame, most: int) -> int:
    """The lowest level from which on there are at most ``most`` words."""
    lowest, n = 1 << 30, 0
    for r in sorted(told.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        n += r.n
        if n > most:
            break
        lowest = r.level
    return lowest


_FOUND = "batch long, w long, i array<short>, n array<int>, a long, b long, " + ", ".join(f"{c} long" for c in ["n_words", *_SUMS])


def _sums(steps: np.ndarray, n: np.ndarray, text: np.ndarray, rows: int) -> list[np.ndarray]:
    """Of each text the summed steps, and the words that tell for and against; ``n`` is how often each word occurs."""
    out = []
    for each in (steps * n, (steps > TELLING * STEPS) * n, (steps < -TELLING * STEPS) * n):
        out.append(np.zeros(rows, np.int64))
        np.add.at(out[-1], text, each)
    return out


def _sums_of_texts(rows: pa.Table) -> pa.Table:
    """(batch, i, sums) of one batch, from its words with their texts and counts."""
    rows = rows.combine_chunks()
    text, n = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in "in")
    steps = np.repeat(rows.column("of_w").to_numpy(), pc.list_value_length(rows.column("i")).to_numpy())
    sums, own = _sums(steps, n, text, BATCH_ROWS), np.unique(text)
    batch = np.full(len(own), rows.column("batch")[0].as_py())
    return pa.table({"batch": batch, "i": own.astype(np.int16)} | {f"of_{c}": x[own] for c, x in zip(_SUMS, sums, strict=True)})


def _text_evidence(texts: DataFrame, model: Model) -> DataFrame:
    """(a, b, n_words, steps, toxic, plain) of each different text, named by 128 bits of hash. ``texts`` has a, b and text."""
    shared, bits = texts.sparkSession.sparkContext.broadcast((*model.head, model.filter)), model.filter_bits

    def run(batches):
        keys, steps_of, marks = shared.value

        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                a, b = (batch.column(c).to_numpy() for c in "ab")
                order, first = toxicity._firsts(a, b)
                once = np.zeros(len(a), bool)  # a copy says nothing new
                once[order[first]] = True
                rest, n_words = [], np.zeros(len(a), np.int64)
                sums = [np.zeros(len(a), np.int64) for _ in _SUMS]
                for block in toxicity._lower_blocks(batch):
                    text, word, _ = toxicity._features(block)
                    text = text + block.first
                    n_words += np.bincount(text, minlength=len(a))
                    text, word = text[once[text]], word[once[text]]
                    in_head = np.zeros(len(word), bool)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
                        in_head = keys[at] == word
                        for x, more in zip(sums, _sums(steps_of[at[in_head]], 1, text[in_head], len(a)), strict=True):
                            x += more
                    at = word % bits
                    own = np.flatnonzero(~in_head & (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
                    rest.append((word[own], text[own]))
                w, text = (np.concatenate(x) for x in zip(*rest, strict=True))
                order, at = toxicity._firsts(w, text)
                n = np.diff(np.append(at, len(w)))
                w, text = w[order[at]], text[order[at]]
                _, start = toxicity._firsts(w)
                kept = np.flatnonzero(once)
                ends = np.concatenate([start, len(w) + np.arange(len(kept) + 1)]).astype(np.int32)
                rows, is_word = len(ends) - 1, np.arange(len(ends) - 1) < len(start)
                none = np.zeros(len(start), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, int.from_bytes(os.urandom(8), "big", signed=True))),
                        pa.array(np.concatenate([w[start], np.zeros(len(kept), np.int64)]), mask=~is_word),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([text, kept]).astype(np.int16))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([n, np.ones(len(kept), n.dtype)]).astype(np.int32))),
                        *(pa.array(np.concatenate([none, x[kept]]), mask=is_word) for x in (a, b, n_words, *sums)),
                    ],
                    ["batch", "w", "i", "n", "a", "b", "n_words", *_SUMS],
                )

    # Written once: a batch that is computed again would have another name.
    found = stored(texts.select("a", "b", "text").mapInArrow(run, _FOUND), "document-words")
    told = model.tail.select(F.col("key").alias("w"), F.col("steps").alias("of_w"))
    each = found.where("w IS NOT NULL").select("batch", "w", "i", "n").join(told.hint("merge"), "w").select("batch", "of_w", "i", "n")
    of = [f"of_{c}" for c in _SUMS]
    sums = each.groupBy("batch").applyInArrow(_sums_of_texts, "batch long, i short, " + ", ".join(f"{c} long" for c in of))
    texts = found.where("w IS NULL").select("batch", F.col("i")[0].alias("i"), "a", "b", "n_words", *_SUMS)
    rows = texts.join(sums.hint("shuffle_hash"), ["batch", "i"], "left")
    # Tasks that hold copies of one text all have it. Copies of a text meet its evidence in a join that can be split.
    total = {c: F.max(F.col(c) + F.coalesce(f"of_{c}", F.lit(0))).cast("long") for c in _SUMS}
    return grouped(rows, ["a", "b"], n_words=F.max("n_words").cast("long"), **total)


def _inputs(steps, toxic, plain, n_words):
    """The mean log ratio, and the telling words of both classes per square root of the words, beside the threshold."""
    n = np.maximum(n_words, 1)
    return np.stack([np.ones(len(n)), steps / STEPS / n, toxic / np.sqrt(n), plain / np.sqrt(n)], axis=1)


def train(counts: toxicity.Model, head: int = HEAD, filter_bits: int = FILTER_BITS) -> Model:
    """A model from the counts of ``toxicity.train`` and its calibration rows. Without labels of both classes all scores are one half."""
    nothing = Model(None, (np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint8), filter_bits, np.zeros(4))
    if counts.counted is None:
        return nothing
    told = stored(_ratios(counts.counted), "words")
    lowest = _head_level(told, head)
    copy = told.where(F.col("level") >= lowest).select("key", "steps").toPandas().sort_values("key")
    tail = told.where(F.col("level") < lowest).select("key", "steps")
    known = (copy.key.to_numpy(np.int64), copy.steps.to_numpy(np.int64))
    model = Model(tail, known, toxicity._filter(tail, filter_bits), filter_bits, np.zeros(4))
    rows = counts.calibration.select("doc_id", "a", "b", F.col("toxic").alias("label"))
    rows = rows.join(_text_evidence(counts.calibration, model).hint("shuffle_hash"), ["a", "b"])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    seen = rows.select(*_SUMS, "n_words", "label").toPandas()
    if len(seen):
        inputs = _inputs(*(seen[c].to_numpy() for c in (*_SUMS, "n_words")))
        model.weights = toxicity._fit(inputs, seen.label.to_numpy())
    return model


def score(docs: DataFrame, model: Model, texts: DataFrame) -> DataFrame:
    """``docs`` with ``kn_score``, between 0 and 1, and ``kn_predicted``, 1 from one half on.

    ``a`` and ``b`` of ``docs`` name the texts by 128 bits of hash; ``texts`` has them with the text.
    Null and empty texts get the score of no evidence. Columns of these names are replaced.
    """
    docs = docs.drop("kn_score", "kn_predicted")
    if model.tail is None:
        return docs.withColumns({"kn_score": F.lit(0.5), "kn_predicted": F.lit(1)})
    names = {c: free_name(docs, f"_{c}") for c in ("n_words", *_SUMS)}
    found = _text_evidence(texts, model).withColumnsRenamed(names)
    n, steps, toxic, plain = (F.col(names[c]) for c in ("n_words", *_SUMS))
    n = F.greatest(n, F.lit(1))
    w = [F.lit(float(x)) for x in model.weights]
    total = w[0] + w[1] * steps / F.lit(float(STEPS)) / n + w[2] * toxic / F.sqrt(n) + w[3] * plain / F.sqrt(n)
    done = docs.join(found.hint("shuffle_hash"), ["a", "b"]).withColumn("kn_score", 1 / (1 + F.exp(-total)))
    return done.select(*docs.columns, "kn_score", (F.col("kn_score") >= 0.5).cast("int").alias("kn_predicted"))
