"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each rule that
the document fails. A policy is a named set of rules; applying one, or comparing policies, only looks
at the bits, so a changed policy never reads a text again.
"""

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm import text as tx
from roadpulse.llm.shared import brought_back, set_aside, with_columns_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
WINDOW = 5
#: Repeated lines that a rule asks for if its caller names no number.
LEAST_DUP_LINES = 3
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _rules(least_dup_lines: int = LEAST_DUP_LINES) -> dict[str, Column]:
    """Each rule's failure; a rule's bit is its place here, so new rules go to the end."""
    c = F.col
    return {
        "too_few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "many_symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "repeated_lines": (c("n_dup_lines") >= least_dup_lines) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
    }


RULES = ["too_few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words"]
#: Policies by version: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": ["too_few_words", "repeated_windows", "many_symbols"],
    "v2": RULES,
}


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The number of different keys of each owner."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    return np.bincount(o[first], minlength=n)


def _repeated(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Marks of the keys that their owner has twice or more."""
    with np.errstate(over="ignore"):
        both = tx.mix(keys + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(both)
    both = both[order]
    same = both[1:] == both[:-1]
    marks = np.zeros(len(both), bool)
    marks[order[1:][same]] = True
    marks[order[:-1][same]] = True
    return marks


def _measure(block: tx.Block) -> dict[str, np.ndarray]:
    data, offsets, n = block.data, block.offsets, len(block)
    in_word = ~_SPACE[data]
    starts, ends = tx.runs(in_word, offsets)
    owner = tx.owners(starts, offsets)
    hashed = tx.SpanHash(data)
    at = tx.windows(owner, WINDOW)
    again = at[_repeated(owner[at], tx.gram_hash(hashed(starts, ends), at, WINDOW))]
    repeat = tx.covered(again, WINDOW, len(starts))

    breaks = np.flatnonzero(data == 10)
    # A line starts with its text, or after a line feed of the same text.
    line_start = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.minimum(
        np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, line_start)],
        offsets[1:][tx.owners(line_start, offsets)] if n else 0,
    )
    seen = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    full = seen[line_end] > seen[line_start]
    line_start, line_end = line_start[full], line_end[full]
    line_owner = tx.owners(line_start, offsets)
    n_lines = np.bincount(line_owner, minlength=n)
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": block.per_text(in_word & ((data & 0xC0) != 0x80)),
        "n_symbols": block.per_text(_SYMBOL[data]),
        "n_dup_lines": n_lines - _distinct(line_owner, hashed(line_start, line_end), n),
        "n_repeat_words": np.bincount(owner[repeat], minlength=n),
        "n_lines": n_lines,
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the measurements of each whole text.

    Null and empty texts measure zero throughout. Columns that have a measurement's name are replaced.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [_measure(b) for b in tx.blocks(batch.column(text))]
        return {k: pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in MEASURES}

    return with_columns_of(docs, make, [(k, T.LongType()) for k in MEASURES])


def mask(rules: list[str]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def ledger(docs: DataFrame, text: str = "text", least_dup_lines: int = LEAST_DUP_LINES) -> DataFrame:
    """``docs``, the measurements, and ``failed_bits`` with a bit for each rule that the document fails.

    Repeated lines are judged by their share alone with ``least_dup_lines`` of 1; with more, no text with fewer of them fails that rule.
    """
    rules = _rules(least_dup_lines)
    bits = sum((F.when(rules[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0))
    return measure(docs, text).withColumn("failed_bits", bits.cast("long"))


def passes(version: str, policies: Mapping[str, list[str]] = POLICIES) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policies[version])).cast("long")) == 0


def apply_policy(rows: DataFrame, version: str, policies: Mapping[str, list[str]] = POLICIES) -> DataFrame:
    """Ledger rows with ``policy`` and ``kept``."""
    return rows.withColumn("policy", F.lit(version)).withColumn("kept", passes(version, policies))


def ablations(rows: DataFrame, policies: Mapping[str, list[str]] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: documents that fail the rule, and those that only it rejects.

    Documents are counted per bit pattern first, so what is expanded is as long as there are patterns.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rs)).cast("long").alias("all"),
                 F.lit(1 << RULES.index(r)).cast("long").alias("own"))
        for v, rs in policies.items()
        for r in rs
    ]
    each = patterns.select("failed_bits", "n", F.explode(F.array(*cases)).alias("c"))
    hit = F.col("failed_bits").bitwiseAND(F.col("c.own")) != 0
    only = F.col("failed_bits").bitwiseAND(F.col("c.all")) == F.col("c.own")
    return each.groupBy("c.policy", "c.rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only_here"),
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("c.all")) == 0, F.col("n")).otherwise(0)).alias(
            "n_kept"
        ),
    )


def quality_filter(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents that a policy keeps, with their own columns only."""
    kept = ledger(set_aside(docs)).where(passes(version))
    return kept.select(*brought_back(kept, docs))
