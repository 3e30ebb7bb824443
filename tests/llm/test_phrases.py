"""Phrase collocations: summaries, and results against plain counting."""

import random
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import phrases
from tests.llm import brute

SPLIT = brute.re.compile("[.,;:!?\x0a-\x0d]")
WORD = brute.re.compile("[^\x20\x09]+")


def plain(rows, threshold, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything. ``rows`` are (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in SPLIT.split(brute.lower(text)):
            words = WORD.findall(piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        longer = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        kept = []
        for p, a in candidates.items():
            if longer[p] >= a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "中", "a(b)", "X", "\x1f", "\U00010348"]
    fixed = ["new york city hall of fame", "ab cd ef", "One two  three\tfour five six"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\t"]) for p in parts), rng.choice(["en", "de", None, "und"])))
    return rows


def found(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    df = df.withColumns({c: F.lit("x") for c in ("phrase", "n", "key", "part", "number", "size")})
    made = phrases.collocations(df, **options)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in made.collect())


@pytest.mark.parametrize(("threshold", "bits", "summary"), [(5, 1 << 26, 1 << 17), (3, 1 << 15, 400), (12, 1 << 16, 100)])
def test_collocations_equal_plain_counting(spark, threshold, bits, summary):
    rows = texts(threshold)
    assert found(spark, rows, threshold=threshold, filter_bits=bits, summary=summary) == plain(rows, threshold)


def test_only_the_best_of_each_language_are_returned(spark):
    rows = texts(7)
    assert found(spark, rows, threshold=4, top=6) == plain(rows, 4, top=6)
    assert found(spark, rows, threshold=4, longest=3) == plain(rows, 4, longest=3)


def test_edge_rows_long_texts_repeats_and_empty_tables(spark):
    rows = [(None, "en"), ("", "en"), (" \t\n", None), ("one", "en"), ("the end. the end, the end", "en")] * 2
    rows += [("long text without end " * 20_000, "xx")] + [("copy of a line", "yy")] * 500
    assert found(spark, rows, threshold=5) == plain(rows, 5)
    assert found(spark, rows[:2], threshold=1) == found(spark, rows[:0] or [(None, None)], threshold=1) == []
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(none).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    seen = spark.createDataFrame([(10**13 + 7, 10**14 + 3, 10**13 + 9, 10**13 + 11)], "a long, n long, l long, r long")
    r = seen.select(phrases.score().alias("score")).first()
    assert r.score == 1000 * (10**13 + 7) * (10**14 + 3) // ((10**13 + 9) * (10**13 + 11))


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_every_item_that_reaches_the_threshold(seed):
    rng = np.random.default_rng(seed)
    items = (rng.zipf(1.3, 60_000) % 30_000).astype(np.uint64)
    threshold = int(rng.integers(3, 60))
    want = {k for k, n in Counter(items.tolist()).items() if n >= threshold}
    make = partial(phrases.Summary, threshold, 1 + seed % 2)
    parts, whole = [make() for _ in range(5)], make()
    for i, part in enumerate(np.array_split(items, 50)):
        keys, counts = phrases.summed(part, np.ones(len(part), np.int64))
        parts[i % 5].add(keys, counts)
        whole.add(keys, counts)
    assert want <= set(whole.survivors().tolist()) and whole.off < threshold
    assert len(whole.survivors()) <= 3 * (len(items) // threshold + 1) or whole.off == threshold - 1
