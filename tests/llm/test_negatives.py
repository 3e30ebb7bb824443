"""Hard negatives by vertical scans: against brute force over all pairs, and on edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, positives=5, best=10):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by comparing every pair."""
    usable = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        usable.append((vec_id, label, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    for a, label, q in usable:
        if a % every:
            continue
        score = [(-sum(x * y for x, y in zip(q, p)), i, own) for i, own, p in usable]  # noqa: B905
        for positive, p, own in sorted(s for s in score if s[2] == label and s[1] != a)[:positives]:
            fit = sorted(s for s in score if s[2] != label and -30 * positive <= -100 * s[0] <= -90 * positive)
            out += [(a, p, k, i, -positive, -s) for k, (s, i, _) in enumerate(fit[:best], 1)]
    return sorted(out)


def vectors(seed, n=600, width=24):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(6))
        x = middle[label] + rng.normal(size=width) * (0.2 if i % 3 else 2)
        rows.append([i, [float(np.float32(v)) for v in x / np.linalg.norm(x)], label])
    for i in range(0, n, 9):  # ties: copies, and vectors of few values
        rows[i][1] = list(rows[(i * 7) % 50][1])
    for i in range(1, n, 11):
        rows[i][1] = [float(v) / 4 for v in rng.integers(-1, 2, width)]
    return [tuple(r) for r in rows]


def found(spark, rows, parts=3, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    df = df.withColumns({c: F.lit("x") for c in ("q", "rank", "x", "y", "twin", "anchor_id")})
    made = negatives.hard_negatives(df)
    assert made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in made.collect())


@pytest.mark.parametrize(("rows_in_block", "anchors_in_block"), [(1 << 12, 1 << 10), (90, 2)])
def test_negatives_equal_brute_force(spark, monkeypatch, rows_in_block, anchors_in_block):
    monkeypatch.setattr(negatives, "ROWS_IN_BLOCK", rows_in_block)
    monkeypatch.setattr(negatives, "ANCHORS_IN_BLOCK", anchors_in_block)
    rows = vectors(rows_in_block)
    want = plain(rows)
    assert len(want) > 100 and found(spark, rows) == want


def test_edge_rows_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(5, 230, 6)
    rows += [(None, [1.0] * 6, 1), (1000, None, 1), (1001, [1.0] * 6, None), (1002, [1.0, None, 0.0], 1)]
    rows += [(1100, [nan] * 6, 1), (1101, [inf, 0.0], 1), (1200, [], 2), (1300, [0.0] * 6, 3), (1201, [0.5, 0.5], 2)]
    rows += [(-100, [0.5] * 6, 1), (-7, [0.25] * 6, 0), (1400, [100.0, -3.0], 1), (1401, [100000.0, 0.0], 1)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:0], parts=1) == [] and found(spark, rows[1:3]) == [] and found(spark, rows[:1]) == []


def test_repeated_rows_ask_once_and_count_each_time(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 2), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2)]
    rows += [(3, [0.5, 0.0], 3), (3, [0.5, 0.0], 3), (4, [0.6, 0.3], 4)]
    # The anchor's own label moves from 1 to 2; its copy is no positive.
    got = found(spark, rows)
    assert {r[1] for r in got} == {1, 2}
    assert [r[2:4] for r in got if r[1] == 1] == [(1, 4), (2, 3), (3, 3)]
    assert sorted(r[2:4] for r in got if r[1] == 2) == sorted([(1, 4), (2, 3), (3, 3)] * 2)


def test_a_scan_drops_candidates_before_all_columns_are_read():
    rng = random.Random(1)
    columns = np.zeros((64, 1000), np.int64)
    columns[0] = [rng.randrange(1000) for _ in range(1000)]
    columns[1:] = np.random.default_rng(1).integers(-1, 2, (63, 1000))
    scan = negatives.Scan(np.arange(1000), np.zeros(1000, np.int64), columns)
    seen = []

    def bounds(least, most):
        seen.append(len(least))
        return (negatives._kth(least, 5) if len(least) >= 5 else -np.inf), np.inf

    anchor = np.array([1000] + [1] * 63)
    rows, score = scan.wanted(anchor, np.ones(1000, bool), bounds)
    assert seen[0] == 1000 and seen[-1] < 40
    best = negatives._best(rows, score, 5)
    whole = anchor @ columns
    assert sorted(whole)[-5:] == sorted(score[best].tolist())


@pytest.mark.parametrize("large", [1, 1 << 26])
def test_large_components_are_summed_exactly(large):
    rng = random.Random(2)
    columns = np.array([[rng.randrange(-large, large + 1) for _ in range(50)] for _ in range(40)])
    scan = negatives.Scan(np.arange(50), np.zeros(50, np.int64), columns)
    anchor = np.array([rng.randrange(-large, large + 1) for _ in range(40)])
    rows, score = scan.wanted(anchor, np.ones(50, bool), lambda least, most: (-np.inf, np.inf))
    assert score.tolist() == [sum(int(a) * int(b) for a, b in zip(anchor, columns[:, i], strict=True)) for i in rows]


def test_windows_hold_both_ends():
    for p in range(-50, 200):
        low, high = negatives.window(p)
        assert [s for s in range(-80, 200) if 30 * p <= 100 * s <= 90 * p] == list(range(low, high + 1))
