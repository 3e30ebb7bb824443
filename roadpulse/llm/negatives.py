"""Hard negatives by BOND, a vertical scan of vectors.

Vectors lie in columns, one for each dimension. An anchor reads the columns in the descending order of its own components' sizes and adds
to the partial scores of the rows that are still candidates. What the columns not yet read can add lies between sums of
their smallest and largest products with the anchor; rows whose score cannot be wanted any more leave the bitmap of
candidates, until the scores that are left are whole.

Anchors and rows are cut into blocks of a bounded size. A task scans one block of rows for one block of anchors and sends on
only what may be among the best of all: first the positives, whose scores give each anchor its windows, then
the negatives inside those windows. No vector is ever held beside more than its block, and nothing passes the driver but row counts.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadpulse.llm.shared import stored

LABELS = 10
ANCHOR_EVERY, RELABEL_EVERY = 100, 7
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is wanted between these percentages of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Components beyond this size count as this size, so that scores of up to 2,048 dimensions fit 63 bits.
LARGEST = 1 << 26
#: Rows and anchors that one task compares.
ROWS_IN_BLOCK, ANCHORS_IN_BLOCK = 1 << 12, 1 << 10
#: Most partitions that the cells are dealt over.
MOST_PARTITIONS = 1 << 15
#: What tells one positive of one anchor from others, then its negative.
NEGATIVE = ["anchor_id", "twin", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
#: Columns read between two looks at the bounds.
STRIDE = 8


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q): the rows that take part, relabelled, with whole components.

    Rows with a null vec_id, label or vector, or with a component that is null or not finite, take no part.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % RELABEL_EVERY == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label)
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    return rows.select(vec_id.alias("vec_id"), moved.alias("label"), whole.alias("q"))


def _columns(lists: pa.Array, width: int) -> np.ndarray:
    """Whole vectors as columns; missing components at the end are zero."""
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    n = np.diff(ends)
    out = np.zeros((width, len(n)), np.int64)
    if len(n) and n.min() == width:
        out[:] = flat[ends[0] : ends[-1]].reshape(len(n), width).T
    else:
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            out[: b - a, i] = flat[a:b]
    return out


class Scan:
    """A block of rows in columns, with each column's smallest and largest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self._columns = {np.int64: np.ascontiguousarray(columns[:, order])}
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)
        self._most = int(np.abs(columns).max(initial=0))

    def _as(self, kind) -> np.ndarray:
        if kind not in self._columns:
            self._columns[kind] = self._columns[np.int64].astype(kind)
        return self._columns[kind]

    def wanted(
        self, anchor: np.ndarray, alive: np.ndarray, bounds: Callable[[np.ndarray, np.ndarray], tuple[float, float]]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows (as places in order of id) and whole scores of the candidates that are left.

        ``bounds`` gets the least and the greatest scores that the candidates can have and tells which range is still wanted.
        """
        # Doubles hold whole numbers below 2**53 exactly, and multiply faster.
        most = int(np.abs(anchor).max(initial=0)) * self._most * len(anchor)
        kind = np.float64 if most < 1 << 53 else np.int64
        columns, anchor = self._as(kind), anchor.astype(kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])
        rest = np.zeros((2, len(anchor) + 1), kind)
        rest[:, :-1] = np.cumsum(np.stack([ends.min(axis=0), ends.max(axis=0)])[:, order[::-1]], axis=1)[:, ::-1]
        rows, score = np.flatnonzero(alive), None
        for k in range(0, len(anchor), STRIDE):
            read = order[k : k + STRIDE]
            part = columns[read] if len(rows) == columns.shape[1] else columns[read][:, rows]
            part = anchor[read] @ part
            score = part if score is None else score + part
            at = min(k + STRIDE, len(anchor))
            least, most = score + rest[0, at], score + rest[1, at]
            low, high = bounds(least, most)
            kept = (most >= low) & (least <= high)
            if not kept.all():
                rows, score = rows[kept], score[kept]
            if not len(rows):
                break
        if score is None:
            score = np.zeros(len(rows), kind)
        return rows, score.astype(np.int64)


def _best(rows: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The places of the ``n`` best: high scores first, then small ids (rows are in order of id)."""
    if len(score) > n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((rows[near], -score[near]))[:n]]
    return np.lexsort((rows, -score))


def _kth(values: np.ndarray, n: int):
    """The n-th largest value, or None."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else None


def nearest_of_same_label(scan: Scan, vec_id: int, label: int, anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's ``n`` best other rows with the anchor's label."""

    def bounds(least, most):
        kth = _kth(least, n)
        return (-np.inf if kth is None else kth), np.inf

    rows, score = scan.wanted(anchor, (scan.labels == label) & (scan.ids != vec_id), bounds)
    best = _best(rows, score, n)
    return scan.ids[rows[best]], score[best]


def best_in_windows(
    scan: Scan, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], n: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ends included, the block's ``n`` best rows of other labels inside it."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
    open_ = [w for w in windows if w[0] <= w[1]]
    if not open_:
        return out

    def bounds(least, most):
        # n rows that are surely inside a window make worse ones useless for it.
        low = min(max(a, kth) if (kth := _kth(least[(most <= b) & (least >= a)], n)) is not None else a for a, b in open_)
        return low, max(b for _, b in open_)

    rows, score = scan.wanted(anchor, scan.labels != label, bounds)
    for i, (a, b) in enumerate(windows):
        own = np.flatnonzero((score >= a) & (score <= b))
        best = own[_best(rows[own], score[own], n)]
        out[i] = scan.ids[rows[best]], score[best]
    return out


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, width: int, judge, schema: str) -> DataFrame:
    """``judge`` of each block of rows with each block of anchors, which meet in a task of their own."""
    kind = T.StructType.fromDDL(schema)
    row_blocks, anchor_blocks = -(-n_rows // ROWS_IN_BLOCK) or 1, -(-n_anchors // ANCHORS_IN_BLOCK) or 1

    def block(n):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def blocks(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    n = min(row_blocks * anchor_blocks, MOST_PARTITIONS)
    left = rows.withColumn("y", block(row_blocks)).withColumn("x", blocks(anchor_blocks))
    right = anchors.withColumn("x", block(anchor_blocks)).withColumn("y", blocks(row_blocks))

    def run(some_rows: pa.Table, some_anchors: pa.Table) -> pa.Table:
        if not some_rows.num_rows or not some_anchors.num_rows:
            return to_arrow_schema(kind).empty_table()
        some_rows = some_rows.combine_chunks()
        ids, labels = (some_rows.column(c).to_numpy() for c in ("vec_id", "label"))
        scan = Scan(ids, labels, _columns(some_rows.column("q").combine_chunks(), width))
        batches = some_anchors.combine_chunks().to_batches()
        return pa.Table.from_batches([judge(scan, b, _columns(b.column("q"), width)) for b in batches])

    # A given number of partitions is not merged by size: cells are small to move and long to compare.
    left, right = left.repartition(n, "x", "y"), right.repartition(n, "x", "y")
    cells = left.groupBy("x", "y").cogroup(right.groupBy("x", "y"))
    return cells.applyInArrow(run, schema)


def hard_negatives(
    embeddings: DataFrame,
    anchor_every: int = ANCHOR_EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors and their positives.

    ``embeddings`` has vec_id, label and embedding; other columns are not read. Rows of one vec_id are no positives of each
    other. Of vectors of different lengths the missing components count as zero. An empty table gives no rows.
    """
    rows = stored(prepared(embeddings), "vectors")
    is_anchor = F.col("vec_id") % anchor_every == 0
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("q")).alias("width")).first()
    sizes = n.rows, n.anchors, n.width or 0
    # Anchor rows that repeat ask the same question.
    anchors = rows.where(is_anchor).dropDuplicates(["vec_id", "label", "q"])

    def find_positives(scan: Scan, batch: pa.RecordBatch, q: np.ndarray) -> pa.RecordBatch:
        out = []
        for i, (a, label) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            ids, score = nearest_of_same_label(scan, a, label, q[:, i], positives)
            out.append((np.full(len(ids), i), ids, score))
        at, ids, score = (np.concatenate(x) for x in zip(*out, strict=True))
        own = [batch.column(c).take(pa.array(at)) for c in ("vec_id", "label", "q")]
        return pa.RecordBatch.from_arrays([*own, pa.array(ids), pa.array(score)], ["vec_id", "label", "q", "positive_id", "positive_score"])

    schema = "vec_id long, label long, q array<long>, positive_id long, positive_score long"
    found = _cells(rows, anchors, *sizes, find_positives, schema)
    best = _first(found, ["vec_id", "label", "q"], F.desc("positive_score"), F.col("positive_id"), positives)
    of_anchor = F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives")
    asked = best.groupBy("vec_id", "label", "q").agg(of_anchor).withColumn("twin", F.xxhash64("label", "q"))
    asked = stored(asked, "positives")

    def find_negatives(scan: Scan, batch: pa.RecordBatch, q: np.ndarray) -> pa.RecordBatch:
        out = [[np.zeros(0, np.int64)] * len(NEGATIVE)]
        columns = (batch.column(c).to_pylist() for c in ("vec_id", "twin", "label", "positives"))
        for i, (a, twin, label, own) in enumerate(zip(*columns, strict=True)):
            wanted = best_in_windows(scan, label, q[:, i], [window(p["positive_score"], low, high) for p in own], negatives)
            for p, (ids, score) in zip(own, wanted, strict=True):
                same = (a, twin, p["rank"], p["positive_id"], p["positive_score"])
                out.append([*(np.full(len(ids), v, np.int64) for v in same), ids, score])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], NEGATIVE)

    found = _cells(rows, asked, *sizes, find_negatives, ", ".join(f"{c} long" for c in NEGATIVE))
    best = _first(found, NEGATIVE[:5], F.desc("negative_score"), F.col("negative_id"), negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _first(rows: DataFrame, keys: list[str], score: Column, tie: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(score, tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
