"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram is the product of its letters' vectors,
each rotated by its distance from the end; a text is the sum of its n-grams; a language is the sum of the texts known to be in it. A
text is in the language whose vector has the largest cosine with its own. Whatever is no letter, in any number,
counts as one space, and texts begin and end with a space, so that word borders are n-grams too.

Sums merge in any order, so a language with most of the rows is bundled by all tasks. A text of any length adds to its vector
piece by piece; beside it a task holds one block of texts, the n-gram vectors of that block, and the profiles.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm import text as tx
from roadpulse.llm.shared import ROWS_AT_ONCE, brought_back, set_aside, stored, with_columns_of

DIMENSIONS = 512
GRAM = 3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Bytes of texts that are summed together, for languages and for single texts.
LEARNT_BYTES, SCORED_BYTES = 1 << 20, 1 << 17
#: n-grams of a long text taken in one step, distinct ones whose vectors are held at once, and cells of their counts.
GRAMS_AT_ONCE, VECTORS_AT_ONCE, CELLS = 1 << 20, 1 << 12, 1 << 21
#: Languages compared in one pass over the texts; more take several passes.
LANGUAGES_AT_ONCE = 2048
#: n-grams that can be numbered by a table.
TABLE = 1 << 22
#: Groups of tasks whose sums for one language are added by a task each.
SALTS = 64
_SEED = np.uint64(0x8CB92BA72F3D8DD7)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id is in the held-out fold, so it teaches nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(HELD_OUT))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(symbols: np.ndarray, dimensions: int) -> np.ndarray:
    """One row of +1 and -1 for each code point; 0 stands for the space."""
    at = np.arange((dimensions + 63) // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = tx.mix(tx.mix(symbols.astype(np.uint64) + _SEED)[:, None] + tx.mix(at + np.uint64(1))[None, :])
    bits = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :dimensions]
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The product of each row's letter vectors, the first rotated most."""
    symbols, at = np.unique(grams, return_inverse=True)
    letters, at = letter_vectors(symbols, dimensions), at.reshape(grams.shape)
    size = grams.shape[1]
    made = letters[at[:, size - 1]]
    for j in range(size - 1):
        made = made * np.roll(letters, size - 1 - j, axis=1)[at[:, j]]
    return made


def _symbols(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """Per text a space, its letters in lower case with a space for every run of others, and a space; and their texts."""
    parts = [block.text(i).decode("utf-8").lower() for i in range(len(block))]
    code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) for x in parts])
    borders, texts = np.concatenate([[0], ends[:-1], ends]), np.arange(len(parts), dtype=np.int32)
    order = np.argsort(np.concatenate([2 * texts, 2 * texts + 1]))
    borders, border_texts = borders[order], np.concatenate([texts, texts])[order]
    symbol = np.insert(np.where(_letters()[code], code, np.uint32(0)), borders, 0)
    owner = np.insert(np.repeat(texts, [len(x) for x in parts]), borders, border_texts)
    kept = symbol != 0
    kept[1:] |= symbol[:-1] != 0
    kept[1:] |= owner[1:] != owner[:-1]
    kept[:1] = True
    return symbol[kept], owner[kept]


def _distinct(line: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of ``line`` that start at ``at``, as rows of symbols, and which of them each one is."""
    seen = np.zeros(0x110000, bool)
    seen[line] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    if len(alphabet) ** size < TABLE:  # n-grams number a table: nothing needs sorting
        rank = np.zeros(0x110000, np.int64)
        rank[alphabet] = np.arange(len(alphabet))
        letter, key = rank[line], np.zeros(len(at), np.int64)
        for j in range(size):
            key = key * len(alphabet) + letter[at + j]
        found = np.bincount(key, minlength=len(alphabet) ** size) > 0
        keys = np.flatnonzero(found)
        places = [keys // len(alphabet) ** (size - 1 - j) % len(alphabet) for j in range(size)]
        return alphabet[np.stack(places, axis=1)], (np.cumsum(found) - 1)[key]
    rows = np.stack([line[at + j] for j in range(size)], axis=1)
    key = tx.gram_hash(tx.mix(line.astype(np.uint64)), at, size) if size > 3 else None
    if key is None:
        key = np.zeros(len(at), np.uint64)
        for j in range(size):
            key = (key << np.uint64(21)) | rows[:, j].astype(np.uint64)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    return rows[one], which


def text_vectors(block: tx.Block, group: np.ndarray, groups: int, dimensions: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the n-gram vectors of each group of texts, and how many n-grams; text i is in group[i].

    Sums of one step stay under 2**24, so single precision is exact; they are added as whole numbers.
    """
    total, n_grams = np.zeros((groups, dimensions), np.int64), np.zeros(groups, np.int64)
    symbol, owner = _symbols(block)
    for k in range(0, len(symbol), GRAMS_AT_ONCE):
        line, whose = (x[k : k + GRAMS_AT_ONCE + size - 1] for x in (symbol, owner))
        own = tx.windows(whose, size)
        if not len(own):
            continue
        mine = group[whose[own]]
        grams, at = _distinct(line, own, size)
        n_grams += np.bincount(mine, minlength=groups)
        step = max(1, min(VECTORS_AT_ONCE, CELLS // groups))
        for j in range(0, len(grams), step):
            n = min(step, len(grams) - j)
            near = (at >= j) & (at < j + n)
            counts = np.bincount(mine[near] * n + (at[near] - j), minlength=groups * n).reshape(groups, n)
            vectors = gram_vectors(grams[j : j + n], dimensions).astype(np.float32)
            total += (counts.astype(np.float32) @ vectors).astype(np.int64)
    return total, n_grams


@dataclass
class Profiles:
    """(lang, vector, part): the languages' vectors, in ``parts`` parts of a bounded size."""

    rows: DataFrame
    parts: int
    dimensions: int
    gram: int


def _gathered(vectors: Iterator[tuple[list[str], np.ndarray]], dimensions: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Sums by name. Beyond ``at_once`` names all but the newest are sent on, so sorted names come out once."""
    sums: dict[str, np.ndarray] = {}

    def sent():
        flat = np.concatenate(list(sums.values()))
        ends = np.arange(0, len(flat) + 1, dimensions, dtype=np.int32)
        arrays = [pa.array(list(sums), pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "vector"])

    for names, rows in vectors:
        for name, row in zip(names, rows, strict=True):
            if name in sums:
                sums[name] += row
                continue
            if len(sums) >= at_once:
                yield sent()
                sums = {}
            sums[name] = np.array(row, np.int64)
    if sums:
        yield sent()


def train(docs: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM, at_once: int = LANGUAGES_AT_ONCE) -> Profiles:
    """Profiles of the languages in ``lang``, from the texts outside the held-out fold.

    Rows without lang, text or doc_id teach nothing; rows that repeat count each time.
    """
    known = docs.where(fold() != HELD_OUT).where("lang IS NOT NULL AND text IS NOT NULL")

    def of_texts(batches):
        def each():
            for whole in batches:
                for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(k, ROWS_AT_ONCE)
                    names, own = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
                    for block in tx.blocks(batch.column("text"), LEARNT_BYTES):
                        here, group = np.unique(own[block.first : block.first + len(block)], return_inverse=True)
                        yield names[here], text_vectors(block, group, len(here), dimensions, gram)[0]

        return _gathered(each(), dimensions, at_once)

    def of_sums(batches):
        each = ((b.column("lang").to_pylist(), b.column("vector").flatten().to_numpy().reshape(-1, dimensions)) for b in batches)
        return _gathered(each, dimensions, at_once)

    # One row for each task and language, then for each language and some groups of tasks, then for each language.
    schema = "lang string, vector array<long>"
    sums = known.select("lang", "text").mapInArrow(of_texts, schema)
    sums = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    sums = sums.repartition("lang", "salt").drop("salt").sortWithinPartitions("lang").mapInArrow(of_sums, schema)
    sums = sums.repartition("lang").sortWithinPartitions("lang").mapInArrow(of_sums, schema)
    rows = stored(sums, "languages")
    parts = -(-rows.count() // at_once)
    return Profiles(rows.withColumn("part", F.pmod(F.xxhash64("lang"), F.lit(max(parts, 1)))), parts, dimensions, gram)


def _compared(docs: DataFrame, languages: list[tuple[str, list[int]]], profiles: Profiles) -> DataFrame:
    """``docs`` with the better of the languages it came with and these, in columns lang_pred and score."""
    languages.sort(key=lambda x: x[0].encode())
    names = np.array([x[0] for x in languages], object)
    unit = np.array([x[1] for x in languages], np.float64)
    # Whole numbers, so that sums do not depend on their order.
    unit = np.rint(unit / np.linalg.norm(unit, axis=1).clip(1)[:, None] * (1 << 20))
    shared = docs.sparkSession.sparkContext.broadcast((names, unit, np.linalg.norm(unit, axis=1).clip(1)))
    dimensions, gram = profiles.dimensions, profiles.gram

    def judged(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        names, unit, length = shared.value
        pred, score = np.array(batch.column("lang_pred").to_pylist(), object), batch.column("score").to_numpy().copy()
        for block in tx.blocks(batch.column("text"), SCORED_BYTES):
            n = len(block)
            vectors, n_grams = text_vectors(block, np.arange(n), n, dimensions, gram)
            vectors = vectors.astype(np.float64)
            cosine = vectors @ unit.T / (np.linalg.norm(vectors, axis=1).clip(1)[:, None] * length)
            best = np.argmax(cosine, axis=1)
            for i in np.flatnonzero(n_grams):
                at, found, name = block.first + i, cosine[i, best[i]], names[best[i]]
                if pred[at] is None or (-found, name.encode()) < (-score[at], pred[at].encode()):
                    pred[at], score[at] = name, found
        return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)}

    return with_columns_of(docs, judged, [("lang_pred", T.StringType()), ("score", T.DoubleType())])


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred``, the language of the largest cosine, and ``score``, that cosine (0 if negative).

    Of equally near languages the first by name counts. A null text, one without a letter, and every text
    when nothing was learned, is ``und`` with score 0. Columns of these names are replaced; others, also one named lang,
    are kept and not read.
    """
    docs = docs.drop("lang_pred", "score")
    found = set_aside(docs).withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(0.0)})
    for part in range(profiles.parts):
        languages = [tuple(r) for r in profiles.rows.where(F.col("part") == part).select("lang", "vector").collect()]
        if languages:
            found = _compared(found, languages, profiles)
    return found.select(
        *brought_back(found, docs),
        F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.greatest("score", F.lit(0.0)).alias("score"),
    )
