"""SentencePiece encoding and decoding for merge-type (BPE) models, by backtracking.

The library merges the best-scored adjacent pair until none is left. The same result comes from the left: take the
longest piece that an Aho-Corasick pass found at a position, accept it if it is compatible with the piece
before it, else a shorter one, else step back; positions from which no piece led on are kept in a
bitfield and never entered again. Two adjacent pieces are compatible if merging their joined characters anew
gives the same two pieces.

A text is cut where no piece can lie across: in front of each run of white-space marks, and between letters and
other characters as far as the vocabulary keeps them apart. The encodings of frequent units are remembered. Marks in a row have equal scores, so a unit that starts with
several is merged directly. A character outside the vocabulary becomes its UTF-8 bytes.
"""

import codecs
import heapq
import re
from array import array
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.shared import with_columns_of

MARK = "▁"
#: Units remembered in each of two generations, so that frequent ones outlive the rare.
_REMEMBERED, _REMEMBERED_LENGTH, _PAIRS = 130_000, 64, 150_000

_SHORT, _NONE = 40, float("-inf")
#: Units of a text whose ids are put together at once.
_UNITS = 4096

codecs.register_error("each", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    """The pieces of one model file. Unknown characters are ids below zero until they become bytes."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [
            i
            for i in range(size)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on after a white-space mark; units cannot be cut there")
        letters = self._letters()
        self.units = re.compile(f"{MARK}*[{letters}]+|{MARK}*[^{MARK}{letters}]+|{MARK}+")
        self.found = ahocorasick.Automaton()
        # Only pieces that merging can build are ever part of an encoding.
        built = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        for piece, i in built.items():
            self.found.add_word(piece, i)
        self.found.make_automaton()
        self.size = [len(p) for p in self.pieces]
        #: Of each piece the next shorter one that begins it.
        self.shorter: list[int | None] = [None] * size
        for piece, i in built.items():
            self.shorter[i] = next((built[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in built), None)
        self.fits: dict[int, bool] = {}
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.control = {i for i in range(size) if sp.is_control(i)}
        shown = [p.replace(MARK, " ") for p in self.pieces]
        for i in range(size):
            if i in self.control:
                shown[i] = ""
            elif sp.is_unknown(i):
                shown[i] = " ⁇ "
        for b, i in enumerate(self.bytes):
            shown[i] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        self.shown = shown

    def _letters(self) -> str:
        """The Latin letters that no piece joins to any other character but a mark."""
        found = {c for p in self.ids for c in p if c.isalpha() and ord(c) < 0x250}
        while True:
            mixed = {
                c for p in self.ids for x, y in zip(p, p[1:]) if MARK not in (x, y) and (x in found) != (y in found)
                for c in (x, y)
            }
            if not mixed & found:
                return "".join(sorted(found)) or "\uffff"
            found -= mixed

    def merged(self, text: str) -> list[str]:
        """The pieces after merging by score, the leftmost first among equals."""
        if len(text) <= _SHORT:
            return self._merged_short(text)
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.scores:
                    heapq.heappush(queue, (-self.scores[both], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _merged_short(self, text: str) -> list[str]:
        """The same for few characters: looking through all pairs is quicker than keeping them in order."""
        parts, score = list(text), self.scores.get
        pairs = [score(a + b, _NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while pairs:
            best = max(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], _NONE)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        if left < 0 or right < 0:
            return True
        pair = left << 24 | right
        known = self.fits.get(pair)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = a + b not in self.ids and self.merged(a + b) == [a, b]
            if len(self.fits) >= _PAIRS:
                self.fits.clear()
            self.fits[pair] = known
        return known

    def backtracked(self, unit: str) -> list[int]:
        """Ids of a unit; unknown characters as -1 - code point."""
        size, shorter, compatible = self.size, self.shorter, self.compatible
        longest = [-1 - ord(c) for c in unit]
        for end, i in self.found.iter(unit):  # of the matches that begin at one place the longest ends last
            longest[end + 1 - size[i]] = i
        failed = bytearray(len(unit) // 8 + 1)  # one bit for each position
        places: list[int] = []
        taken: list[int] = []
        at, i = 0, longest[0]
        while True:
            while i is not None:
                to = at + (size[i] if i >= 0 else 1)
                if not failed[to >> 3] >> (to & 7) & 1 and (not taken or compatible(taken[-1], i)):
                    break
                i = shorter[i] if i >= 0 else None
            if i is None:
                failed[at >> 3] |= 1 << (at & 7)
                at, i = places.pop(), taken.pop()
                i = shorter[i] if i >= 0 else None
                continue
            places.append(at)
            taken.append(i)
            if to == len(unit):
                return taken
            at, i = to, longest[to]

    def unit(self, unit: str) -> bytes:
        """The ids of a unit as 32-bit numbers."""
        known = self.older.get(unit)
        if known is None:
            known = self._fresh(unit)
        if len(unit) <= _REMEMBERED_LENGTH:
            if len(self.remembered) >= _REMEMBERED:
                self.older, self.remembered = self.remembered, {}
            self.remembered[unit] = known
        return known

    def _fresh(self, unit: str) -> bytes:
        out = array("i")
        for i in self.backtracked(unit):
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass"))
        return out.tobytes()

    def encode(self, text: str, out: array) -> None:
        """Appends the ids of a whole text."""
        if text:
            unit, units = self.unit, self.units.findall(MARK + text.replace(" ", MARK))
            for k in range(0, len(units), _UNITS):
                known = self.remembered.get
                out.frombytes(b"".join([known(u) or unit(u) for u in units[k : k + _UNITS]]))

    def _shown(self, ids) -> str:
        shown = self.shown
        text = "".join([shown[i] for i in ids])
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "each")
        return text

    def decode(self, ids) -> str:
        if self.control.isdisjoint(ids):
            text = self._shown(ids)
        else:  # bytes on two sides of a control piece make no character
            groups = groupby(ids, lambda i: i in self.control)
            text = "".join(self._shown(list(g)) for control, g in groups if not control)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` of each whole text; a null or empty one has none. A column of that name is replaced.

    Repeated rows are encoded one by one.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own, flat, ends = model(path), array("i"), [0]
        for value in batch.column(text):
            own.encode(value.as_py() or "", flat)
            ends.append(len(flat))
        return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))}

    return with_columns_of(docs, make, [("ids", T.ArrayType(T.IntegerType()))])


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids; null ids give an empty text."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own, column = model(path), batch.column(ids)
        flat, at, texts = column.flatten().to_numpy(zero_copy_only=False), 0, []
        for length in column.value_lengths():
            n = length.as_py() or 0
            texts.append(own.decode(flat[at : at + n].tolist()))
            at += n
        return {"decoded": pa.array(texts, pa.string())}

    return with_columns_of(rows, make, [("decoded", T.StringType())])


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """What ``decode`` makes of ``encode``, in one step and with one model per task."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own, flat, ends, texts = model(path), array("i"), [0], []
        for value in batch.column(text):
            own.encode(value.as_py() or "", flat)
            texts.append(own.decode(flat[ends[-1] :]))
            ends.append(len(flat))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
        return {"ids": ids, "decoded": pa.array(texts, pa.string())}

    return with_columns_of(docs, make, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())])


def ids_digest(ids: str = "ids"):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
