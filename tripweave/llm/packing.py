"""Token sequences of a fixed length, packed online by sums of squares.

Every task streams its documents once. A document longer than a sequence fills whole sequences
first; its rest goes to an open sequence of the fill level that makes the sum of squared counts
of open sequences per level smallest (or opens one), so levels that are hard to complete never
pile up. A level array holds the counts. When the input ends, the few open sequences are cut
anew: their pieces, end to end, fill whole sequences, and what is left becomes sequences of the
powers of two that sum to it, which need no padding. Tasks share nothing, so a lost task is
simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, slices
from .lexicon import Lexicon

LENGTH, END_ID = 4096, 2

#: A mark between the words of one call to the tokenizer; no merge crosses white space.
MARK = "\x01"

_LEXICONS: dict[str, Lexicon] = {}


def word_encoder(path: str):
    """Ids of words (UTF-8, free of ASCII white space) by the tokenizer file at ``path``.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    words; many words go through it in one call, a marked word between each two.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids

    def one(word: str) -> np.ndarray:
        return np.array(tokenizer.encode(word, add_special_tokens=False).ids, dtype=np.int64)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [], []
        for at in range(0, len(words), 20_000):
            group = [w.decode("utf-8") for w in words[at : at + 20_000]]
            odd = [i for i, w in enumerate(group) if MARK in w]
            safe = ["" if MARK in w else w for w in group]
            ids = np.array(tokenizer.encode_batch_fast([f" {MARK} ".join([*safe, ""])], add_special_tokens=False)[0].ids, dtype=np.int64)
            stops = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else []
            if len(stops) != len(group):
                parts = [one(w) for w in group]
            else:
                parts = np.split(ids, stops)[:-1]
                parts = [p[1:] if i else p for i, p in enumerate(parts)]
                for i in odd:
                    parts[i] = one(group[i])
            lengths.append(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
            flat.extend(parts)
        return np.concatenate(flat), np.concatenate(lengths)

    return encode


def lexicon(path: str) -> Lexicon:
    if path not in _LEXICONS:
        _LEXICONS[path] = Lexicon(word_encoder(path))
    return _LEXICONS[path]


class Packer:
    """Open sequences by fill level. A piece is ``(doc, start, ids, doc_tokens)``."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels = np.zeros(length + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def _level(self, size: int) -> int:
        """The level whose choice adds least to the sum of squares; 0 opens a sequence."""
        best, least = 0, 2 * int(self.levels[size]) + 1
        levels = np.flatnonzero(self.levels[1 : self.length - size + 1]) + 1
        if len(levels):
            after = levels + size
            change = 1 - 2 * self.levels[levels] + np.where(after < self.length, 2 * self.levels[after] + 1, 0)
            at = len(change) - 1 - int(change[::-1].argmin())  # of equals the fullest
            if change[at] <= least:
                best = int(levels[at])
        return best

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        """Sequences (lists of pieces) that this document completes."""
        total, start = len(ids), 0
        while total - start >= self.length:
            yield [(doc, start, ids[start : start + self.length], total)]
            start += self.length
        size = total - start
        if not size:
            return
        level = self._level(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
        pieces.append((doc, start, ids[start:].copy(), total))
        if level + size == self.length:
            yield pieces
        else:
            self.open.setdefault(level + size, []).append(pieces)
            self.levels[level + size] += 1

    def close(self) -> Iterator[list]:
        """What is open, cut anew into whole sequences and powers of two."""
        pieces = [piece for level in sorted(self.open, reverse=True) for sequence in self.open[level] for piece in sequence]
        left = sum(len(p[2]) for p in pieces)
        self.open, self.levels[:] = {}, 0
        queue = iter(pieces)
        piece = next(queue, None)
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            sequence = []
            while room:
                doc, start, ids, total = piece
                sequence.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    piece, room = (doc, start + room, ids[room:], total), 0
                else:
                    piece, room = next(queue, None), room - len(ids)
            yield sequence


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where it comes from, its ids' checksum and its place in a sequence.

    A document is its text's ids (null: none) and the end id; whole texts are read. Repeated rows
    are documents of their own, a null doc_id stays null, an empty table gives no pieces and
    other columns are ignored. ``with_ids`` adds the ids themselves (``ids`` array<int>).
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = lexicon(path), Packer(length)
        number = TaskContext.get().partitionId() << 36
        end = np.array([end_id], dtype=np.uint32)

        def rows(sequences: list[list]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in range(7)]
            ids = []
            for sequence in sequences:
                at = 0
                for doc, start, part, total in sequence:
                    for column, value in zip(columns, (doc, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, number, at)):
                        column.append(value)
                    at += len(part)
                    if with_ids:
                        ids.append(part.astype(np.int32))
                number += 1
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            names = [*SCHEMA.replace(" long", "").split(", "), *(["ids"] if with_ids else [])]
            return pa.RecordBatch.from_arrays(arrays, names)

        for whole in batches:
            for batch in slices(whole, "text"):
                names = batch.column(0).to_pylist()
                flat, stops = known.ids([(t or "").encode("utf-8").split() for t in batch.column(1).to_pylist()])
                done, begin = [], 0
                for name, stop in zip(names, stops.tolist()):
                    done.extend(packer.add(name, np.concatenate([flat[begin:stop], end])))
                    begin = stop
                if done:
                    yield rows(done)
        rest = list(packer.close())
        if rest:
            yield rows(rest)

    rows = docs.select(field(doc_id).cast("long").alias("doc_id"), field(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(tokens, padding)`` of packed pieces; a sequence of a power of two is not padded."""
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    spare = F.when(F.bit_count("n") == 1, F.lit(0)).otherwise(length - F.col("n"))
    return full.agg(F.sum("n").alias("tokens"), F.sum(spare).alias("padding"))
