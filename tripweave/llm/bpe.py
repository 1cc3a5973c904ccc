"""Byte-level BPE with a hierarchical-bitmap rank queue.

All pieces to encode lie end to end in one linked list of symbols, links ending at piece
borders. Every position whose pair with its successor can merge sits in the bucket of that
merge's rank, and a bitmap in three levels of 64-bit words marks the buckets in use: three
find-first-set steps give the next rank. Taking a bucket merges its positions at once; entries
whose pair has changed meanwhile are stale and skipped, and new pairs go to their buckets. Ranks
are unique, so pieces do not disturb each other and one queue serves a whole batch; a very long
piece costs no more per symbol than a short one.

A merge could only form a pair of lower rank if the vocabulary was not grown in rank order; for
such ranks just the first position per piece is merged before the queue is asked again, so the
result is always that of merging the leftmost pair of lowest rank, one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import field
from .lexicon import Lexicon

_TOOLS: dict[str, tuple["Bpe", Lexicon]] = {}

#: Letters, numbers and white space up to U+024F, for the standard library's faster matcher.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\\t-\\r \x85\xa0"
_PLAIN = re.compile("[^ɐ-\U0010ffff]*")


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap."""

    def __init__(self):
        self.top, self.middle, self.low = 0, [0] * 64, [0] * 4096
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[starts[:-1]].tolist(), starts, starts[1:]):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        first = (self.top & -self.top).bit_length() - 1
        word = self.middle[first]
        second = first << 6 | (word & -word).bit_length() - 1
        word = self.low[second]
        rank = second << 6 | (word & -word).bit_length() - 1
        self.low[second] &= ~(1 << (rank & 63))
        if not self.low[second]:
            self.middle[first] &= ~(1 << (second & 63))
            if not self.middle[first]:
                self.top &= ~(1 << first)
        found = self.buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)

    def __bool__(self) -> bool:
        return bool(self.top)


class Bpe:
    """A vocabulary of byte strings by rank; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        if max(ranks.values()) >= 1 << 18:
            raise ValueError("the queue holds ranks below 2**18")
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.plain = None
        if pattern == public_tokenizers.PATTERN:
            shaped = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
            self.plain = re.compile(shaped.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
            # Python's \s also takes U+001C to U+001F, which are not White_Space
            self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.text = {rank: token for token, rank in ranks.items()}
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 18 | right] = rank
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], dtype=np.int64)
        uneven = (self.merged < self.pairs >> 18) | (self.merged < (self.pairs & (1 << 18) - 1))
        parts = self.pairs[uneven]
        self.backward = {int(x) for x in np.concatenate([parts >> 18, parts & (1 << 18) - 1])}

    @classmethod
    def load(cls, path: str) -> "Bpe":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def split(self, text: str) -> list[str]:
        if self.plain is not None and _PLAIN.fullmatch(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols, -1 for none."""
        key = left << 18 | right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.merged[at], -1) if len(self.pairs) else np.full(len(key), -1)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per piece; a piece that is a token is that token."""
        raw = [p.encode("utf-8") for p in pieces]
        whole = np.array([self.ranks.get(r, -1) for r in raw], dtype=np.int64)
        open_ = np.flatnonzero(whole < 0)
        flat, lengths = self.merge([raw[i] for i in open_.tolist()])
        counts = np.ones(len(raw), dtype=np.int64)
        counts[open_] = lengths
        out = np.empty(int(counts.sum()), dtype=np.int64)
        starts = np.cumsum(counts) - counts
        known = whole >= 0
        out[starts[known]] = whole[known]
        owned = np.repeat(~known, counts)
        out[owned] = flat
        return out, counts

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        n = int(sizes.sum())
        if not n:
            return np.zeros(0, dtype=np.int64), sizes
        symbol = self.single[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(raw)), sizes)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends = np.cumsum(sizes) - 1
        ends = ends[sizes > 0]
        after[ends] = -1
        before[(ends - sizes[sizes > 0] + 1)] = -1
        current = np.full(n, -1, dtype=np.int64)
        joint = np.flatnonzero(after >= 0)
        current[joint] = self._rank(symbol[joint], symbol[after[joint]])
        alive = np.ones(n, dtype=bool)
        queue = RankQueue()
        start = np.flatnonzero(current >= 0)
        if len(start):
            queue.push_all(current[start], start)
        while queue:
            rank, at = queue.pop()
            at = at[current[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                if rank in self.backward:
                    first = np.ones(len(at), dtype=bool)
                    first[1:] = piece[at[1:]] != piece[at[:-1]]
                    if not first.all():
                        queue.push(rank, at[~first])
                        at = at[first]
                else:
                    chained = np.zeros(len(at), dtype=bool)
                    chained[1:] = at[1:] == after[at[:-1]]
                    if chained.any():  # overlapping pairs of one symbol: every other one from the left
                        index = np.arange(len(at))
                        heads = np.maximum.accumulate(np.where(chained, 0, index))
                        at = at[(index - heads) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbol[at] = rank
            alive[gone] = False
            current[gone] = -1
            after[at] = follow
            linked = follow >= 0
            before[follow[linked]] = at[linked]
            current[at] = -1
            previous = before[at]
            previous = previous[previous >= 0]
            touched = np.concatenate([at[linked], previous])
            if len(touched):
                if len(at) > 1:
                    touched = np.unique(touched)
                fresh = self._rank(symbol[touched], symbol[after[touched]])
                current[touched] = fresh
                good = fresh >= 0
                if good.any():
                    if len(touched) <= 2:
                        for r, p in zip(fresh[good].tolist(), touched[good].tolist()):
                            queue.push(r, np.array([p]))
                    else:
                        queue.push_all(fresh[good], touched[good])
        return symbol[alive], np.bincount(piece[alive], minlength=len(raw))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text.__getitem__, ids.tolist()))


def tools(path: str) -> tuple[Bpe, Lexicon]:
    if path not in _TOOLS:
        bpe = Bpe.load(path)
        _TOOLS[path] = bpe, Lexicon(bpe.encode_pieces)
    return _TOOLS[path]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row, the last from decoding the ids.

    Null and empty texts have no tokens. Repeated rows, null ids and columns of any name are
    fine; an empty table gives an empty result. ``with_ids`` adds ``ids`` array<int>.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = tools(path)
        for batch in batches:
            flat, stops = known.ids(bpe.split(t or "") for t in batch.column(1).to_pylist())
            counts, digests, decoded, parts, begin = [], [], [], [], 0
            for stop in stops.tolist():
                ids = flat[begin:stop]
                begin = stop
                counts.append(len(ids))
                digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    parts.append(ids.astype(np.int32))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(field(doc_id).cast("long").alias("doc_id"), field(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
