"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merging a pre-token keeps its parts in a doubly linked list over byte positions. Every
adjacent pair whose concatenation is in the vocabulary is filed under its merge rank: a
bucket per rank holds list positions, a two-level bitmap marks the ranks with a bucket, and
find-first-set on it yields the lowest rank. Positions in a bucket are taken in text order.
An entry whose position has been merged away, or whose pair has changed since, is stale and
skipped. Push and pop cost O(1) bit operations, so a pre-token of n bytes takes O(n) of them
however long it is (plus ordering positions within a bucket).

Encoding matches each piece of the pattern separately; special strings are ordinary text.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are
encoded each; an empty table gives an empty result; further columns pass through, and those
named like a result column are replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from heapq import heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: Distinct pre-tokens whose ids a worker remembers before it starts afresh.
CACHE_ENTRIES = 150_000
#: New pre-tokens that share a rank queue.
MERGED_TOGETHER = 200_000
#: Bytes of Arrow data whose new pre-tokens are merged before any of it is encoded.
BATCH_BYTES = 24 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Positions by merge rank: a bucket a rank, and a bitmap of 256 ranks a word under a bitmap of words."""

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.add(rank, at)
        else:
            heappush(bucket, at)

    def add(self, rank: int, entry) -> None:
        """File an entry at the end of its bucket; a new bucket is marked in the bitmap."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [entry]
            hi = rank >> 8
            self.words[hi] = self.words.get(hi, 0) | 1 << (rank & 255)
            self.top |= 1 << hi
        else:
            bucket.append(entry)

    def lowest(self) -> int:
        """Find-first-set over both levels; -1 if no rank is marked."""
        top = self.top
        if not top:
            return -1
        hi = (top & -top).bit_length() - 1
        word = self.words[hi]
        return hi << 8 | (word & -word).bit_length() - 1

    def _unmark(self, rank: int) -> None:
        hi = rank >> 8
        word = self.words[hi] & ~(1 << (rank & 255))
        self.words[hi] = word
        if not word:
            self.top &= ~(1 << hi)

    def take(self) -> tuple[int, list] | None:
        """The lowest rank with its whole bucket."""
        rank = self.lowest()
        if rank < 0:
            return None
        self._unmark(rank)
        return rank, self.buckets.pop(rank)

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank with the lowest position in its bucket."""
        rank = self.lowest()
        if rank < 0:
            return None
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self._unmark(rank)
        return rank, at


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends, which is where the next one starts
    prev = list(range(-1, n - 1))
    due = [-1] * n  # rank under which the pair that starts here is filed; -1: none, or merged away
    queue = RankQueue()
    push, pop, get = queue.push, queue.pop, ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            due[i] = r
            push(r, i)
    while (found := pop()) is not None:
        rank, i = found
        if due[i] != rank:
            continue  # stale
        mid = end[i]
        stop = end[mid]
        end[i] = stop
        due[mid] = -1
        if stop < n:
            prev[stop] = i
            r = get(piece[i : end[stop]])
            if r is None:
                due[i] = -1
            else:
                due[i] = r
                push(r, i)
        else:
            due[i] = -1
        p = prev[i]
        if p >= 0:
            r = get(piece[p:stop])
            if r is None:
                due[p] = -1
            elif r != due[p]:
                due[p] = r
                push(r, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks, and the rank of every pair of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.none = max(ranks.values(), default=0) + 1
        self.shift = self.none.bit_length()
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = sorted(
            (left << self.shift | right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        )
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.found = np.array([r for _, r in pairs], np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of token pairs; ``none`` where they don't merge."""
        keys = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.found[at], np.int32(self.none))


def merge_many(pieces: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each pre-token, all merged through one rank queue: a bucket's positions are merged together.

    A pre-token whose own order could differ from that (two pairs of one rank overlap, or a
    merge makes a pair of lower rank) is left to :func:`merge`.
    """
    ranks, none = vocab.ranks, vocab.none
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    token = vocab.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    nxt, prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[ends - 1] = n
    prev[ends - lengths] = -1
    due = np.full(n + 1, none, np.int32)
    inner = np.flatnonzero(nxt < n).astype(np.int32)
    due[inner] = vocab.pair(token[inner], token[inner + 1])
    alone = np.zeros(len(pieces), bool)
    queue = RankQueue()

    def file(at: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True):
            queue.add(int(rank[i]), at[i:j])

    if len(start := inner[due[inner] < none]):
        file(start, due[start])
    while (found := queue.take()) is not None:
        rank, parts = found
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[due[at] == rank]  # the others are stale
        if not len(at):
            continue
        own = owner[at]
        mid = nxt[at]
        if (clash := due[mid] == rank).any():
            alone[own[clash]] = True
        if (skip := alone[own]).any():
            at, mid, own = at[~skip], mid[~skip], own[~skip]
            if not len(at):
                continue
        stop = nxt[mid]
        token[at] = rank
        nxt[at] = stop
        due[mid] = none
        due[at] = none
        has = stop < n
        a, b = at[has], stop[has]
        prev[b] = a
        before = prev[at]
        has = before >= 0
        left, right = np.concatenate((a, before[has])), np.concatenate((b, at[has]))
        if len(left):
            new = vocab.pair(token[left], token[right])
            due[left] = new
            live = new < none
            if live.any():
                left, new = left[live], new[live]
                if (lower := new < rank).any():
                    alone[owner[left[lower]]] = True
                file(left, new)
    heads = np.zeros(n, bool)
    heads[ends - lengths] = True
    # from each pre-token's first part along the list
    seen = np.flatnonzero(heads)
    while len(seen):
        seen = nxt[seen]
        seen = seen[seen < n]
        heads[seen] = True
    at = np.flatnonzero(heads)
    counts = np.bincount(owner[at], minlength=len(pieces))
    out = np.split(token[at], np.cumsum(counts)[:-1])
    for i in np.flatnonzero(alone).tolist():
        out[i] = np.array(merge(pieces[i], ranks), np.int64)
    return out


class _Index(dict):
    """Numbers pre-tokens as they turn up."""

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        return at


class Encoder:
    """Encoder of one vocabulary. Remembers the ids of the pre-tokens it has met."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocab = Vocabulary(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in self.vocab.ranks.items()}
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.flat = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.joined: list[str] = []

    def learn(self, texts: Iterable[str | None]) -> list[array]:
        """The numbers of each text's pre-tokens. New ones of all texts share a rank queue."""
        if len(self.index) > CACHE_ENTRIES:
            self._forget()
        number = self.index.__getitem__
        numbers = [array("i", map(number, self.find(t or ""))) for t in texts]
        while new := list(islice(self.index, len(self.joined), len(self.joined) + MERGED_TOGETHER)):
            self._add([x.encode() for x in new])
        return numbers

    def _add(self, new: list[bytes]) -> None:
        get = self.vocab.ranks.get
        whole = [get(x) for x in new]
        rest = [x for x, w in zip(new, whole, strict=True) if w is None]
        if len(rest) < 64:
            made = iter([merge(x, self.vocab.ranks) for x in rest])
        else:
            made = (x.tolist() for x in merge_many(rest, self.vocab))
        ids = [[w] if w is not None else next(made) for w in whole]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        self.joined += [" ".join(map(str, x)) for x in ids]

    def ids(self, numbers: list[array]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's, from :meth:`learn`'s numbers."""
        at = np.concatenate([np.frombuffer(x, np.int32) for x in numbers]) if numbers else np.empty(0, np.int32)
        start = self.starts[at]
        size = self.starts[at + 1] - start
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.cumsum([0, *map(len, numbers)])]

    def decimals(self, numbers: list[array]) -> list[str]:
        """Each text's ids in decimal, joined by spaces."""
        joined = self.joined.__getitem__
        return [" ".join(map(joined, x)) for x in numbers]

    def encode(self, text: str) -> list[int]:
        return self.ids(self.learn([text]))[0].tolist()

_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary; one is kept between tasks."""
    if (key := (path, pattern)) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


def encode(
    docs: DataFrame,
    vocab: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    joined: str | None = None,
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the array of token ids of ``text`` in column ``ids``. No shuffle.

    ``joined`` names one more column: the ids in decimal, joined by spaces. ``decoded`` names a
    column for the bytes that the ids are decoded to, as :func:`decode` does, in the same pass.
    """
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if joined:
        fields.append(T.StructField(joined, T.StringType()))
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))

    def make():
        own = encoder(vocab, pattern)
        bytes_of = own.bytes_of.__getitem__
        numbers: list[array] = []

        def learn(texts: Iterable[str | None]) -> None:
            numbers[:] = own.learn(texts)

        def run(texts: list[str | None]) -> list[pa.Array]:
            these = numbers[: len(texts)]
            del numbers[: len(texts)]
            flat, offsets = own.ids(these)
            out = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
            if joined:
                out.append(pa.array(own.decimals(these), pa.string()))
            if decoded:
                parts = (flat[i:j].tolist() for i, j in pairwise(offsets))
                out.append(pa.array([b"".join(map(bytes_of, p)) for p in parts], pa.binary()))
            return out

        run.ahead = learn
        return run

    return add_columns(docs, text, fields, make, ahead_bytes=BATCH_BYTES)


def decode(df: DataFrame, vocab: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in column ``out``; an unknown or null id is an error."""

    def make():
        get = {i: b for b, i in load_ranks(vocab).items()}.__getitem__
        return lambda rows: [pa.array([b"".join(map(get, r or ())) for r in rows], pa.binary())]

    return add_columns(df, ids, [T.StructField(out, T.BinaryType())], make)
