"""Packing token sequences by first-fit decreasing in randomised groups.

A document's ids (and an end id) are cut into full sequences from its start; what is left over,
always shorter than a sequence, is packed. Leftovers are dealt to groups of about ``group_docs``
by a hash of the row's number, so that groups look alike whatever key is hot, and each group is
packed alone: leftovers in order of falling length go to the first bin with room, found in a
tournament tree of bin capacities, whose inner nodes hold the largest capacity below them.

First fit leaves gaps, and documents may be cut, so gaps of ``least`` tokens or more are then
filled from the group's emptiest bins. One bin of the group stays open; it is cut into
sequences of a power of two, which need no padding.

Ids of texts come from their chunks between spaces, each encoded by the library once: no
pre-token of a vocabulary with word ends holds a space, nor does normalisation or an added
token reach across one. Chunks of plain Latin letters and signs are split on into the file's own
pre-tokens in lower case, of which there are far fewer. Files for which this can't be seen from
their settings are encoded whole.

Only leftovers cross the network, as 2 or 4 bytes an id; of full sequences their check sums do.
The token table is written first, so that row numbers hold if a task runs again.

Defined results: null and empty texts consist of the end id alone; repeated rows are packed each;
rows of one length are in order of id, nulls first, and then of row number; an empty table
gives an empty result; columns other than the id and the text aren't looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces

LENGTH, GROUP_DOCS, LEAST = 2048, 1024, 8
#: Distinct chunks and pre-tokens a worker remembers, characters split and encoded at a time.
CHUNKS, WORDS, WINDOW, CALL_CHUNKS = 1_200_000, 1_500_000, 1 << 20, 20_000
#: Pre-tokens in one call's text.
RUN_WORDS = 128
PIECE_BYTES = 8 << 20


class Numbers(dict):
    """Numbers keys as they turn up."""

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        return at


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at these numbers, one after the other."""
    many = size[at]
    ends = np.cumsum(many)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - ends + many, many)]


def flat(made: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists' lengths, and their numbers one after the other."""
    size = np.fromiter(map(len, made), np.int64, len(made))
    return size, np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum()))


class WordIds:
    """Ids of chunks as those of their pre-tokens in lower case, where a chunk has none but these characters; others at once.

    The library is given runs of pre-tokens with spaces between, whose ids are told apart by those that end a word.
    """

    plain = re.compile(r"[\t\n\r\x21-\x7E\xA1-\xAC\xAE-\xFF]*").fullmatch

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pattern: str, ends: np.ndarray) -> None:
        self.encode, self.find, self.ends = encode, regex.compile(pattern).findall, ends
        self._forget()

    def _forget(self) -> None:
        self.index, self.flat, self.start, self.size = Numbers(), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [(np.empty(0, np.int64), np.empty(0, np.uint32))]
        runs = [words[i : i + RUN_WORDS] for i in range(0, len(words), RUN_WORDS)]
        for run, ids in zip(runs, self.encode([" ".join(r) for r in runs]), strict=True):
            ids = np.array(ids, np.uint32)
            size = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            made.append((size, ids) if len(size) == len(run) and size.sum() == len(ids) else flat(self.encode(run)))
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > WORDS:
            self._forget()
        number, words, many = self.index.__getitem__, array("i"), []
        split = np.array([bool(self.plain(c)) and "<|" not in c for c in chunks], bool)
        for c in compress(chunks, split):
            found = self.find(c.lower())
            words.extend(map(number, found))
            many.append(len(found))
        size, ids = self._apart(list(islice(self.index, len(self.size), None)))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, ids))
        at = np.frombuffer(words, np.int32)
        ends = np.append(0, np.cumsum(self.size[at]))[np.append(0, np.cumsum(many, dtype=np.int64))]
        whole_size, whole_ids = flat(self.encode(list(compress(chunks, ~split))))
        sizes = np.empty(len(chunks), np.int64)
        sizes[split], sizes[~split] = np.diff(ends), whole_size
        where = np.repeat(split, sizes)
        out = np.empty(len(where), np.uint32)
        out[where], out[~where] = gather(self.flat, self.start, self.size, at), whole_ids
        return sizes, out


class ChunkIds:
    """Ids of texts as those of their chunks between spaces; ``encode`` gives lengths and ids of chunks."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self._forget()

    def _forget(self) -> None:
        self.index, self.flat, self.start, self.size = Numbers(), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        new = list(islice(self.index, len(self.size), None))
        for i in range(0, len(new), CALL_CHUNKS):
            size, ids = self.encode(new[i : i + CALL_CHUNKS])
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, ids))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CHUNKS:
            self._forget()
        number = self.index.__getitem__
        rows = []
        for text in texts:
            row, at = array("i"), 0
            while at <= len(text):
                cut = text.find(" ", at + WINDOW) if len(text) - at > WINDOW else -1
                cut = len(text) if cut < 0 else cut
                row.extend(map(number, text[at:cut].split(" ")))
                at = cut + 1
            rows.append(row)
        self._learn()
        return [gather(self.flat, self.start, self.size, np.frombuffer(r, np.int32)) for r in rows]


class Encoder:
    """Ids by the library for the file, as arrays."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tokenizers

        tok = tokenizers.Tokenizer.from_file(path)
        self.dtype = "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
        whole = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        # pre-tokens are matches between what is removed, and the pattern has no place for white space
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        splits = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s.get("invert")]
        apart = bool(splits) and not any(" " in t["content"] for t in said["added_tokens"]) and not model.get("dropout")
        apart = apart and not tok.encode("  ", add_special_tokens=False).ids
        marks = ("<|" in t["content"] for t in said["added_tokens"])
        kinds = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        lowers = apart and len(splits) == 1 and kinds == ["NFC", "Replace", "Lowercase"] and "Regex" in splits[0]["pattern"] and all(marks)
        suffix = model.get("end_of_word_suffix")
        if lowers and suffix:
            ends = np.zeros(max(tok.get_vocab().values()) + 1, bool)
            ends[[i for token, i in tok.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
            parts = WordIds(whole, splits[0]["pattern"]["Regex"], ends)
        else:
            parts = lambda texts: flat(whole(texts))
        self.ids = ChunkIds(parts) if apart else lambda texts: [np.array(x, np.uint32) for x in whole(texts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; one is kept between tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def first_fit(sizes: list[int], room: int) -> list[int]:
    """The bin of each size, for sizes in falling order: the first with capacity left."""
    width = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [room] * (2 * width)  # a leaf is a bin's capacity, a node the larger of its two
    out = []
    for need in sizes:
        at = 1
        while at < width:
            at *= 2
            if tree[at] < need:
                at += 1
        out.append(at - width)
        tree[at] -= need
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return out


def packed(sizes: list[int], room: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in it, length), for sizes in falling order, all at most ``room``."""
    bins: list[list[tuple[int, int, int]]] = []
    for item, b in enumerate(first_fit(sizes, room)):
        if b == len(bins):
            bins.append([])
        bins[b].append((item, 0, sizes[item]))
    held = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-held[b], b))
    done, lo, hi = [], 0, len(order) - 1
    while lo < hi:
        b, giver = order[lo], order[hi]
        gap = room - held[b]
        if gap < least:
            done.append(bins[b])
            lo += 1
            continue
        item, start, size = bins[giver].pop()
        cut = min(gap, size)  # the piece's end goes, its start stays where it is
        bins[b].append((item, start + size - cut, cut))
        held[b] += cut
        held[giver] -= cut
        if cut < size:
            bins[giver].append((item, start, size - cut))
        if not bins[giver]:
            hi -= 1
    if lo == hi:
        last, n = bins[order[lo]], held[order[lo]]
        while n and room - n >= least:
            take = 1 << (n.bit_length() - 1)
            n -= take
            part = []
            while take:
                item, start, size = last.pop()
                cut = min(take, size)
                part.append((item, start + size - cut, cut))
                take -= cut
                if cut < size:
                    last.append((item, start, size - cut))
            done.append(part)
        if last:
            done.append(last)
    return done


def pack(
    docs: DataFrame,
    vocab: str,
    ident: str = "doc_id",
    text: str = "text",
    end: int = 1,
    length: int = LENGTH,
    group_docs: int = GROUP_DOCS,
    least: int = LEAST,
    ids: bool = False,
) -> DataFrame:
    """Pieces: ``ident``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``vocab``: path of a vocabulary file on every executor; ``end``: the id after each document.
    ``ids``: also the piece's ids, which then all cross the network. Positions count ids.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab)
        for b in (p for whole in batches for p in pieces(whole, PIECE_BYTES)):
            n, crcs, body = [], [], []
            for x in own.ids([t or "" for t in b.column(1).to_pylist()]):
                x = np.append(x, np.uint32(end)).astype("<u4")
                full = len(x) // length * length
                n.append(len(x))
                crcs.append([zlib.crc32(x[i : i + length].tobytes()) for i in range(0, full, length)])
                body.append((x if ids else x[full:]).astype(own.dtype).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(body, pa.binary()), pa.array([own.dtype] * len(n))],
                names=["id", "n", "crcs", "body", "kind"],
            )

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        rows.sort(key=lambda r: (-(r["n"] % length), r["id"] is not None, 0 if r["id"] is None else r["id"], r["row"]))
        out: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else []))}
        sequence = key[0].as_py() << 32

        def put(r: dict, start: int, size: int, crc: int, offset: int, own: np.ndarray | None) -> None:
            made = (r["id"], start, size, crc, r["n"], sequence, offset, *([own.tolist()] if ids else []))
            for column, x in zip(out.values(), made, strict=True):
                column.append(x)

        bodies = [np.frombuffer(r["body"], r["kind"]).astype("<u4") for r in rows]
        for r, body in zip(rows, bodies, strict=True):
            for i, crc in enumerate(r["crcs"]):
                put(r, i * length, length, crc, 0, body[i * length : (i + 1) * length])
                sequence += 1
        for made in packed([r["n"] % length for r in rows if r["n"] % length], length, least):
            offset = 0
            for item, start, size in made:
                r, body = rows[item], bodies[item]
                first = len(body) - r["n"] % length + start
                own = body[first : first + size]
                put(r, r["n"] // length * length + start, size, zlib.crc32(own.tobytes()), offset, own)
                offset += size
            sequence += 1
        kinds = [t.schema.field("id").type, *[pa.int64()] * 6, *([pa.list_(pa.int64())] if ids else [])]
        return pa.table([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], names=list(out))

    kind = docs.select(ident).schema[0].dataType.simpleString()
    read = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text"))
    made = read.mapInArrow(tokens, f"id {kind}, n long, crcs array<long>, body binary, kind string")
    table = materialise(made.withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    groups = max(1, -(-table.count() // group_docs))
    dealt = table.withColumn("g", F.pmod(F.xxhash64(F.lit("pack"), "row"), F.lit(groups)))
    schema = f"`{ident}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if ids else "")

    def named(key: tuple, t: pa.Table) -> pa.Table:
        out = fill(key, t)
        return out.rename_columns([ident, *out.column_names[1:]])

    return dealt.groupBy("g").applyInArrow(named, schema)
