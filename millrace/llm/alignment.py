"""Cross-tokenizer alignment, and how often its linked id pairs are linked.

A text with a space before it is encoded by two tokenizers. Each byte gets a label: none, end
of an A token, end of a B token, or both. A regular expression then scans the label string for
spans up to each both-label; in such a span, which is a token group, the number of A-labels and
that of B-labels, each with the last one, say how many tokens of either side it takes. All A-B
pairs of a group are links.

Both tokenizers work chunk by chunk. A chunk ends before a space, unless white space stands before
that, and between a Latin letter and a sign: no pre-token of A and no piece of B (this is looked
up in the vocabulary) reaches across such a place. So each distinct chunk is encoded, labelled and
scanned once a worker, and a text's groups are those of its chunks. Texts with a chunk whose
bytes either side doesn't give back are tried as a whole, and have no tokens if that fails too.

A pair's count is the number of documents that hold it linked. Workers add counts up over all their
documents before anything crosses the network. The pairs with the largest counts, ``head`` of
them at most, are then broadcast; where there are more, documents carry what they have of
the others to an ordinary join. So neither memory nor the driver's share grows with the corpus,
and no pair is left out.

A group's links are held as its distinct pairs: where two tokenizers share no boundary for long,
that is the product of the distinct ids of both sides, whatever the length.

Defined results: null and empty texts have no tokens; repeated rows are documents of their own; an
empty table gives an empty result; further columns pass through, and those named like a result
column are replaced.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialise, pieces, without
from .packing import Numbers, gather

HEAD = 1_000_000
#: Chunks and characters of chunks a worker remembers before it starts afresh, and bytes of rows that share a batch.
CHUNKS, CHUNK_CHARS, CALL_CHUNKS, BATCH_BYTES = 800_000, 16 << 20, 10_000, 8 << 20
#: Chunks in one text for A.
RUN_CHUNKS = 64
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
LETTER, SIGN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"
#: A character and what follows it, up to a space behind something else than white space or a sign behind a letter.
CHUNK = re.compile(rf"(?s:.)(?:[^ {SIGN}]++|(?<![{LETTER}])[{SIGN}]++|(?<=\s) ++)*+")
NONE, A_END, B_END, BOTH = b"nabx"
SPAN = re.compile(rb"[nab]*+x")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers: ids of texts that begin with a space, and the bytes of each id."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        tok = tokenizers.Tokenizer.from_file(a)
        tok.encode_special_tokens = True
        self.whole = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in s) for s, i in tok.get_vocab(with_added_tokens=False).items()}
        self.a_size = np.zeros(max(tok.get_vocab().values()) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        sp = sentencepiece.SentencePieceProcessor(model_file=b)
        said = [sp.id_to_piece(i).replace("▁", " ") for i in range(sp.get_piece_size())]
        self.b_bytes = [bytes([int(s[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else s.encode() for i, s in enumerate(said)]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # the library adds a space to a text, which stands for that of a chunk; it adds none to nothing, and a letter goes before a sign
        space, letter = sp.piece_to_id("▁"), sp.encode("a")

        def b(texts: list[str]) -> list[list[int]]:
            made = sp.encode([t[1:] if t[0] == " " else "a" + t for t in texts], num_threads=1)
            return [[space] if t == " " else x if t[0] == " " else x[1:] for x, t in zip(made, texts, strict=True)]

        self.b = b
        plain = [s for i, s in enumerate(said) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if len(letter) != 1 or any(re.search(rf"\S |[{LETTER}][{SIGN}]", s) for s in plain):
            raise ValueError("a piece of B reaches across the end of a chunk")

    def a(self, texts: list[str]) -> list[list[int]]:
        """A's ids of chunks. Those from a space to no white space can follow each other, so the library gets runs of them as one text."""
        out: list[list[int] | None] = [None] * len(texts)
        apart = [i for i, t in enumerate(texts) if t[0] == " " and not t[-1].isspace()]
        runs = [apart[i : i + RUN_CHUNKS] for i in range(0, len(apart), RUN_CHUNKS)]
        for run, ids in zip(runs, self.whole(["".join([texts[i] for i in r]) for r in runs]), strict=True):
            ends = np.cumsum(self.a_size[ids])
            want = np.cumsum([len(texts[i].encode()) for i in run])
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
                start = 0
                for i, end in zip(run, (at + 1).tolist(), strict=True):
                    out[i] = ids[start:end]
                    start = end
        rest = [i for i, x in enumerate(out) if x is None]  # also of runs whose bytes A doesn't give back
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


def labels(a_sizes: np.ndarray, b_sizes: np.ndarray) -> bytes:
    """The label of each byte, from the byte counts of both sides' tokens."""
    out = np.full(int(a_sizes.sum()), NONE, np.uint8)
    a, b = np.cumsum(a_sizes) - 1, np.cumsum(b_sizes) - 1
    out[a] = A_END
    out[b] = np.where(out[b] == A_END, BOTH, B_END)
    return out.tobytes()


def groups(a_ids: list[int], b_ids: list[int], spans: list[bytes]) -> Iterator[tuple]:
    """The ids of both sides in the token group of each span of labels; bare ids where it has one of each."""
    i = j = 0
    for span in spans:
        if span.count(NONE) == len(span) - 1:
            yield a_ids[i], b_ids[j]
            i, j = i + 1, j + 1
            continue
        u, v = i + span.count(A_END) + 1, j + span.count(B_END) + 1
        yield a_ids[i:u], b_ids[j:v]
        i, j = u, v


class Aligner:
    """What a worker knows of chunks: token and group counts, links by pair, and the groups as text."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.index, self.pairs, self.chars = Numbers(), Numbers(), 0
        self.text: list[str | None] = []  # None: the sides' bytes differ
        self.sizes = np.empty((0, 3), np.int64)  # A tokens, B tokens, groups
        self.start = self.size = np.empty(0, np.int64)
        self.flat = np.empty((0, 2), np.int64)  # number of the pair, links

    def full(self) -> bool:
        return len(self.index) > CHUNKS or self.chars > CHUNK_CHARS

    def keys(self) -> np.ndarray:
        """A id and B id of each pair in one number."""
        return np.fromiter(self.pairs, np.int64, len(self.pairs))

    def _same(self, chunk: str, a: list[int], b: list[int]) -> int:
        """The chunk's bytes if both sides give them back, else 0."""
        self.chars += len(chunk)
        raw, of_a, of_b = chunk.encode(), self.pair.a_bytes, self.pair.b_bytes
        return len(raw) if b"".join([of_a[x] for x in a]) == raw == b"".join([of_b[x] for x in b]) else 0

    def _learn(self) -> None:
        new, number = list(islice(self.index, len(self.text), None)), self.pairs.__getitem__
        for at in range(0, len(new), CALL_CHUNKS):
            chunks = new[at : at + CALL_CHUNKS]
            sizes, many, flat, counts = [], [], [], []
            every_a, every_b, end = self.pair.a(chunks), self.pair.b(chunks), 0
            same = [self._same(*z) for z in zip(chunks, every_a, every_b, strict=True)]
            good = [[x for ids, s in zip(every, same, strict=True) if s for x in ids] for every in (every_a, every_b)]
            label = labels(self.pair.a_size[np.array(good[0], np.int64)], self.pair.b_size[np.array(good[1], np.int64)])
            for raw, a, b in zip(same, every_a, every_b, strict=True):
                if not raw:
                    self.text.append(None)
                    sizes.append((0, 0, 0))
                    many.append(0)
                    continue
                links: dict[int, int] = {}
                said = []
                start, end = end, end + raw
                for x, y in groups(a, b, SPAN.findall(label, start, end)):
                    if x.__class__ is int:
                        said.append(f"{x}|{y}")
                        key = x << 32 | y
                        links[key] = links.get(key, 0) + 1
                        continue
                    said.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
                    ys = Counter(y).items() if len(y) > 1 else ((y[0], 1),)
                    for p, m in Counter(x).items() if len(x) > 1 else ((x[0], 1),):
                        for q, n in ys:
                            key = p << 32 | q
                            links[key] = links.get(key, 0) + m * n
                self.text.append(";".join(said))
                sizes.append((len(a), len(b), len(said)))
                many.append(len(links))
                flat.extend(map(number, links))
                counts.extend(links.values())
            size = np.array(many, np.int64)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.sizes = np.concatenate((self.sizes, np.array(sizes, np.int64).reshape(-1, 3)))
            self.flat = np.concatenate((self.flat, np.array([flat, counts], np.int64).T))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's chunks; none if it has no tokens."""
        number = self.index.__getitem__

        def split(text: str) -> array:
            said = " " + text
            return array("i", map(number, CHUNK.findall(said) if len(said) < 1 << 20 else (m[0] for m in CHUNK.finditer(said))))

        rows = [split(t) if t else array("i") for t in texts]
        self._learn()
        out = []
        for text, row in zip(texts, rows, strict=True):
            at = np.frombuffer(row, np.int32)
            if not self.sizes[at, 2].all():  # a chunk without groups is one whose bytes differ
                at = np.array([number(" " + text)], np.int32)
                self._learn()
                if self.text[at[0]] is None:
                    at = at[:0]
            out.append(at)
        return out

    def linked(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the pair, links) of each pair that a row holds linked, in order of rows."""
        at = np.concatenate(rows) if rows else np.empty(0, np.int32)
        many = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        got = gather(self.flat, self.start, self.size, at)
        key = np.repeat(many, self.size[at]) << 32 | got[:, 0]
        order = np.argsort(key, kind="stable")
        key, links = key[order], got[order, 1]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(links, first) if len(first) else links


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The worker's aligner; what it knows of chunks is kept between tasks."""
    if (a, b) not in _aligners:
        _aligners.clear()
        _aligners[a, b] = Aligner(Pair(a, b))
    return _aligners[a, b]


def pair_counts(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(pair, n, best): documents that hold a pair (A id << 32 | B id) linked; ``best``: no pair of its A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        held = np.zeros(0, np.int64)

        def made() -> pa.RecordBatch:
            some = np.flatnonzero(held)
            return pa.RecordBatch.from_arrays([pa.array(own.keys()[some]), pa.array(held[some])], names=["pair", "n"])

        for batch in (p for whole in batches for p in pieces(whole, BATCH_BYTES)):
            if own.full():
                yield made()
                own.forget()
                held = np.zeros(0, np.int64)
            _, pair, _ = own.linked(own(batch.column(0).to_pylist()))
            held = np.concatenate((held, np.zeros(len(own.pairs) - len(held), np.int64))) + np.bincount(pair, minlength=len(own.pairs))
        yield made()

    parts = docs.select(F.col(f"`{text}`")).mapInArrow(count, "pair long, n long")
    sums = materialise(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts", narrow=True)
    most = sums.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return sums.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, text: str = "text", head: int = HEAD, groups: str | None = None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256.

    ``a``: path of a byte-level vocabulary file, ``b``: of a sentencepiece model, on every executor.
    n_best: links whose pair has the most documents of all pairs of its A id; count_sum: of all links'
    pairs. ``groups``: name of a column for the groups themselves, as ``a1,a2|b1;a3|b2,b3``.
    """
    pairs = materialise(pair_counts(docs, a, b, text), "pairs", narrow=True)
    # the least power of two such that no more than ``head`` pairs count as many or more
    bar, room = 1 << 62, head
    for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().orderBy(F.desc("e")).collect():
        room -= r["count"]
        if room < 0:
            break
        bar = 1 << r["e"]
    known = pairs.where(F.col("n") >= bar).orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n", "best")))
    added = [*COUNTS, "groups_sha256", *([groups] if groups else [])]
    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.StringType()) for c in added[len(COUNTS) :]]
    rest = T.StructType([T.StructField("pair", T.LongType()), T.StructField("links", T.LongType())])
    fields.append(T.StructField("__rest", T.ArrayType(rest)))

    def make():
        own = aligner(a, b)
        keys, counts, bests = shared.value

        def score(texts: list[str | None]) -> list[pa.Array]:
            if own.full():
                own.forget()
            rows = own(texts)
            row, pair, links = own.linked(rows)
            key = own.keys()[pair] if len(pair) else np.empty(0, np.int64)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = keys[at] == key if len(keys) else np.zeros(len(key), bool)

            def total(x: np.ndarray) -> np.ndarray:
                out = np.zeros(len(rows), np.int64)
                np.add.at(out, row, x)
                return out

            n = np.where(found, counts[at] if len(keys) else 0, 0)
            good = found & (bests[at] if len(keys) else False)
            sizes = np.array([own.sizes[r].sum(axis=0) for r in rows], np.int64).reshape(-1, 3)
            said = [";".join([own.text[x] for x in r.tolist()]) for r in rows]
            sha = [sha256(s.encode()).hexdigest() if s else "" for s in said]
            left = np.flatnonzero(~found)
            ends = np.searchsorted(row[left], np.arange(len(rows) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(key[left]), pa.array(links[left])], ["pair", "links"]))
            made = [*sizes.T, total(links), total(np.where(good, links, 0)), total(links * n)]
            return [*(pa.array(np.ascontiguousarray(x)) for x in made), pa.array(sha, pa.string()), *([pa.array(said, pa.string())] if groups else []), lists]

        return score

    base = without(docs, [c for c in [*added, "__rest"] if c != text.lower()])
    out = add_columns(base, text, fields, make, piece_bytes=BATCH_BYTES)
    if room >= 0:  # all pairs were broadcast
        return out.drop("__rest")
    out = materialise(out.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    far = (
        out.select("__row", F.inline("__rest"))
        .join(pairs.where(F.col("n") < bar), "pair")
        .groupBy("__row")
        .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("__best"), F.sum(F.col("links") * F.col("n")).alias("__sum"))
    )
    more = {"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))}
    return out.drop("__rest").join(far, "__row", "left").withColumns(more).drop("__row", "__best", "__sum")
