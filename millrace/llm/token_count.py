"""Token counts by overlap resynchronisation.

A document longer than ``chunk_chars`` is encoded in overlapping chunks with offsets.
Two neighbours are spliced at a *proven* boundary: a position at which both start a
pre-token. The pre-tokeniser scans from left to right and its only state is the position,
so from a shared start on, the right chunk goes through the very pre-tokens that the whole
document would; up to it, the left chunk did, as long as its artificial end is further
away than any look-ahead or added token can reach (``guard``). BPE merges never cross
pre-tokens, hence counts add up exactly. Where an overlap shares no start (one pre-token
fills it) it is doubled until it does, or until the right chunk begins at the last proven
boundary, where it needs no partner.

Memory is bounded by a chunk's encoding unless a single pre-token is larger than that.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; an empty table gives an empty result; further columns pass through, and those named
like a result column are replaced.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, without

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512
#: Characters of text encoded by one library call, to bound what its encodings hold.
CALL_CHARS = 1_000_000
#: Distinct pre-tokens a worker remembers before it starts afresh, and bytes of Arrow data that share a batch.
PRETOKENS, BATCH_BYTES = 600_000, 24 << 20


class _Index(dict):
    """Numbers pre-tokens as they turn up."""

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        return at


class PretokenCounter:
    """Counts of short texts as sums over their pre-tokens, each encoded by the library once.

    BPE merges never cross pre-tokens and a pre-token alone is split off as itself, so the sum
    is the text's count. A text with an added token's string, or with a character beyond the
    Latin blocks (whose class may differ between two libraries' Unicode tables), isn't covered.
    """

    def __init__(self, fast: Callable, pattern: str, added: list[str]) -> None:
        self.fast, self.find = fast, regex.compile(pattern).findall
        self.odd = re.compile("|".join(["[^\x00-\u024f]", *map(re.escape, added)])).search
        self._forget()

    def _forget(self) -> None:
        self.index, self.sizes = _Index(), np.empty(0, np.int32)

    def covers(self, text: str) -> bool:
        return self.odd(text) is None

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.index) > PRETOKENS:
            self._forget()
        number = self.index.__getitem__
        rows = [array("i", map(number, self.find(t))) for t in texts]
        if new := list(islice(self.index, len(self.sizes), None)):
            made = [n for i in range(0, len(new), 50_000) for n in self.fast(new[i : i + 50_000])]
            self.sizes = np.concatenate((self.sizes, np.array(made, np.int32)))
        return [int(self.sizes[np.frombuffer(r, np.int32)].sum()) if r else 0 for r in rows]


class Tokenizer:
    """Counts with the library that reads the file: tokenizers, or sentencepiece for a .model."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        self.pretokens = self.encode = None
        self.guard = 0
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.fast = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        tok = tokenizers.Tokenizer.from_file(path)
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        #: Distance from a chunk's end beyond which that end has no effect.
        self.guard = 16 + max(map(len, added), default=0)
        self.fast = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.encode = lambda text: tok.encode(text, add_special_tokens=False)
        if pattern:
            self.pretokens = PretokenCounter(self.fast, pattern, added)


_tokenizers: dict[tuple[str, str | None], Tokenizer] = {}


def tokenizer(path: str, pattern: str | None = None) -> Tokenizer:
    """The worker's tokenizer for a file; one is kept between tasks."""
    if (key := (path, pattern)) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(path, pattern)
    return _tokenizers[key]


def _start(enc, at: int) -> int:
    """The index of the token that starts a pre-token at position ``at`` of its chunk; -1 if none does."""
    t = enc.char_to_token(at)
    if t is None or enc.token_to_chars(t)[0] != at:
        return -1
    while t > 0 and enc.token_to_chars(t - 1)[0] == at:  # a character may be several tokens
        t -= 1
    return t if t == 0 or enc.token_to_word(t) != enc.token_to_word(t - 1) else -1


def spliced_count(encode: Callable, text: str, chunk: int, overlap: int, guard: int) -> int:
    """Tokens of the whole text, from overlapping chunks spliced at proven boundaries."""
    n, total = len(text), 0
    base, start, end = 0, 0, min(chunk, n)
    left = encode(text[:end])
    done = 0  # tokens of the left chunk that lie before base
    while end < n:
        upto, width = min(n, end + max(chunk, end - base)), overlap
        while True:
            begin = max(base, end - width)
            right = encode(text[begin:upto])
            if begin == base:  # it begins at a proven boundary: right as it stands
                done = 0
                break
            for p in range(end - guard, begin, -1):
                if (t := _start(left, p - start)) >= 0 and (u := _start(right, p - begin)) >= 0:
                    total += t - done
                    base, done = p, u
                    break
            if base > begin:
                break
            width *= 2
        left, start, end = right, begin, upto
    return total + len(left) - done


def counts(texts: list[str | None], tok: Tokenizer, chunk: int, overlap: int) -> list[int]:
    """Token counts of many texts; equal texts of a batch are encoded once."""
    known: dict[str, int] = {"": 0}
    short: list[str] = []
    plain: list[str] = []
    for t in dict.fromkeys(x or "" for x in texts):
        if not t:
            continue
        if tok.encode is not None and len(t) > chunk:
            known[t] = spliced_count(tok.encode, t, chunk, overlap, tok.guard)
        elif tok.pretokens is not None and tok.pretokens.covers(t):
            short.append(t)
        else:
            plain.append(t)
    if short:
        known.update(zip(short, tok.pretokens(short), strict=True))
    at = 0
    while at < len(plain):
        upto, held = at, 0
        while upto < len(plain) and held < CALL_CHARS:
            held += len(plain[upto])
            upto += 1
        known.update(zip(plain[at:upto], tok.fast(plain[at:upto]), strict=True))
        at = upto
    return [known[x or ""] for x in texts]


def count_tokens(
    docs: DataFrame,
    vocab: str,
    text: str = "text",
    limit: int = 1024,
    pattern: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (``n_tokens > limit``). No shuffle.

    ``vocab`` is the path of a vocabulary file, on every executor. ``pattern``: that of the
    file's pre-tokeniser, if it is a byte-level one; texts that aren't chunked then share the
    counts of their pre-tokens. A sentencepiece model has no pre-tokens that could be proven to
    be boundaries, so it encodes whole texts.
    """
    base = without(docs, [n for n in ("n_bytes", "n_tokens", "over_limit") if n != text.lower()])

    def make():
        tok = tokenizer(vocab, pattern)
        return lambda texts: [pa.array(counts(texts, tok, chunk_chars, overlap_chars), pa.int64())]

    out = add_columns(base, text, [T.StructField("n_tokens", T.LongType())], make, piece_bytes=BATCH_BYTES)
    return out.withColumns(
        {
            "n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
            "over_limit": F.col("n_tokens") > F.lit(limit),
        }
    )
