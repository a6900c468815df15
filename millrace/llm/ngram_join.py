"""Similarity join of documents on the Jaccard similarity of their word n-gram sets.

1. *Sets.* A document's set holds 64-bit hashes of its distinct n-word shingles. Documents
   with equal sets are one node (a 128-bit hash of the sorted set), so copies, however many,
   are compared once.
2. *Rare first.* Shingles are ordered by frequency class, then by hash. The class is the
   quantile of the shingle's counter in a count sketch over all documents. Any order that all
   documents share gives right results; this one puts frequent passages last.
3. *Prefixes.* Two sets that reach the threshold share one of their first
   ``size - ceil(threshold * size) + 1`` shingles, so nodes meet by those alone: a bucket is
   the nodes with a shingle in their prefix. What moves is (shingle, node, size, position).
4. *Leaders.* Each node of a bucket is paired with the bucket's first node; of its leaders, the
   one it meets most often is verified. Links make components.
5. *Across components.* Only buckets with nodes of several components are looked at again, so
   near copies by the thousand cost their number, not its square, and no link between
   components is lost. In a bucket of up to ``SMALL`` nodes all pairs across components are
   made; how many prefix shingles a pair shares, and the positions of the last, bound its
   overlap (positional filter), which few unrelated pairs survive. A larger bucket joins the
   group of the component that most of its nodes are of (or is a group of its own), where each
   node is there once, however many shingles it shares. In a group, nodes of other components
   are compared with all by the length filter and the suffix filter: shingles are counted in
   several times as many partitions by hash as there are shingles, and those whose count is odd
   in one set and even in the other are no more than the symmetric difference. First each
   such node's likeliest partners, of different components, are verified, in rounds as long as
   many components are united; then, with the components that makes, all pairs that are left.
6. *Verification.* Each distinct pair is verified once, on whole sets. Sets are computed anew
   from the texts of the nodes in question (found by a bitmap of bounded size) rather than
   kept for all documents: that trades CPU for disk.

Hot groups: a shingle whose counter says that very many documents have it is dealt out by its
nodes' hashes, each part with a leader of its own, and the leaders meet in a second step.
Buckets are counted by aggregations with partial sums; a group of over ``BLOCK`` nodes is cut
into blocks, which are compared by pairs in different tasks.

Defined results: null and empty texts, and texts of white space only, have no shingles and
are alone; fewer words than n make one shingle; a row whose id is null takes part in its
copies' group and is given its component's id, but a group of null ids only has a null one;
repeated rows are in one group; an empty table gives an empty result. Columns other than id
and text are not carried: join on the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, pieces
from .components import components

SKETCH_BITS, SEGMENTS, BLOCK, SMALL = 20, 64, 4096, 8
#: A bitmap of nodes has 16 bits a node, within these bounds.
BITMAP_BITS = 20, 26
#: A shingle of more than this share of all documents is dealt out.
HOT = 1e-4
#: Partners of a node that are tried first, and the share of nodes that such a round must link for another.
LIKELY, MERGED = 4, 0.02
#: The fewest partitions of the suffix filter, and how many a shingle at most.
PARTITIONS, FINE = 256, 8
#: Bytes of rows worked on together.
TEXT_BYTES = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL[1]
    x = (x ^ (x >> np.uint64(27))) * _MUL[2]
    return x ^ (x >> np.uint64(31))


#: For each byte whether it is white space, and a number that A-Z share with a-z.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = _mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + _MUL[0])


class _Powers:
    """Powers of the base modulo 2^64, and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            more = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(_BASE, more, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(_BASE, -more, 1 << 64))))
        return self.up, self.down


_powers = _Powers()


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the bounds of each text's.

    ``data``: the texts' UTF-8 bytes, one after another; ``bounds``: where each begins, and the
    end. Words are runs of other than ASCII white space, with A-Z as a-z. Their hashes are
    polynomials of the bytes, taken from running sums over all texts at once, then mixed.
    """
    size, texts = len(data), len(bounds) - 1
    up, down = _powers.upto(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:size], out=sums[1:])
    edge = np.zeros(size + 1, bool)
    edge[bounds] = True
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    if size:
        first[1:] &= ~inside[:-1] | edge[1:size]
        last[:-1] &= ~inside[1:] | edge[1:size]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = _mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * _MUL[0])
    at = np.searchsorted(start, bounds)
    many = np.diff(at)
    # texts of fewer words than n are one shingle of them all
    width = np.minimum(many, n)
    count = np.where(many > 0, many - width + 1, 0)
    upto = np.concatenate(([0], np.cumsum(count)))
    from_word = np.repeat(at[:-1] - upto[:-1], count) + np.arange(upto[-1])
    wide = np.repeat(width, count)
    out = wide.astype(np.uint64)
    for i in range(n):
        have = wide > i
        if have.all():
            out = _mixed(out * _MUL[0] + words[from_word + i])
        else:
            out[have] = _mixed(out[have] * _MUL[0] + words[from_word[have] + i])
    for k in np.flatnonzero(count > 1):
        out[upto[k] : upto[k + 1]].sort()
    fresh = np.ones(len(out), bool)
    if len(out):
        fresh[1:] = out[1:] != out[:-1]
        fresh[upto[:-1][count > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], kept[upto]


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.data.cast("B")) - (1 << 63)


def _check(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.data.cast("B")) - (1 << 63)


def _signature(s: np.ndarray) -> bytes:
    """A bit a partition: whether its count is odd. Partitions: the power of two up to ``FINE`` times the size."""
    many = max(PARTITIONS, 1 << int(FINE * len(s)).bit_length() - 1)
    odd = np.bincount((s >> np.uint64(24)).astype(np.int64) & (many - 1), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, hashes, bounds) of pieces of the rows, whose first column is the text."""
    for whole in batches:
        for batch in pieces(whole, TEXT_BYTES):
            text = batch.column(0)
            if not len(text):
                continue
            if text.null_count:
                text = text.fill_null("")
            _, offsets, data = text.buffers()
            wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
            at = np.frombuffer(offsets, wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
            hashes, bounds = shingle_sets(raw, at - at[0], n)
            yield batch, hashes, bounds


class Threshold:
    """Jaccard similarity of at least ``num`` / ``den``, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def prefix(self, size: int) -> int:
        return size - -(-self.num * size // self.den) + 1

    def overlap(self, a, b):
        """The least overlap of sets of these sizes that reaches the threshold."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def sizes(self, size: int) -> tuple[int, int]:
        """The least and the greatest set that one of this size can be similar to."""
        return -(-self.num * size // self.den), size * self.den // self.num

    def similar_sizes(self, a: Column, b: Column) -> Column:
        return (a * self.den >= b * self.num) & (b * self.den >= a * self.num)

    def reachable(self, shared: Column, a: Column, b: Column, at_a: Column, at_b: Column) -> Column:
        """Whether sets of sizes a and b can be similar if so many prefix shingles are shared, the last at these positions.

        What they share beyond is at most the shorter rest, and at most what follows the prefix that ends first.
        """
        both = self.num + self.den
        least = F.floor((self.num * (a + b) + (both - 1)) / F.lit(both))
        after = F.greatest(*[F.floor((self.num * x + (self.den - 1)) / F.lit(self.den)) - 1 for x in (a, b)])
        return (shared + F.least(a - at_a - 1, b - at_b - 1) >= least) & (shared + after >= least)


def _summaries(source: DataFrame, n: int) -> DataFrame:
    """A row a document (id, hash, size, node, check), and rows of the task's sketch by segment (size -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        low = np.uint64((1 << SKETCH_BITS) - 1)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "hash", "size", "node", "check", "part"]
            )

        for batch, hashes, bounds in _sets_of(batches, n):
            rows, at = [], bounds.tolist()
            for i, h, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), at, at[1:], strict=False):
                s = hashes[a:b]
                rows.append((i, h, b - a, _node(s), _check(s), None) if b > a else (i, h, 0, None, None, None))
            np.add.at(sketch, (hashes & low).astype(np.int64), 1)
            yield made(rows)
        if sketch.any():
            parts = np.minimum(sketch, 65535).astype("<u2").reshape(SEGMENTS, -1)
            for k, p in enumerate(parts):
                yield made([(None, None, -1, k, None, p.tobytes())])

    return source.mapInArrow(run, "id long, hash long, size long, node long, check long, part binary")


def _counters(summaries: DataFrame) -> np.ndarray:
    """All tasks' sketches, added up segment by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, "<u2").astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"node": [k], "part": pa.array([v.tobytes()], pa.binary())})

    parts = (
        summaries.where("size = -1")
        .select("node", "part")
        .repartition(SEGMENTS, "node")
        .mapInArrow(run, "node long, part binary")
        .collect()
    )
    total = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), np.int64)
    for r in parts:
        total[r["node"]] = np.frombuffer(r["part"], np.int64)
    return total.ravel()


def _order(counters: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequency class of each counter, and into how many parts (as a power of two) the nodes of its shingles are dealt."""
    steps = np.unique(np.quantile(counters, np.linspace(0, 1, 256)[1:-1], method="lower"))
    hot = counters > max(BLOCK, HOT * documents + 4 * counters.mean())
    parts = np.where(hot, np.ceil(np.log2(np.maximum(counters, 1) / BLOCK)), 0)
    return np.searchsorted(steps, counters, "left").astype(np.uint8), np.clip(parts, 0, 30).astype(np.uint8)


def _postings(source: DataFrame, n: int, t: Threshold, order) -> DataFrame:
    """(token, part, node, size, pos) of each node's prefix; part -1 if the token isn't dealt out. A node may come from several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rank, bits), low = order.value, np.uint64((1 << SKETCH_BITS) - 1)
        met: set[int] = set()
        for _, hashes, bounds in _sets_of(batches, n):
            tokens, nodes, sizes, places = [], [], [], []
            counter = (hashes & low).astype(np.int64)
            classes = rank[counter]
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                s = hashes[a:b]
                if a == b or (node := _node(s)) in met:
                    continue
                met.add(node)
                k = t.prefix(len(s))
                first = np.argsort(classes[a:b], kind="stable")[:k]
                tokens.append(s[first])
                nodes.append(np.full(k, node, np.int64))
                sizes.append(np.full(k, len(s), np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if tokens:
                token, node = np.concatenate(tokens), np.concatenate(nodes)
                many = bits[(token & low).astype(np.int64)].astype(np.uint64)
                part = (_mixed(node.view(np.uint64)) & ((np.uint64(1) << many) - np.uint64(1))).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": token.view(np.int64), "part": np.where(many > 0, part, -1).astype(np.int32), "node": node,
                        "size": np.concatenate(sizes), "pos": np.concatenate(places),
                    }
                )

    return source.select("text").mapInArrow(run, "token long, part int, node long, size int, pos int")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of sorted rows and the bounds of the runs that agree in the first ``keys`` columns; no run is cut."""
    held = None
    for batch in batches:
        cols = [
            np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
            for c in batch.columns
        ]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        change = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            change |= c[1:] != c[:-1]
        bounds = np.concatenate(([0], np.flatnonzero(change) + 1))
        last = int(bounds[-1])
        held = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols], bounds
    if held is not None:
        yield held, np.array([0, len(held[0])])


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of shingles that several nodes share, each node once, with the leader of their (part of a) bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, part, node, size, pos), bounds in _runs(batches, 2):
            first = np.zeros(len(token), bool)
            first[bounds[:-1]] = True
            own = first.copy()  # a node that came from several tasks is there once
            own[1:] |= node[1:] != node[:-1]
            at, run_of = np.flatnonzero(own), np.cumsum(first) - 1
            many = np.bincount(run_of[at])[run_of]
            at = at[(many[at] > 1) | (part[at] >= 0)]
            lead = np.flatnonzero(first)[run_of[at]]
            if len(at):
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": token[at], "part": part[at], "node": node[at], "size": size[at], "pos": pos[at],
                        "lead": node[lead], "lead_size": size[lead], "lead_pos": pos[lead],
                    }
                )

    return (
        postings.repartition("token", "part")
        .sortWithinPartitions("token", "part", "node")
        .mapInArrow(run, "token long, part int, node long, size int, pos int, lead long, lead_size int, lead_pos int")
    )


def _leaders(shared: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b), distinct: each node with the leader that it meets most often, if what they share allows a link."""
    led = shared.where("lead <> node").select("node", "size", "pos", "lead", "lead_size", "lead_pos")
    # the leaders of a token's parts meet the least of them
    tops = shared.where("part >= 0 AND lead = node").select("token", "node", "size", "pos")
    top = tops.groupBy("token").agg(F.min(F.struct("node", "size", "pos")).alias("top"))
    second = tops.join(top, "token").where("node <> top.node")
    led = led.unionByName(
        second.select(
            "node", "size", "pos", F.col("top.node").alias("lead"), F.col("top.size").alias("lead_size"), F.col("top.pos").alias("lead_pos")
        )
    )
    met = (
        led.where(t.similar_sizes(F.col("size"), F.col("lead_size")))
        .groupBy("lead", "lead_size", "node", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos"), F.max("lead_pos").alias("lead_pos"))
    )
    close = met.where(t.reachable(F.col("n"), F.col("size"), F.col("lead_size"), F.col("pos"), F.col("lead_pos")))
    best = close.groupBy("node").agg(F.max(F.struct("n", "lead")).alias("best"))
    return best.select(F.least("node", "best.lead").alias("a"), F.greatest("node", "best.lead").alias("b")).distinct()


def _mixed_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, node, size, pos, label, n, own) of buckets with nodes of several components.

    n: nodes of the bucket; own: the component that half of them or more are of, else null.
    """
    labelled = shared.select("token", "node", "size", "pos").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "label"))
    buckets = (
        each.groupBy("token")
        .agg(F.sum("n").alias("n"), most.alias("most"), F.min("label").alias("x"), F.max("label").alias("y"))
        .where("x <> y")
        .select("token", "n", F.when(F.col("most.n") * 2 >= F.col("n"), F.col("most.label")).alias("own"))
    )
    return labelled.join(buckets, "token")


def _few(mixed: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b), distinct, across components that meet in small buckets and share enough for a link.

    A pair that meets in a larger bucket as well shares more than is counted here; it is compared there.
    """
    rows = (
        mixed.where(F.col("n") <= SMALL)
        .groupBy("token")
        .agg(F.array_sort(F.collect_list(F.struct("node", "label", "size", "pos"))).alias("rows"))
    )
    each = rows.select("rows", F.posexplode("rows").alias("i", "x"))
    pairs = each.select("x", F.explode(F.expr("slice(rows, i + 2, size(rows))")).alias("y")).where(
        (F.col("x.label") != F.col("y.label")) & t.similar_sizes(F.col("x.size"), F.col("y.size"))
    )
    met = pairs.groupBy(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.size").alias("s"), F.col("y.size").alias("u")
    ).agg(F.count(F.lit(1)).alias("n"), F.max("x.pos").alias("p"), F.max("y.pos").alias("q"))
    return met.where(t.reachable(F.col("n"), F.col("s"), F.col("u"), F.col("p"), F.col("q"))).select("a", "b")


def _groups(mixed: DataFrame) -> DataFrame:
    """(k, node, size), distinct: the nodes of large buckets, by component or by bucket."""
    k = F.struct(F.col("own").isNull().cast("int").alias("kind"), F.coalesce("own", "token").alias("of"))
    return mixed.where(F.col("n") > SMALL).select(k.alias("k"), "node", "size").distinct()


class _Signatures:
    """Signatures of rows in order of size; compares one with others, folded to the shorter of their lengths."""

    def __init__(self, signatures: np.ndarray) -> None:
        self.all = signatures
        # lengths never fall, as rows are in order of size
        self.wide = np.fromiter(map(len, signatures), np.int64, len(signatures))
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def _words(self, wide: int, to: int) -> tuple[np.ndarray, int]:
        """The rows of one length as words, folded (halves added bit by bit) to another, and the first of them."""
        first, last = np.searchsorted(self.wide, [wide, wide + 1])
        if (wide, to) not in self.made:
            words = np.frombuffer(b"".join(self.all[first:last]), np.uint64).reshape(last - first, -1)
            while words.shape[1] * 8 > to:
                half = words.shape[1] // 2
                words = words[:, :half] ^ words[:, half:]
            self.made[wide, to] = words
        return self.made[wide, to], int(first)

    def differ(self, a: int, b: np.ndarray) -> np.ndarray:
        """At least this many shingles are in one of the sets a and b only."""
        out = np.empty(len(b), np.int64)
        for wide in np.unique(self.wide[b]).tolist():
            to = min(wide, int(self.wide[a]))
            at = np.flatnonzero(self.wide[b] == wide)
            words, first = self._words(wide, to)
            mine, start = self._words(int(self.wide[a]), to)
            out[at] = np.bitwise_count(words[b[at] - first] ^ mine[a - start]).sum(axis=1)
        return out


def _across(groups: DataFrame, labels: DataFrame, sets: DataFrame, t: Threshold, likely: int) -> DataFrame:
    """Pairs (a, b), distinct, across the components of a group that pass the length and the suffix filter.

    ``likely``: for each node that isn't of the group's own component only its likeliest partners, each of
    another component, at most so many in a pair of blocks; 0: all pairs. Nodes are in host
    blocks, those of other components in guest blocks too; each guest block meets each host block.
    """
    labelled = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # a group's own component may have become part of a larger one: that of most of its nodes counts
    each = labelled.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"))
    shape = (
        each.groupBy("k")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .select(
            "k", F.col("most.label").alias("own"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("hosts"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("guests"),
        )
    )
    deal = F.xxhash64("node")
    placed = labelled.join(shape, "k").select(
        "k", "node", "size", "label", "hosts", "guests", (F.col("label") != F.col("own")).alias("guest"),
        F.pmod(deal, F.col("hosts")).cast("int").alias("x0"), F.pmod(F.shiftright(deal, 20), F.col("guests")).cast("int").alias("y0"),
    )
    cells = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda y: F.struct(F.col("x0").alias("x"), y.alias("y")))
    more = F.transform(F.sequence(F.lit(0), F.col("hosts") - 1), lambda x: F.struct(x.alias("x"), F.col("y0").alias("y")))
    dealt = (
        placed.withColumn("cell", F.explode(F.when(F.col("guest"), F.array_union(cells, more)).otherwise(cells)))
        .select(
            "k.kind", "k.of", "cell.x", "cell.y", "size", "node", "label",
            (F.col("cell.x") == F.col("x0")).alias("host"), (F.col("guest") & (F.col("cell.y") == F.col("y0"))).alias("guest"),
        )
        .join(sets.select("node", "made"), "node")
    )
    dealt = dealt.select("kind", "of", "x", "y", "size", "node", "label", "host", "guest", "made")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, _, size, node, label, host, guest, made), bounds in _runs(batches, 4):
            size, found = size.astype(np.int64), []
            for r in np.flatnonzero(np.diff(bounds) > 1).tolist():
                i, j = int(bounds[r]), int(bounds[r + 1])
                s, tags, v = size[i:j], label[i:j], _Signatures(made[i:j])
                hosts, guests, names = host[i:j].astype(bool), guest[i:j].astype(bool), node[i:j]
                for a in np.flatnonzero(guests).tolist():
                    least, most = t.sizes(int(s[a]))
                    b = np.arange(*np.searchsorted(s, [least, most + 1]))
                    b = b[hosts[b] & (tags[b] != tags[a])]
                    if not len(b):
                        continue
                    spare = s[a] + s[b] - 2 * t.overlap(s[a], s[b]) - v.differ(a, b)
                    b, spare = b[spare >= 0], spare[spare >= 0]
                    if likely and len(b) > 1:
                        b = b[np.argsort(-spare, kind="stable")]
                        b = b[np.sort(np.unique(tags[b], return_index=True)[1])[:likely]]
                    if len(b):
                        found.append(np.stack((np.minimum(names[a], names[b]), np.maximum(names[a], names[b]))))
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_pydict({"a": pairs[0], "b": pairs[1]})

    return (
        dealt.repartition("kind", "of", "x", "y")
        .sortWithinPartitions("kind", "of", "x", "y", "size", "node")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bitmap that has each node's bit (others may share it): 16 bits a node, but no more than 2^26."""
    bits = min(max(int(16 * nodes.count()).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    at = F.col("node").bitwiseAND(F.lit((1 << bits) - 1))
    words = nodes.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["w"]] = r["bits"]
    return out.view(np.uint64)


def _has(bitmap: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = nodes & np.int64(len(bitmap) * 64 - 1)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _fetched(source: DataFrame, n: int, wanted: DataFrame, make: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """(node, made) of the wanted nodes: what ``make`` makes of their sets, computed from the texts, one row a node."""
    bits = source.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, met = bits.value, set()
        for _, hashes, bounds in _sets_of(batches, n):
            at = bounds.tolist()
            some = [(_node(hashes[a:b]), a, b) for a, b in zip(at, at[1:], strict=False) if b > a]
            if not some:
                continue
            maybe = _has(bitmap, np.array([x[0] for x in some], np.int64)).tolist()
            nodes, made = [], []
            for (node, a, b), ok in zip(some, maybe, strict=True):
                if ok and node not in met:
                    met.add(node)
                    nodes.append(node)
                    made.append(make(hashes[a:b]))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(made, pa.binary())], names=["node", "made"])

    found = source.select("text").mapInArrow(run, "node long, made binary")
    return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("made").alias("made"))


def _verified(pairs: DataFrame, source: DataFrame, n: int, t: Threshold) -> DataFrame:
    """The links among the materialised ``pairs`` (a, b), materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, TEXT_BYTES):
                a, b, x, y = (c.to_pylist() for c in batch.columns)
                ok = []
                for p, q, s, u in zip(a, b, x, y, strict=True):
                    s, u = np.frombuffer(s, np.uint64), np.frombuffer(u, np.uint64)
                    both = np.concatenate((s, u))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if t.den * common >= t.num * (len(s) + len(u) - common):
                        ok.append((p, q))
                if ok:
                    yield pa.RecordBatch.from_pydict({"a": [p for p, _ in ok], "b": [q for _, q in ok]})

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _fetched(source, n, ends)
    checked = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("made").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("made").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(run, "a long, b long")
    )
    return materialise(checked, "links", narrow=True)


def _labels(source: DataFrame, n: int, t: Threshold, order) -> DataFrame:
    """(node, label) of all linked nodes."""
    shared = materialise(_shared(_postings(source, n, t, order)), "shared")
    pairs = materialise(_leaders(shared, t), "pairs", narrow=True)
    links = _verified(pairs, source, n, t)
    labels = components(links)
    mixed = materialise(_mixed_buckets(shared, labels), "mixed")
    discard(shared)
    few = materialise(_few(mixed, t).join(pairs, ["a", "b"], "left_anti"), "pairs", narrow=True)
    groups = materialise(_groups(mixed), "groups", narrow=True)
    discard(mixed)
    signatures = materialise(_fetched(source, n, groups.select("node").distinct(), _signature), "signatures")
    done = pairs.unionByName(few)
    # the likeliest pairs first, as long as they unite many components; then all that are left
    many, likely, asked = signatures.count(), LIKELY, few
    while True:
        found = _across(groups, labels, signatures, t, likely)
        new = materialise(found, "pairs", narrow=True)
        new = materialise(new.join(done, ["a", "b"], "left_anti"), "pairs", narrow=True)
        done = done.unionByName(new)
        asked = asked.unionByName(new) if asked else new
        fresh = links.limit(0) if asked.isEmpty() else _verified(asked, source, n, t)
        number = fresh.count()
        if number:
            links = links.unionByName(fresh)
            discard(labels)
            labels = components(links)
        if not likely:
            break
        asked, likely = None, likely if number > MERGED * many else 0
    discard(groups, signatures)
    return labels


def grouped(docs: DataFrame, num: int = 80, den: int = 100, n: int = 5, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, size, component, component_hash) of each row.

    hash: xxhash64 of the text; component: the least id reachable by links of Jaccard >= num / den,
    component_hash: the least hash of the texts that have it.
    """
    t = Threshold(num, den)
    string = F.col(text).cast("string")
    source = docs.select(string.alias("text"), F.col(ident).cast("long").alias("id"), F.xxhash64(string).alias("hash"))
    sc = docs.sparkSession.sparkContext
    summaries = materialise(_summaries(source, n), "summaries")
    rows = summaries.where("size >= 0").drop("part")
    key = F.when(F.col("id").isNotNull(), F.struct("id", "hash"))
    nodes = materialise(
        rows.where("size > 0").groupBy("node", "check", "size").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")),
        "nodes",
        narrow=True,
    )
    documents = nodes.agg(F.sum("n")).first()[0] or 0
    labels = _labels(source, n, t, sc.broadcast(_order(_counters(summaries), documents)))
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # only nodes that differ from their row's own id need a lookup
    least = named.groupBy("label").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    lookup = named.join(least, "label").where("members > 1 or n > 1").select("node", "check", "component")
    lookup = materialise(lookup, "lookup", narrow=True)
    discard(nodes, labels)
    return rows.join(lookup, ["node", "check"], "left").select(
        "id", "hash", "size",
        F.coalesce("component.id", "id").alias("component"), F.coalesce("component.hash", "hash").alias("component_hash"),
    )


def similar(
    docs: DataFrame, num: int = 80, den: int = 100, n: int = 5, ident: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``ident``, ``n_shingles`` and ``component_id`` of each row: the least id reachable by links of Jaccard >= num / den."""
    found = grouped(docs, num, den, n, ident, text)
    out = found.select(F.col("id").alias(ident), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)  # three numbers a row: no more tasks than keep all cores busy


def one_of_each(docs: DataFrame, num: int = 80, den: int = 100, n: int = 5, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less those that are linked with a document of smaller id.

    Of rows equal in id and text one stays, and of linked rows equal in id but not in text that
    with the smallest hash; rows of one id that are not linked are judged each; rows without an
    id stay. Only rows that may have to go are shuffled: a bitmap of bounded size tells them
    from the rest. All columns pass through.
    """
    found = materialise(grouped(docs, num, den, n, ident, text), "groups", narrow=True).where("id IS NOT NULL")
    code = F.xxhash64("id", "hash").alias("node")
    gone = found.where("id <> component OR hash <> component_hash").select("id", "hash", code).distinct()
    again = found.groupBy("id", "hash").count().where("count > 1").select(code)
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(gone.select("node").unionByName(again)))

    @F.pandas_udf("boolean")
    def suspected(codes: pd.Series) -> pd.Series:
        return pd.Series(_has(bits.value, codes.to_numpy(np.int64)))

    # the caller's columns go into one, so that no name of theirs can clash
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    marked = docs.select(
        whole.alias("row"), F.col(ident).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash")
    ).withColumn("maybe", F.col("id").isNotNull() & suspected(F.xxhash64("id", "hash")))
    some = marked.where("maybe").join(gone.select("id", "hash"), ["id", "hash"], "left_anti").dropDuplicates(["id", "hash"])
    rows = marked.where("NOT maybe").select("row").unionByName(some.select("row"))
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
