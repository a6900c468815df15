"""Toxicity by a classifier chain.

Categories are predicted one after another, in a stated order. A category's linear model sees
the text's features and the probabilities of the categories before it. In training those are
out-of-fold: each labelled row's come from a model that was fitted without its fold, so later
models learn to trust them as far as they hold on new texts. In prediction they come from
models fitted on all folds.

Features: presence of words and of word beginnings (so that inflected forms share a weight),
all that occur in the sample, and four figures of form. Models are logistic regressions with a
weighted absolute penalty on words and a small squared one: a word's weight differs from 0
only where it explains more than ``NOISE`` standard deviations of chance would, given how many
texts have it, so words which merely come along get none. Fitting works on the words that
violate this condition (accelerated proximal gradient), looks at all words again, and ends
when none is left out that should be in: the solution is that of all features.

A category's cut, the probability from which a text is of it, is the one with the best F1 on
the out-of-fold predictions, in the middle of its gap.

Only fitting is bounded: it takes the ``sample`` labelled rows of the smallest hash, equal
texts once; the driver keeps the numbers of their words, and one text at a time. All documents
are scored, on whole texts.

Defined results: null and empty texts have no words and get the intercepts' probabilities;
labels that are null or whose document is missing are ignored, and of several labels of a
document the greatest holds; a category without both classes in the sample has its share as
probability; without labels all probabilities are 0; repeated rows are scored each; further
columns pass through, and those named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, discard, materialise

#: ``SAMPLE``: labelled rows that fitting takes at most.
SAMPLE, FOLDS, ROUNDS = 6000, 3, 300
#: Standard deviations that a word must explain; texts added to its count; weight of the squared penalty.
NOISE, SMOOTH, RIDGE = 3.0, 3.0, 1e-4
FORM, STEM = 4, 4
_find = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    return _find(text.lower())


def features(words: set[str]) -> set[str]:
    """Words, and the beginnings of those that are longer than that."""
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def form(text: str, words: list[str], distinct: int) -> list[float]:
    """Share of characters outside words, distinct words, word length, and length, each near 0 to 1."""
    n, letters = len(words), sum(map(len, words))
    return [
        1 - letters / max(1, len(text)),
        distinct / max(1, n),
        min(1.0, letters / max(1, n) / 20),
        min(1.0, np.log1p(n) / 12),
    ]


class Sparse:
    """Rows of word indices and dense figures."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, width: int) -> None:
        self.at = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.dense, self.width, self.n = dense, width, len(rows)

    def take(self, keep: np.ndarray) -> Sparse:
        number = (np.cumsum(keep) - 1).astype(np.int32)
        inside = keep[self.row]
        out = Sparse([], self.dense[keep], self.width)
        out.at, out.row, out.n = self.at[inside], number[self.row[inside]], int(keep.sum())
        return out

    def with_dense(self, more: np.ndarray) -> Sparse:
        out = Sparse([], np.concatenate((self.dense, more[:, None]), axis=1), self.width)
        out.at, out.row, out.n = self.at, self.row, self.n
        return out

    def dot(self, words: np.ndarray, dense: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, words[self.at], self.n) + self.dense @ dense + bias

    def gradient(self, err: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return np.bincount(self.at, err[self.row], self.width), self.dense.T @ err, float(err.sum())


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _minimise(x: Sparse, y: np.ndarray, toll: np.ndarray, start: tuple, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of words and figures, and the intercept, from ``start``, by accelerated proximal gradient."""
    # the step is one over the greatest curvature, found by power iteration
    pw, pd, pb = np.ones(x.width), np.ones(x.dense.shape[1]), 1.0
    norm = 1.0
    for _ in range(30):
        pw, pd, pb = x.gradient(x.dot(pw, pd, pb))
        norm = float(np.sqrt((pw**2).sum() + (pd**2).sum() + pb**2))
        pw, pd, pb = pw / norm, pd / norm, pb / norm
    step = 3.5 * x.n / norm
    old, ahead, t = start, start, 1.0
    for _ in range(rounds):
        gw, gd, gb = x.gradient((_sigmoid(x.dot(*ahead)) - y) / x.n)
        nw = ahead[0] - step * gw
        nw = np.sign(nw) * np.maximum(0.0, np.abs(nw) - step * toll) / (1 + step * RIDGE)
        nd, nb = ahead[1] - step * (gd + 1e-4 * ahead[1]), ahead[2] - step * gb
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / u
        ahead = (nw + k * (nw - old[0]), nd + k * (nd - old[1]), nb + k * (nb - old[2]))
        old, t = (nw, nd, nb), u
    return old


def tolls(x: Sparse, share: float) -> np.ndarray:
    """The absolute penalty of each word: NOISE standard deviations of its gradient if it says nothing."""
    df = np.bincount(x.at, minlength=x.width)
    return NOISE * np.sqrt((df + SMOOTH) * share * (1 - share)) / x.n


def fit_linear(x: Sparse, y: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of all words and figures, and the intercept."""
    words, dense = np.zeros(x.width), np.zeros(x.dense.shape[1])
    share = float(y.mean()) if x.n else 0.0
    if not 0 < share < 1:
        return words, dense, 30.0 if share >= 1 else -30.0
    toll, bias = tolls(x, share), float(np.log(share / (1 - share)))
    active = np.zeros(x.width, bool)
    while True:  # the active words only grow, so this ends
        # a word of weight 0 stays there as long as its gradient is within its penalty
        gradient = x.gradient((_sigmoid(x.dot(words, dense, bias)) - y) / x.n)[0]
        fresh = ~active & (np.abs(gradient) > toll * (1 + 1e-6))
        if active.any() and not fresh.any():
            break
        active |= fresh
        number, inside = np.cumsum(active) - 1, active[x.at]
        small = Sparse([], x.dense, int(active.sum()))
        small.at, small.row, small.n = number[x.at[inside]], x.row[inside], x.n
        some, dense, bias = _minimise(small, y, toll[active], (words[active], dense, bias), rounds)
        words[active] = some
        if not active.any():
            break
    return words, dense, bias


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that splits best by F1; in a tie the one in the widest gap, in log odds. 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1 - 1e-9))
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits, taken = np.cumsum(y)[:-1], np.arange(1, len(y))
    f1 = np.where(z[:-1] > z[1:], 2 * hits / (taken + y.sum()), -1.0)
    gap = np.where(f1 >= f1.max() - 1e-12, z[:-1] - z[1:], -1.0)
    k = int(gap.argmax())
    return float(_sigmoid((z[k] + z[k + 1]) / 2)) if f1.max() > 0 else 0.5


class Chain:
    """The fitted models: for each category its name, its words' weights, its figures' weights and its intercept; and its cut."""

    def __init__(self, links: list[tuple[str, dict[str, float], list[float], float]], cuts: dict[str, float]) -> None:
        self.links, self.cuts = links, cuts
        known = sorted({w for _, words, _, _ in links for w in words})
        self.number = {w: i for i, w in enumerate(known)}
        self.matrix = np.zeros((len(known), len(links)))
        for j, (_, words, _, _) in enumerate(links):
            for w, x in words.items():
                self.matrix[self.number[w], j] = x

    def probabilities(self, text: str | None) -> list[float]:
        text = text or ""
        words = words_of(text)
        distinct = set(words)
        sums = np.zeros(len(self.links))
        for w in self.number.keys() & features(distinct):
            sums = sums + self.matrix[self.number[w]]
        figures, out = form(text, words, len(distinct)), []
        for j, (_, _, dense, bias) in enumerate(self.links):
            z = bias + float(sums[j]) + sum(a * b for a, b in zip(dense, [*figures, *out], strict=True))
            out.append(float(_sigmoid(z)))
        return out


def _counted(texts: Iterable[str]) -> tuple[Sparse, list[str]]:
    """The texts' features and figures, and the features' names."""
    number: dict[str, int] = {}
    rows, figures = [], []
    for t in texts:  # a text's words are never kept
        ws = words_of(t)
        distinct = set(ws)
        rows.append(np.array(sorted(number.setdefault(w, len(number)) for w in sorted(features(distinct))), np.int32))
        figures.append(form(t, ws, len(distinct)))
    return Sparse(rows, np.array(figures).reshape(-1, FORM), len(number)), list(number)


def fit_chain(texts: Iterable[str], labels: dict[str, np.ndarray], fold: np.ndarray) -> Chain:
    """``labels``: for each category, in order, 0 or 1 of each text, or nan where unknown."""
    return _chained(*_counted(texts), labels, fold)


def _chained(x: Sparse, known: list[str], labels: dict[str, np.ndarray], fold: np.ndarray) -> Chain:
    links, cuts = [], {}
    for name, y in labels.items():
        have = ~np.isnan(y)
        out = np.zeros(x.n)
        for k in range(FOLDS):  # each fold by a model without it
            model = fit_linear(x.take(have & (fold != k)), y[have & (fold != k)])
            out[fold == k] = _sigmoid(x.take(fold == k).dot(*model))
        words, weights, bias = fit_linear(x.take(have), y[have])
        at = np.flatnonzero(words)
        links.append((name, {known[i]: float(words[i]) for i in at}, weights.tolist(), bias))
        cuts[name] = best_cut(out[have], y[have])
        x = x.with_dense(out)
    return Chain(links, cuts)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], ident: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit on at most ``sample`` labelled ids, with one text each. ``categories``: for each category, in order, an SQL expression of ``labels``, 0 or 1."""
    names = list(categories)
    each = labels.select(F.col(ident).alias("id"), *[F.expr(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())])
    each = each.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    some = each.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded: broadcast below
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    met = rows.join(F.broadcast(some), "id")
    # an id may have many texts: that of least hash stands for it, so no more than ``sample`` texts are fitted
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    one = met.groupBy("id").agg(first, *[F.first(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    chosen = materialise(one.select("id", "t.text", *[f"y{i}" for i in range(len(names))]), "labelled", narrow=True)
    seen: set[bytes] = set()
    kept: list[tuple] = []

    def once() -> Iterator[str]:
        """Each text once, with the labels of its smallest id; a partition at a time."""
        for r in chosen.orderBy("id").toLocalIterator():
            code = blake2b(r["text"].encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if code not in seen:
                seen.add(code)
                kept.append((r["id"], *(r[f"y{i}"] for i in range(len(names)))))
                yield r["text"]

    x, known = _counted(once())
    discard(chosen)
    table = np.array([[np.nan if v is None else v for v in k[1:]] for k in kept], float).reshape(-1, len(names))
    ids = np.array([k[0] for k in kept], np.int64).view(np.uint64)
    fold = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    return _chained(x, known, {n: table[:, i] for i, n in enumerate(names)}, fold)


def predict(docs: DataFrame, fitted: Chain, text: str = "text") -> DataFrame:
    """``docs`` with a probability column a category, named like it. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    fields = [T.StructField(name, T.DoubleType()) for name, *_ in fitted.links]

    def make():
        own = shared.value

        def run(texts: list[str | None]) -> list[pa.Array]:
            made = [own.probabilities(t) for t in texts]
            return [pa.array([m[j] for m in made], pa.float64()) for j in range(len(own.links))]

        return run

    return add_columns(docs, text, fields, make)
