"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives (rows labelled of good quality) and unlabelled texts are described by numbers of their form (kinds of
characters, repetition, word shapes). Shares of hashed words beside them made held-out accuracy worse. The share of good texts among the unlabelled ones,
the class prior, is estimated by the best bin: over the top scores of a classifier of positives against unlabelled, the least
ratio of the two tail shares. The unlabelled tail shares are those of every unlabelled document. A small network then
minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss; where the second part turns negative the
step goes up on it, so that the network cannot overfit the positives. Labels of bad rows are not used.

Features are computed once, whole texts of any length, and stored; learning draws a bounded sample of their rows, and only
numbers, no texts, go to the driver.

Results: null and empty texts have the score of a text without words; equal texts have equal scores; without positives every
score is 1 (nothing is rejected without evidence); an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _labelled, _shared

#: Most positive and most unlabelled rows that are learned from.
POSITIVES, UNLABELLED = 6000, 8000
HIDDEN, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 16, 30, 1500, 256, 0.005, 1e-4, 5
THRESHOLD = 0.5
#: Kinds of bytes, one number for each.
_KINDS = ("upper", "lower", "digit", "space", "newline", "comma_stop", "exclaim", "bar", "symbol", "other_punctuation", "high", "control")


def _kind_table() -> np.ndarray:
    t = np.full(256, _KINDS.index("control"), np.uint8)
    for b in range(256):
        c = chr(b)
        name = (
            "high" if b >= 128 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "newline" if c in "\n\r" else "space" if c in " \t"
            else "comma_stop" if c in ",.;:'\"-" else "exclaim" if c in "!?" else "bar" if c == "|" else "symbol" if c in "#$%&*@^~=+_<>" else "other_punctuation" if b > 32 and b < 127 else "control"
        )
        t[b] = _KINDS.index(name)
    return t


_KIND = _kind_table()
_SYMBOLS = np.isin(_KIND, [_KINDS.index(k) for k in ("exclaim", "bar", "symbol")])
N_FEATURES = len(_KINDS) + 11


def features(text: str | None) -> np.ndarray:
    """Numbers of a text's form; of an empty one, zeros."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES)
    if not raw:
        return out
    codes = np.frombuffer(raw, np.uint8)
    share = np.bincount(_KIND[codes], minlength=len(_KINDS)) / len(codes)
    words = raw.split()
    n = max(len(words), 1)
    counts = Counter(words)
    space = np.isin(codes, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    # words that end in a symbol, and words all in capitals, from bytes next to a space
    last = np.flatnonzero(~space & np.r_[space[1:], True])
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    # of each word, whether it has a letter of a kind: one byte for each byte of the text
    has_lower, has_upper = (np.logical_or.reduceat(_KIND[codes] == _KINDS.index(k), first) if len(first) else np.zeros(0, bool) for k in ("lower", "upper"))
    same = sum(map(bytes.__eq__, words[1:], words)) / n
    lines = raw.split(b"\n")
    sizes = last - first + 1
    more = [
        same, len(counts) / n, max(counts.values(), default=0) / n, _SYMBOLS[codes[last]].sum() / n, (has_upper & ~has_lower).sum() / n,
        1 - len(set(lines)) / len(lines), sizes.mean() / 10 if len(sizes) else 0, sizes.std() / 10 if len(sizes) else 0,
        np.log1p(len(words)) / 10, np.log1p(len(raw) / len(lines)) / 10, (sizes > 30).sum() / n,
    ]
    out[:len(_KINDS)] = np.sqrt(share)
    out[len(_KINDS):] = more
    return out


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN))
        self.b = np.zeros(HIDDEN)
        self.v = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        self.c = np.zeros(1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._standard(x) @ self.w + self.b) @ self.v + self.c

    def _standard(self, x):
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def train(self, batches, slopes) -> None:
        """Adam over batches of feature rows; slopes(logits, batch) gives the loss's slope at each logit."""
        names = ("w", "b", "v", "c")
        m, s = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        for step, (x, kind) in enumerate(batches, 1):
            z = self._standard(x)
            h = np.tanh(z @ self.w + self.b)
            g = slopes(h @ self.v + self.c, kind)
            back = g[:, None] * self.v * (1 - h * h)
            grads = {"w": z.T @ back + DECAY * self.w, "b": back.sum(0), "v": h.T @ g + DECAY * self.v, "c": g.sum(keepdims=True)}
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
                setattr(self, k, getattr(self, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8))

    def scores(self, x: np.ndarray) -> np.ndarray:
        # rounded: the last bits of a matrix product depend on a row's place in the batch
        return np.round(sigmoid(self.logits(x)), 9) if len(x) else np.zeros(0)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _batches(p: np.ndarray, u: np.ndarray, rng):
    """Batches of positives (kind 1) and unlabelled rows (kind 0), each in its own random order, over again."""
    half = BATCH // 2
    steps = max(STEPS, EPOCHS * max(len(p), len(u)) // BATCH)
    take_p, take_u = (rng.integers(0, len(x), (steps, min(half, max(8, len(x))))) for x in (p, u))
    for i, j in zip(take_p, take_u, strict=True):
        yield np.vstack([p[i], u[j]]), np.repeat([1, 0], [len(i), len(j)])


def nn_pu_slopes(prior: float):
    """Slopes of the non-negative risk with the logistic loss."""

    def slopes(z: np.ndarray, kind: np.ndarray) -> np.ndarray:
        pos, unl = kind == 1, kind == 0
        n_p, n_u = pos.sum(), unl.sum()
        as_positive, as_negative = sigmoid(z) - 1, sigmoid(z)  # slopes of log(1 + e^-z), log(1 + e^z)
        loss_negative = np.logaddexp(0, z)
        negative_risk = loss_negative[unl].mean() - prior * loss_negative[pos].mean()
        g = np.zeros_like(z)
        if negative_risk >= 0:
            g[pos] = prior * (as_positive[pos] - as_negative[pos]) / n_p
            g[unl] = as_negative[unl] / n_u
        else:  # undo the part that has gone below zero
            g[pos] = prior * as_negative[pos] / n_p
            g[unl] = -as_negative[unl] / n_u
        return g

    return slopes


def prior_cuts(scores_p: np.ndarray) -> np.ndarray:
    return np.quantile(scores_p, np.linspace(0.02, 0.98, 97))


def class_prior(scores_p: np.ndarray, cuts: np.ndarray, above: np.ndarray, n_u: int) -> float:
    """Best bin: the least ratio of the shares at or above a cut, with a margin for chance. above: of n_u unlabelled rows, those at or above each cut."""
    share_p = (scores_p[:, None] >= cuts).mean(0)
    share_u = above / n_u
    margin = np.sqrt(np.log(20) / 2 / n_u) + np.sqrt(np.log(20) / 2 / len(scores_p))
    best = np.argmin((share_u + margin) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray, count: Callable[[Network, np.ndarray], tuple[np.ndarray, int]] | None = None, seed: int = SEED) -> Network | None:
    """A network from feature rows of trusted positives and unlabelled texts; None without either.

    count(network, cuts) tells how many of all unlabelled texts reach each cut, and how many there are; without it, u is all.
    """
    if not len(p) or not len(u):
        return None
    rng = np.random.default_rng(seed)
    p, u = (x[rng.permutation(len(x))] for x in (p, u))
    both = np.vstack([p, u])
    mean, spread = both.mean(0), both.std(0) + 1e-3
    cut_p, cut_u = max(1, len(p) // 2), max(1, len(u) // 2)
    apart = Network(mean, spread, seed)
    # positives against unlabelled, on one half of each; the prior comes from the other positives and all unlabelled texts
    apart.train(_batches(p[:cut_p], u[:cut_u], rng), lambda z, kind: (sigmoid(z) - kind) / len(z))
    scores_p = apart.logits(p[cut_p:] if len(p) > 1 else p)
    cuts = prior_cuts(scores_p)
    above, n_u = count(apart, cuts) if count else _reached(apart, cuts, u)
    prior = class_prior(scores_p, cuts, above, n_u)
    net = Network(mean, spread, seed)
    net.train(_batches(p, u, rng), nn_pu_slopes(prior))
    net.prior = prior
    return net


def _reached(net: Network, cuts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
    return (net.logits(x)[:, None] >= cuts).sum(0), len(x)


def _rows(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<f4").reshape(-1, N_FEATURES).astype(float)


def described(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with features binary (N_FEATURES 32-bit numbers), in place of its text if that isn't kept."""
    make = lambda: lambda texts: [pa.array([features(t).astype("<f4").tobytes() for t in texts.to_pylist()], pa.binary())]
    return _shared.map_columns(df, [text], [T.StructField("features", T.BinaryType())], make, drop=() if keep_text else (text,))


def scored(df: DataFrame, net: Network | None) -> DataFrame:
    """df with quality double from 0 to 1 in place of features; 0.5 and more is kept."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few KB

    def make():
        own = shared.value
        return lambda packed: [pa.array(own.scores(_rows(packed)) if own else np.ones(len(packed)), pa.float64())]

    return _shared.map_columns(df, ["features"], [T.StructField("quality", T.DoubleType())], make, drop=("features",))


def score(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """df with quality double from 0 to 1; 0.5 and more is kept."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few KB

    def make():
        own = shared.value
        # as stored features are, in 32 bits: a text has one score, whichever way it is scored
        return lambda texts: [pa.array(own.scores(np.array([features(t).astype("<f4") for t in texts.to_pylist()], float).reshape(-1, N_FEATURES)) if own else np.ones(len(texts)), pa.float64())]

    return _shared.map_columns(df, [text], [T.StructField("quality", T.DoubleType())], make)


def learned(rows: DataFrame, labels: DataFrame) -> Network | None:
    """The network of rows (doc_id, features), of which labels marks the trusted positives; every row without a label is unlabelled.

    If every row has a label, all rows are taken as unlabelled.
    """
    spark = rows.sparkSession
    good = _labelled.sampled(rows, labels.where(~_labelled.held_out() & (F.col("quality") == 1)), POSITIVES, "features")
    free = rows.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    some = _labelled.sampled(free, free, UNLABELLED, "features")
    if not some:
        free = rows
        some = _labelled.sampled(free, free, UNLABELLED, "features")

    def count(net: Network, cuts: np.ndarray) -> tuple[np.ndarray, int]:
        shared = spark.sparkContext.broadcast((net, cuts))  # a few KB

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            above, n = np.zeros(len(shared.value[1]), np.int64), 0
            for batch in batches:
                if batch.num_rows:
                    more, m = _reached(*shared.value, _rows(batch.column("features")))
                    above, n = above + more, n + m
            yield pa.RecordBatch.from_arrays([pa.array(range(len(above) + 1), pa.int64()), pa.array([*above.tolist(), n], pa.int64())], names=["cut", "n"])

        found = free.select("features").mapInArrow(run, "cut long, n long").groupBy("cut").agg(F.sum("n").alias("n")).collect()  # a row a cut
        n = [r.n for r in sorted(found, key=lambda r: r.cut)]
        return np.array(n[:-1]), n[-1]

    as_rows = lambda x: np.array([np.frombuffer(f, "<f4") for f in x], float).reshape(-1, N_FEATURES)
    return fit(as_rows(good), as_rows(some), count)


def digests(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = _shared.materialise(described(documents.select("doc_id", "text")), "features")
    out = scored(rows, learned(rows, labels))
    return out.select("doc_id", _labelled.held_out().alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
