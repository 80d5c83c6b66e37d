"""Toxicity by a convolutional text classifier trained in numpy.

Words are embedded by hashing: a word's vector is the sum of trained rows for its whole form and its first four and five
letters, so that inflected forms share what they learn. Filters over one, two and three words are max-pooled over the whole
text and feed a logistic output. The training sample is bounded (SAMPLE texts a class); part of it is kept back to calibrate
a threshold for each language, which is guessed from the text's own function words. A score is shifted so that 0.7 is the
threshold of the text's language.

Results: null and empty texts have a score, that of a text without words; equal texts have equal scores; without rows of
both labels to learn from every score is 0; an empty table gives no rows; clashing columns of the input are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _labelled, _shared

#: Most texts of each label that are learned from.
SAMPLE = 3000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 900, 32, 0.005, 7  # at least so many passes and steps
#: Spread of the embeddings at the start, and the part of words left out of each step, so that no single word is relied on.
SPREAD, LEFT_OUT = 0.01, 0.6
#: A hashed feature is learned if so many texts of the sample have it.
LEAST_TEXTS = 2
THRESHOLD = 0.7
#: Words whose filter values a worker remembers: only speed depends on it.
MEMO_WORDS = 100_000
_WORD = re.compile(r"\w+").findall
#: Common function words by language, to guess a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as was be by this",
    "de": "der die und das den von zu mit ist im für auf dem nicht ein eine",
    "fr": "le la les des et du une est dans pour que qui au sur par elle",
    "es": "el los las y en del se por con una para es no al lo su",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_LANGUAGE_OF: dict[str, int] = {w: i for i, lang in enumerate(LANGUAGES) for w in FUNCTION_WORDS[lang].split()}


def words_of(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


def feature_ids(word: str) -> tuple[int, int, int]:
    """Rows of the embedding table; row 0 is always zero."""
    import xxhash

    return tuple(1 + xxhash.xxh32_intdigest(f"{k}{part}".encode()) % (BUCKETS - 1) for k, part in (("w", word), ("4", word[:4]), ("5", word[:5])))


class Network:
    """Weights: table (buckets, dim); filters (dim, sum(widths) * FILTERS), by width and offset; bias, out, shift."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, SPREAD, (BUCKETS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.filters = rng.normal(0, DIM**-0.5, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.thresholds = np.zeros(len(LANGUAGES) + 1)

    def pooled(self, values: np.ndarray, index: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False):
        """Max over each text's positions of every filter. values: a row a word, the last one zero for padding.

        index: words of all texts, two paddings after each; a text's positions are starts to ends, at least one.
        """
        found, at = [], []
        col = 0
        for w in WIDTHS:
            n = len(index) - w + 1
            conv = values[index[:n], col:col + FILTERS]
            for k in range(1, w):
                conv = conv + values[index[k:k + n], col + k * FILTERS:col + (k + 1) * FILTERS]
            col += w * FILTERS
            if where:
                place = np.stack([s + conv[s:e].argmax(0) for s, e in zip(starts, np.minimum(ends, n), strict=True)])
                at.append(place)
                found.append(np.take_along_axis(conv, place, 0))
            else:
                found.append(np.maximum.reduceat(conv, starts, axis=0))
        return np.concatenate(found, 1) + self.bias, at


def _laid_out(docs: list[np.ndarray], pad: int):
    """Texts' word indices one after another, each followed by two paddings (three if it has no words)."""
    parts, starts, at = [], [], 0
    for d in docs:
        starts.append(at)
        parts += [d, [pad] * (2 if len(d) else 3)]
        at += len(d) + (2 if len(d) else 3)
    starts = np.array(starts)
    return np.concatenate(parts).astype(np.int64), starts, np.array([s + max(len(d), 1) for s, d in zip(starts, docs, strict=True)])


def fit(texts: dict[int, list[str]], seed: int = SEED) -> Network | None:
    """A network from texts by label; None if a label has none."""
    if not texts[0] or not texts[1]:
        return None
    rng = np.random.default_rng(seed)
    net = Network(seed)
    words = [words_of(t) for v in (0, 1) for t in texts[v]]
    y = np.repeat([0.0, 1.0], [len(texts[0]), len(texts[1])])
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in d], np.int64) for d in words]
    ids = np.array([feature_ids(w) for w in vocabulary] or np.zeros((0, 3)), np.int64).reshape(-1, 3)
    seen = np.zeros(BUCKETS, np.int64)
    for d in docs:
        seen[np.unique(ids[np.unique(d)])] += 1
    known = seen >= LEAST_TEXTS
    known[0] = False
    net.table[~known] = 0
    ids = np.where(known[ids], ids, 0)
    ids = np.vstack([ids, np.zeros((1, 3), np.int64)])
    pad = len(vocabulary)

    order = rng.permutation(len(docs))
    kept_back, learn = order[: len(order) // 5], order[len(order) // 5:]
    weights = {"table": net.table, "filters": net.filters, "bias": net.bias, "out": net.out, "shift": net.shift}
    m, v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(learn)))):
        for begin in range(0, len(learn), BATCH):
            picked = learn[begin:begin + BATCH]
            index, starts, ends = _laid_out([docs[i] for i in picked], pad)
            index[rng.random(len(index)) < LEFT_OUT] = pad
            used, place = np.unique(index, return_inverse=True)
            vectors = net.table[ids[used]].sum(1)
            hidden, at = net.pooled(vectors @ net.filters, place, starts, ends, where=True)
            active = np.maximum(hidden, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.shift, -30, 30)))
            slope = ((p - y[picked]) / len(picked)).astype(np.float32)
            back = slope[:, None] * net.out * (hidden > 0)
            grads = {"out": active.T @ slope + 1e-4 * net.out, "shift": slope.sum(keepdims=True), "bias": back.sum(0), "filters": np.zeros_like(net.filters)}
            to_vectors = np.zeros_like(vectors)
            col = 0
            for k, w in enumerate(WIDTHS):
                b = back[:, k * FILTERS:(k + 1) * FILTERS]
                for offset in range(w):
                    cols = slice(col + offset * FILTERS, col + (offset + 1) * FILTERS)
                    word = place[at[k] + offset]
                    grads["filters"][:, cols] += np.einsum("nfd,nf->df", vectors[word], b)
                    np.add.at(to_vectors, word.ravel(), (b[:, :, None] * net.filters[:, cols].T).reshape(-1, DIM))
                col += w * FILTERS
            hit = np.flatnonzero(np.abs(to_vectors).sum(1))
            rows = ids[used[hit]]
            touched, inverse = np.unique(rows, return_inverse=True)
            table = np.zeros((len(touched), DIM), np.float32)
            np.add.at(table, inverse.ravel(), np.repeat(to_vectors[hit], 3, axis=0))
            table[touched == 0] = 0
            step += 1
            size = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for name, g in [*grads.items(), ("table", table)]:
                s = touched if name == "table" else slice(None)
                m[name][s] = 0.9 * m[name][s] + 0.1 * g
                v[name][s] = 0.999 * v[name][s] + 0.001 * g * g
                weights[name][s] -= size * m[name][s] / (np.sqrt(v[name][s]) + 1e-8)
        learn = rng.permutation(learn)
    scorer = Scorer(net)
    back_texts = [t for v in (0, 1) for t in texts[v]]
    raw, lang = scorer.raw([back_texts[i] for i in kept_back])
    net.thresholds = _thresholds(raw, lang, y[kept_back])
    return net


def _thresholds(raw: np.ndarray, lang: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each language (the last: unknown), the raw score between the classes with the fewest errors on texts kept back."""

    def best(r, t):
        cuts = np.sort(r)
        cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
        errors = np.array([((r >= c) != (t == 1)).sum() for c in cuts])
        good = cuts[errors == errors.min()]
        return float((good.min() + good.max()) / 2)

    whole = best(raw, y) if len(raw) else 0.0
    out = np.full(len(LANGUAGES) + 1, whole)
    for i in range(len(LANGUAGES)):
        own = lang == i
        if (y[own] == 1).sum() >= 15 and (y[own] == 0).sum() >= 15:
            out[i] = best(raw[own], y[own])
    return out


def _language(counts: np.ndarray) -> int:
    """The language with the most function words; the last count is that of all other words."""
    return int(counts[:-1].argmax()) if counts[:-1].any() else len(LANGUAGES)


class Scorer(dict):
    """Word -> its row of filter values, kept for a worker's life up to MEMO_WORDS."""

    def __init__(self, net: Network):
        super().__init__()
        self.net = net
        self.values = np.zeros((MEMO_WORDS + 1, net.filters.shape[1]), np.float32)
        self.language = np.full(MEMO_WORDS + 1, len(LANGUAGES), np.int8)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the guessed language of each text (len(LANGUAGES): unknown)."""
        logits, langs = [], []
        for text in texts:  # one text at a time, so that memory follows the longest text
            words = words_of(text)
            index = np.empty(len(words) + 2 + (not words), np.int64)
            index[len(words):] = MEMO_WORDS
            if len(set(words)) + len(self) > MEMO_WORDS:
                self.clear()
                self.new.clear()
                if len(set(words)) > MEMO_WORDS:
                    logits.append(self._long(words))
                    langs.append(_language(np.bincount([_LANGUAGE_OF.get(w, len(LANGUAGES)) for w in words], minlength=len(LANGUAGES) + 1)))
                    continue
            index[:len(words)] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            if self.new:
                rows = slice(len(self) - len(self.new), len(self))
                self.values[rows] = self.net.table[np.array([feature_ids(w) for w in self.new])].sum(1) @ self.net.filters
                self.language[rows] = [_LANGUAGE_OF.get(w, len(LANGUAGES)) for w in self.new]
                self.new.clear()
            pooled, _ = self.net.pooled(self.values, index, np.array([0]), None)
            logits.append(float(np.maximum(pooled[0], 0) @ self.net.out + self.net.shift[0]))
            langs.append(_language(np.bincount(self.language[index[:len(words)]], minlength=len(LANGUAGES) + 1)))
        return np.array(logits), np.array(langs, np.int64)

    def _long(self, words: list[str]) -> float:
        """A text with more distinct words than are remembered: the max over overlapping parts of it."""
        part = MEMO_WORDS // 2
        best = None
        for begin in range(0, len(words), part):
            w = words[begin:begin + part + max(WIDTHS) - 1]
            distinct: dict[str, int] = {}
            index = np.array([distinct.setdefault(x, len(distinct)) for x in w] + [len(set(w))] * 2)
            values = np.vstack([self.net.table[np.array([feature_ids(x) for x in distinct])].sum(1) @ self.net.filters, np.zeros((1, self.values.shape[1]), np.float32)])
            pooled, _ = self.net.pooled(values, index, np.array([0]), None)
            best = pooled[0] if best is None else np.maximum(best, pooled[0])
        return float(np.maximum(best, 0) @ self.net.out + self.net.shift[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        raw, lang = self.raw(texts)
        # rounded: the last bits of a matrix product depend on a row's place in it
        return np.round(1 / (1 + np.exp(-np.clip(raw - self.net.thresholds[lang] + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30))), 6)


def score(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """df with toxicity double from 0 to 1; 0.7 and more is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input

    def make():
        scorer = Scorer(shared.value) if shared.value is not None else None
        return lambda texts: [pa.array(scorer.scores(texts.to_pylist()) if scorer is not None else np.zeros(len(texts)), pa.float64())]

    return _shared.map_columns(df, [text], [T.StructField("toxicity", T.DoubleType())], make, drop=(text,))


def digests(documents: DataFrame, labels: DataFrame) -> DataFrame:
    net = fit(_labelled.labelled_texts(documents, labels, "toxic", SAMPLE))
    scored = score(documents.select("doc_id", "text"), net)
    return scored.select("doc_id", _labelled.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
