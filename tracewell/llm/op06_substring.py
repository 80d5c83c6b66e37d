"""Substring dedup by fixed-block anchors.

A word is removed if a window of `window` words that covers it also starts in a document with a smaller id. Each document is
cut into non-overlapping blocks of (window + 1) // 2 words: any repeat of a whole window holds one of them. The blocks are
the index; every rolling run of a block's length probes it. Where a probe of one document meets a block of another, the
windows around the hit are compared by hash, and the windows that repeat add up to the maximal exact repeats.

Documents are dealt to chunks of about a megabyte. A chunk sends the hashes of its probes and blocks to buckets (ranges of
the hash) as packed arrays, each hash once, so a passage in every document costs a bucket one entry a chunk, never one a
document; the bucket answers a chunk with one bit for each of its hashes. Windows go the same way, with the smallest
document id of the chunk. No pair of documents is ever formed, no row is dropped or capped; the numbers of chunks and buckets
follow from the bytes of the input, and a chunk's work depends on its own text alone. The bucket of a passage that every chunk
has gets an entry from each chunk.

Results: a null text has no words; a null id comes after all others; rows that share an id are one document for each other,
so they remove nothing from each other; an empty table gives no rows; clashing columns of the input are replaced.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _shared

WINDOW = 13
#: Bytes of text in a chunk, and hashes in a bucket, about.
CHUNK_BYTES = 1 << 20
BUCKET_HASHES = 2_000_000
#: Words whose hash a worker remembers: only speed depends on it.
MEMO_WORDS = 100_000
LAST_ID = (1 << 63) - 1
U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))


class WordHashes(dict):
    """Bytes of a word -> its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_known_words = WordHashes()
_word_hash = _known_words.__getitem__
_shared.resident("words", _known_words.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolling(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of n values."""
    count = max(0, len(h) - n + 1)
    out = h[:count].copy()
    for j in range(1, n):
        out *= base
        out += h[j:j + count]
    return mixed(out)


class Chunk:
    """The words of a chunk's documents, one after another, and the hashes of their runs."""

    def __init__(self, texts: list[bytes | None], ids: np.ndarray, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.words = [t.split() if t else [] for t in texts]
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        total = int(self.lengths.sum())
        self.h = np.fromiter(map(_word_hash, itertools.chain.from_iterable(self.words)), np.uint64, total)
        self.ids = ids
        self.doc = np.repeat(np.arange(len(self.words)), self.lengths)

    def inside(self, n: int) -> np.ndarray:
        """Positions where a run of n words lies in one document."""
        count = max(0, len(self.h) - n + 1)
        return np.flatnonzero(self.doc[:count] == self.doc[n - 1:]) if count else np.zeros(0, np.int64)

    def probes(self, buckets: int):
        """at, bucket and 32-bit key of every probe, and whether it is a block of the index."""
        at = self.inside(self.block)
        h = rolling(self.h, self.block, BASES[0])[at]
        offset = at - self.starts[self.doc[at]]
        return at, (h >> U(32)) % U(buckets), h.astype(np.uint32), offset % self.block == 0, h

    def cells(self, bucket: np.ndarray, key: np.ndarray):
        """Distinct keys by bucket and key, the place of each input among them, and the buckets that there are with their edges."""
        both = bucket.astype(np.uint64) << U(32) | key
        distinct, place = np.unique(both, return_inverse=True)
        return distinct, place, *own_buckets(distinct >> U(32))

    def near(self, hit: np.ndarray) -> np.ndarray:
        """Positions of the windows that hold a probe at a position of hit."""
        at = self.inside(self.window)
        if not len(at):
            return at
        upto = np.zeros(len(self.h) + 1, np.int64)
        upto[1:] = np.cumsum(np.bincount(hit, minlength=len(self.h)))
        return at[upto[at + self.window - self.block + 1] > upto[at]]

    def windows(self, at: np.ndarray, buckets: int):
        """Distinct windows of those at, by bucket and key: keys, the buckets that there are, their edges, smallest ids, places and ids."""
        bucket = (rolling(self.h, self.window, BASES[1])[at] >> U(24)) % U(buckets)
        key = rolling(self.h, self.window, BASES[0])[at]
        order = np.lexsort((key, bucket))
        b, k = bucket[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        place = np.empty(len(at), np.int64)
        place[order] = group
        ids = self.ids[self.doc[at]]
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
        return k[first], *own_buckets(b[first]), least, place, ids


def own_buckets(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ordered array, and where each begins and the last ends. A chunk's work doesn't depend on how many buckets there are in all."""
    sent, first = np.unique(of, return_index=True)
    return sent.astype(np.int64), np.r_[first, len(of)]


def planes(x: np.ndarray) -> bytes:
    """8-byte integers, byte by byte of significance: high bytes that agree compress away."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def answered(table: pa.Table, kind: int, sent: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bits of a chunk's hashes from the buckets' answers of a kind."""
    bits = np.zeros(int(edges[-1]), bool)
    for k, b, packed in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["bits"].to_pylist(), strict=True):
        if k == kind:
            i = int(np.searchsorted(sent, b))
            n = int(edges[i + 1] - edges[i])
            bits[edges[i]:edges[i + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
    return bits


CELL = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("more", T.BinaryType())])
ANSWER = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def _opened(table: pa.Table, at: tuple[str, str, int, str]) -> Chunk:
    """at: names of the id and the text, the window, and the name of the chunk's number."""
    _shared.enter("words")
    ids = table[at[0]].cast(pa.int64()).fill_null(LAST_ID).to_numpy()
    return Chunk(table[at[1]].cast(pa.binary()).to_pylist(), ids, at[2])


def _cells(bucket, chunk, keys, more) -> pa.Table:
    _shared.trim()
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([chunk] * len(bucket), pa.int64()), "keys": pa.array(keys, pa.binary()), "more": pa.array(more, pa.binary())})


def _answers(chunks, kind, bucket, bits) -> pa.Table:
    _shared.trim()
    n = len(chunks)
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _send_anchors(at, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        c = _opened(table, at)
        _, bucket, key, block, _ = c.probes(buckets)
        distinct, place, sent, edges = c.cells(bucket, key)
        is_block = np.zeros(len(distinct), bool)
        is_block[place[block]] = True
        low = distinct.astype(np.uint32)
        part = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return _cells(sent, table[at[3]][0].as_py(), [low[p].tobytes() for p in part], [np.packbits(is_block[p]).tobytes() for p in part])

    return run


def _meet_anchors(table: pa.Table) -> pa.Table:
    """Keys that several chunks probe and that a block of one of them has."""
    keys = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
    blocks = [k[np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool)] for k, m in zip(keys, table["more"].to_pylist(), strict=True)]
    every = np.sort(np.concatenate(keys))
    repeated = every[1:][every[1:] == every[:-1]]
    active = np.intersect1d(repeated, np.concatenate(blocks))
    chunks, bits = [], []
    for c, k in zip(table["chunk"].to_pylist(), keys, strict=True):
        at = np.searchsorted(active, k)
        hit = active[np.minimum(at, len(active) - 1)] == k if len(active) else np.zeros(len(k), bool)
        if hit.any():
            chunks.append(c)
            bits.append(np.packbits(hit).tobytes())
    return _answers(chunks, 0, table["bucket"][0].as_py(), bits)


def _hit_windows(c: Chunk, answers: pa.Table, buckets: int) -> np.ndarray:
    """Windows around probes that met a block of another document, of another chunk or of this one."""
    at, bucket, key, block, h = c.probes(buckets)
    if not len(at):
        return at
    _, place, sent, edges = c.cells(bucket, key)
    hit = answered(answers, 0, sent, edges)[place]
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    ids = c.ids[c.doc[at]][order]
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    indexed = np.logical_or.reduceat(block[order], first)
    local = np.empty(len(at), bool)
    local[order] = np.repeat(several & indexed, np.diff(np.r_[first, len(at)]))
    return c.near(at[hit | local])


def _send_windows(at, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _cells([], 0, [], [])
        c = _opened(table, at)
        keys, sent, edges, least, *_ = c.windows(_hit_windows(c, answers, buckets), buckets)
        part = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return _cells(sent, table[at[3]][0].as_py(), [keys[p].tobytes() for p in part], [planes(least[p]) for p in part])

    return run


def _meet_windows(table: pa.Table) -> pa.Table:
    """For each chunk's windows, whether another chunk has one in a document with a smaller id."""
    keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
    least = [unplanes(m) for m in table["more"].to_pylist()]
    k, d = np.concatenate(keys), np.concatenate(least)
    order = np.argsort(k, kind="stable")
    first = np.flatnonzero(np.r_[True, k[order][1:] != k[order][:-1]])
    smallest = np.empty(len(k), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(d[order], first), np.diff(np.r_[first, len(k)]))
    chunks, bits, at = [], [], 0
    for c, own in zip(table["chunk"].to_pylist(), least, strict=True):
        hit = smallest[at:at + len(own)] < own
        at += len(own)
        if hit.any():
            chunks.append(c)
            bits.append(np.packbits(hit).tobytes())
    return _answers(chunks, 1, table["bucket"][0].as_py(), bits)


def covered(c: Chunk, answers: pa.Table, buckets: int) -> np.ndarray:
    """Of a chunk's words, those to remove."""
    at = _hit_windows(c, answers, buckets)
    _, sent, edges, least, place, ids = c.windows(at, buckets)
    gone = answered(answers, 1, sent, edges)[place] | (least[place] < ids) if len(at) else np.zeros(0, bool)
    change = np.zeros(len(c.h) + 1, np.int64)
    starts = at[gone]  # distinct positions
    change[starts] += 1
    change[starts + c.window] -= 1
    return np.cumsum(change[:-1]) > 0


def without_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of spans and the white space that follows each of them; all else stays as it is."""
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:starts[a]])
        at = starts[b]
    return b"".join([*kept, raw[at:]])


def _remove(at, buckets: int, columns: list[str], schema: pa.Schema, keep_layout: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        c = _opened(table, at)
        gone = covered(c, answers, buckets)
        kept, removed, spans = [], [], []
        for i, (words, s, e) in enumerate(zip(c.words, c.starts, c.ends, strict=True)):
            g = gone[s:e]
            n = int(g.sum())
            removed.append(n)
            edges = np.flatnonzero(np.diff(np.r_[False, g, False])).tolist() if n else []
            own = list(zip(edges[::2], edges[1::2], strict=True))
            spans.append([{"start": a, "end": b} for a, b in own])
            if keep_layout:
                kept.append(without_spans((table[at[1]][i].as_py() or "").encode(), own))
            else:
                kept.append(b" ".join(itertools.compress(words, ~g) if n else words))
        made = {
            "n_words": pa.array(c.lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed_spans": pa.array(spans, schema.field("removed_spans").type),
        }
        _shared.trim()
        return pa.table([*[table[x] for x in columns], *made.values()], schema=schema)

    return run


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES, keep_layout: bool = False) -> DataFrame:
    """df with n_words long, n_removed long, kept_text string and removed_spans array<struct<start, end>> (in words).

    kept_text: the kept words joined by one blank, or with keep_layout the text itself without the removed spans. doc_id must
    be a column of integers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if window < 2:
        raise ValueError("a window has at least two words")
    spark = df.sparkSession
    _shared.bounded_batches(spark)
    size = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(math.ceil(size["bytes"] / chunk_bytes), min(parts, math.ceil(size["rows"] / 64)), 1)
    buckets = max(math.ceil(size["bytes"] / 6 / bucket_hashes), min(parts, chunks))

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    columns = _shared.without(df, [f.name for f in added]).columns
    chunk = _shared.fresh(df, "chunk")
    # every step takes all columns, so that the plan deals the documents out once and reuses that exchange
    dealt = df.select(*[f"`{c}`" for c in columns], F.pmod(F.xxhash64(doc_id, text), F.lit(chunks)).alias(chunk)).repartition(chunk)
    out = T.StructType([*[df.schema[c] for c in columns], *added])
    at = (doc_id, text, window, chunk)

    anchors = dealt.groupBy(chunk).applyInArrow(_send_anchors(at, buckets), CELL)
    met = anchors.groupBy("bucket").applyInArrow(_meet_anchors, ANSWER)
    windows = dealt.groupBy(chunk).cogroup(met.groupBy("chunk")).applyInArrow(_send_windows(at, buckets), CELL)
    answers = met.unionByName(windows.groupBy("bucket").applyInArrow(_meet_windows, ANSWER))
    return dealt.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(_remove(at, buckets, columns, to_arrow_schema(out), keep_layout), out)


def digests(df: DataFrame) -> DataFrame:
    return dedup(df.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_shared.table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring": op6_substring}
