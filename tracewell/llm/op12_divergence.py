"""Source divergence audit: how far the vocabulary of each source is from the other sources of its language.

A tokenizer works on bytes: one table look-up over the concatenated UTF-8 of a batch marks what belongs to a term, its edges
are the terms. Equal slices are grouped by xxhash, and every slice is compared byte by byte with the first of its group. The
counts of batches add up by (lang, term); terms in at least `least` documents of a language are kept. Blocks of a language's
terms become sparse rows, one a source, and reduceat adds up the divergences of all pairs of sources of a block; blocks add up.

Shares are p = 1 + floor(10^9 (count + 2) / (N + 2 V)), a term's divergence between p and q is floor((p - q)^2 / (p + q)), all
in integers (exact up to 9 * 10^15 occurrences in a source). A row of the input is a document, repeated ids or not.

A block holds whole terms, so at most as many entries of one term as the language has sources; the sums of a block, like the
result, have a row for each pair of sources of a language. No row is dropped or capped.

Results: null text, lang and source are empty strings; a language without kept terms has all values 0 and no terms; an empty
table gives no rows; other columns of the input aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import _shared

LEAST, TOP = 10, 10
#: Bytes of text after which a task hands its counts on, and entries (term and source) of a block, about.
FLUSH_BYTES, BLOCK_ENTRIES = 1 << 24, 1_000_000
#: Bytes that belong to a term, and what becomes of each byte: letters, and all of a character beyond ASCII.
IN_TERM = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[edges[0]:edges[-1]], edges - edges[0]


def slices(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms, and the text of each; none goes over an edge."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(edges, starts, "right") - 1


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all bytes of slices, one slice after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] | None = None) -> tuple[np.ndarray, list[bytes]]:
    """A group for each slice, and each group's bytes."""
    if digest is None:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
    raw = low.tobytes()
    parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    hashes = np.fromiter(map(digest, parts), np.uint64, len(parts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [parts[i] for i in first.tolist()]
    lengths, lead = ends - starts, first[group]
    differs = lengths != lengths[lead]
    own = np.flatnonzero(~differs)
    unlike = low[spread(starts[own], lengths[own])] != low[spread(starts[lead[own]], lengths[own])]
    if len(own):
        differs[own] = np.add.reduceat(unlike, np.cumsum(lengths[own]) - lengths[own]) > 0
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(differs).tolist():  # one hash, other bytes: a group by the bytes themselves
        group[i] = len(terms) + others.setdefault(parts[i], len(others))
    return group, terms + list(others)


def counted(batch: pa.RecordBatch, digest: Callable[[bytes], int] | None = None) -> pa.Table:
    """lang, source, term, n, docs of a batch of lang, source, text."""
    data, edges = bytes_of(batch.column(2))
    starts, ends, doc = slices(data, edges)
    group, terms = grouped(LOWERED[data], starts, ends, digest)
    lang, source = (batch.column(i).fill_null("").dictionary_encode() for i in (0, 1))
    n_sources = max(1, len(source.dictionary))
    own = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()  # a number for each (lang, source)
    per_doc, n = np.unique(doc * max(1, len(terms)) + group, return_counts=True)  # texts and terms of a batch: far below 2^63
    d, t = np.divmod(per_doc, max(1, len(terms)))
    key = own[d] * max(1, len(terms)) + t
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    g, t = np.divmod(key[at], max(1, len(terms)))
    total = np.add.reduceat(n[order], at) if len(at) else at
    return pa.table({
        "lang": lang.dictionary.take(pa.array(g // n_sources)), "source": source.dictionary.take(pa.array(g % n_sources)), "term": pa.array(terms, pa.binary()).take(pa.array(t)),
        "n": pa.array(total, pa.int64()), "docs": pa.array(np.diff(np.r_[at, len(key)]), pa.int64()),
    })


def _count(flush_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _shared.enter("terms")
        held: list[pa.Table] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sums = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            out = pa.table({"lang": sums["lang"], "source": sums["source"], "term": sums["term"].cast(pa.string()), "n": sums["n_sum"], "docs": sums["docs_sum"]})
            held.clear()
            yield from out.to_batches(max_chunksize=_shared.BATCH_ROWS * 8)

        for batch in batches:
            size += batch.nbytes
            held.append(counted(batch))
            if size >= flush_bytes:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        _shared.trim()

    return run


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), by long division, three digits at a time."""
    rest, below = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * kept
    out = np.zeros(np.broadcast(rest, below).shape, np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def sums_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and each one's sum of values."""
    if not len(key):
        return (key, *values)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    return (key[order][at], *(np.add.reduceat(v[order], at) for v in values))


class Block:
    """Some terms of a language: sparse rows, one for each of all its sources."""

    def __init__(self, row: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, kept: int):
        """row, term, n: entries with n > 0. totals: N of each source. kept: V."""
        order = np.lexsort((term, row))
        self.row, self.term, self.n = row[order], term[order], n[order]
        self.size, self.n_terms = len(totals), int(term.max()) + 1
        self.starts = np.searchsorted(self.row, np.arange(self.size))
        self.stored = np.diff(np.r_[self.starts, len(self.row)])
        self.zero = share(np.zeros(self.size, np.int64), totals, kept)
        self.p = share(self.n, totals[self.row], kept)
        by_term = np.lexsort((self.row, self.term))
        self.c_row, self.c_term, self.c_p = self.row[by_term], self.term[by_term], self.p[by_term]

    def against_zero(self) -> np.ndarray:
        """[a, b]: the terms of a against a source that has none of them."""
        out = np.zeros((self.size, self.size), np.int64)
        filled = self.stored > 0
        for b in range(self.size):
            out[filled, b] = np.add.reduceat(divergence(self.p, self.zero[b]), self.starts[filled])
        return out

    def pairs(self) -> np.ndarray:
        """[a, b], a < b: the divergence over all terms of the block."""
        once = self.against_zero()
        total = (once + once.T).ravel()
        both = np.zeros(self.size * self.size, np.int64)
        for step in range(1, int(np.bincount(self.c_term).max())):
            same = self.c_term[step:] == self.c_term[:-step]
            a, b, pa_, pb = self.c_row[:-step][same], self.c_row[step:][same], self.c_p[:-step][same], self.c_p[step:][same]
            more = divergence(pa_, pb) - divergence(pa_, self.zero[b]) - divergence(pb, self.zero[a])
            key, more, n = sums_by(a * self.size + b, more, np.ones(len(a), np.int64))
            total[key] += more
            both[key] += n
        none = self.n_terms - self.stored[:, None] - self.stored[None, :] + both.reshape(self.size, -1)
        return total.reshape(self.size, -1) + none * divergence(self.zero[:, None], self.zero[None, :])

    def leading(self, lang_total: int, kept: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source, term and value of each source's top terms with a larger share than in the language. Terms are numbered in their order."""
        _, in_lang = sums_by(self.term, self.n)  # every term of the block has an entry
        q = share(in_lang, np.int64(lang_total), kept)[self.term]
        more = self.p > q
        row, term, value = self.row[more], self.term[more], divergence(self.p[more], q[more])
        order = np.lexsort((term, -value, row))
        row, term, value = row[order], term[order], value[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < top
        return row[first], term[first], value[first]


def _diverge(top: int):
    def run(entries: pa.Table, sources: pa.Table) -> pa.Table:
        _shared.enter("terms")
        found: dict[str, list] = {"lang": [], "source": [], "part": [], "item": [], "value": []}
        if entries.num_rows:
            names = sources["source"].to_pylist()
            order = sorted(range(len(names)), key=lambda i: names[i].encode())
            names = [names[i] for i in order]
            totals = sources["total"].to_numpy()[order]
            kept, lang_total = sources["kept"][0].as_py(), sources["lang_total"][0].as_py()
            place = {s: i for i, s in enumerate(names)}
            row = np.array([place[s] for s in entries["source"].to_pylist()], np.int64)
            terms = entries["term"].combine_chunks().cast(pa.binary()).dictionary_encode()
            words = terms.dictionary.to_pylist()
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            words.sort()
            block = Block(row, rank[terms.indices.to_numpy()], entries["n"].to_numpy(), totals, kept)
            total = block.pairs()
            total = np.triu(total, 1) + np.triu(total, 1).T
            a, b = np.nonzero(~np.eye(len(names), dtype=bool))
            who, what, value = block.leading(lang_total, kept, top)
            found["source"] = [names[i] for i in a.tolist()] + [names[i] for i in who.tolist()]
            found["part"] = ["pair"] * len(a) + ["term"] * len(who)
            found["item"] = [names[i] for i in b.tolist()] + [words[i].decode() for i in what.tolist()]
            found["value"] = np.r_[total[a, b], value].tolist()
            found["lang"] = [sources["lang"][0].as_py()] * len(found["source"])
        _shared.trim()
        return pa.table({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in found.items()})

    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, flush_bytes: int = FLUSH_BYTES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (`pair`), and the top terms of the source (`term`)."""
    spark = docs.sparkSession
    _shared.bounded_batches(spark)
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(_count(flush_bytes), "lang string, source string, term string, n long, docs long")
    # dealt by term at once: sums by source, documents and sources of a term all follow without another shuffle
    by_source = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = _shared.materialise(by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("per")).where(F.col("docs") >= least).drop("docs"), "terms")
    entries = kept.select("lang", "term", F.inline("per"))

    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    occurring = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept"])
    sources = _shared.materialise(occurring.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))), "sources")
    blocks = max(1, math.ceil((kept.agg(F.sum(F.size("per"))).first()[0] or 0) / block_entries))

    dealt = entries.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    told = sources.where("kept > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    made = dealt.groupBy("lang", "block").cogroup(told.groupBy("lang", "block")).applyInArrow(_diverge(top), "lang string, source string, part string, item string, value long")
    summed = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))

    empty = sources.where("kept = 0").select("lang", "source")  # without kept terms no block tells of the pairs
    nothing = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.unionByName(nothing).withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_shared.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
nl AS (SELECT lang, sum(total)::HUGEINT AS total FROM n GROUP BY 1),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (n.total + 2 * v.v) AS p
  FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(p.n)::HUGEINT + 2) // (any_value(nl.total) + 2 * any_value(v.v)) AS q FROM p JOIN nl USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::HUGEINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op12_divergence": op12_divergence}
ORACLES = {"op12_divergence": ORACLE}
