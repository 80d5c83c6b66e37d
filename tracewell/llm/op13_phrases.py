"""Phrase collocation mining.

Texts become pieces, identical pieces become one with a multiplicity. Phrases are counted in rounds over the pieces: words,
then pairs of frequent words, then three to five words whose pairs are all frequent. What is frequent travels to the next
round as a filter of a fixed number of bits, so a false positive is only counted in vain and no count is ever lost. In a
round, a task adds up the phrases of some megabytes of pieces exactly, by numbers of words, then of pairs, then of triples,
and packs them by hash bucket; DuckDB adds up each bucket out of core and keeps the phrases that are frequent enough. The
parts of candidates ask for their counts by a shuffled join on the part.

Buckets follow from the number of words; a flush sends a row only for buckets that it has phrases of, so a very common phrase
is a row a flush, never one an occurrence. No row is dropped or capped, nothing but the filters (FILTER_BITS) is broadcast.

Results: a null text has no words; a null lang is `und`; rows count as often as they occur, repeated ids or not; an empty table
gives no rows; other columns of the input aren't read. Words are split at blanks and tabs only, other white space and controls
belong to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import _shared
from tracewell.llm.op06_substring import BASES, mixed
from tracewell.llm.op12_divergence import LOWERED, bytes_of, spread

LEAST, LONGEST, TOP, UNKNOWN = 100, 5, 2000, "und"
#: Bits of a filter (8 MB), and of a row in which it is built.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15
#: Bytes of pieces that a task adds up at once; phrases (occurrences) of a bucket, about; memory of DuckDB in a task.
FLUSH_BYTES, BUCKET_PHRASES, DUCKDB_MB = 12 << 20, 4_000_000, 256
BLANK, BREAK = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces with words of all texts in lower case, each word followed by one blank; the text and the number of words of each."""
    data, edges = bytes_of(texts)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~(BLANK[data] | BREAK[data])
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    breaks = np.cumsum(np.r_[0, BREAK[data]])
    text = np.searchsorted(edges, starts, "right") - 1
    if not len(starts):
        return pa.array([], pa.string()), text, text
    first = np.flatnonzero(np.r_[True, (breaks[starts[1:]] != breaks[starts[:-1]]) | (text[1:] != text[:-1])])
    # one byte more of each word, which becomes the blank: the byte behind it, or one past the end of all
    lengths = ends - starts + 1
    own = np.r_[LOWERED[data], np.uint8(0)][spread(starts, lengths)]
    after = np.cumsum(lengths)
    own[after - 1] = 0x20
    offsets = np.r_[0, after][np.r_[first, len(starts)]]
    whole = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)])
    return whole.cast(pa.binary()).cast(pa.string()), text[first], np.diff(np.r_[first, len(starts)])


def _split():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _shared.enter("phrases")
        for batch in batches:
            pieces, text, words = pieces_of(batch.column(1))
            made = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pieces, pa.array(words, pa.int64())], names=["lang", "piece", "n_words"])
            for at in range(0, len(pieces), _shared.BATCH_ROWS * 8):
                yield made.slice(at, _shared.BATCH_ROWS * 8)
        _shared.trim()

    return run


def word_slots(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * BASES[0] + second)


class Filter:
    """Bits of what is frequent."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def has(self, slots: np.ndarray) -> np.ndarray:
        at = slots % U(self.bits)
        return (self.packed[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) == 1


def filter_of(counted: DataFrame, bits: int) -> Filter:
    """The filter of the column slot: the driver gets at most bits / ROW_BITS rows of ROW_BITS bits."""
    place = F.pmod(F.col("slot"), F.lit(bits)).alias("at")  # bits is a power of two: the same as of the unsigned number
    rows = counted.select(place).groupBy(F.expr(f"at div {ROW_BITS}").alias("row")).agg(F.expr(f"bitmap_construct_agg(at % {ROW_BITS})").alias("own")).collect()
    packed = np.zeros(bits // 8, np.uint8)
    for r in rows:
        packed[r["row"] * ROW_BITS // 8:(r["row"] + 1) * ROW_BITS // 8] = np.frombuffer(r["own"], np.uint8)
    return Filter(packed, bits)


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys' first places and weights, and the number of each key among them."""
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[at], np.add.reduceat(weight[order], at) if len(at) else weight[:0], number


class Pieces:
    """Some pieces: their words by number, with the place of each word's bytes."""

    def __init__(self, table: pa.Table):
        pieces = table["piece"].combine_chunks()
        self.data, edges = bytes_of(pieces)
        blanks = np.flatnonzero(self.data == 0x20)
        self.ends = blanks + 1
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64) if len(blanks) else np.zeros(0, np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(blanks), [None, pa.py_buffer(np.r_[self.starts, len(self.data)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data))])
        coded = words.dictionary_encode()
        self.word, self.known = coded.indices.to_numpy().astype(np.int64), [w[:-1] for w in coded.dictionary.to_pylist()]
        self.slots = word_slots(self.known)
        self.piece = np.searchsorted(edges, self.starts, "right") - 1
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.lang_names = langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[self.piece]
        self.weight = table["copies"].to_numpy()[self.piece]

    def phrases(self, lengths: tuple[int, ...], words: Filter | None, pairs: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each length: it, the first places of distinct (lang, phrase), and their weights. Words not in words, or pairs not in pairs, don't count."""
        if not len(self.word):
            return
        slots = self.slots
        fits = np.ones(len(self.word), bool) if words is None else words.has(slots)[self.word]
        dense, at = self.lang, np.flatnonzero(fits)
        for m in range(1, max(lengths) + 1):
            if m > 1:
                at = at[at + m - 1 < len(self.word)]
                last = at + m - 1
                at = at[(self.piece[at] == self.piece[last]) & fits[last]]
                if pairs is not None:
                    tail = self.word[at + m - 2], self.word[at + m - 1]
                    at = at[pairs.has(pair_slots(slots[tail[0]], slots[tail[1]]))]
            key = dense[at] * len(self.known) + self.word[at + m - 1]
            first, weight, own = summed(key, self.weight[at])
            dense = np.zeros(len(self.word), np.int64)
            dense[at] = own
            if m in lengths:
                yield m, at[first], weight

    def packed(self, m: int, at: np.ndarray, weight: np.ndarray, buckets: int) -> Iterator[dict]:
        """Rows of a bucket, language and length: the phrases' bytes, and their weights."""
        if not len(at):
            return
        hashed = self.slots[self.word[at]]
        for j in range(1, m):
            hashed = pair_slots(hashed, self.slots[self.word[at + j]])
        bucket = (mixed(hashed + U(m)) % U(buckets)).astype(np.int64)
        order = np.lexsort((hashed, self.lang[at], bucket))
        at, weight, bucket, lang = at[order], weight[order], bucket[order], self.lang[at[order]]
        edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1]), True])
        starts, lengths = self.starts[at], self.ends[at + m - 1] - self.starts[at]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = self.data[spread(starts[a:b], lengths[a:b])]
            last = np.cumsum(lengths[a:b]) - 1
            own[last] = 0x0A  # no word has a line feed
            raw = own.tobytes()
            counts = weight[a:b].astype("<i8").tobytes()
            yield {"bucket": int(bucket[a]), "lang": self.lang_names[int(lang[a])].as_py(), "m": m, "n": b - a, "size": len(raw), "phrases": pa.compress(raw, "zstd", asbytes=True), "weights": pa.compress(counts, "zstd", asbytes=True)}


PACKED = "bucket long, lang string, m int, n long, size long, phrases binary, weights binary"


def _pack(lengths: tuple[int, ...], buckets: int, flush_bytes: int, filters):
    """filters: broadcast (words, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _shared.enter("phrases")
        words, pairs = filters.value
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            own = Pieces(pa.Table.from_batches(held))
            held.clear()
            for m, at, weight in own.phrases(lengths, words, pairs):
                rows = []
                for row in own.packed(m, at, weight, buckets):
                    rows.append(row)
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= flush_bytes:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        _shared.trim()

    return run


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "lang": pa.string(), "m": pa.int32(), "n": pa.int64(), "size": pa.int64(), "phrases": pa.binary(), "weights": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


COUNTED = "lang string, m int, phrase string, a long, slot long"


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, m, phrase (with a line feed behind it) and weight of packed rows, one row after another."""
    for batch in batches:
        for r in batch.to_pylist():
            raw = pa.decompress(r["phrases"], r["size"], "zstd")
            ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x0A) + 1
            phrases = pa.Array.from_buffers(pa.large_binary(), r["n"], [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), raw])
            weights = pa.Array.from_buffers(pa.int64(), r["n"], [None, pa.decompress(r["weights"], 8 * r["n"], "zstd")])
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * r["n"], pa.string()), pa.array([r["m"]] * r["n"], pa.int32()), phrases.cast(pa.large_string()), weights], names=["lang", "m", "phrase", "weight"])


def _add_up(least: int, scratch: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shutil
        import uuid

        import duckdb

        _shared.enter("phrases")
        own = f"{scratch}/duckdb-{uuid.uuid4().hex}" if scratch else ""
        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "preserve_insertion_order": False, "temp_directory": own})
        try:
            schema = pa.schema([("lang", pa.string()), ("m", pa.int32()), ("phrase", pa.large_string()), ("weight", pa.int64())])
            rows = pa.RecordBatchReader.from_batches(schema, unpacked(batches))  # noqa: F841  DuckDB reads it by its name, batch by batch
            found = con.sql(f"SELECT lang, m, rtrim(phrase, chr(10)) AS phrase, CAST(sum(weight) AS BIGINT) AS a FROM rows GROUP BY lang, m, phrase HAVING sum(weight) >= {int(least)}").to_arrow_reader(_shared.BATCH_ROWS * 8)
            for batch in found:
                words = [p.encode().split(b" ") for p in batch.column(2).to_pylist()]
                slots = np.zeros(0, np.uint64)
                if words:
                    slots = word_slots([w[0] for w in words])
                    pair = np.fromiter((len(w) == 2 for w in words), bool, len(words))
                    slots[pair] = pair_slots(slots[pair], word_slots([w[1] for w in words if len(w) == 2]))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), batch.column(2).cast(pa.string()), batch.column(3), pa.array(slots.view(np.int64))], names=["lang", "m", "phrase", "a", "slot"])
        finally:
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)
        _shared.trim()

    return run


def scratch_folder(spark: SparkSession) -> str:
    """Where DuckDB may spill: in the shared folder where that is a mounted path; else nowhere, and what doesn't fit raises."""
    shared = _shared.shared_dir(spark)
    if shared.startswith("file:"):
        shared = "/" + shared.removeprefix("file:").lstrip("/")
    return shared if shared.startswith("/") else ""


def counted(pieces: DataFrame, lengths: tuple[int, ...], n_words: int, least: int, words: Filter | None = None, pairs: Filter | None = None, flush_bytes: int = FLUSH_BYTES, bucket_phrases: int = BUCKET_PHRASES) -> DataFrame:
    """lang, m, phrase, a >= least and slot of the phrases of the lengths, stored."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(math.ceil(n_words * len(lengths) / bucket_phrases), min(parts, math.ceil(n_words / 50_000)), 1)
    filters = spark.sparkContext.broadcast((words, pairs))
    packed = pieces.select("lang", "piece", "copies").mapInArrow(_pack(lengths, buckets, flush_bytes, filters), PACKED)
    return _shared.materialise(packed.repartition(buckets, "bucket").mapInArrow(_add_up(least, scratch_folder(spark)), COUNTED), f"phrases-{lengths[0]}")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the phrases of two words and more, by the cut of the lowest score, at the least k among equals.

    counts: lang, m, phrase, a. totals: lang, n.
    """
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    known = counts.select("lang", "phrase", "a")
    cuts = counts.where("m > 1").withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, m - 1)")))
    asked = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.expr("slice(words, k + 1, m - k)"), " ").alias("tail"))
    told = asked.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]).join(totals, "lang")
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * _a * _n div (_l * _r)")
    valued = told.withColumns({"_a": wide("a"), "_n": wide("n"), "_l": wide("l"), "_r": wide("r")}).withColumn("score", score)
    best = valued.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def independent(phrases: DataFrame) -> DataFrame:
    """phrases without those that occur in a longer one as often as anywhere."""
    inner = phrases.where(F.size("words") > 2).withColumn("m", F.explode(F.expr("sequence(2, size(words) - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size(words) - m + 1)")))
    held = inner.select("lang", F.array_join(F.expr("slice(words, at, m)"), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("in_longer"))
    return phrases.join(held, ["lang", "phrase"], "left").where("in_longer IS NULL OR 100 * in_longer < 100 * a").drop("in_longer")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, filter_bits: int = FILTER_BITS, flush_bytes: int = FLUSH_BYTES, bucket_phrases: int = BUCKET_PHRASES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases."""
    spark = docs.sparkSession
    _shared.bounded_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    split = rows.mapInArrow(_split(), "lang string, piece string, n_words long")
    pieces = _shared.materialise(split.groupBy("lang", "piece").agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies")), "pieces")
    totals = _shared.materialise(pieces.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("copies")).alias("n")), "totals")
    n_words = pieces.agg(F.sum("n_words")).first()[0] or 0

    sizes = {"flush_bytes": flush_bytes, "bucket_phrases": bucket_phrases}
    one = counted(pieces, (1,), n_words, least, **sizes)
    words = filter_of(one, filter_bits)
    two = counted(pieces, (2,), n_words, least, words, **sizes)
    more = counted(pieces, tuple(range(3, LONGEST + 1)), n_words, least, words, filter_of(two, filter_bits), **sizes)
    counts = one.unionByName(two).unionByName(more).drop("slot")

    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = independent(_shared.materialise(scored(counts, totals), "scored")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(_shared.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda z: z <> '') AS words FROM t),
n AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY 1),
x AS (SELECT lang, words, unnest(range(1, 6)) AS m FROM w),
y AS (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM x WHERE len(words) >= m),
f AS (SELECT lang, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS phrase, count(*) AS a FROM y GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS words, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.words, c.k, l.a AS l, r.a AS r, n.n, 1000::HUGEINT * c.a * n.n // (l.a::HUGEINT * r.a) AS score
  FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.words, 1, c.k), ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.words, c.k + 1, c.m), ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
i AS (SELECT lang, words, a, unnest(range(2, len(words))) AS m FROM b WHERE cut = 1 AND len(words) > 2),
j AS (SELECT lang, words, a, m, unnest(range(1, len(words) - m + 2)) AS p FROM i),
h AS (SELECT lang, array_to_string(list_slice(words, p, p + m - 1), ' ') AS phrase, max(a) AS longer FROM j GROUP BY 1, 2),
q AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.n, b.score FROM b LEFT JOIN h USING (lang, phrase) WHERE cut = 1 AND (h.longer IS NULL OR 100 * h.longer < 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM q QUALIFY rank <= 2000
"""

QUERIES = {"op13_phrases": op13_phrases}
ORACLES = {"op13_phrases": ORACLE}
