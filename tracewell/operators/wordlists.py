"""Word lists of any size, looked up in texts by joins, and the entity cascade over what they find.

A text's words and a list's values meet in two steps, as in a trie: by their first word, which says how long the values are
that begin so, then by the piece of that length itself. A filter of FILTER_BITS bits, the only thing that every worker gets,
keeps the words that begin no value from being shuffled; a false positive costs a row and never a result.

Results: null and empty texts and values give nothing; a value found in several lists is found once for each; repeated values
count once; documents with equal or null ids are searched on their own; an empty list finds nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import strings as S
from tracewell.operators import ner
from tracewell.sources.storage import materialise

FILTER_BITS = 1 << 23
#: Rows of a batch that a worker gives back.
BATCH = 20_000
WORD = r"[\p{L}\p{N}_]"
TIERS = tuple(label for label, _ in ner.Gazetteer().lists)


def _filter(keys: DataFrame) -> np.ndarray:
    """One bit for each remainder that a key's checksum leaves; at most FILTER_BITS / 8 bytes come to the driver."""
    at = (F.crc32(F.encode("key", "UTF-8")) % FILTER_BITS).alias("at")
    bits = keys.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(FILTER_BITS + (1 << 15), bool)
    for r in bits.collect():
        part = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little").astype(bool)
        if r.bucket:
            out[(r.bucket - 1) * len(part) + 1:r.bucket * len(part) + 1] = part
        else:  # 0 alone
            out[0] = True
    return np.packbits(out)


def _probes(documents: DataFrame, keys: DataFrame, most: int, names: bool) -> DataFrame:
    """_row, start, end, key, piece: words that may begin a value (with what follows) and, if asked, names that may be in a list."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(_filter(keys))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, cascade, pieces = shared.value, ner.Cascade(), re.compile(r"\w+|\W")
        schema = pa.schema([("_row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.string()), ("piece", pa.string())])

        def may(key: str) -> bool:
            at = zlib.crc32(key.encode()) % FILTER_BITS
            return bool(bits[at >> 3] >> (7 - (at & 7)) & 1)

        heads: dict[str, bool] = {}  # words and names repeat: what the filter says of them is remembered
        known: dict[str, tuple[str, ...]] = {}

        def begins(word: str) -> bool:
            if len(heads) >= ner.MEMO:
                heads.clear()
            heads[word] = hit = may("H|" + word)
            return hit

        def keys_of(name: str) -> tuple[str, ...]:
            if len(known) >= ner.MEMO:
                known.clear()
            known[name] = hits = tuple(key for key in {"N|" + S.py_normalize(name), *("T|" + w for w in cascade.name_words(name))} if may(key))
            return hits

        def found(row: int, text: str) -> Iterator[tuple]:
            s = 0
            for word in pieces.findall(text) if most else ():
                hit = heads.get(word)
                if (begins(word) if hit is None else hit) and not (s and re.match(r"\w", text[s - 1])):
                    yield row, s, None, "H|" + word, text[s:s + most + 1]
                s += len(word)
            for s, e in cascade.candidates(text) if names else ():
                name = text[s:e]
                hits = known.get(name)
                for key in keys_of(name) if hits is None else hits:
                    yield row, s, e, key, None

        out: list[tuple] = []
        for b in ner.slices(batches):
            for row, text in zip(b["_row"].to_pylist(), b["text"].to_pylist(), strict=True):
                for hit in found(row, text) if text else ():
                    out.append(hit)
                    if len(out) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return documents.select("_row", "text").mapInArrow(run, "_row long, start int, end int, key string, piece string")


def _values(words: DataFrame) -> DataFrame:
    """label, value, key (its first word), n (its length), distinct."""
    value = F.trim("value")
    return words.select("label", value.alias("value")).where("value <> '' and value <> '-'").distinct().withColumns(
        {"key": F.concat(F.lit("H|"), F.regexp_extract("value", rf"(?s)^({WORD}+|.)", 1)), "n": F.length("value")}
    )


def _found(probes: DataFrame, values: DataFrame) -> DataFrame:
    """_row, label, start, end: every value at every place, between non-words."""
    lengths = values.groupBy("key").agg(F.collect_set("n").alias("lengths"))  # no more than the longest value has letters
    pieces = probes.where("piece is not null").join(lengths, "key").select("_row", "start", "piece", F.explode("lengths").alias("n")).where("length(piece) >= n")
    pieces = pieces.where(~F.substring("piece", F.col("n") + 1, F.lit(1)).rlike(WORD)).select("_row", "start", "n", F.left("piece", F.col("n")).alias("value"))
    return pieces.join(values.select("label", "value"), "value").select("_row", "label", "value", "start", (F.col("start") + F.col("n")).cast("int").alias("end"))


def _most(values: DataFrame) -> int:
    return values.agg(F.max("n")).first()[0] or 0


def places(documents: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, label, value, start, end: every place where a value of words (label, value) stands between non-words.

    Values that overlap are all found.
    """
    values = materialise(_values(words), "values")
    docs = materialise(documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "texts")
    found = _found(_probes(docs, values.select("key"), _most(values), False), values)
    return docs.select("_row", "doc_id").join(found, "_row").drop("_row")


def extract(documents: DataFrame, words: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, text, label, as ner.extract gives them, for lists that no worker can hold.

    words: label, value; the tiers of ner.Gazetteer come first, other labels after them by name. persons: full_name.
    """
    values = materialise(_values(words), "values")
    keys = values.select("key").distinct()
    if persons is not None:
        full = persons.where("full_name is not null")
        named = full.select(F.concat(F.lit("N|"), S.normalize("full_name")).alias("key"))
        parts = full.select(F.explode(F.split("full_name", r"\s+")).alias("w")).where("length(w) > 2").select(F.concat(F.lit("T|"), F.lower("w")).alias("key"))
        names = materialise(named.union(parts).distinct(), "names")
        keys = keys.union(names)
    docs = materialise(documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "texts")
    probes = _probes(docs, keys, _most(values), persons is not None)
    if persons is not None:
        probes = materialise(probes, "probes")
    found = _found(probes, values).select("_row", "label", "start", "end")
    if persons is not None:
        known = probes.where("piece is null").join(names, "key", "left_semi").select("_row", F.lit("").alias("label"), "start", "end").distinct()
        found = found.union(known)
    found = found.groupBy("_row").agg(F.collect_list(F.struct("label", "start", "end")).alias("found"))  # of one text
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = ner.Cascade()
        for b in ner.slices(batches):
            out = []
            for i, (text, hits) in enumerate(zip(b["text"].to_pylist(), b["found"].to_pylist(), strict=True)):
                if text:
                    out += [(i, s, e, text[s:e], label) for s, e, label in _claimed(cascade, text, hits or [])]
            at, s, e, t, label = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(pa.array(at, pa.int64())), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(t, pa.string()), pa.array(label, pa.string())], ["doc_id", "start", "end", "text", "label"]
            )

    return docs.join(found, "_row", "left").select("doc_id", "text", "found").mapInArrow(run, f"doc_id {kind}, start int, end int, text string, label string")


def _claimed(cascade: ner.Cascade, text: str, hits: list[dict]) -> list[tuple[int, int, str]]:
    spans: dict[str, set[tuple[int, int]]] = defaultdict(set)
    for h in hits:
        spans[h["label"]].add((h["start"], h["end"]))
    people, cities, areas = spans.pop("", set()), spans.get("GPE", set()), spans.get("LOC", set())
    order = sorted(spans, key=lambda k: (TIERS.index(k) if k in TIERS else len(TIERS), k))
    return cascade.claimed(
        text, ((label, _leftmost_longest(spans[label])) for label in order), lambda s, e: (s, e) in cities, lambda s, e: (s, e) in cities and (s, e) in areas, lambda s, e: (s, e) in people
    )


def _leftmost_longest(spans: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    done = 0
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= done:
            yield s, e
            done = e
