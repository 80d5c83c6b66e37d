"""Entities and relations in text. A cascade claims spans in a fixed order of tiers and never overlaps an earlier claim.

The cascade is stateful within a text, so it runs Arrow batch by batch in Python, one regular expression a tier, compiled once
a worker. Linking, fuzzy matching and relations are joins.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.conf import FUZZY_NAME
from tracewell.functions import strings as S
from tracewell.operators.pairing import paired
from tracewell.sources.storage import materialise

# Patterns of the first tier, in order; labels in SILENT take their span and are not reported.
PATTERNS = {
    "FIR_NO": r"\bFIR\sNo\.\s?\d{1,3}/\d{4}\b", "VEHICLE_REG": r"\b[A-Z]{2}\d{2}\s[A-Z]{2}\s\d{4}\b", "DATE": r"\b\d{2}\.\d{2}\.\d{4}\b", "MONEY": r"\bRs\.\s?[\d,]+(?:\.\d+)?\b",
    "QUANTITY": r"(?i:\b\d+(?:\.\d+)?\s(?:kg|grams|nos|INR face value)\b)", "SEAL": r"'[A-Z]{3}'", "PHONE": r"\b[6-9]\d{9}\b", "IMEI": r"\b\d{15}\b", "ACCOUNT": r"\b\d{11,16}\b",
    "POLICE_STATION": r"\b(?:[A-Z][\w'\-]*(?:\s[A-Z][\w'\-]*)*)\sPolice\sStation\b",
}
SILENT = ("FIR_NO", "SEAL")
# What every match of a pattern holds. It is found many times faster than that the pattern has no match.
HOLDS = {
    "FIR_NO": "FIR", "VEHICLE_REG": r"[A-Z]\d", "DATE": r"\d\.\d", "MONEY": r"Rs\.", "QUANTITY": r"\d\s", "SEAL": "'", "PHONE": r"\d{10}", "IMEI": r"\d{15}", "ACCOUNT": r"\d{11}", "POLICE_STATION": "Police",
}
#: Rows of a batch that a worker gives back, and texts that it has as Python objects at a time.
BATCH, TEXTS = 20_000, 64
#: Names whose words a worker remembers.
MEMO = 1 << 16
# A name after an alias mark, and capitalised words that may be a person.
ALIAS = r"(?:@|\burf\b)\s+([A-Z][\w'\-]*(?:\s[A-Z][\w'\-]*){0,2})"
CANDIDATE = r"\b([A-Z][a-z'\-]{1,}(?:\s[A-Z][a-z'\-]{1,}){0,3})\b"
# Words that stand right before a person.
TRIGGERS = ("namely", "accused", "one", r"identity\s+as", "complainant", "deceased", "subject", "r/o", "s/o", "against", r"of\s+one", "apprehended")
# Capitalised words that are no part of a name.
STOP_WORDS = frozenset("""
the on at a an and of in it is was were this that during accordingly mobile police station bank account source note alert assessment observation
investigation enquiry technical subject static acting numerous confidence moderate high low rs fir no bns ipc ndps pmla uapa imfl ficn upi imps
neft rtgs atm cctv sho kg nos hrs vpa kyc sim imei sub registrar mining department state central directorate bureau wing cell squad force
crime branch narcotics control revenue intelligence enforcement railway protection income tax border security economic offences special task anti
terrorism cyber criminal history unlawful activity
""".split())
# Fixed value: a name in a relation.
_NAME = r"[A-Z][\w']+(?:\s[A-Z][\w']+){0,2}"
# Relation, pattern (its name is group b), and whether the named one is the source.
RELATIONS = (
    ("CO_ACCUSED_WITH", rf"(?P<a>{_NAME})\s+(?:along with|and)\s+(?:his\s+associates?\s+)?(?P<b>{_NAME})", "both"), ("ACTS_ON_INSTRUCTIONS_OF", rf"at the instance of\s+(?P<b>{_NAME})", "to"),
    ("REPORTS_TO", rf"under the direction of\s+(?P<b>{_NAME})", "to"), ("ARRANGED_BY", rf"(?:arranged|organised) by (?:one\s+)?(?P<b>{_NAME})", "to"),
    ("SUPPLIES_TO", rf"(?:supplied|delivered) to\s+(?P<b>{_NAME})", "from"), ("ASSOCIATE_OF", rf"known associates? of\s+(?P<b>{_NAME})", "to"), ("BENAMI_OF", rf"benami of\s+(?P<b>{_NAME})", "to"),
    ("COMMUNICATION_CONDUIT", rf"relayed through\s+(?P<b>{_NAME})", "to"), ("RECEIVED_FROM", rf"handed over to (?:him |her )?by\s+(?P<b>{_NAME})", "to"),
    ("MET_WITH", rf"(?:met|meeting with)\s+(?P<b>{_NAME})", "to"), ("FINANCED_BY", rf"received funds from\s+(?P<b>{_NAME})", "to"),
)


@dataclass(frozen=True)
class Gazetteer:
    """Closed word lists, small enough for every worker."""

    agencies: frozenset[str] = frozenset()
    orgs: frozenset[str] = frozenset()
    models: frozenset[str] = frozenset()
    contraband: frozenset[str] = frozenset()
    cities: frozenset[str] = frozenset()
    areas: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()  # full names in normal form
    tokens: frozenset[str] = frozenset()  # words of names, lower case, of three letters and more
    lists: tuple[tuple[str, str], ...] = field(default=(("AGENCY", "agencies"), ("ORG", "orgs"), ("VEHICLE_MODEL", "models"), ("CONTRABAND", "contraband"), ("GPE", "cities"), ("LOC", "areas")))


def gazetteer(columns: dict[str, list[tuple[DataFrame, str]]], persons: DataFrame | None = None, most: int = 2_000_000) -> Gazetteer:
    """Lists from columns of tables: distinct trimmed values but "" and "-". At most `most` values in all."""
    found = {}
    for name, sources in columns.items():
        out = None
        for df, c in sources:
            part = df.select(F.trim(c).alias("v")).where("v <> '' and v <> '-'")
            out = part if out is None else out.union(part)
        found[name] = frozenset(r.v for r in out.distinct().limit(most + 1).collect())
    if persons is not None:
        rows = persons.select("full_name").where("full_name is not null").distinct().limit(most + 1).collect()
        found["names"] = frozenset(S.py_normalize(r.full_name) for r in rows)
        found["tokens"] = frozenset(t.lower() for r in rows for t in r.full_name.split() if len(t) > 2)
    if sum(map(len, found.values())) > most:
        raise ValueError(f"more than {most} words in the lists")
    return Gazetteer(**found)


class Cascade:
    """Spans of a text, given what the word lists hold: the spans found of each list in the order of tiers, whether a span is
    a city, whether it is a city and an area, and whether it is a person's name or has a word of one."""

    def __init__(self):
        self.first = [(k, re.compile(HOLDS[k]), re.compile(p)) for k, p in PATTERNS.items()]
        self.digit, self.alias = re.compile(r"\d"), re.compile(ALIAS)
        self.memo: dict[str, int] = {}
        self.trigger = re.compile(rf"(?:{'|'.join(TRIGGERS)})\s+$")

    @staticmethod
    def _locality(text: str, start: int, end: int, city: Callable[[int, int], bool]) -> bool:
        """Whether a name that is a city and an area reads as the area: a city follows, or a word of residence stands before."""
        m = re.match(r",\s*([A-Z][\w'\-]*(?:\s[A-Z][\w'\-]*)*)", text[end:end + 40])
        return bool(m and city(end + m.start(1), end + m.end(1))) or bool(re.search(r"(?:r/o|resident of|situated at)\s+$", text[max(0, start - 12):start]))

    @staticmethod
    def trimmed_end(text: str, start: int, end: int) -> int:
        """The end of a span without stop words at its two sides; its start stays. start itself if nothing is left."""
        words = text[start:end].split()
        while words and words[-1].lower() in STOP_WORDS:
            words.pop()
        while words and words[0].lower() in STOP_WORDS:
            del words[0]
        at = text.find(" ".join(words), start, end) if words else -1
        return start if at < 0 else at + len(" ".join(words))

    @staticmethod
    def name_words(name: str) -> list[str]:
        """The words of what may be a name; none if it can't be one."""
        words = [w.lower().strip(".") for w in name.split()]
        return words if 1 <= len(words) <= 4 and not any(w in STOP_WORDS for w in words) else []

    def name_length(self, name: str) -> int:
        """How many letters of capitalised words may be a name, without stop words at their sides; 0 if none."""
        n = self.memo.get(name)
        if n is None:
            n = self.trimmed_end(name, 0, len(name))
            if not self.name_words(name[:n]):
                n = 0
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[name] = n
        return n

    def candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of capitalised words, without stop words at their sides."""
        for m in re.finditer(CANDIDATE, text):
            if n := self.name_length(m[1]):
                yield m.start(1), m.start(1) + n

    def claimed(
        self, text: str, listed: Iterable[tuple[str, Iterable[tuple[int, int]]]], city: Callable[[int, int], bool], both: Callable[[int, int], bool], named: Callable[[int, int], bool]
    ) -> list[tuple[int, int, str]]:
        starts: list[int] = []  # of claimed spans, in order; they don't overlap
        ends: list[int] = []
        found = []

        def free(s: int, e: int) -> bool:
            at = bisect_left(starts, e)
            return not at or ends[at - 1] <= s

        def claim(s: int, e: int, label: str) -> None:
            if e > s and free(s, e):
                at = bisect_left(starts, s)
                starts.insert(at, s)
                ends.insert(at, e)
                if label not in SILENT:
                    found.append((s, e, label))

        digits = self.digit.search(text) is not None
        for label, holds, rx in self.first:
            if (digits or "\\d" not in HOLDS[label]) and holds.search(text):
                for m in rx.finditer(text):
                    claim(*m.span(), label)
        for label, spans in listed:
            for s, e in spans:
                if not (label == "GPE" and both(s, e) and self._locality(text, s, e, city)):
                    claim(s, e, label)
        for m in self.alias.finditer(text) if "@" in text or "urf" in text else ():
            claim(m.start(1), self.trimmed_end(text, *m.span(1)), "ALIAS")
        for m in re.finditer(CANDIDATE, text):
            s, e = m.span(1)
            if free(s, e) and (n := self.name_length(m[1])) and (self.trigger.search(text[max(0, s - 24):s]) or named(s, s + n)):
                claim(s, s + n, "PERSON")
        return sorted(found)


class Extractor(Cascade):
    """The cascade over lists that are in memory; wordlists.extract takes lists of any size."""

    def __init__(self, g: Gazetteer):
        super().__init__()
        self.g = g
        self.listed = [(label, self._any(getattr(g, name))) for label, name in g.lists if getattr(g, name)]
        self.both = g.cities & g.areas

    @staticmethod
    def _any(values) -> re.Pattern:
        """One of the values between non-words, longer ones first."""
        return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(values, key=lambda v: (-len(v), v)))) + r")(?!\w)")

    def _named(self, name: str) -> bool:
        return bool(self.g.names or self.g.tokens) and (S.py_normalize(name) in self.g.names or any(w in self.g.tokens for w in self.name_words(name)))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        listed = ((label, (m.span() for m in rx.finditer(text))) for label, rx in self.listed)
        return self.claimed(text, listed, lambda s, e: text[s:e] in self.g.cities, lambda s, e: text[s:e] in self.both, lambda s, e: self._named(text[s:e]))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few texts: what a worker has as Python objects doesn't follow the batches that it is given."""
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            yield b.slice(i, TEXTS)


def in_batches(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of a bounded number of rows: what a worker holds doesn't follow the batches that it is given."""
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == BATCH:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def extract(documents: DataFrame, g: Gazetteer = Gazetteer()) -> DataFrame:
    """doc_id, start, end, text, label of documents doc_id, text."""
    shared = documents.sparkSession.sparkContext.broadcast(g)  # its size is bounded where it is made
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = Extractor(shared.value)
        rows = ((d, s, e, t[s:e], label) for b in batches for d, t in zip(b["doc_id"], b["text"], strict=True) if t for s, e, label in x.spans(t))
        yield from in_batches(rows, ["doc_id", "start", "end", "text", "label"])

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, text string, label string")


def fuzzy_names(mentions: DataFrame, names: DataFrame, threshold: float = FUZZY_NAME) -> DataFrame:
    """key, name: for each key (a normal form), the name that shares a word with it and is most like it, beyond threshold."""
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("w")).where("w <> ''")
    near = words(mentions, "key").join(words(names, "name"), "w").select("key", "name").distinct()
    scored = near.withColumn("s", S.name_similarity("key", "name")).where(F.col("s") > threshold)
    return scored.groupBy("key").agg(F.min_by("name", F.struct(-F.col("s"), F.col("name"))).alias("name"))


def link(entities: DataFrame, index: DataFrame, phones: DataFrame | None = None) -> DataFrame:
    """entities with entity_id, candidates (five at most, joined by |), link_confidence and ambiguous.

    index: kind (PERSON, LOC or ORG), name, id. A person's or alias's id only if it is the only one; a place's or
    organisation's the first. Names without a letter that the normal form keeps, as numbers, are compared as they are.
    phones: msisdn, id.
    """
    key = lambda c: F.coalesce(F.nullif(S.normalize(c), F.lit("")), F.trim(c), F.lit(""))
    keys = index.select("kind", key("name").alias("key"), F.col("id").cast("string").alias("id")).where("key <> ''").distinct()
    groups = keys.groupBy("kind", "key").agg(F.slice(F.sort_array(F.collect_set("id")), 1, 5).alias("ids"), F.count_distinct("id").alias("n"))
    e = entities.withColumns({"_key": key("text"), "_kind": F.when(F.col("label") == "ALIAS", "PERSON").otherwise(F.col("label"))})
    exact = e.join(groups, (F.col("_kind") == F.col("kind")) & (F.col("_key") == F.col("key")), "left").drop("kind", "key")
    missing = exact.where("label = 'PERSON' and n is null").select(F.col("_key").alias("key")).distinct()
    fuzzy = fuzzy_names(missing, groups.where("kind = 'PERSON'").select(F.col("key").alias("name"))).join(groups.where("kind = 'PERSON'").select(F.col("key").alias("name"), F.col("ids").alias("_ids"), F.col("n").alias("_n")), "name").select(F.col("key").alias("_fk"), "_ids", "_n")
    out = exact.join(fuzzy, (F.col("label") == "PERSON") & F.col("n").isNull() & (F.col("_key") == F.col("_fk")), "left").withColumns({"ids": F.coalesce("ids", "_ids"), "n": F.coalesce("n", "_n")})
    if phones is not None:
        out = out.join(phones.select(F.col("msisdn").cast("string").alias("_m"), F.col("id").cast("string").alias("_phone")), (F.col("label") == "PHONE") & (F.col("text") == F.col("_m")), "left")
    else:
        out = out.withColumn("_phone", F.lit(None).cast("string"))
    person = F.col("_kind") == "PERSON"
    one = F.when(person & (F.col("n") > 1), "").otherwise(F.col("ids")[0])
    sure = F.when(F.col("n") == 1, 1.0).when(person, F.round(1 / F.col("n"), 3)).when(F.col("n") > 1, 0.5)
    return out.select(
        *entities.columns, F.coalesce("_phone", one, F.lit("")).alias("entity_id"), F.array_join(F.coalesce("ids", F.array().cast("array<string>")), "|").alias("candidates"),
        F.when(F.col("_phone").isNotNull(), 1.0).otherwise(F.coalesce(sure, F.lit(0.0))).alias("link_confidence"), F.coalesce(person & (F.col("n") > 1), F.lit(False)).alias("ambiguous"),
    )


def matches(documents: DataFrame) -> DataFrame:
    """doc_id, relation, mode, pos, name_a, name_b, evidence (the sentence around) of every relation pattern."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(r, re.compile(p), m) for r, p, m in RELATIONS]

        def found(d, t: str) -> Iterator[tuple]:
            for relation, rx, mode in compiled:
                for m in rx.finditer(t):
                    before, after = t.rfind(". ", 0, m.start()), t.find(". ", m.start())
                    sentence = t[before + 2 if before >= 0 else 0:after + 1 if after >= 0 else len(t)].strip()
                    yield d, relation, mode, m.start(), m["a"] if mode == "both" else None, m["b"], sentence

        rows = (row for b in batches for d, t in zip(b["doc_id"], b["text"], strict=True) if t for row in found(d, t))
        yield from in_batches(rows, ["doc_id", "relation", "mode", "pos", "name_a", "name_b", "evidence"])

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, relation string, mode string, pos int, name_a string, name_b string, evidence string")


def relations(documents: DataFrame, linked: DataFrame, index: DataFrame) -> DataFrame:
    """src, dst, relation, symmetric, evidence, doc_id, confidence, verified of patterns whose ends are known; claims, not facts.

    linked: entities with entity_id; index: persons' name, id. The other end is the linked person nearest before the match.
    """
    unique = index.select(S.normalize("name").alias("key"), F.col("id").cast("string").alias("id")).distinct().groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").select("key", "id")
    m = materialise(matches(documents).withColumn("_m", F.monotonically_increasing_id()), "matches")  # stored: the numbers are read twice
    m = m.withColumns({"_a": S.normalize("name_a"), "_b": S.normalize("name_b")})
    m = m.join(unique.select(F.col("key").alias("_b"), F.col("id").alias("id_b")), "_b").join(unique.select(F.col("key").alias("_a"), F.col("id").alias("id_a")), "_a", "left")
    people = linked.where("label = 'PERSON' and entity_id <> ''").select("doc_id", "end", "entity_id")
    near = m.where("mode <> 'both'").join(people, "doc_id").where(F.col("end") <= F.col("pos")).groupBy("_m").agg(F.max_by("entity_id", "end").alias("near"))
    m = m.join(near, "_m", "left").withColumn("one", F.when(F.col("mode") == "both", F.col("id_a")).otherwise(F.col("near"))).where("one is not null and one <> id_b")
    turned = F.col("mode") == "from"
    return m.select(
        F.when(turned, F.col("id_b")).otherwise(F.col("one")).alias("src"), F.when(turned, F.col("one")).otherwise(F.col("id_b")).alias("dst"), "relation", (F.col("mode") == "both").alias("symmetric"), "evidence",
        "doc_id", F.lit(0.7).alias("confidence"), F.lit("PATTERN").alias("extraction_method"), F.lit(0).alias("verified"),
    )


def co_mentions(linked: DataFrame) -> DataFrame:
    """Unordered pairs of persons of one document: weak evidence."""
    p = linked.where("label = 'PERSON' and entity_id <> ''").select("doc_id", "entity_id").distinct()
    return paired(p, ["doc_id"], "entity_id").select(F.col("a_entity_id").alias("src"), F.col("b_entity_id").alias("dst"), F.lit("CO_MENTIONED_WITH").alias("relation"), F.lit(True).alias("symmetric"), "doc_id", F.lit(0.25).alias("confidence"))
