"""WARC archives with a two-level capture index.

`write_archives` gives every row a WARC/1.1 record, each in a gzip member of its own. Of rows with equal payloads the one with
the smallest page_id (nulls last, then the smallest url) is a response, the others are revisits of it. Tasks write archives
with names of their own into the shared folder and return one row a record: what a lost or repeated task has written is never
referred to. `build_index` sorts the captures by URL key (reversed host, then the rest) over range partitions, packs them into
compressed blocks, and ends each index file with a sparse directory of its blocks' first keys. `lookup` finds the files whose
range may hold a key by binary search, then the block in the file's directory, then the line in the block. `read_records`
reads ranges of the archives, near ones together.

The driver keeps one row an index file (at most MAX_FILES, bounds of at most BOUND_BYTES), nothing a record. A key with very
many captures goes over as many blocks and files as it needs, since captures are ordered by key and place.

Results: a null html is an empty payload; a null url has the key `-` and no target URI; rows that share page_id, url and
payload are one response and revisits of it; payloads under min_bytes are all responses; an empty table gives no archives, an
empty index and no rows; other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _shared

#: A new archive begins after so many bytes; lines and bytes of a block of the index, before compression.
ARCHIVE_BYTES, BLOCK_LINES, BLOCK_BYTES = 1 << 30, 3000, 1 << 20
#: Captures of an index file, about, the most files, and the most bytes of a bound that the driver keeps.
FILE_LINES, MAX_FILES, BOUND_BYTES = 1_000_000, 4096, 512
#: Ranges that are so near to each other are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 22
#: The date of a capture where the table has none.
CAPTURED = "2024-01-01T00:00:00Z"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:capture-archive")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "-"

CAPTURE = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("target_uri", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])
FILE = T.StructType([T.StructField("first", T.BinaryType()), T.StructField("last", T.BinaryType()), T.StructField("file", T.StringType()), T.StructField("directory_at", T.LongType()), T.StructField("directory_bytes", T.LongType())])


def url_key(url: Column) -> Column:
    """Reversed host labels, `)`, then port, path and query; blanks and control characters as %20, the host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    after = F.regexp_replace(rest, r"^[^/?#:]*", "")
    return F.when(url.isNull(), F.lit(NO_URL)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), after))


class Store:
    """Files of a folder that all executors share, by its URI: local mounts, HDFS or an object store."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

    def make(self) -> None:
        self.fs.create_dir(self.root, recursive=True)

    def create(self, name: str):
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")


def read_range(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def typed(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, url_key, sha1, n_bytes, record_type and lead_id, lead_url of the response that a revisit refers to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("n_bytes"))
    place = [F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url"]
    alike = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes", "page_id", "url").agg(F.count("*").alias("copies"))
    leads = _shared.materialise(alike.groupBy("sha1", "n_bytes").agg(F.min(F.struct(*place, "copies")).alias("lead")), "leads")
    is_lead = F.col("page_id").eqNullSafe(F.col("lead.page_id")) & F.col("url").eqNullSafe(F.col("lead.url"))
    out = lambda df, kind: df.select("page_id", "url", "html", url_key(F.col("url")).alias("url_key"), "sha1", "n_bytes", kind.alias("record_type"), F.col("lead.page_id").alias("lead_id"), F.col("lead.url").alias("lead_url"))
    kind = F.when(F.col("lead").isNull() | is_lead, "response").otherwise("revisit")
    joined = rows.join(leads, ["sha1", "n_bytes"], "left")
    several = leads.where("lead.copies > 1")
    if several.isEmpty():
        return out(joined, kind)
    # responses among rows that nothing tells apart: one of them, told off by number
    one = joined.where(F.col("lead").isNull() | (F.col("lead.copies") == 1) | ~is_lead)
    same = rows.join(several, ["sha1", "n_bytes"]).where(is_lead).dropDuplicates(["sha1", "n_bytes"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "lead.copies")))
    return out(one, kind).unionByName(out(same, F.when(F.col("copy") == 1, "response").otherwise("revisit")))


def plain(url: str | None) -> str | None:
    """A URL that fits into a header line."""
    return None if url is None else "".join(c if " " < c != "\x7f" else "%20" for c in url)


def record(kind: str, ident: uuid.UUID, page_id: int | None, url: str | None, digest: str, payload: bytes, lead: tuple[uuid.UUID, int | None, str | None] | None) -> bytes:
    """A record; of a revisit the block is the HTTP head alone, which still tells the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", CAPTURED)]
    fields += [("WARC-Target-URI", plain(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page_id)]
    if lead:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{lead[0]}>"), ("Refers-To-Page-Id", lead[1]), ("WARC-Refers-To-Target-URI", plain(lead[2]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record in its gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record of the length that it states")
    return fields, rest[:n]


def _write(folder: str, min_bytes: int, archive_bytes: int):
    names = [f.name for f in CAPTURE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _shared.enter("warc")
        store, file, name, at = Store(folder), None, "", 0
        for batch in batches:
            out: list[tuple] = []
            for page_id, url, html, key, sha1, n, kind, lead_id, lead_url in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file is None or at >= archive_bytes:
                    if file is not None:
                        file.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    file = store.create(name)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                first = uuid.uuid5(NAMES, f"response {digest} {n}")
                own = first if kind == "response" and n >= min_bytes else uuid.uuid5(NAMES, f"{name} {at}")
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(kind, own, page_id, url, digest, html.encode(), None if kind == "response" else (first, lead_id, lead_url))
                member = packer.compress(raw) + packer.flush()
                file.write(member)
                out.append((key, page_id, kind, digest, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _arrow(CAPTURE), strict=True)] if out else [pa.array([], t) for t in _arrow(CAPTURE)], names=names)
        if file is not None:
            file.close()
        _shared.trim()

    return run


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of pages (page_id, url, html) in folder -> the captures: url_key, page_id, record_type, payload_digest, archive, offset, length.

    The result is stored: reading it again writes nothing.
    """
    spark = pages.sparkSession
    _shared.bounded_batches(spark)
    Store(folder).make()
    rows = typed(pages, min_bytes).select("page_id", "url", "html", "url_key", "sha1", "n_bytes", "record_type", "lead_id", "lead_url")
    return _shared.materialise(rows.mapInArrow(_write(folder, min_bytes, archive_bytes), CAPTURE), "captures")


@dataclass(frozen=True)
class Index:
    """Index files in the order of their keys, with conservative bounds of what they hold."""

    folder: str
    files: tuple[tuple[bytes, bytes, str, int, int], ...]


def _block(lines: list[bytes]) -> bytes:
    return zlib.compress(b"\n".join(lines), 6)


def _write_index(folder: str, block_lines: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, file, name, at = Store(folder), None, "", 0
        directory: list[bytes] = []
        lines: list[bytes] = []
        held, first, last = 0, b"", b""

        def put() -> None:
            nonlocal at, held
            packed = _block(lines)
            directory.append(b"%s\t%d\t%d" % (lines[0].partition(b"\t")[0], at, len(packed)))
            file.write(packed)
            at += len(packed)
            held = 0
            lines.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file is None:
                    name = f"{uuid.uuid4().hex}.cdx"
                    file, first = store.create(name), row[0].encode()
                line = "\t".join("" if v is None else str(v) for v in row).encode()
                if lines and (len(lines) >= block_lines or held + len(line) > block_bytes):
                    put()
                lines.append(line)
                held += len(line)
                last = row[0].encode()
        if file is not None:
            put()
            packed = _block(directory)
            file.write(packed)
            file.close()
            bound = last if len(last) <= BOUND_BYTES else last[:BOUND_BYTES] + b"\xff"
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((first[:BOUND_BYTES], bound, name, at, len(packed)), _arrow(FILE), strict=True)], names=[f.name for f in FILE])

    return run


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, block_bytes: int = BLOCK_BYTES, file_lines: int = FILE_LINES) -> Index:
    """Index files of captures in folder. Files: as many as the captures need at file_lines each, at most MAX_FILES."""
    spark = captures.sparkSession
    Store(folder).make()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.count()
    files = min(MAX_FILES, max(1, math.ceil(rows / file_lines), min(parts, math.ceil(rows / block_lines))))
    order = ["url_key", "page_id", "archive", "offset"]
    written = captures.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(_write_index(folder, block_lines, block_bytes), FILE)
    return Index(folder, tuple(sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in written.collect())))


def _route(index: Index):
    firsts, lasts = [f[0] for f in index.files], [f[1] for f in index.files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, files = [], []
            for key in batch.column(0).to_pylist():
                k = key.encode()
                own = range(bisect_left(lasts, k), bisect_right(firsts, k))
                keys += [key] * len(own)
                files += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.int32())], names=["url_key", "file"])

    return run


class Blocks:
    """An index file: its directory, and the block that was read last."""

    def __init__(self, store: Store, file: tuple):
        self.file = store.open(file[2])
        entries = [e.split(b"\t") for e in zlib.decompress(read_range(self.file, file[3], file[4])).split(b"\n")]
        self.firsts, self.places = [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]
        self.at, self.keys, self.lines = -1, [], []

    def find(self, key: bytes) -> Iterator[bytes]:
        """The lines of a key, by binary search in the directory, then in the blocks that may hold it."""
        for b in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            if b != self.at:
                self.lines = zlib.decompress(read_range(self.file, *self.places[b])).split(b"\n")
                self.at, self.keys = b, [line.partition(b"\t")[0] for line in self.lines]
            yield from self.lines[bisect_left(self.keys, key):bisect_right(self.keys, key)]


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at, blocks = Store(index.folder), -1, None
        for batch in batches:
            found = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != at:
                    at, blocks = n, Blocks(store, index.files[n])
                found += [line.decode().split("\t") for line in blocks.find(key.encode())]
            cols = list(zip(*found, strict=True)) or [()] * len(CAPTURE)
            cols = [[int(v) if v else None for v in c] if isinstance(f.dataType, T.LongType) else list(c) for c, f in zip(cols, CAPTURE, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _arrow(CAPTURE), strict=True)], names=[f.name for f in CAPTURE])

    return run


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """The captures of each distinct url_key of keys. Requests are dealt by file and key; a key that the index doesn't have gives no row."""
    spark = keys.sparkSession
    _shared.bounded_batches(spark)
    if not index.files:
        return spark.createDataFrame([], CAPTURE)
    asked = keys.where("url_key IS NOT NULL").select("url_key").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = asked.mapInArrow(_route(index), "url_key string, file int")
    return routed.repartitionByRange(parts, "file", "url_key").sortWithinPartitions("file", "url_key").mapInArrow(_search(index), CAPTURE)


def _read(folder: str, keep_payload: bool):
    def rows(file, ranges: list[tuple[int, int]]) -> Iterator[tuple]:
        low = ranges[0][0]
        held = read_range(file, low, ranges[-1][0] + ranges[-1][1] - low)
        for offset, length in ranges:
            fields, block = parsed(held[offset - low:offset - low + length])
            head, _, payload = block.partition(b"\r\n\r\n")
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            n = next(int(x[16:]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))
            whole = fields["WARC-Type"] == "response"
            if whole and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"a record's payload differs from its digest {digest}")
            number = lambda name: int(fields[name]) if name in fields else None
            yield number("Page-Id"), fields.get("WARC-Target-URI"), n, digest, fields["WARC-Type"], number("Refers-To-Page-Id"), payload if whole and keep_payload else None

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [()] * len(RECORD)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _arrow(RECORD), strict=True)], names=[f.name for f in RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at, file = Store(folder), None, None
        for batch in batches:
            near: list[tuple[int, int]] = []
            for name, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if near and (name != at or offset - sum(near[-1]) > GAP_BYTES or offset + length - near[0][0] > READ_BYTES):
                    yield batch_of(list(rows(file, near)))
                    near = []
                if name != at:
                    at, file = name, store.open(name)
                near.append((offset, length))
            if near:
                yield batch_of(list(rows(file, near)))
        _shared.trim()

    return run


def read_records(captures: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to and payload (null of revisits) of captures, by reads of ranges.

    Each payload is held against its digest; a difference raises.
    """
    spark = captures.sparkSession
    _shared.bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = captures.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(_read(folder, keep_payload), RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, **sizes: int) -> DataFrame:
    """pages written as archives and found again through the index: each url_key of pages is looked up and all of its captures are read."""
    spark = pages.sparkSession
    folder = f"{_shared.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder, min_bytes)
    index = build_index(captures, folder, **sizes)
    return read_records(lookup(pages.select(url_key(F.col("url")).alias("url_key")), index), folder, keep_payload=False)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_shared.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 takes 5 bits a letter: 20 bits (5 hexadecimal digits) are 4 letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (
  SELECT page_id, strlen(html) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS lead
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to FROM r
"""

QUERIES = {"op11_warc": op11_warc}
ORACLES = {"op11_warc": ORACLE}
