import base64
import glob
import gzip
import hashlib
import random
import uuid

import pytest

from tests.llm.oracle import check
from tracewell.llm import _shared
from tracewell.llm import op11_warc as warc


def brute(rows, least=0):
    """rows: (page_id, url, html) -> sorted page_id, bytes, digest, type, refers_to."""
    last = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    groups = {}
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r)
    out = []
    for payload, own in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own = sorted(own, key=last)
        for k, r in enumerate(own):
            revisit = k > 0 and len(payload) >= least
            out.append((r[0], len(payload), digest, "revisit" if revisit else "response", own[0][0] if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def some_pages(n, seed):
    rng = random.Random(seed)
    rows = [(i, f"http://{rng.choice(['a.Example.org', 'b.example.org', 'c.net:8080'])}/{rng.randint(0, n)}?q={rng.randint(0, 3)}", f"<p>{rng.randint(0, n // 2)} é</p>") for i in range(n)]
    rows += [(n + i, "https://hot.example.org/", "<p>hot</p>") for i in range(n)]  # one key and one payload with half of all rows
    rows += [(5, "http://x.org/ü b", "<p>hot</p>"), (None, None, "<p>hot</p>"), (None, "http://x.org", None), (7, None, ""), (-3, "", ""), (8, "x", "long " * 300_000)]
    rows += [(4 * n, "http://same.org/", "same")] * 3 + [(4 * n, "http://same.org/1", "same")] * 2 + [(None, None, "none")] * 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, least):
    rows = some_pages(150, 1)
    df = spark.createDataFrame([(i, u, h, 1, "x", 2) for i, u, h in rows], "page_id long, url string, html string, sha1 int, lead string, URL_KEY int").repartition(5)
    assert found(warc.round_trip(df, least, block_lines=7, file_lines=40)) == brute(rows, least)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert found(warc.round_trip(df)) == []


def test_lookup_and_payloads(spark):
    rows = some_pages(120, 2)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"{_shared.shared_dir(spark)}/test-{uuid.uuid4().hex}"
    captures = warc.write_archives(df, folder, archive_bytes=5000)
    index = warc.build_index(captures, folder, block_lines=5, file_lines=30)
    assert len(index.files) > 3
    asked = spark.createDataFrame([(u,) for u in ["https://hot.example.org/", "http://x.org/ü b", None, "http://nowhere.org/", "!", "zzz~"]] + [(rows[0][1],)] * 3, "url string").select(warc.url_key(warc.F.col("url")).alias("url_key"))
    got = warc.lookup(asked, index)
    keys = {r.url_key for r in asked.collect()}
    assert "org,example,hot)/" in keys and "org,x)/ü%20b" in keys
    expect = sorted(map(tuple, captures.where(warc.F.col("url_key").isin(list(keys))).select(captures.columns).collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == expect and len(expect) > 120
    # every payload is in the archives once, as a reader of gzip streams sees them
    texts = {(r.payload.decode()) for r in warc.read_records(captures, folder).collect() if r.payload is not None}
    assert texts == {h or "" for _, _, h in rows}
    streams = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder}/*.warc.gz"))
    assert streams.count(b"WARC/1.1\r\n") == len(rows) == captures.count() and streams.count(b"WARC-Type: response") == len(texts)
    assert len(glob.glob(f"{folder}/*.warc.gz")) > 3


def test_a_changed_payload_raises(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "text")], "page_id long, url string, html string")
    folder = f"{_shared.shared_dir(spark)}/test-{uuid.uuid4().hex}"
    captures = warc.write_archives(df, folder)
    path = glob.glob(f"{folder}/*.warc.gz")[0]
    raw = gzip.compress(gzip.open(path).read().replace(b"\r\n\r\ntext", b"\r\n\r\ntexx"), 6)
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(captures.withColumn("length", warc.F.lit(len(raw)).cast("long")), folder).collect()


def test_query(spark):
    assert check(spark, "/root/testdata/sf0.01", warc.op11_warc, warc.ORACLE) > 0
