import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tracewell.llm import op03_telephony as tel


def slow_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            d = step >> 3
            d += step if nibble & 4 else 0
            d += step >> 1 if nibble & 2 else 0
            d += step >> 2 if nibble & 1 else 0
            value = max(-32768, min(32767, value - d if nibble & 8 else value + d))
            index = max(0, min(88, index + int(tel.INDEX_CHANGE[nibble & 7])))
            out.append(value)
    return out


def slow_parse(media):
    """Codec and data of a WAV file by the standard's fixed offsets."""
    assert media[:4] == b"RIFF" and int.from_bytes(media[4:8], "little") == len(media) - 8 and media[8:16] == b"WAVEfmt "
    size = int.from_bytes(media[16:20], "little")
    tag = int.from_bytes(media[20:22], "little")
    assert int.from_bytes(media[22:24], "little") == 1 and int.from_bytes(media[24:28], "little") == 8000
    at = 20 + size
    assert media[at:at + 4] == b"fact" and media[at + 12:at + 16] == b"data"
    return {6: "alaw", 7: "mulaw", 17: "ima_adpcm"}[tag], media[at + 20:at + 20 + int.from_bytes(media[at + 16:at + 20], "little")]


def slow_expanded(codec, byte):
    """One companded sample, by the definition of the code."""
    if codec == "mulaw":
        byte ^= 0xFF
        size = ((2 * (byte & 15) + 33) << (byte >> 4 & 7)) - 33
        return -4 * size if byte & 0x80 else 4 * size
    byte ^= 0x55
    exponent, mantissa = byte >> 4 & 7, byte & 15
    size = 2 * mantissa + 1 if not exponent else (2 * mantissa + 33) << (exponent - 1)
    return 8 * size if byte & 0x80 else -8 * size


def slow_sound(codec, data):
    if codec == "ima_adpcm":
        return [x for i in range(0, len(data), 68) for x in slow_adpcm(data[i:i + 68])]
    return [slow_expanded(codec, b) for b in data]


def slow_resampled(x):
    at = lambda i: x[max(0, min(len(x) - 1, i))]
    out = []
    for i in range(len(x)):
        mid = 3 * at(i - 2) - 25 * at(i - 1) + 150 * at(i) + 150 * at(i + 1) - 25 * at(i + 2) + 3 * at(i + 3)
        out += [x[i], max(-32768, min(32767, (mid + 128) // 256))]
    return out


def slow_feature(codec, x):
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    return f"{codec} peak={max(map(abs, x))} power={sum(v * v for v in x) // len(x)} crossings={crossings} slope={sum(abs(b - a) for a, b in zip(x, x[1:])) // len(x)}"


def test_tables():
    assert tel.TABLES["mulaw"][[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    for codec in ("mulaw", "alaw"):
        assert tel.TABLES[codec].tolist() == [slow_expanded(codec, b) for b in range(256)]
    assert tel.TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def test_adpcm_against_sample_by_sample():
    blocks = np.random.default_rng(1).integers(0, 256, (7, 68), dtype=np.uint8)
    assert tel.adpcm_blocks(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", tel.CODECS)
@pytest.mark.parametrize("raw", [b"", b"a", bytes(range(256)) * 3, b"x" * 64])
def test_lossless(codec, raw):
    p = tel.padded(raw)
    got, data = tel.parsed(tel.wav(codec, p))
    assert got == codec and len(p) % 64 == 0 and p
    assert p == (data if codec != "ima_adpcm" else b"".join(data[i + 4:i + 68] for i in range(0, len(data), 68)))


def test_documents(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    rows = {r.doc_id: r for r in tel.op3_telephony(spark, sf_dir).collect()}
    assert len(rows) == len(t["doc_id"])
    for d, text in zip(t["doc_id"], t["text"], strict=True):
        p, r = tel.padded((text or "").encode()), rows[d]
        media = tel.wav(tel.chosen(p), p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        codec, data = slow_parse(media)
        assert data == (p if codec != "ima_adpcm" else b"".join(bytes(4) + p[i:i + 64] for i in range(0, len(p), 64)))
        if len(p) <= 6400:
            sound = slow_sound(codec, data)
            assert np.frombuffer(r.pcm, "<i2").tolist() == slow_resampled(sound) and r.feature == slow_feature(codec, sound)
        assert hashlib.sha256(r.pcm).hexdigest() == r.pcm_sha256 and len(r.pcm) == r.pcm_bytes


def test_nulls_repeats_clashes_and_pcm(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "é" * 100, 3), (3, "é" * 100, 3)], "doc_id long, text string, Media int")
    out = tel.read(tel.store(df, "text")).orderBy("doc_id").collect()
    assert out[0].payload == bytes(64) == out[1].payload and out[0].feature == out[1].feature and out[2] == out[3]
    assert hashlib.sha256(out[2].pcm).hexdigest() == out[2].pcm_sha256
    assert tel.digests(df.limit(0)).count() == 0


def test_a_text_of_megabytes_among_short_ones(spark):
    long = "lorem ipsum " * 200_000
    df = spark.createDataFrame([(1, long), (2, "a"), (3, long + "b"), (4, "a")], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in tel.digests(df).collect()}
    for i, t in ((1, long), (2, "a"), (3, long + "b"), (4, "a")):
        p = tel.padded(t.encode())
        assert rows[i].payload_sha256 == hashlib.sha256(p).hexdigest() and rows[i].n_bytes == len(t)
    assert rows[2].pcm == rows[4].pcm and rows[1].feature.split()[0] == tel.chosen(tel.padded(long.encode()))
