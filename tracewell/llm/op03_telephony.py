"""Media columns of telephony audio: mu-law, A-law and IMA ADPCM stored losslessly in WAV files, and resampled PCM.

`store` puts a byte payload into a WAV file of one of three 8 kHz telephony formats. Mu-law and A-law hold one payload byte
in each 8-bit sample. ADPCM holds 64 payload bytes (128 four-bit samples) in each 68-byte block behind the block's
predictor and step index, so its unit is a block. `read` parses the file, returns the payload byte for byte, expands it to
16-bit PCM (companded formats by lookup tables, ADPCM by numpy across all blocks of a batch, one sample position at a time),
resamples it to 16 kHz with an integer half-band filter and computes features.

Results: a null payload is the empty one; every payload is padded with bytes 0 to a positive multiple of 64; equal payloads
give equal files, PCM and features; an empty table gives no rows; clashing columns of the input are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _shared

UNIT, HEAD, RATE = 64, 4, 8000
#: Bytes of files, about, that are decoded at once.
PIECE = 1 << 17
#: WAV format tags of the telephony codecs.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
CODECS = tuple(sorted(TAGS))
#: Fixed values of IMA ADPCM: change of the step index by the low three bits of a sample.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: Fixed values of IMA ADPCM: step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
#: Half-band interpolator: the sample between x[i] and x[i+1] from x[i-2..i+3], in 1/256.
TAPS = np.array([3, -25, 150, 150, -25, 3], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law byte: bits are inverted; sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law byte: even bits are inverted; a set sign bit is positive."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = a >> 4 & 7, (a & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def wav(codec: str, payload: bytes) -> bytes:
    """A WAV file of padded payload."""
    tag = TAGS[codec]
    if codec == "ima_adpcm":
        blocks = np.zeros((len(payload) // UNIT, HEAD + UNIT), np.uint8)  # predictor 0, step index 0
        blocks[:, HEAD:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, samples, align, bits = blocks.tobytes(), len(blocks) * (2 * UNIT + 1), HEAD + UNIT, 4
        extra = struct.pack("<HH", 2, 2 * UNIT + 1)
        per_second = RATE * align // (2 * UNIT + 1)
    else:
        data, samples, align, bits, extra, per_second = payload, len(payload), 1, 8, struct.pack("<H", 0), RATE
    form = struct.pack("<HHIIHH", tag, 1, RATE, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parsed(media: bytes) -> tuple[str, bytes]:
    """The codec and the data chunk of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        name, size = media[at:at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = {v: k for k, v in TAGS.items()}[struct.unpack_from("<H", media, at + 8)[0]]
        elif name == b"data":
            return codec, media[at + 8:at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks (n, 4 + 64) -> (n, 129): all blocks advance together, sample by sample; low nibbles come first."""
    n = len(blocks)
    out = np.empty((2 * UNIT + 1, n), np.int16)
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value = np.where(value >= 32768, value - 65536, value)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, HEAD:].T)
    for k in range(2 * UNIT):
        nibble = (body[k >> 1] >> (4 * (k & 1)) & 15).astype(np.int32)
        step = STEPS[index]
        low = nibble & 7
        change = (step >> 3) + (step & -(low >> 2)) + (step >> 1 & -(low >> 1 & 1)) + (step >> 2 & -(low & 1))
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[low], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples and, between them, the half-band filter's values; ends are held."""
    x = np.pad(pcm.astype(np.int32), (2, 3), mode="edge")
    n = len(pcm)
    mid = np.zeros(n, np.int32)
    for k, tap in enumerate(TAPS):
        mid += tap * x[k:k + n]
    out = np.empty(2 * n, np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(mid + 128 >> 8, -32768, 32767)
    return out


def features(codec: str, pcm: np.ndarray) -> str:
    """codec, peak, mean square, zero crossings, and the mean step between samples, in whole numbers."""
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec} peak={int(np.abs(x).max())} power={int((x * x).sum()) // len(x)} crossings={crossings} slope={int(np.abs(np.diff(x)).sum()) // len(x)}"


def chosen(payload: bytes) -> str:
    """A codec by the payload's content, so that a column of mixed calls holds all three and equal payloads are stored alike."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def _stored(texts: pa.Array, codec: str | None) -> list[pa.Array]:
    """n_bytes and media of payloads."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return [pa.array(map(len, raw), pa.int64()), pa.array([wav(codec or chosen(p), p) for p in map(padded, raw)], pa.binary())]


def _read(files: pa.Array, pcm: bool) -> list[pa.Array]:
    """payload, pcm, pcm_sha256 and feature of WAV files; memory follows one run of files of about a unit of PIECE bytes, or one long file."""
    payloads, wides, digests, found = [], [], [], []
    piece: list[tuple[str, bytes]] = []

    def decoded() -> None:
        blocks = [np.frombuffer(d, np.uint8).reshape(-1, HEAD + UNIT) for c, d in piece if c == "ima_adpcm"]
        sounds = iter(np.split(adpcm_blocks(np.concatenate(blocks)), np.cumsum([len(b) for b in blocks])[:-1])) if blocks else iter(())
        for codec, data in piece:
            if codec == "ima_adpcm":
                payloads.append(np.frombuffer(data, np.uint8).reshape(-1, HEAD + UNIT)[:, HEAD:].tobytes())
                sound = next(sounds).ravel()
            else:
                payloads.append(data)
                sound = TABLES[codec][np.frombuffer(data, np.uint8)]
            wide = resampled(sound).astype("<i2").tobytes()
            wides.append(wide if pcm else None)
            digests.append(hashlib.sha256(wide).hexdigest())
            found.append(features(codec, sound))
        piece.clear()

    size = 0
    for media in files.to_pylist():
        piece.append(parsed(media))
        size += len(media)
        if size >= PIECE:
            decoded()
            size = 0
    decoded()
    return [pa.array(payloads, pa.binary()), pa.array(wides, pa.binary()), pa.array(digests, pa.string()), pa.array(found, pa.string())]


STORED = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
READ = [T.StructField("payload", T.BinaryType()), T.StructField("pcm", T.BinaryType()), T.StructField("pcm_sha256", T.StringType()), T.StructField("feature", T.StringType())]


def store(df: DataFrame, payload: str, codec: str | None = None) -> DataFrame:
    """df with n_bytes long and media binary (a WAV file) in place of payload; codec: one of CODECS, or by content."""
    return _shared.map_columns(df, [payload], STORED, lambda: lambda texts: _stored(texts, codec), drop=(payload,))


def read(df: DataFrame, media: str = "media", pcm: bool = True) -> DataFrame:
    """df with payload binary, pcm binary (16 kHz, 16-bit samples; null if pcm is False), pcm_sha256 and feature."""
    return _shared.map_columns(df, [media], READ, lambda: lambda files: _read(files, pcm))


def store_and_read(df: DataFrame, payload: str, codec: str | None = None, pcm: bool = True) -> DataFrame:
    """read(store(df)) in one worker: the files go to Spark once and don't come back to be read."""

    def f(texts: pa.Array) -> list[pa.Array]:
        stored = _stored(texts, codec)
        return stored + _read(stored[1], pcm)

    return _shared.map_columns(df, [payload], STORED + READ, lambda: f, drop=(payload,))


def digests(df: DataFrame) -> DataFrame:
    """With the resampled PCM as a column, and the digest of what that column holds."""
    return store_and_read(df.select("doc_id", "text"), "text").select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.octet_length("pcm").cast("long").alias("pcm_bytes"), "pcm_sha256", "pcm",
    )


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_shared.table(spark, sf_dir, "documents"))


QUERIES = {"op3_telephony": op3_telephony}
