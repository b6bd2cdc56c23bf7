"""Media columns of telephony audio: mu-law, A-law and IMA ADPCM.

A payload is kept as the samples of a WAV file whose format follows from the
payload itself: 8-bit mu-law or A-law samples, or ADPCM blocks of 64 bytes. The
bytes are the payload's own, so the stored form is lossless. Reading goes the
other way: parse the file, expand the companded samples by 256-entry tables, or
decode all ADPCM blocks of a batch side by side (one numpy step a nibble), and
resample to 16-bit PCM.

Rows are independent: nothing is shuffled. A null text is an empty payload,
which is stored as one block of 64 zero bytes; equal texts give equal values;
repeated rows give repeated results; an empty table gives an empty result; extra columns, whatever their names, are ignored.
PCM that is longer than a value of Spark may be (2^31 bytes, of texts of over 2^28 bytes) is null; all else of such texts is as of any other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.kernel import pieces, utf8

BLOCK = 64
#: WAV format tags: ADPCM, A-law and mu-law (fixed values of the RIFF registry).
IMA, ALAW, ULAW = 17, 6, 7
FORMATS = (ULAW, ALAW, IMA)
NAMES = {ULAW: "ulaw", ALAW: "alaw", IMA: "ima"}
RATE, OUT_RATE = 8000, 16000
#: Bytes of the longest PCM value, and samples whose features are taken at once.
LONGEST, PART = (1 << 31) - 64, 1 << 22
#: IMA ADPCM: fixed values of the published specification.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def ulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, segment = (code & 15) << 4, code >> 4 & 7
    size = np.where(segment == 0, low + 8, low + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {ULAW: ulaw_table(), ALAW: alaw_table()}


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of a block."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def store(payload: bytes) -> bytes:
    """A mono WAV file with the payload as its samples."""
    tag = FORMATS[zlib.crc32(payload) % len(FORMATS)]
    extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if tag == IMA else struct.pack("<H", 0)
    align, bits = (BLOCK, 4) if tag == IMA else (1, 8)
    per_second = RATE * BLOCK // (2 * (BLOCK - 4) + 1) if tag == IMA else RATE
    head = struct.pack("<HHIIHH", tag, 1, RATE, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def load(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, sample rate and sample bytes of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x 121) of ADPCM blocks (blocks x 64 bytes), all blocks side by side."""
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(1, len(out)):
        code = codes[(k - 1) // 2]
        code = (code >> 4 if k % 2 == 0 else code & 15).astype(np.int32)
        step, size = STEPS[index], code & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[size], 0, len(STEPS) - 1)
        out[k] = value
    return out.T


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers."""
    if source == target or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * target // source, dtype=np.int64) * source
    left, part = at // target, at % target
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (target - part) + wide[right] * part) // target).astype(np.int16)


def _twice(pcm: np.ndarray) -> np.ndarray:
    """``resample`` to the double rate."""
    out = np.empty(2 * len(pcm), np.int16)
    wide = pcm.astype(np.int32)
    out[::2] = pcm
    out[1:-1:2] = wide[:-1] + wide[1:] >> 1
    out[-1:] = pcm[-1:]
    return out


def features(tag: int, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean square, sign changes and checksum of resampled PCM."""
    peak = square = crc = 0
    for at in range(0, len(pcm), PART):
        wide = pcm[at : at + PART].astype(np.int64)
        peak, square = max(peak, int(np.abs(wide).max())), square + int(np.dot(wide, wide))
        crc = zlib.crc32(pcm[at : at + PART].astype("<i2").tobytes(), crc)
    sign = pcm < 0
    return f"{NAMES[tag]};n={len(pcm)};peak={peak};ms={square // max(1, len(pcm))};zc={int(np.count_nonzero(sign[1:] != sign[:-1]))};crc={crc:08x}"


RESULT = "doc_id bigint, n_bytes bigint, media binary, payload binary, pcm binary, feature string"


def media_columns(docs: DataFrame, rate: int = OUT_RATE) -> DataFrame:
    """The stored file, the payload read back from it, its PCM at ``rate`` and features of that."""

    def code(texts: list[bytes]):
        media = [store(pad(x)) for x in texts]
        read = [load(x) for x in media]
        blocks = [np.frombuffer(x, np.uint8).reshape(-1, BLOCK) for tag, _, x in read if tag == IMA]
        samples = decode_adpcm(np.concatenate(blocks)) if blocks else None
        at = 0
        for raw, (tag, source, payload), stored in zip(texts, read, media):
            if tag == IMA:
                n = len(payload) // BLOCK
                pcm, at = samples[at : at + n].reshape(-1), at + n
            else:
                pcm = TABLES[tag][np.frombuffer(payload, np.uint8)]
            pcm = _twice(pcm) if rate == 2 * source else resample(pcm, source, rate)
            yield len(raw), stored, payload, pcm.astype("<i2").tobytes() if 2 * len(pcm) < LONGEST else None, features(tag, pcm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets, 2 << 20):
                part = batch.slice(i, j - i)
                rows = list(zip(*code([x or b"" for x in part.column(1).to_pylist()])))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds))], names=["doc_id", "n_bytes", "media", "payload", "pcm", "feature"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return own.mapInArrow(run, RESULT)


def digest(media: DataFrame) -> DataFrame:
    payload = F.col("payload")
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -BLOCK, BLOCK)).cast("bigint").alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
