"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks, resampled PCM.

A payload of bytes is the sample data of a WAV file, one byte a sample for mu-law and A-law, blocks of 36 bytes (4 of header, 64
samples) for ADPCM. Storing it loses nothing: reading the file gives the same bytes. Samples are decoded from what was
read, resampled with integer arithmetic, and described by integer features.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydf.llm import common

#: WAV format tags.
ALAW, MULAW, ADPCM, PCM = 6, 7, 17, 1
NAMES = {ALAW: "alaw", MULAW: "mulaw", ADPCM: "adpcm", PCM: "pcm"}
#: A payload is padded to whole units; both sample formats and the blocks of ADPCM fit into one.
UNIT, PAD = 576, 255
BLOCK = 36
#: Documents decoded at once, and bytes of files that they may hold together (a larger file is decoded alone): PCM takes seven times that.
DOCS, FILE_BYTES = 64, 1 << 20


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte (G.711)."""
    byte = ~np.arange(256, dtype=np.int32) & 255
    size = (((byte & 15) << 3) + 132 << (byte >> 4 & 7)) - 132
    return np.where(byte & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte (G.711)."""
    byte = np.arange(256, dtype=np.int32) ^ 85
    step, low = byte >> 4 & 7, (byte & 15) << 4
    size = np.where(step == 0, low + 8, low + 264 << np.maximum(step - 1, 0))
    return np.where(byte & 128, size, -size).astype(np.int16)


# Fixed values of IMA ADPCM: the change of the step index by the low three bits of a code, and the step sizes by index.
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Decode mono IMA ADPCM: all blocks advance together, one code at a time. One sample of the header and two of each further byte a block."""
    rows = data.reshape(-1, block)
    value = np.ascontiguousarray(rows[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2].astype(np.int32), 88)
    codes = np.stack([rows[:, 4:] & 15, rows[:, 4:] >> 4], 2).reshape(len(rows), -1)
    out = np.empty((len(rows), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k, code in enumerate(np.ascontiguousarray(codes.T).astype(np.int32)):
        step = _STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + _INDEX[code & 7], 0, 88)
        out[:, k + 1] = value
    return out


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation in integers; the last sample is held."""
    if not len(pcm) or source == target:
        return pcm
    wide = pcm.astype(np.int64)
    place = np.arange(len(pcm) * target // source, dtype=np.int64) * source
    at, part = place // target, place % target
    after = np.minimum(at + 1, len(pcm) - 1)
    return ((wide[at] * (target - part) + wide[after] * part) // target).astype(np.int16)


def wav(data: bytes, kind: int, rate: int) -> bytes:
    """A mono WAV file of this sample data."""
    if kind == PCM:
        form = struct.pack("<HHIIHH", kind, 1, rate, 2 * rate, 2, 16)
    elif kind == ADPCM:
        samples = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", kind, 1, rate, rate * BLOCK // samples, BLOCK, 4, 2, samples)
    else:
        form = struct.pack("<HHIIHHH", kind, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and sample data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def payload(text: str | None) -> bytes:
    """The text in UTF-8, padded to whole units, one at least."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def features(pcm: np.ndarray) -> str:
    """Samples, peak, root of the mean square, zero crossings and mean absolute change, as integers."""
    wide = pcm.astype(np.int64)
    sign = wide >= 0
    n = max(1, len(wide))
    return f"{len(wide)}:{int(np.abs(wide).max(initial=0))}:{int(np.sqrt((wide * wide).sum() / n))}:{int((sign[1:] != sign[:-1]).sum())}:{int(np.abs(np.diff(wide)).sum() // n)}"


def store(df: DataFrame, text: str = "text", media: str = "media", rate: int = 8000) -> DataFrame:
    """``df`` with ``media`` (binary): a WAV file whose sample data is the text's payload.

    The format is chosen by the payload's crc32: mu-law, A-law or ADPCM, so equal texts give equal files. Null texts count as empty
    and give one unit of padding. Row by row, whole texts; repeated rows get equal files, an empty table stays empty; a column
    named ``media`` is replaced.
    """
    common.ship(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), DOCS):
            files = []
            for t in texts.slice(at, DOCS).to_pylist():
                data = payload(t)
                files.append(wav(data, (MULAW, ALAW, ADPCM)[zlib.crc32(data) % 3], rate))
            out.append(pa.array(files, pa.binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return df.withColumn(media, F.arrow_udf(run, "binary")(F.col(f"`{text}`").cast("string")))


def decode(df: DataFrame, media: str = "media", rate: int = 16000, pcm: bool = True) -> DataFrame:
    """``df`` with what the files of ``media`` hold: ``payload`` (binary, the sample data), ``codec``, ``feature`` (of the
    resampled samples) and, with ``pcm``, ``pcm`` (binary, a 16-bit WAV file at ``rate``). Columns of those names are replaced.

    A null file gives nulls; a file of another kind is an error. Files leave in batches of at most ``DOCS`` rows and ``FILE_BYTES``, so memory is
    bounded by these and the largest file. An empty table stays empty.
    """
    common.ship(df.sparkSession)
    tables = {MULAW: mulaw_table(), ALAW: alaw_table()}
    own = ["payload", "codec", "feature"] + ["pcm"] * pcm
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])
    names = kept.columns
    if media not in names:
        raise ValueError(f"no column {media}")

    def run(batches):
        for batch in common.slices(batches, DOCS, names.index(media), FILE_BYTES):
            read = [unwav(m) if m is not None else None for m in batch.column(names.index(media)).to_pylist()]
            packed = [np.frombuffer(r[2], np.uint8) for r in read if r and r[0] == ADPCM]
            decoded = adpcm(np.concatenate(packed)) if packed else None
            at, samples = 0, []
            for r in read:
                if r is None:
                    samples.append(None)
                    continue
                kind, own_rate, data = r
                if kind == ADPCM:
                    n = len(data) // BLOCK
                    wave = decoded[at : at + n].ravel()
                    at += n
                elif kind in tables:
                    wave = tables[kind][np.frombuffer(data, np.uint8)]
                else:
                    raise ValueError(f"format tag {kind}")
                samples.append(resample(wave, own_rate, rate))
            new = [
                ("payload", pa.array([r and r[2] for r in read], pa.binary())),
                ("codec", pa.array([r and NAMES[r[0]] for r in read], pa.string())),
                ("feature", pa.array([None if s is None else f"{NAMES[r[0]]}:{features(s)}" for r, s in zip(read, samples)], pa.string())),
            ]
            if pcm:
                new.append(("pcm", pa.array([None if s is None else wav(s.astype("<i2").tobytes(), PCM, rate) for s in samples], pa.binary())))
            yield common.with_columns(batch, new)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", payload binary, codec string, feature string" + ", pcm binary" * pcm
    return kept.mapInArrow(run, schema)


def op7_media(spark, sf_dir):
    """Store every text of ``documents`` as telephony audio, read it back, store the resampled PCM, and describe the samples."""
    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    stored = store(docs).select("doc_id", F.octet_length(common.text_of("text")).cast("long").alias("n_bytes"), "media")
    read = decode(stored)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "codec",
        F.length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
