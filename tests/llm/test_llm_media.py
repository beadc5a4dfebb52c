import hashlib
import struct
import zlib

import numpy as np
import pytest
from cases import ROWS, documents, table

from quarrydf.llm import media


def test_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert [mu[i] for i in (0, 127, 128, 255, 16)] == [-32124, 0, 32124, 0, -15996]
    assert [a[i] for i in (0x55, 0xD5, 0x2A, 0xAA, 0x54)] == [-8, 8, -32256, 32256, -24]
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def scalar(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media._STEPS[index])
            change = step // 8 + step * (code >> 2 & 1) + step // 2 * (code >> 1 & 1) + step // 4 * (code & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    data = np.random.default_rng(0).integers(0, 256, media.BLOCK * 33, dtype=np.uint8)
    assert media.adpcm(data).tolist() == [scalar(data[i : i + media.BLOCK].tobytes()) for i in range(0, len(data), media.BLOCK)]


def test_resample():
    assert media.resample(np.array([0, 10, -10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10]
    assert media.resample(np.array([3], np.int16), 8000, 8000).tolist() == [3]
    assert len(media.resample(np.zeros(0, np.int16), 8000, 16000)) == 0


@pytest.mark.parametrize("kind", [media.MULAW, media.ALAW, media.ADPCM, media.PCM])
@pytest.mark.parametrize("n", [0, 1, 36, 577])
def test_files_hold_their_bytes(kind, n):
    data = bytes(range(256)) * 3
    assert media.unwav(media.wav(data[:n], kind, 8000)) == (kind, 8000, data[:n])


def test_bad_files():
    with pytest.raises(ValueError):
        media.unwav(b"nothing")


def whole_files(data):
    """The stored file and its resampled PCM file, sample by sample: an independent decoder."""
    kind = (7, 6, 17)[zlib.crc32(data) % 3]
    if kind == 17:
        wave = [x for i in range(0, len(data), 36) for x in scalar(data[i : i + 36])]
        form = struct.pack("<HHIIHHHH", 17, 1, 8000, 8000 * 36 // 65, 36, 4, 2, 65)
    else:
        wave = []
        for byte in data:
            if kind == 7:
                byte = 255 - byte
                size = ((byte % 16 * 2 + 33) << (byte // 16 % 8)) - 33
                wave.append((-4 if byte >= 128 else 4) * size)
            else:
                byte ^= 0x55
                step, low = byte // 16 % 8, byte % 16
                size = 2 * low + 1 if step == 0 else (2 * low + 33) << (step - 1)
                wave.append((8 if byte >= 128 else -8) * size)
        form = struct.pack("<HHIIHHH", kind, 1, 8000, 8000, 1, 8, 0)
    after = wave[1:] + wave[-1:]
    twice = [x for a, b in zip(wave, after) for x in (a, (a * 8000 + b * 8000) // 16000)]
    pcm = struct.pack(f"<{len(twice)}h", *twice)

    def riff(form, data):
        body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
        return b"RIFF" + struct.pack("<I", len(body)) + body

    return riff(form, data), riff(struct.pack("<HHIIHH", 1, 1, 16000, 32000, 2, 16), pcm)


def test_query(spark, tmp_path):
    folder = table(spark, tmp_path, documents=documents(spark, ["media", "payload", "codec", "feature", "pcm"]))
    got = media.op7_media(spark, folder).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text, *_ in ROWS:
        raw = (text or "").encode()
        data = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((doc_id, len(raw), len(data), sha(data), zlib.crc32(data[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    texts = {}
    for _, text, *_ in ROWS:
        texts[sha(media.payload(text))] = media.payload(text)
    for r in got:
        file, pcm = whole_files(texts[r["payload_sha256"]])
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), sha(file))
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (len(pcm), sha(pcm))
        samples = struct.unpack(f"<{(len(pcm) - 44) // 2}h", pcm[44:])
        peak, square = max(map(abs, samples)), sum(x * x for x in samples) // len(samples)
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(samples, samples[1:]))
        n, top, root, cross, _ = map(int, r["feature"].split(":")[1:])
        assert (n, top, cross) == (len(samples), peak, crossings) and root * root <= square + 1 and (root + 1) ** 2 > square - 1
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], tuple(r)[2:]) == tuple(r)[2:]
        assert r["media_bytes"] > r["payload_bytes"]


def test_decoded_files(spark):
    stored = media.store(documents(spark, ["payload"]))
    read = media.decode(stored).collect()
    assert {r["codec"] for r in read} <= {"mulaw", "alaw", "adpcm"}
    for r in read:
        kind, rate, pcm = media.unwav(bytes(r["pcm"]))
        assert (kind, rate) == (media.PCM, 16000)
        assert r["feature"] == f"{r['codec']}:{media.features(np.frombuffer(pcm, '<i2'))}"
        assert media.unwav(bytes(r["media"]))[2] == bytes(r["payload"])
    assert media.decode(stored.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,)], "media binary")
    assert media.decode(nulls).first()["payload"] is None
