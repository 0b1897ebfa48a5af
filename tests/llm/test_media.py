import hashlib
import io
import math
import random
import struct
import wave
import zlib
from collections import Counter

import pytest

from kinfold.llm import media
from kinfold.llm.queries import op4_media_sniffing

GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03x\x11\xff\x00\x22\xff\xd0\x33\xff\xd9"
WEBP = b"RIFF\x16\x00\x00\x00WEBPVP8 \x0a\x00\x00\x00abcdefghij"


def payloads():
    rng = random.Random(1)
    return [rng.randbytes(64 * rng.randrange(1, 30)) for _ in range(60)]


def test_round_trip_of_every_format():
    kinds = set()
    for p in payloads():
        kind, data = media.store(p)
        kinds.add(kind)
        assert media.sniff_bytes(data)[:2] == (kind, len(data))
        assert media.samples(kind, data) == p
    assert kinds == {"audio/wav", "image/bmp", "image/png"}


@pytest.mark.parametrize("kind, data", [("image/gif", GIF), ("image/jpeg", JPEG), ("image/webp", WEBP)])
def test_other_formats(kind, data):
    assert media.sniff_bytes(data) == (kind, len(data), [])
    assert media.sniff_bytes(data[:-1])[0] == media.UNKNOWN


def test_broken_structure_is_not_confirmed():
    png = next(d for p in payloads() for k, d in [media.store(p)] if k == "image/png")
    flipped = bytearray(png)
    flipped[40] ^= 1
    assert media.sniff_bytes(bytes(flipped))[0] == media.UNKNOWN
    wav = next(d for p in payloads() for k, d in [media.store(p)] if k == "audio/wav")
    assert media.sniff_bytes(wav[:4] + struct.pack("<I", len(wav) * 2) + wav[8:])[0] == media.UNKNOWN
    for text in (b"", b"BM", b"BM is not a picture" * 50, b"GIF89a" * 30, b"RIFF", b"WAVEfmt "):
        assert media.sniff_bytes(text)[0] == media.UNKNOWN


def test_embedded_files_are_carved():
    data = b"head BM " + GIF + b"middle" + JPEG + WEBP
    assert media.sniff_bytes(data) == (media.UNKNOWN, 0, [("image/gif", 8, len(GIF)), ("image/jpeg", 14 + len(GIF), len(JPEG)), ("image/webp", 14 + len(GIF) + len(JPEG), len(WEBP))])
    inside = GIF + bytes(64 * 3 - len(GIF))
    kind, stored = media.store(inside)
    found = media.sniff_bytes(stored)
    assert found[0] == kind and (kind == "image/png" or [c[0] for c in found[2]] == ["image/gif"])


def test_query_against_its_contract(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op4_media_sniffing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert any(r["type_corrected"] for r in got) and not all(r["type_corrected"] for r in got)
    seen = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        n, payload = media.padded(texts[r["doc_id"]])
        assert len(payload) % 64 == 0 and payload[: len(raw)] == raw and not any(payload[len(raw) :]) and 0 < len(payload) - len(raw) < 64 or len(payload) == len(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        kind, data = media.store(payload)
        assert (r["type"], r["media_bytes"], r["media_sha256"]) == (kind, len(data), hashlib.sha256(data).hexdigest())
        assert seen.setdefault(raw, r["feature"]) == r["feature"]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x" * 200_000, "c")], "doc_id long, text string, media string")
    got = media.sniff(media.store_texts(df)).collect()
    assert sorted((r["n_bytes"], r["payload_bytes"]) for r in got) == [(0, 64), (0, 64), (200_000, 200_000)]
    raw = spark.createDataFrame([(None, "image/png", 1), (bytearray(b"text"), None, 2), (bytearray(JPEG), "image/jpeg", 3)], "media binary, declared string, type int")
    assert sorted(((r["type"] or "-"), r["feature"], r["type_corrected"]) for r in media.sniff(raw).collect()) == [("-", None, None), (media.UNKNOWN, None, True), ("image/jpeg", None, False)]
    assert media.sniff(media.store_texts(df.limit(0))).count() == 0


def wav_samples(data):
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
        return w.readframes(w.getnframes())


def bmp_samples(data):
    """Rows of an 8-bit picture through its palette, from the top down."""
    assert data[:2] == b"BM" and int.from_bytes(data[2:6], "little") == len(data)
    start, width, height = (int.from_bytes(data[a : a + 4], "little", signed=True) for a in (10, 18, 22))
    palette = [data[54 + 4 * i] for i in range(256)]
    step = -(-width // 4) * 4
    rows = [data[start + i * step : start + i * step + width] for i in range(abs(height))]
    return bytes(palette[x] for row in (rows if height < 0 else rows[::-1]) for x in row)


def png_samples(data):
    """Rows of a grey 8-bit picture, all filters undone."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, packed, width = 8, b"", 0
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        if kind == b"IHDR":
            width = int.from_bytes(body[:4], "big")
            assert body[8:10] == bytes([8, 0])
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    raw, out, above = zlib.decompress(packed), b"", bytes(width)
    for i in range(0, len(raw), width + 1):
        kind, row = raw[i], bytearray(raw[i + 1 : i + 1 + width])
        for x in range(width):
            left, up = row[x - 1] if x else 0, above[x]
            row[x] = (row[x] + (0, left, up, (left + up) // 2)[kind]) % 256
        out, above = out + bytes(row), bytes(row)
    return out


def test_stored_files_read_by_other_readers(spark, sf_dir):
    """What the query stores, read by readers of other make, is the texts' bytes; the features follow from these."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.store_texts(docs).collect()}
    got = {r["doc_id"]: r for r in op4_media_sniffing(spark, sf_dir).collect()}
    read = {"audio/wav": wav_samples, "image/bmp": bmp_samples, "image/png": png_samples}
    for d, text in texts.items():
        r, raw = got[d], text.encode()
        payload = read[r["type"]](stored[d])
        assert payload == raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert r["media_sha256"] == hashlib.sha256(stored[d]).hexdigest() and r["media_bytes"] == len(stored[d])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        share = [n / len(payload) for n in Counter(payload).values()]
        entropy = max(0.0, -sum(p * math.log2(p) for p in share))
        changes = sum(a != b for a, b in zip(payload, payload[1:], strict=False))
        assert r["feature"].rsplit("entropy=", 1)[0] == f"{r['type']};n={len(payload)};min={min(payload)};max={max(payload)};sum={sum(payload)};"
        assert r["feature"].endswith(f";changes={changes}") and abs(float(r["feature"].split("entropy=")[1].split(";")[0]) - entropy) < 1e-4
