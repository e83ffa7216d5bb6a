"""MPEG audio columns (operator 7): parsing with resynchronisation, tags, variable-bitrate tables, checksums, seek offsets.

``parse`` walks a stream as a player must: it steps over ID3v2 and APEv2 tags, searches for a frame header that is
confirmed by the next one, follows the chain, and searches anew where the chain breaks. It reads Xing/Info and
VBRI tables, verifies the CRC-16 of protected Layer III frames, and gives exact durations (samples over rate) and
every frame's byte offset.

``store`` makes such a stream around any bytes, without loss: MPEG-1 Layer III mono frames at 48 kHz with empty
side information, whose main data are then ancillary bytes by the standard. They carry the payload; the last frame has
the least bitrate that holds the rest, so the stream has variable bitrate, a Xing table, and an ID3v2 tag that holds the
payload's length in a private frame. An empty frame ends the stream, so that no payload stands where a parser looks for
trailing tags. ``payload`` reads it back from the parsed frames.

Checksums are verified for Layers I and III; that of Layer II covers a part that depends on its allocation tables.
"""

from __future__ import annotations

import functools
import itertools
import hashlib
import struct
import zlib
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch

# Fixed values of the MPEG audio standard: bitrates in kbit/s by index 1 to 14 and sampling rates.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

UNIT = 192
OWNER = b"newsloom.payload\0"
_SIDE = 17
_HEADER = 0xFFFA0000  # MPEG-1, Layer III, protected


@functools.lru_cache(4096)
def header(word: int):
    """(version, layer, protected, kbit/s, rate, length, samples, side bytes) of a frame header, or None."""
    if word >> 21 != 0x7FF:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    index, r, pad = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1
    if version is None or layer == 4 or index in (0, 15) or r == 3 or word & 3 == 2:
        return None
    kbits, rate = KBITS[(1 if version == 1 else 2, layer)][index - 1], RATES[version][r]
    if layer == 1:
        samples, length = 384, (12000 * kbits // rate + pad) * 4
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        length = samples // 8 * 1000 * kbits // rate + pad
    mono = word >> 6 & 3 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return version, layer, not word >> 16 & 1, kbits, rate, length, samples, side


def _crc_table():
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        yield c & 0xFFFF


_CRC = tuple(_crc_table())


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for x in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ x]
    return c


def _allocation(mode: int) -> int:
    """Bytes of the bit allocation of a Layer I frame, by the last byte of its header: four bits a band and channel, joint bands once."""
    kind, bound = mode >> 6, 32
    if kind == 3:
        return 16
    if kind == 1:
        bound = 4 * ((mode >> 4 & 3) + 1)
    return (2 * bound + 32 - bound) // 2


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[int, int, dict[str, bytes]]:
    """(first byte of audio, byte after it, tag frames)."""
    at, end, tags = 0, len(data), {}
    while data[at:at + 3] == b"ID3" and at + 10 <= end:
        flags, size = data[at + 5], _syncsafe(data[at + 6:at + 10])
        k, stop = at + 10, min(at + 10 + size, end)
        while k + 10 <= stop and data[k]:
            n = _syncsafe(data[k + 4:k + 8]) if data[at + 3] == 4 else int.from_bytes(data[k + 4:k + 8], "big")
            tags.setdefault(data[k:k + 4].decode("latin-1"), data[k + 10:min(k + 10 + n, stop)])
            k += 10 + n
        at = min(at + 10 + size + 10 * (flags >> 4 & 1), end)
    if end - at >= 128 and data[end - 128:end - 125] == b"TAG":
        tags["ID3v1"] = data[end - 125:end]
        end -= 128
    if end - at >= 32 and data[end - 32:end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20:end - 8])
        tags["APEv2"] = data[max(at, end - size):end - 32]
        end = max(at, end - size - 32 * (flags >> 31))
    return at, end, tags


def _table(frame: bytes, side: int, protected: bool):
    """The variable-bitrate table in a first frame: (kind, frames, bytes, seek points), or None."""
    k = 4 + 2 * protected + side
    for k in (k, 4 + side):
        if frame[k:k + 4] in (b"Xing", b"Info") and len(frame) >= k + 8:
            flags, k2 = int.from_bytes(frame[k + 4:k + 8], "big"), k + 8
            frames, size, toc = None, None, b""
            if flags & 1:
                frames, k2 = int.from_bytes(frame[k2:k2 + 4], "big"), k2 + 4
            if flags & 2:
                size, k2 = int.from_bytes(frame[k2:k2 + 4], "big"), k2 + 4
            if flags & 4:
                toc = frame[k2:k2 + 100]
            return frame[k:k + 4].decode(), frames, size, toc
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        points = [int.from_bytes(frame[62 + k * width:62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return "VBRI", frames, size, [0, *itertools.accumulate(points)]
    return None


def parse(data: bytes) -> dict:
    """What a stream holds; empty or foreign bytes give no frames."""
    at, end, tags = _tags(data)
    out = {"tags": tags, "table": None, "offsets": [], "bodies": [], "skipped": 0, "crc_ok": 0, "crc_bad": 0, "samples": 0, "rate": 0, "kbits": 0}
    locked = False
    while at + 4 <= end:
        h = header(int.from_bytes(data[at:at + 4], "big"))
        good = h is not None and at + h[5] <= end
        if good and not locked:  # a lone match may be chance: the next frame must bear it out
            after = at + h[5]
            n = header(int.from_bytes(data[after:after + 4], "big")) if after + 4 <= end else None
            good = after == end or n is not None and n[:2] == h[:2] and n[4] == h[4]
        if not good:
            out["skipped"] += 1
            at, locked = at + 1, False
            continue
        _, layer, protected, kbits, rate, length, samples, side = h
        first = not locked and not out["offsets"] and out["table"] is None
        locked = True
        covered = side if layer == 3 else _allocation(data[at + 3]) if layer == 1 else None
        if protected and covered is not None:
            stored = int.from_bytes(data[at + 4:at + 6], "big")
            out["crc_ok" if crc16(data[at + 2:at + 4] + data[at + 6:at + 6 + covered]) == stored else "crc_bad"] += 1
        if first and layer == 3 and (table := _table(data[at:at + length], side, protected)):
            out["table"] = table
        else:
            out["offsets"].append(at)
            out["bodies"].append((at + 4 + 2 * protected + side, at + length))
            out["samples"] += samples
            out["kbits"] += kbits
            out["rate"] = rate
        at += length
    out["skipped"] += max(0, end - at)
    out["duration"] = Fraction(out["samples"], out["rate"]) if out["rate"] else Fraction(0)
    return out


def _head(index: int) -> bytes:
    word = _HEADER | index << 12 | 1 << 10 | 3 << 6
    return struct.pack(">I", word)


@functools.lru_cache(64)
def _prefix(index: int) -> bytes:
    head = _head(index)
    return head + struct.pack(">H", crc16(head[2:] + bytes(_SIDE))) + bytes(_SIDE)


_ROOM = [3 * k - 6 - _SIDE for k in KBITS[(1, 3)]]


def store(payload: bytes) -> bytes:
    most = _ROOM[-1]
    full, rest = divmod(len(payload), most)
    frames = [_prefix(14) + payload[k * most:(k + 1) * most] for k in range(full)]
    if rest:
        index = next(i for i, room in enumerate(_ROOM) if room >= rest)
        frames.append((_prefix(index + 1) + payload[full * most:]).ljust(3 * KBITS[(1, 3)][index], b"\0"))
    frames.append(_prefix(5).ljust(192, b"\0"))  # trailing tags are sought in the last 128 bytes
    body = b"".join(frames)
    total = len(body)
    begins = [0]
    for f in frames:
        begins.append(begins[-1] + len(f))
    toc = bytes(min(255, begins[len(frames) * p // 100] * 256 // total) for p in range(100))
    table = _prefix(5) + b"Xing" + struct.pack(">III", 7, len(frames), len(body)) + toc
    private = OWNER + struct.pack(">Q", len(payload))
    inner = b"PRIV" + struct.pack(">IH", len(private), 0) + private
    size = len(inner)
    tag = b"ID3\3\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + inner
    return tag + table.ljust(192, b"\0") + body


def payload(data: bytes, parsed: dict | None = None) -> bytes:
    parsed = parsed or parse(data)
    private = parsed["tags"].get("PRIV", b"")
    if not private.startswith(OWNER):
        raise ValueError("no payload in this stream")
    (n,) = struct.unpack(">Q", private[len(OWNER):])
    return b"".join(data[a:b] for a, b in parsed["bodies"])[:n]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


MEDIA = "doc_id long, n_bytes long, media binary"
PARSED = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, frames long, rate int, "
    "samples long, duration double, table string, crc_ok long, crc_bad long, skipped long, mean_kbits double, seek array<long>"
)
BATCH_BYTES = 16 << 20


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row; a null text counts as empty. Repeated rows and null ids stay."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for d, t in zip(*(c.to_pylist() for c in batch.columns)):
                n, raw = padded(t)
                rows.append({"doc_id": d, "n_bytes": n, "media": store(raw)})
                size += n
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, kind)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)


def described(media: DataFrame) -> DataFrame:
    """Parses a media column; ``seek`` has the byte offset of every frame."""
    def run(batches):
        for batch in batches:
            out = []
            for d, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                m = m.as_py()
                p = parse(m)
                raw = payload(m, p)
                k = len(p["offsets"])
                out.append((d, n, len(m), hashlib.sha256(m).hexdigest(), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), k, p["rate"], p["samples"],
                            float(p["duration"]), p["table"][0] if p["table"] else None, p["crc_ok"], p["crc_bad"], p["skipped"], p["kbits"] / k if k else 0.0, p["offsets"]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=[x.split()[0] for x in PARSED.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PARSED)


def features(docs: DataFrame) -> DataFrame:
    """Stores every text as MPEG audio in the shared folder, reads the streams back and describes them."""
    return described(Scratch(docs.sparkSession).cut(stored(docs)))
