"""Media columns: MPEG-1 Layer III audio streams.

write_stream() stores a payload losslessly as the main data of audio frames behind an ID3v2 tag and a frame with a
variable-bitrate table; scan_stream() reads any such stream, of one or two channels: it steps over tags, finds frame
headers (and, where bytes are damaged, looks for the next header that a second one confirms), checks each frame's
CRC-16, reads the variable-bitrate table (both usual kinds) and returns durations in samples, the byte offset of every
frame and the main data. A frame's main data may begin in frames before it (the bit reservoir) and ends within it; where
the beginning was lost, or the side information asks for more than there is, the frame counts as lost and gives none.

Defined results: a null text is an empty one; every payload has one block at least; equal texts and repeated rows give
equal values, a row for each; long texts are stored whole, in the memory of one text; an empty table gives an empty
result; input columns other than the two named are ignored, whatever their names. scan_stream reads any bytes without
raising: what is no frame or tag is counted as skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.llm.common import table

BLOCK = 192
#: Bitrates of MPEG-1 Layer III in kbit/s by index (0 is free format, which isn't read) and its sample rates.
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
#: What write_stream uses: 48 kHz, 80 kbit/s, one channel, with a checksum; 240 bytes a frame.
_HEAD = bytes([0xFF, 0xFA, 6 << 4 | 1 << 2, 0xC0])
_FRAME, _SIDE = 240, 17
_AT = 4 + 2 + _SIDE


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out[i] = c
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frame checksum of each row of bytes (polynomial 0x8005, first value 0xFFFF)."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


def _side_info() -> bytes:
    """Main data starts in this frame; each of the two granules has half of the block's bits."""
    half = BLOCK * 8 // 2
    bits = "0" * 9 + "0" * 5 + "0" * 4 + (f"{half:012b}" + "0" * 47) * 2
    return int(bits, 2).to_bytes(_SIDE, "big")


_SIDE_BYTES = _side_info()


def _frames(blocks: np.ndarray) -> np.ndarray:
    out = np.zeros((len(blocks), _FRAME), np.uint8)
    out[:, :4] = np.frombuffer(_HEAD, np.uint8)
    out[:, 6:_AT] = np.frombuffer(_SIDE_BYTES, np.uint8)
    checked = np.frombuffer(_HEAD[2:] + _SIDE_BYTES, np.uint8)[None]
    crc = int(crc16(checked)[0])
    out[:, 4], out[:, 5] = crc >> 8, crc & 255
    out[:, _AT : _AT + BLOCK] = blocks
    return out


def _tag(n_bytes: int) -> bytes:
    """An ID3v2.4 tag with one text frame, the unpadded length."""
    text = b"\x03n_bytes\x00" + str(n_bytes).encode()
    sync = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    frame = b"TXXX" + sync(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + sync(len(frame)) + frame


def pad(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % BLOCK if data else BLOCK)


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """payload: a positive multiple of BLOCK bytes."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    body = _frames(blocks)
    n = len(blocks) + 1
    first = _frames(np.zeros((1, BLOCK), np.uint8))[0]
    table_ = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + (n * _FRAME).to_bytes(4, "big") + bytes(min(255, (n * k // 100) * 256 // n) for k in range(100))
    first[_AT : _AT + len(table_)] = np.frombuffer(table_, np.uint8)
    return _tag(n_bytes) + first.tobytes() + body.tobytes()


def _header(b: bytes, at: int) -> tuple[int, int, int, bool] | None:
    """(frame length, sample rate, side information length, has checksum) of a Layer III header at that place."""
    h = b[at : at + 4]
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xFE != 0xFA:
        return None
    k, r = h[2] >> 4, h[2] >> 2 & 3
    if not 0 < k < 15 or r == 3:
        return None
    return 144_000 * KBITS[k] // RATES[r] + (h[2] >> 1 & 1), RATES[r], 17 if h[3] >> 6 == 3 else 32, not h[1] & 1


def read_tag(b: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag and the length of the tag; ({}, 0) without one."""
    if b[:3] != b"ID3" or len(b) < 10:
        return {}, 0
    whole = lambda x: (x[0] & 127) << 21 | (x[1] & 127) << 14 | (x[2] & 127) << 7 | x[3] & 127
    end = min(len(b), 10 + whole(b[6:10]) + 10 * bool(b[5] & 16))
    at, out = 10, {}
    if b[5] & 64 and len(b) >= 14:  # an extended header, whose length counts itself from version 4 on
        at += whole(b[10:14]) if b[3] >= 4 else 4 + int.from_bytes(b[10:14], "big")
    while at + 10 <= end and b[at] != 0:
        n = whole(b[at + 4 : at + 8]) if b[3] >= 4 else int.from_bytes(b[at + 4 : at + 8], "big")
        name, text = b[at : at + 4].decode("latin-1"), b[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and text:
            key, _, value = text[1:].partition(b"\0")
            out[f"{name}:{key.decode('utf-8', 'replace')}" if name == "TXXX" else name] = (value if name == "TXXX" else text[1:]).decode("utf-8", "replace")
        at += 10 + n
    return out, end


def read_table(b: bytes, at: int, side: int) -> dict | None:
    """The variable-bitrate table of the frame at that place, whose side information ends at `side`."""
    number = lambda x, n: int.from_bytes(b[x : x + n], "big")
    if b[side : side + 4] in (b"Xing", b"Info"):
        flags, x = number(side + 4, 4), side + 8
        out = {"frames": None, "bytes": None, "toc": b""}
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
            if flags & bit:
                out[name] = b[x : x + n] if name == "toc" else number(x, n)
                x += n
        return out
    x = at + 36
    if b[x : x + 4] == b"VBRI":
        return {"frames": number(x + 14, 4), "bytes": number(x + 10, 4), "toc": b[x + 26 : x + 26 + number(x + 18, 2) * number(x + 22, 2)]}
    return None


def _field(bits: np.ndarray, at: int, n: int) -> np.ndarray:
    return bits[:, at : at + n] @ (1 << np.arange(n - 1, -1, -1))


def scan_stream(b: bytes) -> dict:
    """tags, offsets (of frames with audio), lengths, rate, samples, skipped (bytes that belong to no frame), crc_bad,
    table (frames, bytes, toc), lost (frames without their main data) and payload (the main data that the side
    information declares)."""
    tags, at = read_tag(b)
    end, tail = len(b), len(b) - 128 if b[-128:-125] == b"TAG" else -1  # an ID3v1 tag, unless it lies within a frame
    seen: dict[bytes, tuple | None] = {}
    starts, kinds, skipped = [], [], 0
    locked = False
    while at + 4 <= end:
        four = b[at : at + 4]
        h = seen[four] if four in seen else seen.setdefault(four, _header(b, at))
        ok = h is not None and at + h[0] <= end
        if ok and not locked:  # a header counts after damage if another one, or the end, follows it
            ok = at + h[0] + 4 > end or at + h[0] == tail or _header(b, at + h[0]) is not None
        if ok:
            starts.append(at)
            kinds.append(four)
            at, locked = at + h[0], True
        elif at == tail:
            break
        else:
            n = b.find(b"\xff", at + 1, end)
            n = end if n < 0 else n
            n = tail if at < tail < n else n
            skipped, at, locked = skipped + n - at, n, False
    data, off, bad = np.frombuffer(b, np.uint8), np.array(starts, np.int64), 0
    length, side_end, begins, wants = (np.zeros(len(starts), np.int64) for _ in range(4))
    kind_of = np.frombuffer(b"".join(kinds), ">u4")
    for k in dict.fromkeys(kinds):
        h, of = seen[k], np.flatnonzero(kind_of == int.from_bytes(k, "big"))
        length[of] = h[0]
        side_end[of] = off[of] + 4 + 2 * h[3] + h[2]
        info = data[side_end[of, None] - h[2] + np.arange(h[2])]
        if h[3]:
            head = np.broadcast_to(np.frombuffer(k[2:], np.uint8), (len(of), 2))
            bad += int((crc16(np.hstack([head, info])) != (data[off[of] + 4].astype(np.uint16) << np.uint16(8) | data[off[of] + 5])).sum())
        bits = np.unpackbits(info, axis=1)
        begins[of] = _field(bits, 0, 9)
        # 59 bits for each granule and channel, which begin with the number of its bits
        wants[of] = (sum(_field(bits, p, 12) for p in ((18, 77) if h[2] == 17 else (20, 79, 138, 197))) + 7) // 8
    found = read_table(b, starts[0], int(side_end[0])) if starts else None
    first = int(found is not None)
    off, length, side_end, begins, wants = off[first:], length[first:], side_end[first:], begins[first:], wants[first:]
    # the reservoir: main data areas in order, anew after bytes that belong to no frame
    ends = off + length
    store = b"".join([b[x:y] for x, y in zip(side_end.tolist(), ends.tolist(), strict=True)])
    until = np.cumsum(ends - side_end)
    area = until - (ends - side_end)
    anew = np.concatenate([[True], off[1:] != ends[:-1]])[: len(off)]
    since = np.maximum.accumulate(np.where(anew, area, 0)) if len(off) else area
    begin = area - begins
    whole = (begin >= since) & (begin + wants <= until)
    payload = b"".join([store[x : x + n] for x, n in zip(begin[whole].tolist(), wants[whole].tolist(), strict=True)])
    rate = seen[kinds[0]][1] if kinds else 0
    return {"tags": tags, "offsets": off, "lengths": length, "rate": rate, "samples": SAMPLES * len(off), "skipped": skipped, "crc_bad": bad, "table": found, "lost": int((~whole).sum()), "payload": payload}


def store_text(text: str | None) -> tuple[bytes, dict]:
    """The stored stream of a text and what reading it back gives."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = write_stream(pad(raw), len(raw))
    return media, scan_stream(media)


def _describe(text: str | None) -> tuple:
    media, got = store_text(text)
    payload, t = got["payload"], got["table"] or {}
    seek = hashlib.md5(got["offsets"].astype("<i8").tobytes()).hexdigest()
    feature = f"mpeg1-layer3;rate={got['rate']};frames={len(got['offsets'])};samples={got['samples']};ms={got['samples'] * 1000 // max(1, got['rate'])};table_frames={t.get('frames')};table_bytes={t.get('bytes')};skipped={got['skipped']};crc_bad={got['crc_bad']};seek_md5={seek}"
    return int(got["tags"].get("TXXX:n_bytes", -1)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text, reads it back and describes it; a map over partitions without a shuffle."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_describe(t.as_py()) for t in b.column(1)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def media_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the stored stream of each text as a binary column."""

    @F.pandas_udf("binary")
    def stored(x: pd.Series) -> pd.Series:
        return x.map(lambda t: store_text(t)[0])

    return docs.withColumn(media, stored(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document stored as an audio stream and read back."""
    return media_features(table(spark, sf_dir, "documents"))
