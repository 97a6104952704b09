"""Media columns: MPEG audio.

`read_mpeg` parses a column of MPEG audio files: it reads the text frames of an ID3v2 tag (versions 2 to 4) and the fields of a trailing ID3v1 tag, resynchronises on frame headers
(a candidate counts when the header is valid and the next frame or the end follows at the length it
declares; 'TAG' 128 bytes before the end is a trailing tag unless a frame covers it), reads a Xing/Info or VBRI table (frames, bytes, seek table), verifies the CRC-16 of
protected frames of layers I and III, and returns the exact duration at each frame's own rate,
every frame's offset for seeking, and the bytes that silent frames carry behind their side information. Checksums of layer II,
which cover fields whose place depends on the allocation, are counted as not checked.
`write_mpeg` makes such files from bytes: MPEG-2 Layer III, 16 kHz, mono, protected frames without
coded samples, each with 576 payload bytes as ancillary data, so a player hears silence and the payload
comes back bit for bit.

Null or empty content: no frames, duration 0, empty payload. Bytes that hold no valid frame: the same, with
`junk_bytes` counting them. Repeated rows give repeated results; extra columns are kept by name and never
read. Memory is bounded by an Arrow batch and its files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, extended, steps, utf8

#: Fixed values of the format: kbit/s by bitrate index, Hz by rate index.
BITRATES = {
    ("1", 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: Payload bytes of a frame that write_mpeg makes, and its parts.
UNIT, SIDE, HEADER = 576, 9, 6
FRAME = 648


def parse_header(b: bytes | np.ndarray, at: int) -> tuple[int, int, int, int, bool, int] | None:
    """(bytes of the frame, samples, Hz, side information bytes, protected, layer), or None if no valid header stands there."""
    if at + 4 > len(b) or b[at] != 0xFF or (b[at + 1] & 0xE0) != 0xE0:
        return None
    version, layer = (int(b[at + 1]) >> 3) & 3, 4 - ((int(b[at + 1]) >> 1) & 3)
    index, rate_index, pad = int(b[at + 2]) >> 4, (int(b[at + 2]) >> 2) & 3, (int(b[at + 2]) >> 1) & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3 or (int(b[at + 3]) & 3) == 2:
        return None
    kbps, hz = BITRATES["1" if version == 3 else "2", layer][index], RATES[version][rate_index]
    mono = int(b[at + 3]) >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return size, samples, hz, side, not b[at + 1] & 1, layer


def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
            crc &= 0xFFFF
    return crc


def _frame_head() -> bytes:
    """Header, checksum and empty side information of a frame."""
    head = bytes([0xFF, 0xF2, 13 << 4 | 2 << 2, 0xC0])
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


HEAD = _frame_head()
#: An ID3v2.4 tag with one text frame; its sizes are synchsafe.
TAG = b"ID3\x04\x00\x00\x00\x00\x00\x1c" + b"TSSE\x00\x00\x00\x12\x00\x00\x03terrabrook silent"


def padded_sizes(n: np.ndarray) -> np.ndarray:
    """Payload bytes: the positive multiple of 576 at or above n."""
    return np.maximum(1, -(-n // UNIT)) * UNIT


def write_mpeg(texts: pa.Array) -> pa.Array:
    """One file per row of a large_binary column: tag, frame with the Info table, a frame per 576 bytes."""
    at, data = buffers(texts)
    sizes = np.diff(at)
    frames = padded_sizes(sizes) // UNIT
    media = len(TAG) + (frames + 1) * FRAME
    out_at = np.concatenate(([0], np.cumsum(media)))
    out = np.zeros(int(out_at[-1]), np.uint8)
    head = np.frombuffer(HEAD, np.uint8)
    for i in range(len(sizes)):
        n, o = int(frames[i]), int(out_at[i])
        out[o : o + len(TAG)] = np.frombuffer(TAG, np.uint8)
        body = out[o + len(TAG) : int(out_at[i + 1])].reshape(n + 1, FRAME)
        body[:, : len(head)] = head
        seek = (np.arange(100) * (n + 1) // 100) * 256 // (n + 1)
        info = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + seek.astype(np.uint8).tobytes()
        body[0, len(head) : len(head) + len(info)] = np.frombuffer(info, np.uint8)
        payload = np.full(n * UNIT, 255, np.uint8)
        payload[: int(sizes[i])] = data[int(at[i]) : int(at[i + 1])]
        body[1:, len(head) : len(head) + UNIT] = payload.reshape(n, UNIT)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(out_at.astype(np.int64)), pa.py_buffer(out)])


def _text(raw: bytes) -> str:
    """A tag's text: its first byte names the encoding."""
    kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[raw[0]] if raw[:1] and raw[0] < 4 else "latin-1"
    return raw[1:].decode(kind, "replace").rstrip("\0")


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def parse_tag(b: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the tag, text frames by name) of an ID3v2 tag at the start, or (0, {})."""
    if b[:3] != b"ID3" or len(b) < 10:
        return 0, {}
    version, flags = b[3], b[5]
    size = 10 + _synchsafe(b[6:10]) + (10 if flags & 16 else 0)
    body = b[10 : 10 + _synchsafe(b[6:10])]
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, texts, name = 0, {}, 3 if version == 2 else 4
    if flags & 64 and version > 2 and len(body) >= 4:  # an extended header
        at = _synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + 2 * name <= len(body) and body[at] != 0:
        long_ = _synchsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + name : at + 2 * name], "big")
        first = at + (6 if version == 2 else 10)
        if body[at : at + 1] == b"T" and long_:
            texts.setdefault(body[at : at + name].decode("latin-1"), _text(body[first : first + long_]))
        at = first + long_
    return size, texts


def parse_table(b: bytes, at: int, first: int) -> tuple[int, int, list[int]] | None:
    """(frames, bytes, seek table) of a Xing, Info or VBRI table in the frame at `at`, -1 where it doesn't say; None if there is none. first: behind the side information."""
    if b[first : first + 4] in (b"Xing", b"Info"):
        flags, place = int.from_bytes(b[first + 4 : first + 8], "big"), first + 8
        frames = int.from_bytes(b[place : place + 4], "big") if flags & 1 else -1
        place += 4 * (flags & 1)
        total = int.from_bytes(b[place : place + 4], "big") if flags & 2 else -1
        place += 2 * (flags & 2)
        return frames, total, list(b[place : place + 100]) if flags & 4 else []
    start = at + 36
    if b[start : start + 4] == b"VBRI":
        number = lambda k, n: int.from_bytes(b[start + k : start + k + n], "big")
        entries, scale, width = number(18, 2), number(20, 2), number(22, 2)
        return number(14, 4), number(10, 4), [number(26 + i * width, width) * scale for i in range(entries)]
    return None


def covered(b: bytes, at: int, layer: int, first: int) -> bytes | None:
    """What a protected frame's checksum covers, where it is whole bytes: the header's second half and the side information (layer III) or the allocation (layer I)."""
    if layer == 3:
        return b[at + 2 : at + 4] + b[at + 6 : first]
    if layer == 1:
        mode, bound = b[at + 3] >> 6, 4 * ((b[at + 3] >> 4 & 3) + 1)
        fields = 32 if mode == 3 else 2 * bound + 32 - bound if mode == 1 else 64
        return b[at + 2 : at + 4] + b[at + 6 : at + 6 + fields // 2]
    return None


def parse_mpeg(b: bytes) -> dict:
    """What read_mpeg returns of one file."""
    n = len(b)
    tag, tags = parse_tag(b)
    at = tag
    mark = n - 128 if n >= 128 and b[n - 128 : n - 125] == b"TAG" else -1  # an ID3v1 tag, unless a frame covers it
    offsets, units, junk, bad, checked, hz, table = [], [], 0, 0, 0, 0, None
    known: dict[bytes, int] = {}
    samples: dict[int, int] = {}
    while at < n and at != mark:
        h = parse_header(b, at)
        follows = h and (at + h[0] in (n, mark) or at + h[0] < n and parse_header(b, at + h[0]) is not None)
        if not follows:
            stop = mark if at < mark else n
            found = b.find(b"\xff", at + 1, stop)
            junk += (stop if found < 0 else found) - at
            at = stop if found < 0 else found
            continue
        size, count, hz, side, protected, layer = h
        first = at + 4 + 2 * protected + side
        if table is None and not offsets and (table := parse_table(b, at, first)) is not None:
            at += size
            continue
        part = covered(b, at, layer, first) if protected else None
        if part is not None:
            if part not in known:
                known[part] = crc16(part)
            checked += 1
            bad += known[part] != int.from_bytes(b[at + 4 : at + 6], "big")
        offsets.append(at)
        samples[hz] = samples.get(hz, 0) + count
        units.append(b[first : min(first + UNIT, at + size)])
        at += size
    if at == mark:
        fields = {"title": b[mark + 3 : mark + 33], "artist": b[mark + 33 : mark + 63], "album": b[mark + 63 : mark + 93], "year": b[mark + 93 : mark + 97]}
        tags |= {k: t for k, v in fields.items() if (t := v.split(b"\0")[0].decode("latin-1").strip())}
    frames, total, seek = table or (None, None, [])
    lasts = sum((Fraction(k * 1_000_000_000, rate) for rate, k in samples.items()), Fraction(0))
    return {"payload": b"".join(units), "offsets": offsets, "samples": sum(samples.values()), "hz": hz, "duration_ns": int(lasts), "checked": checked, "bad": bad, "listed": frames, "listed_bytes": total, "seek": seek, "junk": junk, "tag_bytes": tag, "tags": tags}


def store_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `media`: each text (null: empty) in UTF-8, padded with 255, as an MPEG audio file. An old column of just that name goes, all others stay."""

    def write(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = utf8(batch.column(place))
            at, _ = buffers(column)
            for a, b in steps(at, 4 << 20):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns)), write_mpeg(column.slice(a, b - a)).cast(pa.binary())], [*batch.schema.names, "media"])

    return extended(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "media")), text, write, {"media": "binary"})


RESULT = "payload binary, media_bytes long, media_sha256 string, frames long, samples long, sample_rate int, duration_ns long, seek_offsets array<long>, crc_checked long, crc_bad long, listed_frames long, junk_bytes long, tag_bytes long, listed_bytes long, seek_table array<long>, tags map<string,string>"


def read_mpeg(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, what the file holds) of every row of `files`; see RESULT for the columns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, content = batch.column(0), batch.column(1)
            for a in range(0, max(1, batch.num_rows), 256):
                rows = [x or b"" for x in content.slice(a, 256).to_pylist()]
                got = [parse_mpeg(x) for x in rows]
                columns = [
                    pa.array([g["payload"] for g in got], pa.binary()), pa.array([len(x) for x in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
                    pa.array([len(g["offsets"]) for g in got], pa.int64()), pa.array([g["samples"] for g in got], pa.int64()), pa.array([g["hz"] for g in got], pa.int32()), pa.array([g["duration_ns"] for g in got], pa.int64()),
                    pa.array([g["offsets"] for g in got], pa.list_(pa.int64())), pa.array([g["checked"] for g in got], pa.int64()), pa.array([g["bad"] for g in got], pa.int64()),
                    pa.array([g["listed"] for g in got], pa.int64()), pa.array([g["junk"] for g in got], pa.int64()), pa.array([g["tag_bytes"] for g in got], pa.int64()),
                    pa.array([g["listed_bytes"] for g in got], pa.int64()), pa.array([g["seek"] for g in got], pa.list_(pa.int64())), pa.array([list(g["tags"].items()) for g in got], pa.map_(pa.string(), pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([keys.slice(a, 256), *columns], [key, *(x.split()[0] for x in RESULT.split(", "))])

    kind = dict(files.dtypes)[key]
    return files.select(key, media).mapInArrow(read, f"`{key}` {kind}, {RESULT}")


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of documents stored as audio and read back."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), *(batch.column(i) for i in range(3, 6))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    files = store_text(docs).withColumn("key", F.struct("doc_id", "n_bytes"))
    read = read_mpeg(files, "key")
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for k, c in (("frames", "frames"), ("listed", "listed_frames"), ("hz", "sample_rate"), ("ns", "duration_ns"), ("bad_crc", "crc_bad"), ("junk", "junk_bytes"))), F.concat(F.lit("last="), F.coalesce(F.element_at("seek_offsets", -1).cast("string"), F.lit("-"))))
    return read.select("key.doc_id", "payload", "key.n_bytes", "media_bytes", "media_sha256", feature.alias("feature")).mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
