"""Ogg media columns: write and read logical streams, with page checksums and granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm.common import named, with_fields
from quern.llm.hashing import slices, text_bytes

PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
RATE, UNIT, PACKET = 8000, 192, 1920
#: Text or media that become Python objects at once.
SLICE_BYTES = 8 << 20
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The page checksum: polynomial 0x04c11db7, most significant bit first, from 0, without a final xor.

    That is zlib's CRC run from 0 over bit-reversed bytes, bit-reversed itself.
    """
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """One logical stream: (packet, granule position at its end) as pages; the first packet has the first page."""
    out: list[bytes] = []
    body: list[bytes] = []
    lacing: list[int] = []
    granule, flags = -1, FIRST

    def close(last: bool) -> None:
        nonlocal granule
        head = PAGE.pack(b"OggS", 0, flags | (LAST if last else 0), granule, serial, len(out), 0, len(lacing)) + bytes(lacing)
        page = head + b"".join(body)
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
        body.clear()
        lacing.clear()
        granule = -1

    for k, (packet, end) in enumerate(packets):
        left = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while left:
            if len(lacing) == 255:
                close(False)
                flags = CONTINUED if at else 0
            taken = left[: 255 - len(lacing)]
            del left[: len(taken)]
            lacing += taken
            body.append(packet[at : at + sum(taken)])
            at += sum(taken)
        granule = end
        if k == len(packets) - 1:
            close(True)
        elif k == 0:
            close(False)
            flags = 0
    return out


def parse(media: bytes) -> list[tuple[int, int, int, int, list[int], bytes]]:
    """Every page as (flags, granule, serial, number, lacing, body). A bad mark, length or checksum is a ValueError."""
    out, at, n = [], 0, len(media)
    while at < n:
        if n - at < PAGE.size:
            raise ValueError(f"page header cut off at byte {at}")
        mark, version, flags, granule, serial, number, crc, segments = PAGE.unpack_from(media, at)
        body = at + PAGE.size + segments
        lacing = list(media[at + PAGE.size : body])
        end = body + sum(lacing)
        if mark != b"OggS" or version or len(lacing) < segments or end > n:
            raise ValueError(f"no whole page at byte {at}")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum at byte {at}")
        out.append((flags, granule, serial, number, lacing, media[body:end]))
        at = end
    return out


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Per serial number, in order of the first pages: (packet, granule position or -1 if its page ends later packets).

    A lost page (a gap in the numbers), a packet that continues nothing and one that never ends are ValueErrors.
    """
    streams: dict[int, list[tuple[bytes, int]]] = {}
    partial: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    for flags, granule, serial, number, lacing, body in parse(media):
        if bool(flags & FIRST) == (serial in streams) or number != numbers.get(serial, 0):
            raise ValueError(f"stream {serial}: page {number} out of place")
        numbers[serial] = number + 1
        done = streams.setdefault(serial, [])
        parts = partial.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(parts):
            raise ValueError(f"stream {serial}: page {number} continues nothing")
        at, size, ended = 0, 0, []
        for x in lacing:
            size += x
            if x < 255:
                ended.append(b"".join([*parts, body[at : at + size]]))
                parts.clear()
                at, size = at + size, 0
        if size or (lacing and lacing[-1] == 255):
            parts.append(body[at : at + size])
        done += [(packet, granule if i == len(ended) - 1 else -1) for i, packet in enumerate(ended)]
        if flags & LAST and parts:
            raise ValueError(f"stream {serial}: the last packet is cut off")
    if any(partial.values()):
        raise ValueError("a packet never ends")
    return streams


def store(raw: bytes, unit: int = UNIT, packet: int = PACKET) -> bytes:
    """Bytes as 8-bit samples: padded with spaces to a positive multiple of ``unit``, cut into packets that go
    in turn to two logical streams, each with an identification packet; granule positions count samples."""
    payload = raw + b" " * (-len(raw) % unit or (0 if raw else unit))
    seed = zlib.crc32(payload)
    cut = [(payload[i : i + packet], min(i + packet, len(payload))) for i in range(0, len(payload), packet)]
    out: list[list[bytes]] = []
    for k in (0, 1):
        head = b"QUERNPCM" + struct.pack("<BBIQ", 1, k, RATE, len(raw))
        out.append(pages((seed + k) & 0xFFFFFFFF, [(head, 0), *cut[k::2]]))
    first, rest = [p[0] for p in out], [p[1:] for p in out]
    mixed = [x for i in range(max(map(len, rest))) for p in rest for x in p[i : i + 1]]
    return b"".join(first + mixed)


def load(media: bytes) -> tuple[bytes, int, list[dict]]:
    """The payload, the unpadded length and per stream: serial, packets, samples and end in milliseconds.

    Granule positions must be those of the samples decoded, and the streams must say the same length.
    """
    streams = demultiplex(media)
    length, lengths, lanes, info = 0, set(), [], []
    for serial, packets in streams.items():
        mark, (_, lane, rate, length) = packets[0][0][:8], struct.unpack("<BBIQ", packets[0][0][8:22])
        if mark != b"QUERNPCM" or lane != len(lanes):
            raise ValueError("not a stream of samples")
        lengths.add(length)
        data = packets[1:]
        end = max((g for _, g in packets if g >= 0), default=0)
        lanes.append(data)
        info.append({"serial": serial, "packets": len(data), "samples": sum(len(p) for p, _ in data), "end_ms": end * 1000 // rate})
    parts, end = [], 0
    for part, granule in (x for i in range(max(map(len, lanes), default=0)) for lane in lanes for x in lane[i : i + 1]):
        parts.append(part)
        end += len(part)
        if granule not in (-1, end):
            raise ValueError(f"granule position {granule} after {end} samples")
    if len(lengths) != 1 or not 0 <= length <= end:
        raise ValueError("the streams disagree on the length")
    return b"".join(parts), length, info


def encode(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add ``media`` (binary): the whole text's UTF-8 bytes as an Ogg file. Null counts as empty text."""
    kept = [c for c in docs.columns if c != media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in slices(np.diff(text_bytes(whole.column(kept.index(text)))[1]), SLICE_BYTES, 1024):
                batch = whole.slice(low, high - low)
                out = [store((t or "").encode()) for t in batch.column(kept.index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, media])

    rows = docs.select(*named(kept))
    return rows.mapInArrow(run, with_fields(rows, **{media: "binary"}))


def features(payload: bytes, info: list[dict]) -> str:
    """Streams, packets, samples, end and, of the samples, peak, mean and mean square in fixed point."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    total, squares = int(samples.sum()), int((samples * samples).sum())
    return ";".join([f"streams={len(info)}", "packets=" + "+".join(str(x["packets"]) for x in info), f"samples={len(payload)}", f"end_ms={max(x['end_ms'] for x in info)}", f"peak={int(samples.max())}", f"mean_milli={total * 1000 // len(samples)}", f"square={squares // len(samples)}"])


def decode(media_rows: DataFrame, media: str = "media", keep_payload: bool = False) -> DataFrame:
    """Read each file back: n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the payload's last 16 bytes),
    media_bytes, media_sha256, feature, error and, if wanted, payload.

    ``media`` itself goes. A null or broken file has nulls and, if broken, its error; no row is lost.
    """
    new = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kept = [c for c in media_rows.columns if c not in (*new, "payload", media)]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 9
        own = (len(raw), hashlib.sha256(raw).hexdigest())
        try:
            payload, length, info = load(raw)
        except (ValueError, struct.error) as e:
            return (None, None, None, None, *own, None, str(e), None)
        return (length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, features(payload, info), None, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, high - low) for whole in batches for low, high in slices(pc.fill_null(pc.binary_length(whole.column(len(kept))), 0).to_numpy(), SLICE_BYTES)):
            columns = list(zip(*map(one, batch.column(len(kept)).to_pylist()), strict=True)) or [()] * 9
            out = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            if keep_payload:
                out.append(pa.array(columns[8], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *out], names=[*kept, *new, *["payload"] * keep_payload])

    rows = media_rows.select(*named(kept), media)
    fields = dict(zip(new, ("long", "long", "string", "long", "long", "string", "string", "string"), strict=True))
    return rows.mapInArrow(run, with_fields(media_rows.select(*named(kept)), **fields, **({"payload": "binary"} if keep_payload else {})))
