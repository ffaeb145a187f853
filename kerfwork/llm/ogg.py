"""Media columns: Ogg pages and logical streams.

Writing puts payload bytes (8-bit samples) in packets of ``PACKET`` samples, dealt in
turn to two logical streams whose pages are multiplexed. Reading verifies each page's
checksum, groups pages by serial number, checks their sequence, reassembles packets
from the lacing values (also across pages), and derives each packet's time from the
granule positions, by which the streams are merged again.

The Ogg checksum (polynomial 0x04C11DB7, most significant bit first, no inversion)
is zlib's crc32 of the bit-reversed bytes, bit-reversed, so it runs in C.

``with_media`` stores texts in a media column, ``read_media`` reads any media column.

Edge cases: null text counts as empty and its payload is 64 zero bytes; equal texts
have equal media. In ``read_media`` a damaged page, a gap in a stream or a packet
without its end costs that row its payload and gives it an error; null media have
neither. Empty media are no error and have an empty payload. Repeated rows are read
alike, and only the columns named are read or kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfwork.llm.common import map_texts

REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, BEGIN, END = 1, 2, 4
PACKET, RATE, STREAMS = 4096, 8000, 2
MAGIC = b"kerf-pcm"


class OggError(ValueError):
    pass


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes


@dataclass
class Packet:
    data: bytes
    granule: int | None  # position at its end, known after derivation


def checksum(data: bytes) -> int:
    crc = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(REVERSED), "little")


def page_bytes(page: Page) -> bytes:
    def head(crc: int) -> bytes:
        return HEAD.pack(b"OggS", 0, page.flags, page.granule, page.serial, page.sequence, crc, len(page.lacing)) + page.lacing

    return head(checksum(head(0) + page.body)) + page.body


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(serial: int, packets: list[bytes], samples: list[int]) -> list[Page]:
    """Pages of one logical stream; ``samples`` are those each packet holds. The
    first packet (the header) has a page of its own."""
    pages: list[Page] = []
    laces, body, done, granule, continued = bytearray(), bytearray(), 0, -1, False

    def flush(more: bool) -> None:
        nonlocal laces, body, granule, continued
        flags = CONTINUED * continued | BEGIN * (not pages)
        pages.append(Page(flags, granule, serial, len(pages), bytes(laces), bytes(body)))
        laces, body, granule, continued = bytearray(), bytearray(), -1, more

    for i, (packet, size) in enumerate(zip(packets, samples, strict=True)):
        at = 0
        for lace in lacing(len(packet)):
            if len(laces) == 255:
                flush(at > 0)
            laces.append(lace)
            body += packet[at : at + lace]
            at += lace
        done += size
        granule = done
        if i == 0:
            flush(False)
    if laces:
        flush(False)
    pages[-1].flags |= END
    return pages


def write(payload: bytes, packet: int = PACKET, rate: int = RATE, streams: int = STREAMS) -> bytes:
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    made = []
    for k in range(streams):
        own = parts[k::streams]
        header = MAGIC + struct.pack("<BBI", k, streams, rate)
        made.append(stream_pages(k + 1, [header, *own], [0, *map(len, own)]))
    out = []
    for turn in range(max(map(len, made))):
        out += [page_bytes(pages[turn]) for pages in made if turn < len(pages)]
    return b"".join(out)


def pages(media: bytes) -> list[Page]:
    found, at = [], 0
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise OggError("a page is cut short")
        magic, version, flags, granule, serial, sequence, crc, laces = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should begin")
        begin = at + HEAD.size + laces
        lacing_values = media[at + HEAD.size : begin]
        end = begin + sum(lacing_values)
        if len(lacing_values) < laces or end > len(media):
            raise OggError("a page is cut short")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum in page {sequence} of stream {serial}")
        found.append(Page(flags, granule, serial, sequence, lacing_values, media[begin:end]))
        at = end
    return found


def demultiplex(found: list[Page]) -> dict[int, list[Page]]:
    streams: dict[int, list[Page]] = {}
    for page in found:
        own = streams.setdefault(page.serial, [])
        if page.sequence != len(own) or bool(page.flags & BEGIN) != (not own):
            raise OggError(f"stream {page.serial} lacks a page")
        own.append(page)
    for serial, own in streams.items():
        if not own[-1].flags & END:
            raise OggError(f"stream {serial} has no end")
    return streams


def packets(own: list[Page], samples=len) -> list[Packet]:
    """The packets of a stream with the granule position at each one's end: a page
    states it for the last packet that ends there, the ones before lie back by the
    samples that follow them."""
    out: list[Packet] = []
    part = bytearray()
    open_ = False
    for page in own:
        if bool(page.flags & CONTINUED) != open_:
            raise OggError(f"a packet of stream {page.serial} has lost its other part")
        at, ended = 0, []
        for lace in page.lacing:
            part += page.body[at : at + lace]
            at += lace
            open_ = lace == 255
            if not open_:
                ended.append(Packet(bytes(part), None))
                part = bytearray()
        position = page.granule
        if bool(ended) != (position != -1):
            raise OggError(f"a granule position of stream {page.serial} is amiss")
        for packet in reversed(ended):
            packet.granule = position
            position -= samples(packet.data)
        out += ended
    if open_:
        raise OggError("the last packet has no end")
    return out


def read(media: bytes) -> tuple[bytes, dict]:
    """The payload and facts about the container."""
    found = pages(media)
    timed, rate = [], RATE
    streams = demultiplex(found)
    for own in streams.values():
        head, *rest = packets(own, lambda data: 0 if data.startswith(MAGIC) and len(data) == len(MAGIC) + 6 else len(data))
        if not head.data.startswith(MAGIC):
            raise OggError("an unknown codec")
        channel, _, rate = struct.unpack("<BBI", head.data[len(MAGIC) :])
        position = 0
        for packet in rest:
            timed.append((position, channel, packet.data))
            position += len(packet.data)
            if packet.granule != position:
                raise OggError("granule positions and packets disagree")
    timed.sort(key=lambda x: x[:2])
    end = max((begin + len(data) for begin, _, data in timed), default=0)
    return b"".join(data for _, _, data in timed), {"streams": len(streams), "pages": len(found), "packets": len(timed), "seconds": end / rate}


def padded(text: bytes, unit: int = 64) -> bytes:
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


def with_media(docs: DataFrame, keep: Sequence[str], media: str = "media") -> DataFrame:
    """``keep`` columns of ``docs``, the bytes of its text (n_bytes) and the Ogg file
    that holds them, padded."""

    def one(text: str | None) -> tuple[int, bytes]:
        raw = (text or "").encode()
        return len(raw), write(padded(raw))

    return map_texts(docs, list(keep), {"n_bytes": "long", media: "binary"}, lambda: lambda texts: list(map(list, zip(*map(one, texts), strict=True))))


FACTS = ("streams", "pages", "packets", "seconds")


def read_media(df: DataFrame, keep: Sequence[str], media: str = "media") -> DataFrame:
    """``keep`` columns of ``df``, and of its column ``media``: payload, streams, pages,
    packets, seconds, mean, peak and crossings of its samples, error."""

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 9
        try:
            payload, facts = read(data)
        except (OggError, struct.error, IndexError) as error:
            return (*(None,) * 8, str(error) or "damaged")
        samples = np.frombuffer(payload, np.uint8)
        shown = (float(samples.mean()), int(samples.max()), int(np.count_nonzero(np.diff(samples > 127)))) if len(samples) else (None,) * 3
        return (payload, *[facts[x] for x in FACTS], *shown, None)

    added = {"payload": "binary", "streams": "long", "pages": "long", "packets": "long", "seconds": "double", "mean": "double", "peak": "long", "crossings": "long", "error": "string"}
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media}`").alias("text"))
    return map_texts(rows, list(keep), added, lambda: lambda some: list(map(list, zip(*map(one, some), strict=True))))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = with_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    found = read_media(stored.select("*", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")), ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    named = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    feature = F.concat_ws(";", *map(named, FACTS), F.format_string("mean=%.4f", "mean"), named("peak"), named("crossings"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
