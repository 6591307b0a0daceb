"""Media columns: bytes stored as MPEG transport streams, and streams read back into elementary packets.

Writing: the payload is cut into access units, each in one elementary packet with a presentation time; every GROUP units a
random-access point starts, with a clock reference and the program tables before it. Reading takes any stream of 188-byte
packets: it parses the program tables, checks continuity counters, reassembles elementary packets, and gives time stamps
with random-access points.

Rules: a null text is an empty one (its payload is padding alone); rows are independent, so repeated rows give repeated
results; an empty table gives no rows; a stream that is not whole 188-byte packets in sync is an error of that value's, not a crash:
it gives no packets and counts in `faults`; a damaged elementary packet is given with what arrived of it, marked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, table, tune, written

UNIT = 576  # payload bytes of an access unit
GROUP = 8  # access units from one random-access point to the next
TICKS = 3600  # of the 90 kHz clock between units
# fixed values of the format
SIZE, SYNC, PAT_PID, PMT_PID, ES_PID, PRIVATE_STREAM, PRIVATE_TYPE, CRC_POLY = 188, 0x47, 0x0000, 0x1000, 0x0100, 0xBD, 0x06, 0x04C11DB7
PADDING_STREAM, BARE_STREAMS = 0xBE, {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}  # elementary packets without an optional header


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ CRC_POLY if c >> 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytearray:
    return bytearray(struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(SIZE, b"\xff")


PAT = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)))
PMT = _table_packet(PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000)))
PES_HEAD = 14
PER_UNIT = 4


def _template(random_access: bool) -> tuple[np.ndarray, np.ndarray]:
    """The PER_UNIT packets of one unit with zeros for what varies, and the places of the elementary packet's bytes."""
    out, at, left = np.zeros((PER_UNIT, SIZE), np.uint8), [], PES_HEAD + UNIT
    for k in range(PER_UNIT):
        adapt = 8 * (random_access and k == 0)
        room = SIZE - 4 - adapt
        if left < room:
            adapt += room - left
            room = left
        out[k, 0], out[k, 1], out[k, 2] = SYNC, (0x40 if k == 0 else 0) | ES_PID >> 8, ES_PID & 0xFF
        out[k, 3] = 0x30 if adapt else 0x10
        if adapt:
            out[k, 4] = adapt - 1
            if adapt > 1:
                out[k, 5], out[k, 6 : 4 + adapt] = 0x50 if random_access and k == 0 else 0, 0xFF
        at += range(k * SIZE + SIZE - room, (k + 1) * SIZE)
        left -= room
    return out.ravel(), np.array(at)


TEMPLATES = {r: _template(r) for r in (True, False)}


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data and bytes 255 up to a positive multiple of unit."""
    return data + b"\xff" * (-len(data) % unit if data else unit)


def mux(payload: bytes) -> bytes:
    """A transport stream of whole units of payload."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(units)
    k = np.arange(n)
    out = np.zeros((n, PER_UNIT * SIZE), np.uint8)
    pes = np.zeros((n, PES_HEAD + UNIT), np.uint8)
    pts = (k * TICKS) & (1 << 33) - 1
    pes[:, :9] = np.frombuffer(struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, PES_HEAD - 6 + UNIT, 0x84, 0x80, 5), np.uint8)
    pes[:, 9], pes[:, 10], pes[:, 11] = 0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 0xFF, (pts >> 15 & 0x7F) << 1 | 1
    pes[:, 12], pes[:, 13] = pts >> 7 & 0xFF, (pts & 0x7F) << 1 | 1
    pes[:, PES_HEAD:] = units
    for first, (packets, places) in TEMPLATES.items():
        rows = k[(k % GROUP == 0) == first]
        out[rows] = packets
        out[rows[:, None], places] = pes[rows]
    heads = np.arange(0, n, GROUP)
    for b, shift in zip(range(6, 10), (25, 17, 9, 1), strict=True):  # the clock reference: 33 bits, 6 reserved, 9 of extension
        out[heads, b] = pts[heads] >> shift & 0xFF
    out[heads, 10], out[heads, 11] = (pts[heads] & 1) << 7 | 0x7E, 0
    out.reshape(n, PER_UNIT, SIZE)[:, :, 3] |= (np.arange(n * PER_UNIT).reshape(n, PER_UNIT) & 15).astype(np.uint8)
    parts = []
    for g, a in enumerate(range(0, n, GROUP)):
        for tables in (PAT, PMT):
            packet = tables.copy()
            packet[3] |= g & 15
            parts.append(bytes(packet))
        parts.append(out[a : a + GROUP].tobytes())
    return b"".join(parts)


class Sections:
    """Table sections of one packet identifier, put together from its packets in turn; a section may span packets, and a packet hold several."""

    def __init__(self, table_id: int):
        self.table_id, self.held, self.found, self.faults, self.seen = table_id, None, [], 0, set()

    def _take(self) -> None:
        """Moves the whole sections at the head of what is held to found; 0xFF is padding."""
        while self.held and self.held[0] != 0xFF:
            if len(self.held) < 3 or len(self.held) < (size := 3 + ((self.held[1] & 15) << 8 | self.held[2])):
                return
            section, self.held = self.held[:size], self.held[size:]
            if size < 12 or section_crc(section):
                self.faults += 1
            elif section[0] == self.table_id and section[5] & 1:  # one that applies now
                self.found.append(section[8:-4])
        self.held = None

    def packet(self, data: bytes, begins: bool, lost: bool) -> None:
        if lost:
            self.drop()
        if begins and data:
            after = data[1 + data[0] :]
            if self.held is not None:
                self.held += data[1 : 1 + data[0]]
                self._take()
                self.drop()
            if after in self.seen:
                return
            self.held = after
            self._take()
            if self.held is None:
                self.seen.add(after)
        elif self.held is not None:
            self.held += data
            self._take()

    def drop(self) -> None:
        """Gives up an unfinished section."""
        self.faults += self.held is not None
        self.held = None


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes) -> tuple[list[dict], int]:
    """Elementary packets in stream order (pid, stream_type, pts, dts, random_access, damaged, payload), and the number of faults.

    A jump of a continuity counter is a fault, unless the packet announces it; packets marked as broken count as lost. An elementary packet
    that lost one of its packets, or whose declared length is not met, is given as damaged.
    """
    packets = np.frombuffer(media, np.uint8)
    if len(packets) % SIZE or (packets[::SIZE] != SYNC).any():
        return [], 1
    packets = packets.reshape(-1, SIZE)
    broken = (packets[:, 1] & 0x80) > 0
    faults = int(broken.sum())
    packets = packets[~broken] if faults else packets
    head = packets[:, :6].astype(np.int64)
    pid, begins = (head[:, 1] & 0x1F) << 8 | head[:, 2], (head[:, 1] & 0x40) > 0
    adapts, carries, counter = (head[:, 3] & 0x20) > 0, (head[:, 3] & 0x10) > 0, head[:, 3] & 15
    start = np.where(adapts, np.minimum(5 + head[:, 4], SIZE), 4)
    flags = np.where(adapts & (head[:, 4] > 0), head[:, 5], 0)
    point, announced = (flags & 0x40) > 0, (flags & 0x80) > 0

    def in_turn(p: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a packet identifier without packets sent twice, and before which of them others were lost."""
        rows = np.flatnonzero((pid == p) & carries)
        jump = np.append(1, (counter[rows][1:] - counter[rows][:-1]) & 15)[: len(rows)]
        keep = (jump != 0) | announced[rows]
        return rows[keep], (jump[keep] > 1) & ~announced[rows[keep]]

    def sections(p: int, table_id: int) -> Sections:
        out = Sections(table_id)
        rows, lost = in_turn(p)
        for k, gap in zip(rows.tolist(), lost.tolist(), strict=True):
            out.packet(packets[k, start[k] :].tobytes(), bool(begins[k]), gap)
        out.drop()
        return out

    programs = sections(PAT_PID, 0)
    faults += programs.faults
    maps = {p & 0x1FFF for body in programs.found for n, p in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]) if n}
    streams = {}
    for m in sorted(maps):
        program = sections(m, 2)
        faults += program.faults
        for body in program.found:
            at = 4 + ((body[2] & 15) << 8 | body[3]) if len(body) >= 4 else len(body)
            while at + 5 <= len(body):
                streams[(body[at + 1] & 0x1F) << 8 | body[at + 2]] = body[at]
                at += 5 + ((body[at + 3] & 15) << 8 | body[at + 4])
    found = []
    for p in np.unique(pid).tolist():
        rows, lost = in_turn(p)
        faults += int(lost.sum())
        if p not in streams or not len(rows):
            continue
        body = packets[rows][np.arange(SIZE) >= start[rows][:, None]].tobytes()
        size = SIZE - start[rows]
        at = np.cumsum(size) - size
        firsts = np.flatnonzero(begins[rows])
        ends = np.append(at[firsts[1:]], len(body))
        gaps = np.flatnonzero(lost)
        hit = set((np.searchsorted(firsts, gaps) - 1).tolist())  # what a gap before a packet cut short
        inside = set((np.searchsorted(firsts, gaps[~begins[rows[gaps]]]) - 1).tolist())
        for k, (row, a, b) in enumerate(zip(rows[firsts].tolist(), at[firsts].tolist(), ends.tolist(), strict=True)):
            pes = body[a:b]
            if pes[:3] != b"\0\0\1" or len(pes) < 6:
                faults += 1
                continue
            length, bare = pes[4] << 8 | pes[5], pes[3] in BARE_STREAMS
            if pes[3] == PADDING_STREAM:
                continue
            if not bare and len(pes) < 9:
                faults += 1
                continue
            stamps, more = (0, -3) if bare else (pes[7] >> 6, pes[8])
            short = bool(length) and len(pes) < 6 + length
            faults += int(short)
            damaged = short or k in inside or (k in hit and not length)
            data = pes[9 + more : 6 + length if length else None]
            found.append({"at": row, "pid": p, "stream_type": streams[p], "pts": _stamp(pes[9:14]) if stamps & 2 and more >= 5 and len(pes) >= 14 else None, "dts": _stamp(pes[14:19]) if stamps == 3 and more >= 10 and len(pes) >= 19 else None, "random_access": bool(point[row]), "damaged": damaged, "payload": data})
    return sorted(found, key=lambda x: x["at"]), faults


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a transport stream."""
    tune(docs.sparkSession)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [t.encode() for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n_bytes": [len(x) for x in raw], "media": [mux(padded(x)) for x in raw]})

    src = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInPandas(store, "doc_id long, n_bytes long, media binary")


def elementary_packets(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per elementary packet of each stream: number, pid, stream_type, pts, dts, random_access, damaged, payload."""
    tune(stored.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "number", "pid", "stream_type", "pts", "dts", "random_access", "damaged", "payload"]
        for pdf in batches:
            rows = [(d, k, x["pid"], x["stream_type"], x["pts"], x["dts"], x["random_access"], x["damaged"], x["payload"]) for d, m in zip(pdf.doc_id.astype("Int64"), pdf.media, strict=True) if m is not None for k, x in enumerate(demux(m)[0])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "pts": "Int64", "dts": "Int64"})

    src = picked(stored, doc_id=id_col, media=media_col)
    return src.mapInPandas(read, "doc_id long, number long, pid int, stream_type int, pts long, dts long, random_access boolean, damaged boolean, payload binary")


def features(packets: list[dict], faults: int) -> str:
    """Packets, faults, first and last time, span of the random-access points and the mean byte, as one string."""
    times = [x["pts"] for x in packets if x["pts"] is not None]
    points = [x["pts"] for x in packets if x["random_access"] and x["pts"] is not None]
    size = [len(x["payload"]) for x in packets]
    total = sum(int(np.frombuffer(x["payload"], np.uint8).sum()) for x in packets)
    kinds = ",".join(f"{p}:{t}" for p, t in sorted({(x["pid"], x["stream_type"]) for x in packets}))
    return f"streams={kinds};packets={len(packets)};faults={faults};pts={times[0] if times else ''}-{times[-1] if times else ''};points={','.join(map(str, points))};mean_byte={total / max(1, sum(size)):.4f}"


def summarise(stored: DataFrame) -> DataFrame:
    """Per stream, from its stored bytes: the payload's size and digests, the stream's own, and its features."""
    tune(stored.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, n, media in zip(pdf.doc_id.astype("Int64"), pdf.n_bytes, pdf.media, strict=True):
                packets, faults = demux(media)
                payload = b"".join([x["payload"] for x in packets])
                rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(packets, faults)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})

    return stored.mapInPandas(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media(spark, sf_dir: str) -> DataFrame:
    return summarise(written(store_text(table(spark, sf_dir, "documents")), "media"))
