"""Matroska: a writer and a reader of variable-length EBML elements, clusters, lacing and cues.

``mux`` stores bytes as 8-bit PCM samples of one audio track; ``Reader`` turns any Matroska
bytes into a packet table (track, timestamp, byte range, cluster, block, lace) and a cue table.
Both known and unknown element sizes and all four kinds of lacing are read.  Damaged input
raises ``MatroskaError`` in the reader; the DataFrame operators give such rows their packets
up to the damage and the message in ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import documents, texts_of

# Element ids of the Matroska specification (fixed values).
EBML, DOCTYPE, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367))

RATE = 8000  # samples a second, so eight bytes a millisecond
FRAME, LACES, BLOCKS = 512, 8, 16  # bytes in a frame, frames in a block, blocks in a cluster


class MatroskaError(ValueError):
    pass


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    size: int
    cluster: int
    block: int
    lace: int
    keyframe: bool


class Cue(NamedTuple):
    time: int
    track: int
    position: int  # from the first byte inside the segment


# ---------------------------------------------------------------- writing

def vint(n: int, width: int = 0) -> bytes:
    """A size; all ones is kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def element(ident: int, data: bytes) -> bytes:
    return _id(ident) + vint(len(data)) + data


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes]) -> bytes:
    """A block's bytes: unlaced for one frame, fixed-size lacing for equal ones, EBML lacing otherwise."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, head = 0x80, b""
    elif len(set(sizes)) == 1:
        flags, head = 0x80 | 0x04, bytes([len(frames) - 1])
    else:
        flags, head = 0x80 | 0x06, bytes([len(frames) - 1]) + vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += (d + (1 << 7 * w - 1) - 1 | 1 << 7 * w).to_bytes(w, "big")
    return vint(track) + struct.pack(">hB", relative, flags) + head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """Payload bytes as the samples of one 8-bit mono track."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOCTYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"strata") + element(WRITING_APP, b"strata"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    step = FRAME * LACES * BLOCKS
    for a in range(0, len(payload), step):
        start = a * 1000 // RATE
        data = [uint(TIMESTAMP, start)]
        for b in range(a, min(a + step, len(payload)), FRAME * LACES):
            frames = [payload[c : c + FRAME] for c in range(b, min(b + FRAME * LACES, len(payload)), FRAME)]
            data.append(element(SIMPLE_BLOCK, block(1, b * 1000 // RATE - start, frames)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(data)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


# ---------------------------------------------------------------- reading

class Reader:
    def __init__(self, data: bytes):
        self.data = data
        self.packets: list[Packet] = []
        self.cues: list[Cue] = []
        self.clusters: list[tuple[int, int]] = []  # offset within the segment, timestamp
        self.tracks: dict[int, dict] = {}
        self.scale, self.duration, self.error = 1_000_000, 0.0, ""
        self._blocks = 0

    def vint(self, at: int, stop: int) -> tuple[int, int, bool]:
        """Value, next position and whether all value bits are ones."""
        if at >= stop:
            raise MatroskaError(f"number missing at {at}")
        first = self.data[at]
        width = 9 - first.bit_length()
        if width > 8 or at + width > stop:
            raise MatroskaError(f"number cut short at {at}")
        value = int.from_bytes(self.data[at : at + width], "big") ^ 1 << 7 * width
        return value, at + width, value == (1 << 7 * width) - 1

    def head(self, at: int, stop: int) -> tuple[int, int, int, bool]:
        """Id, start of data, end of data, whether the end is only known from what follows."""
        if at >= stop:
            raise MatroskaError(f"element missing at {at}")
        width = 9 - self.data[at].bit_length()
        if width > 4 or at + width > stop:
            raise MatroskaError(f"bad element id at {at}")
        ident = int.from_bytes(self.data[at : at + width], "big")
        size, start, unknown = self.vint(at + width, stop)
        if unknown:
            return ident, start, stop, True
        if start + size > stop:
            raise MatroskaError(f"element {ident:X} at {at} runs past its parent")
        return ident, start, start + size, False

    def children(self, start: int, stop: int, open_ended: bool = False):
        at = start
        while at < stop:
            ident, a, b, unknown = self.head(at, stop)
            if open_ended and ident in TOP_LEVEL:
                return
            yield ident, a, b, unknown, at
            at = self._end if unknown else b
        self._end = at

    def number(self, a: int, b: int) -> int:
        return int.from_bytes(self.data[a:b], "big")

    def real(self, a: int, b: int) -> float:
        return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", self.data[a:b])[0]

    def read(self) -> Reader:
        at, n = 0, len(self.data)
        while at < n:
            ident, a, b, unknown = self.head(at, n)
            if ident == EBML:
                for i, x, y, _, _ in self.children(a, b):
                    if i == DOCTYPE and self.data[x:y].rstrip(b"\0") not in (b"matroska", b"webm"):
                        raise MatroskaError("another document type")
            elif ident == SEGMENT:
                self._segment(a, b)
            at = b
        return self

    def _segment(self, start: int, stop: int) -> None:
        at = start
        while at < stop:
            ident, a, b, unknown = self.head(at, stop)
            if unknown and ident != CLUSTER:
                raise MatroskaError(f"element {ident:X} needs a size")
            if ident == INFO:
                for i, x, y, _, _ in self.children(a, b):
                    if i == TIMESTAMP_SCALE:
                        self.scale = self.number(x, y)
                    elif i == DURATION:
                        self.duration = self.real(x, y)
            elif ident == TRACKS:
                for i, x, y, _, _ in self.children(a, b):
                    if i == TRACK_ENTRY:
                        self._track(x, y)
            elif ident == CLUSTER:
                b = self._cluster(a, b, unknown, at - start)
            elif ident == CUES:
                self._cues(a, b)
            at = b

    def _track(self, a: int, b: int) -> None:
        t = {"codec": "", "type": 0, "rate": 8000.0, "channels": 1, "bits": 0}
        for i, x, y, _, _ in self.children(a, b):
            if i == TRACK_NUMBER:
                self.tracks[self.number(x, y)] = t
            elif i == TRACK_TYPE:
                t["type"] = self.number(x, y)
            elif i == CODEC_ID:
                t["codec"] = self.data[x:y].decode("ascii", "replace")
            elif i == AUDIO:
                for j, p, q, _, _ in self.children(x, y):
                    if j == SAMPLING:
                        t["rate"] = self.real(p, q)
                    elif j in (CHANNELS, BIT_DEPTH):
                        t["channels" if j == CHANNELS else "bits"] = self.number(p, q)

    def _cluster(self, a: int, b: int, unknown: bool, position: int) -> int:
        time, at = 0, a
        self.clusters.append((position, 0))
        while at < b:
            ident, x, y, _ = self.head(at, b)
            if unknown and ident in TOP_LEVEL:
                return at
            if ident == TIMESTAMP:
                time = self.number(x, y)
                self.clusters[-1] = (position, time)
            elif ident == SIMPLE_BLOCK:
                self._block(x, y, time, None)
            elif ident == BLOCK_GROUP:
                parts = list(self.children(x, y))
                key = all(i != 0xFB for i, *_ in parts)  # a reference to another block
                for i, p, q, _, _ in parts:
                    if i == BLOCK:
                        self._block(p, q, time, key)
            at = y
        return b

    def _block(self, a: int, b: int, time: int, key: bool | None) -> None:
        track, at, _ = self.vint(a, b)
        if at + 3 > b:
            raise MatroskaError(f"block cut short at {a}")
        relative, flags = struct.unpack_from(">hB", self.data, at)
        at += 3
        lacing = flags >> 1 & 3
        if not lacing:
            sizes = [b - at]
        else:
            if at >= b:
                raise MatroskaError(f"lacing cut short at {a}")
            count = self.data[at] + 1
            at += 1
            if lacing == 2:
                if (b - at) % count:
                    raise MatroskaError(f"uneven fixed lacing at {a}")
                sizes = [(b - at) // count] * count
            else:
                sizes = []
                for k in range(count - 1):
                    if lacing == 1:
                        size = 0
                        while True:
                            if at >= b:
                                raise MatroskaError(f"lacing cut short at {a}")
                            byte = self.data[at]
                            at += 1
                            size += byte
                            if byte < 255:
                                break
                    else:
                        before = at
                        value, at, _ = self.vint(at, b)
                        size = value if k == 0 else sizes[-1] + value - (1 << 7 * (at - before) - 1) + 1
                    sizes.append(size)
                sizes.append(b - at - sum(sizes))
            if min(sizes) < 0:
                raise MatroskaError(f"lace sizes exceed the block at {a}")
        info = self.tracks.get(track)
        width = max(1, info["channels"] * info["bits"] // 8) if info and info["codec"].startswith("A_PCM") else 0
        done = 0
        for k, size in enumerate(sizes):
            late = round(done / width / info["rate"] * 1e9 / self.scale) if width and info["rate"] else 0
            self.packets.append(Packet(track, time + relative + late, at, size, len(self.clusters) - 1, self._blocks, k, bool(flags & 0x80) if key is None else key))
            at += size
            done += size
        self._blocks += 1

    def _cues(self, a: int, b: int) -> None:
        for i, x, y, _, _ in self.children(a, b):
            if i != CUE_POINT:
                continue
            time, where = 0, []
            for j, p, q, _, _ in self.children(x, y):
                if j == CUE_TIME:
                    time = self.number(p, q)
                elif j == CUE_POSITIONS:
                    found = {k: self.number(r, s) for k, r, s, _, _ in self.children(p, q)}
                    where.append((found.get(CUE_TRACK, 0), found.get(CUE_CLUSTER, 0)))
            self.cues += [Cue(time, t, c) for t, c in where]

    def samples(self, track: int = 1) -> bytes:
        return b"".join([self.data[p.offset : p.offset + p.size] for p in self.packets if p.track == track])

    def feature(self) -> str:
        """Counts and sizes read from the stored form, and whether every cue points at a cluster of its time."""
        at = dict(self.clusters)
        sizes = [p.size for p in self.packets]
        good = sum(at.get(c.position) == c.time for c in self.cues)
        last = self.packets[-1].timestamp if self.packets else 0
        return f"tracks={len(self.tracks)};clusters={len(self.clusters)};blocks={self._blocks};packets={len(sizes)};cues={good}/{len(self.cues)};largest={max(sizes, default=0)};last_ms={last};duration_ms={self.duration:.0f}"


def read(data: bytes) -> Reader:
    return Reader(data).read()


def pad(text: bytes, to: int = 64) -> bytes:
    """The text and bytes 0 up to a positive multiple of ``to``."""
    return text + bytes(max(to, -(-len(text) // to) * to) - len(text))


# ---------------------------------------------------------------- DataFrame operators

def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media binary``: each text, padded, as a Matroska file."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([mux(pad(t)) for t in texts_of(batch)], pa.binary())], ["doc_id", "media"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


PACKETS = "doc_id long, track int, timestamp long, offset long, size long, cluster int, block int, lace int, keyframe boolean, error string"


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: a row for each frame of each media value.

    A null or empty value has no packets; a damaged one has those before the damage and then a row with only ``error``.
    """

    def run(it):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("track", pa.int32()), ("timestamp", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("cluster", pa.int32()), ("block", pa.int32()), ("lace", pa.int32()), ("keyframe", pa.bool_()), ("error", pa.string())])
        for batch in it:
            rows = []
            for key, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "media"), strict=True):
                r, error = Reader(data), None
                try:
                    r.read()
                except MatroskaError as e:
                    error = str(e)
                rows += [(key, *p, None) for p in r.packets]
                if error:
                    rows.append((key, *[None] * 8, error))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{media_col}` media").mapInArrow(run, PACKETS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back through the packet table, and digests both."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            rows = []
            for t in texts_of(batch):
                media = mux(pad(t))
                r = read(media)
                back = r.samples()
                rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), r.feature()))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in DIGEST.split(", ")])

    return documents(df, id_col, text_col).mapInArrow(run, DIGEST)
