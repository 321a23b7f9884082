"""Media columns: Matroska bytes to packet tables, and payloads to Matroska bytes.

The reader walks EBML elements (identifiers and sizes are variable-length integers, sizes may be unknown), clusters,
simple blocks and block groups with every kind of lacing, and the cue index. Each packet keeps its byte range, so
its data can be cut from the stored bytes without copying the rest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_of

# Fixed values of the format (EBML and Matroska element identifiers).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLE_RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")

#: How mux() lays a payload out: samples of 8 bits, frames of so many, so many frames a block and blocks a cluster, dealt to two tracks by block.
RATE, FRAME, PER_BLOCK, PER_CLUSTER, DEALT = 8000, 1024, 8, 16, 2


@dataclass
class Media:
    """What parse() finds. packets: (track, timestamp in ticks, key frame, lacing, frame in its block, offset, size, cluster). cues: (time, track, cluster position)."""

    scale: int = 1_000_000
    duration: float = 0.0
    doc_type: str = ""
    tracks: dict = field(default_factory=dict)
    clusters: list = field(default_factory=list)
    packets: list = field(default_factory=list)
    cues: list = field(default_factory=list)
    segment: int = 0
    error: str = ""


def vint(data, at: int, mark: bool) -> tuple[int, int]:
    """(value, next position) of a variable-length integer; mark: keep the length marker, as identifiers do. An unknown size is -1."""
    first = data[at]
    if not first:
        raise ValueError("no vint")
    n = 9 - first.bit_length()
    raw = data[at : at + n]
    if len(raw) < n:
        raise ValueError("cut vint")
    value = int.from_bytes(raw, "big")
    if not mark:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            value = -1
    return value, at + n


def _signed(data, at: int) -> tuple[int, int]:
    """A signed variable-length difference of EBML lacing."""
    n = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return value - ((1 << (7 * n - 1)) - 1), at + n


def _children(data, at: int, end: int):
    """(identifier, data position, data end) of the elements in a range; an unknown size reaches to the range's end."""
    while at < end:
        ident, p = vint(data, at, True)
        size, p = vint(data, p, False)
        stop = end if size < 0 else p + size
        if stop > end:
            raise ValueError("cut element")
        yield ident, p, stop
        at = stop


def _uint(data, p: int, stop: int) -> int:
    return int.from_bytes(data[p:stop], "big")


def _float(data, p: int, stop: int) -> float:
    return struct.unpack(">f" if stop - p == 4 else ">d", data[p:stop])[0] if stop - p in (4, 8) else 0.0


def block_frames(data, p: int, stop: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, lacing, [(offset, size) of each frame]) of a block's data."""
    track, p = vint(data, p, False)
    if p + 3 > stop:
        raise ValueError("cut block")
    relative, flags = int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
    p += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, 0, [(p, stop - p)]
    n = data[p] + 1
    p += 1
    sizes = []
    if lacing == 2:
        if (stop - p) % n:
            raise ValueError("uneven fixed lacing")
        sizes = [(stop - p) // n] * n
    else:
        for k in range(n - 1):
            if lacing == 1:
                size = 0
                while data[p] == 255:
                    size, p = size + 255, p + 1
                size, p = size + data[p], p + 1
            elif k == 0:
                size, p = vint(data, p, False)
            else:
                step, p = _signed(data, p)
                size = sizes[-1] + step
            sizes.append(size)
        sizes.append(stop - p - sum(sizes))
    if min(sizes) < 0 or p + sum(sizes) > stop:
        raise ValueError("bad lace")
    out = []
    for size in sizes:
        out.append((p, size))
        p += size
    return track, relative, flags, lacing, out


#: A cluster of unknown size ends where one of these begins.
_TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}


def parse(data: bytes) -> Media:
    """The packets, tracks and cues of Matroska bytes. Damaged or empty input gives what precedes the damage, and error says why."""
    m = Media()
    try:
        at, end = 0, len(data)
        while at < end:
            ident, p = vint(data, at, True)
            size, p = vint(data, p, False)
            stop = end if size < 0 else min(p + size, end)
            if ident == EBML:
                for k, a, b in _children(data, p, stop):
                    if k == DOC_TYPE:
                        m.doc_type = data[a:b].decode("ascii", "replace")
            elif ident == SEGMENT:
                m.segment = p
                _segment(data, p, stop, m)
            at = stop
        if not m.doc_type:
            m.error = "no EBML header"
    except (ValueError, IndexError) as e:
        m.error = str(e) or "cut short"
    return m


def _segment(data, at: int, end: int, m: Media) -> None:
    while at < end:
        start = at
        ident, p = vint(data, at, True)
        size, p = vint(data, p, False)
        stop = end if size < 0 else p + size
        if ident == INFO:
            for k, a, b in _children(data, p, stop):
                if k == TIMESTAMP_SCALE:
                    m.scale = _uint(data, a, b)
                elif k == DURATION:
                    m.duration = _float(data, a, b)
        elif ident == TRACKS:
            for k, a, b in _children(data, p, stop):
                if k == TRACK_ENTRY:
                    found = {x: (c, d) for x, c, d in _children(data, a, b)}
                    get = lambda x, f, default, found=found: f(data, *found[x]) if x in found else default
                    m.tracks[get(TRACK_NUMBER, _uint, 0)] = {"type": get(TRACK_TYPE, _uint, 0), "codec": get(CODEC_ID, lambda d, a, b: d[a:b].decode("ascii", "replace"), ""), "default_ns": get(DEFAULT_DURATION, _uint, 0)}
        elif ident == CLUSTER:
            stop = _cluster(data, start, p, stop, size < 0, m)
        elif ident == CUES:
            for k, a, b in _children(data, p, stop):
                if k == CUE_POINT:
                    time, places = 0, []
                    for x, c, d in _children(data, a, b):
                        if x == CUE_TIME:
                            time = _uint(data, c, d)
                        elif x == CUE_POSITIONS:
                            place = {y: _uint(data, e, f) for y, e, f in _children(data, c, d)}
                            places.append((place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER, 0)))
                    m.cues += [(time, track, position) for track, position in places]
        if stop > end:
            raise ValueError("cut element")
        at = stop


def _cluster(data, start: int, at: int, stop: int, unknown: bool, m: Media) -> int:
    base, number = 0, len(m.clusters)
    m.clusters.append(start)
    while at < stop:
        ident, p = vint(data, at, True)
        if unknown and ident in _TOP:
            return at
        size, p = vint(data, p, False)
        end = p + size
        if size < 0 or end > stop:
            raise ValueError("cut element")
        if ident == CLUSTER_TIMESTAMP:
            base = _uint(data, p, end)
        elif ident == SIMPLE_BLOCK:
            _packets(data, p, end, base, number, None, m)
        elif ident == BLOCK_GROUP:
            parts = {k: (a, b) for k, a, b in _children(data, p, end)}
            if BLOCK in parts:
                _packets(data, *parts[BLOCK], base, number, REFERENCE_BLOCK not in parts, m)
        at = end
    return at


def _packets(data, p: int, end: int, base: int, cluster: int, key: bool | None, m: Media) -> None:
    track, relative, flags, lacing, frames = block_frames(data, p, end)
    step = m.tracks.get(track, {}).get("default_ns", 0) / max(1, m.scale)
    key = bool(flags & 0x80) if key is None else key
    m.packets += [(track, base + relative + round(k * step), key, lacing, k, offset, size, cluster) for k, (offset, size) in enumerate(frames)]


def _number(x: int, n: int = 0) -> bytes:
    return x.to_bytes(n or max(1, (x.bit_length() + 7) // 8), "big")


def _size(x: int) -> bytes:
    n = 1
    while x >= (1 << 7 * n) - 1:
        n += 1
    return (x | 1 << 7 * n).to_bytes(n, "big")


def _element(ident: int, data: bytes) -> bytes:
    return b"".join((_number(ident), _size(len(data)), data))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The lace header and data of frames: 1 Xiph, 2 fixed (equal sizes), 3 EBML."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if lacing == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes)
    elif lacing == 3:
        for k, s in enumerate(sizes):
            if k == 0:
                head += _size(s)
                continue
            step, n = s - sizes[k - 1], 1
            while not -((1 << (7 * n - 1)) - 1) <= step <= (1 << (7 * n - 1)) - 1:
                n += 1
            head += (step + (1 << (7 * n - 1)) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


_HEAD = _element(EBML, b"".join(_element(k, v) for k, v in ((0x4286, b"\x01"), (0x42F7, b"\x01"), (0x42F2, b"\x04"), (0x42F3, b"\x08"), (DOC_TYPE, b"matroska"), (0x4287, b"\x04"), (0x4285, b"\x02"))))
_TRACKS = _element(TRACKS, b"".join(_element(TRACK_ENTRY, b"".join((_element(TRACK_NUMBER, _number(t)), _element(TRACK_UID, _number(t)), _element(TRACK_TYPE, b"\x02"), _element(CODEC_ID, b"A_PCM/INT/LIT"), _element(DEFAULT_DURATION, _number(FRAME * 1_000_000_000 // RATE)), _element(AUDIO, _element(SAMPLE_RATE, struct.pack(">d", RATE)) + _element(CHANNELS, b"\x01") + _element(BIT_DEPTH, b"\x08"))))) for t in range(1, DEALT + 1)))


def mux(payload: bytes) -> bytes:
    """Matroska bytes whose frames, in order of time, are the payload as 8-bit samples. The kinds of lacing take turns."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    info = _element(INFO, _element(TIMESTAMP_SCALE, _number(1_000_000)) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    body, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    ticks = FRAME * 1000 // RATE
    blocks = [frames[k : k + PER_BLOCK] for k in range(0, len(frames), PER_BLOCK)]
    for first in range(0, len(blocks), PER_CLUSTER):
        time = first * PER_BLOCK * ticks
        inner = [_element(CLUSTER_TIMESTAMP, _number(time))]
        for k, block in enumerate(blocks[first : first + PER_CLUSTER], first):
            lacing = (1, 2, 3)[k % 3] if len(block) > 1 else 0
            if lacing == 2 and len(block[-1]) != FRAME:
                lacing = 3
            data = lace(block, lacing) if lacing else block[0]
            inner.append(_element(SIMPLE_BLOCK, b"".join((_size(1 + k % DEALT), ((k - first) * PER_BLOCK * ticks).to_bytes(2, "big"), bytes([0x80 | lacing << 1]), data))))
        cluster = _element(CLUSTER, b"".join(inner))
        cues.append(_element(CUE_POINT, _element(CUE_TIME, _number(time)) + _element(CUE_POSITIONS, _element(CUE_TRACK, _number(1 + first % DEALT)) + _element(CUE_CLUSTER, _number(at)))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(body))


def payload_of(data: bytes, m: Media) -> bytes:
    """The frames' data joined in order of time (blocks of one time stay in file order)."""
    return b"".join(data[p[5] : p[5] + p[6]] for p in sorted(m.packets, key=lambda p: p[1]))


def feature(m: Media) -> str:
    """Counts of a file's parts, in one line."""
    laces = Counter(LACINGS[p[3]] for p in m.packets)
    sound = sum(position + m.segment in m.clusters for _, _, position in m.cues)
    return f"tracks={len(m.tracks)};clusters={len(m.clusters)};packets={len(m.packets)};keys={sum(p[2] for p in m.packets)};bytes={sum(p[6] for p in m.packets)};largest={max((p[6] for p in m.packets), default=0)};{';'.join(f'{k}={laces[k]}' for k in LACINGS)};cues={len(m.cues)};cues_sound={sound};last_ms={max((p[1] for p in m.packets), default=0) * m.scale // 1_000_000};duration_ms={m.duration * m.scale / 1e6:.0f};error={m.error}"


PACKET_SCHEMA = "packet int, track int, timestamp_ns long, keyframe boolean, lacing string, lace_index int, cluster int, offset long, size long, error string"


def packet_table(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """A row per packet of each media value: id, number in the file, track, timestamp, key frame, lacing, cluster and byte range.

    A null or empty value, and one without packets, gives one row whose packet is null and whose error says why.
    Repeated rows give repeated packets. Values are read one at a time, so memory holds one batch and one file.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = parse(data or b"")
                rows += [(i, n, p[0], p[1] * m.scale, p[2], LACINGS[p[3]], p[4], p[7], p[5], p[6], m.error) for n, p in enumerate(m.packets)] or [(i, *[None] * 9, m.error or "no packets")]
            yield _batch(rows, batch.schema.field(0).type)

    types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in PACKET_SCHEMA.split(", ")]

    def _batch(rows, id_type):
        cols = list(zip(*rows, strict=True)) or [[] for _ in range(11)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, *types], strict=True)], [id_col, *names])

    return df.select(id_col, F.col(media_col).cast("binary").alias("_media")).mapInArrow(run, f"`{id_col}` {kind}, {PACKET_SCHEMA}")


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def mux_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text's UTF-8 bytes, padded, stored as Matroska. A null text is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mux(pad(x.encode())) for x in texts_of(batch.column(1))], pa.binary())], [id_col, "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as Matroska and read back: digests of the stored bytes and of the payload cut from its packets, and a feature line. A row per row of docs, repeated ones too; a null text is empty, equal texts have equal values, a text is one file however long, an empty table gives an empty result, and further columns are ignored, whatever their names."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(text: str):
        raw = text.encode()
        media = mux(pad(raw))
        m = parse(media)
        back = payload_of(media, m)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(m)

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(one, texts_of(batch.column(1))), strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a media file, and what is read back of it."""
    return digests(table(spark, sf_dir, "documents"))
