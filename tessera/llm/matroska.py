"""Matroska media columns: a writer for 8-bit PCM and a reader that makes packet tables.

The reader walks variable-length EBML elements (unknown sizes of Segment and Cluster included),
SimpleBlocks and BlockGroups, all four kinds of lacing, and cues. Each packet has its track,
timestamp, key flag and byte range in the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table

# Fixed values of the Matroska format: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0x2AD7B1, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

#: Written files: 8000 samples a second, 512-byte frames, 8 frames a block, 16 blocks a cluster.
HZ, FRAME, LACED, BLOCKS = 8000, 512, 8, 16


# ---------------------------------------------------------------- writing


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the least width, or of the given one."""
    width = width or next(n for n in range(1, 9) if x < (1 << 7 * n) - 1)
    return (x | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + vint(len(body)) + body


def uint(kind: int, x: int) -> bytes:
    return element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def lace(sizes: list[int], how: int) -> bytes:
    """The lacing header: 1 Xiph, 2 fixed, 3 EBML."""
    head = bytes([len(sizes) - 1])
    if how == 1:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if how == 3:
        out = head + vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=False):
            width = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            out += vint(b - a + (1 << 7 * width - 1) - 1, width)
        return out
    return head


def block(track: int, at: int, frames: list[bytes], how: int, key: bool = True) -> bytes:
    flags = (0x80 if key else 0) | how << 1
    return vint(track) + struct.pack(">hB", at, flags) + (lace([len(f) for f in frames], how) if how else b"") + b"".join(frames)


def write_pcm(payload: bytes) -> bytes:
    """A Matroska file whose one track holds ``payload`` as 8-bit PCM samples."""
    ebml = uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2)
    info = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"tessera") + element(0x5741, b"tessera"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HZ)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 10**9 // HZ) + audio
    body = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, body)), b""
    span = FRAME * LACED
    for start in range(0, len(payload), span * BLOCKS):
        time = start * 1000 // HZ
        blocks = [uint(TIMESTAMP, time)]
        for b in range(start, min(start + span * BLOCKS, len(payload)), span):
            frames = [payload[i : i + FRAME] for i in range(b, min(b + span, len(payload)), FRAME)]
            how = 0 if len(frames) == 1 else 2 if len({*map(len, frames)}) == 1 else 3
            blocks.append(element(SIMPLE_BLOCK, block(1, b * 1000 // HZ - time, frames, how)))
        cues += element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at)))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    return element(EBML, ebml) + element(SEGMENT, b"".join(body) + element(CUES, cues))


# ---------------------------------------------------------------- reading


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next position); value -1 is an unknown size. ``keep`` leaves the marker, for ids."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    x = int.from_bytes(data[at : at + width], "big")
    if keep:
        return x, at + width
    x &= (1 << 7 * width) - 1
    return (-1 if x == (1 << 7 * width) - 1 else x), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the bodies between two positions.

    A Segment or Cluster of unknown size runs to the end or to the next element of its level.
    """
    while at < end:
        kind, p = read_vint(data, at, keep=True)
        size, p = read_vint(data, p)
        if size < 0:
            if kind == SEGMENT:
                to = end
            elif kind == CLUSTER:
                to = p
                while to < end:
                    inner, q = read_vint(data, to, keep=True)
                    if inner in TOP or inner in (EBML, SEGMENT):
                        break
                    length, q = read_vint(data, q)
                    if length < 0:
                        raise ValueError(f"unknown size inside a cluster at byte {to}")
                    to = q + length
            else:
                raise ValueError(f"unknown size of element {kind:X} at byte {at}")
        else:
            to = p + size
        if to > end:
            raise ValueError(f"element {kind:X} at byte {at} runs over its parent")
        yield kind, p, to
        at = to


def _unlace(data: bytes, p: int, end: int, how: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose lacing header starts at p."""
    if not how:
        return [(p, end)]
    if p >= end:
        raise ValueError(f"no lacing header at byte {p}")
    n, p = data[p] + 1, p + 1
    sizes: list[int] = []
    if how == 1:
        while len(sizes) < n - 1:
            s = 0
            while True:
                if p >= end:
                    raise ValueError(f"lacing cut off at byte {p}")
                s, p = s + data[p], p + 1
                if data[p - 1] < 255:
                    break
            sizes.append(s)
    elif how == 3:
        if n > 1:
            s, p = read_vint(data, p)
            sizes.append(s)
        while len(sizes) < n - 1:
            q = p
            d, p = read_vint(data, p)
            width = p - q
            d = (1 << 7 * width) - 1 if d < 0 else d
            sizes.append(sizes[-1] + d - ((1 << 7 * width - 1) - 1))
    elif (end - p) % n:
        raise ValueError(f"fixed lacing at byte {p} does not divide")
    else:
        sizes = [(end - p) // n] * (n - 1)
    sizes.append(end - p - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing at byte {p} runs over its block")
    out = []
    for s in sizes:
        out.append((p, p + s))
        p += s
    return out


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def read(data: bytes) -> dict:
    """Tracks, packets and cues of a file; ValueError says at which byte it is malformed.

    A packet is (cluster, track, timestamp in ns, key flag, start, end); laced frames follow each
    other by the track's default duration. A cue is (time in ns, track, byte of its cluster).
    """
    out: dict = {"tracks": {}, "packets": [], "cues": [], "clusters": []}
    seen = False
    for kind, a, b in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        seen, scale, base = True, 1_000_000, a
        for top, c, d in elements(data, a, b):
            if top == INFO:
                scale = next((_uint(data, x, y) for k, x, y in elements(data, c, d) if k == SCALE), scale)
            elif top == TRACKS:
                for k, x, y in elements(data, c, d):
                    if k == TRACK_ENTRY:
                        own = {i: (u, v) for i, u, v in elements(data, x, y)}
                        num = _uint(data, *own[TRACK_NUMBER]) if TRACK_NUMBER in own else 0
                        out["tracks"][num] = {
                            "type": _uint(data, *own[TRACK_TYPE]) if TRACK_TYPE in own else 0,
                            "codec": data[slice(*own[CODEC])].decode("ascii", "replace") if CODEC in own else "",
                            "step": _uint(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0,
                        }
            elif top == CLUSTER:
                _cluster(data, c, d, scale, out)
            elif top == CUES:
                for k, x, y in elements(data, c, d):
                    if k == CUE_POINT:
                        time, places = 0, []
                        for i, u, v in elements(data, x, y):
                            if i == CUE_TIME:
                                time = _uint(data, u, v)
                            elif i == CUE_POSITIONS:
                                own = {i: (u, v) for i, u, v in elements(data, u, v)}
                                places.append((_uint(data, *own.get(CUE_TRACK, (0, 0))), base + _uint(data, *own.get(CUE_CLUSTER, (0, 0)))))
                        out["cues"] += [(time * scale, *p) for p in places]
    if not seen:
        raise ValueError("no segment")
    return out


def _cluster(data: bytes, a: int, b: int, scale: int, out: dict) -> None:
    time, number = 0, len(out["clusters"])
    out["clusters"].append((a, b))

    def add(p: int, end: int, key: bool | None, duration: int) -> None:
        track, p = read_vint(data, p)
        if p + 3 > end:
            raise ValueError(f"block cut off at byte {p}")
        rel, flags = struct.unpack_from(">hB", data, p)
        frames = _unlace(data, p + 3, end, flags >> 1 & 3)
        step = duration * scale // len(frames) if duration else out["tracks"].get(track, {}).get("step", 0)
        for i, (x, y) in enumerate(frames):
            out["packets"].append((number, track, (time + rel) * scale + i * step, bool(flags & 0x80) if key is None else key, x, y))

    for kind, p, q in elements(data, a, b):
        if kind == TIMESTAMP:
            time = _uint(data, p, q)
        elif kind == SIMPLE_BLOCK:
            add(p, q, None, 0)
        elif kind == BLOCK_GROUP:
            own = {i: (u, v) for i, u, v in elements(data, p, q)}
            if BLOCK in own:
                add(*own[BLOCK], REFERENCE not in own, _uint(data, *own.get(BLOCK_DURATION, (0, 0))))


def track_bytes(data: bytes, parsed: dict, track: int = 1) -> bytes:
    return b"".join(data[p[4] : p[5]] for p in parsed["packets"] if p[1] == track)


# ---------------------------------------------------------------- DataFrame operators


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text padded with zeros to a positive multiple of 64, and its length before."""
    body = (text or "").encode()
    return body + bytes(max(64, -(-len(body) // 64) * 64) - len(body)), len(body)


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text (null: empty) as a Matroska file. Row by row, no shuffle.

    Extra columns are ignored; repeated rows and null ids pass as they are, equal texts give equal files;
    an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for part, texts in steps(batch, "text"):
                both = [payload_of(t) for t in texts.to_pylist()]
                media = pa.array([write_pcm(p) for p, _ in both], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in both], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of each ``media`` (doc_id, media); a null or malformed file gives
    one row with ``error`` and no packet. The packets of one file are streamed in bounded batches.
    """
    schema = "doc_id long, packet long, cluster long, track long, timestamp_ns long, key boolean, start long, end long, error string"
    names = ["doc_id", "packet", "cluster", "track", "timestamp_ns", "key", "start", "end", "error"]

    def run(batches):
        for batch in batches:
            for i, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("no file")
                    rows = [(i, n, c, t, at, key, a, b, None) for n, (c, t, at, key, a, b) in enumerate(read(data)["packets"])]
                except (ValueError, struct.error) as e:
                    rows = [(i, None, None, None, None, None, None, None, str(e))]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 10_000]], schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("packet", pa.int64()), ("cluster", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("key", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("error", pa.string())])
    return media.select("doc_id", "media").mapInArrow(run, schema)


def features(data: bytes) -> tuple[bytes, str]:
    """Samples of track 1 read back from a file, and their summary."""
    parsed = read(data)
    pcm = track_bytes(data, parsed)
    counts = np.bincount(np.frombuffer(pcm, np.uint8), minlength=256)
    share = counts[counts > 0] / len(pcm) if pcm else np.ones(1)
    entropy = -float((share * np.log2(share)).sum()) + 0.0
    mean = float((counts * np.arange(256)).sum()) / max(1, len(pcm))
    last = max((p[2] for p in parsed["packets"]), default=0) // 1_000_000
    starts, mark = {a for a, _ in parsed["clusters"]}, _id(CLUSTER)
    good = sum(data[c : c + 4] == mark and any(c + 4 + w in starts for w in range(1, 9)) for _, _, c in parsed["cues"])
    return pcm, f"packets={len(parsed['packets'])};clusters={len(parsed['clusters'])};cues={len(parsed['cues'])};cued={good};last_ms={last};mean={mean:.4f};entropy={entropy:.4f}"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of each stored file (doc_id, n_bytes, media), from its bytes alone.

    A null file has nulls in all columns made here but ``feature``, a malformed one only its own size and
    digest; ``feature`` says ``error=`` and what is wrong then. Null ids and repeated rows pass as they
    are, extra columns are ignored, an empty table gives an empty result.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                try:
                    if data is None:
                        raise ValueError("no file")
                    pcm, feature = features(data)
                    rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), *stored, feature))
                except (ValueError, struct.error) as e:
                    rows.append((None, None, None, *stored, f"error={e}"))
            own = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, k) for v, k in zip(own, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(table(spark, sf_dir, "documents")))
