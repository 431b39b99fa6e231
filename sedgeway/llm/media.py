"""Media columns: texts stored as ISO base media files, and read back by their boxes and sample tables.

``store_media`` writes each text's bytes losslessly as the samples of one 8-bit track: the UTF-8 bytes,
padded with 0x20 to a positive multiple of ``FRAME`` bytes, in a file of the boxes ftyp, moov (mvhd,
trak/tkhd, mdia/mdhd+hdlr, minf/dinf, stbl/stsd+stts+stss+stsz+stsc+stco) and mdat. ``read_media`` walks
the nested boxes of any such file, decodes the sample tables and returns codec, duration and the byte
ranges of key frames; the payload bytes are located, not decoded.

Defined cases: a null text is the empty text, whose payload is one frame of spaces. Texts of any length
are stored whole (64-bit chunk offsets and box sizes where 32 bits do not hold them). Bytes that are not
such a file give a null codec and ``error``. Equal texts give equal bytes; repeated rows are stored one by
one; an empty table gives no rows. Input columns pass through;
new columns replace those of the same names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sedgeway.llm.common import map_arrow

#: Bytes of a sample (frame), samples of a chunk, samples from one key frame to the next, samples a second.
FRAME = 192
CHUNK = 64
KEY_EVERY = 16
RATE = 50
CODEC = b"raw "


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(kind: bytes, rows: list[tuple[int, ...]], width: str = "I") -> bytes:
    flat = [x for row in rows for x in row]
    return _full(kind, struct.pack(f">I{len(flat)}{width}", len(rows), *flat))


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def write_media(payload: bytes) -> bytes:
    """The file whose one track's samples are ``payload``, a positive multiple of FRAME bytes."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if chunks > 1 or last == CHUNK else []
    if last != CHUNK:
        runs.append((chunks, last, 1))
    wide = len(payload) + 64 * chunks + 4096 >= 1 << 32

    def moov(first: int) -> bytes:
        offsets = [(first + i * CHUNK * FRAME,) for i in range(chunks)]
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, (RATE * FRAME) << 16))),
            _table(b"stts", [(n, FRAME)]),
            _table(b"stss", [(i + 1,) for i in range(0, n, KEY_EVERY)]),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _table(b"stsc", runs),
            _table(b"co64", offsets, "Q") if wide else _table(b"stco", offsets),
        )
        ticks = n * FRAME
        version, head = (1, ">QQIQ") if ticks >= 1 << 32 else (0, ">IIII")
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(head, 0, 0, RATE * FRAME, ticks), struct.pack(">HH", 0x55C4, 0), version=version),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl),
        )
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ" if version else ">IIIII", 0, 0, 1, 0, ticks), bytes(8), bytes(8), _MATRIX, bytes(8), version=version, flags=7)
        mvhd = _full(b"mvhd", struct.pack(head, 0, 0, RATE * FRAME, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=version)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
    first = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(first) + _box(b"mdat", payload)


#: Containers inside each other that are walked; sample tables are six deep.
MAX_DEPTH = 16
_CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, start and end of the body of every box, containers before their children; at most ``MAX_DEPTH`` containers deep."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]  # path, where the next box starts, end
    while open_:
        path, start, end = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box ends early")
            size = struct.unpack_from(">Q", data, start + 8)[0]
            body = start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("a box reaches past its parent")
        yield (*path, kind), body, start + size
        open_.append((path, start + size, end))
        if kind in _CONTAINERS:
            if len(path) >= MAX_DEPTH:
                raise ValueError("boxes are nested too deep")
            open_.append(((*path, kind), body, start + size))


class _Box:
    """Big-endian numbers of a box's body, all within it."""

    def __init__(self, data: bytes, kind: bytes, at: int, end: int):
        self.data, self.kind, self.at, self.end = data, kind, at, end

    def read(self, form: str, offset: int) -> tuple[int, ...]:
        if self.at + offset + struct.calcsize(form) > self.end:
            raise ValueError(f"{self.kind!r} is cut short")
        return struct.unpack_from(form, self.data, self.at + offset)

    def rows(self, width: int, form: str = "I") -> list[tuple[int, ...]]:
        """The entries of a full box that starts with their number."""
        n = self.read(">I", 4)[0]
        if self.at + 8 + n * width * struct.calcsize(f">{form}") > self.end:  # before anything of that length is made
            raise ValueError(f"{self.kind!r} is cut short")
        flat = self.read(f">{n * width}{form}", 8)
        return [flat[i : i + width] for i in range(0, len(flat), width)]


def read_media(data: bytes) -> dict:
    """Codec, timescale, duration and sample layout of the first track, from its boxes alone; ValueError for any other bytes."""
    found: dict[bytes, _Box] = {}
    tracks = 0
    for path, at, end in walk(data):
        tracks += path == (b"moov", b"trak")
        if path[:2] == (b"moov", b"trak") and tracks == 1 or path[:2] != (b"moov", b"trak"):
            found.setdefault(path[-1], _Box(data, path[-1], at, end))
    if missing := [k for k in (b"mdhd", b"stsd", b"stts", b"stsz", b"stsc") if k not in found] or ([b"stco"] if not found.keys() & {b"stco", b"co64"} else []):
        raise ValueError(f"no {missing[0]!r}")
    header = found[b"mdhd"]
    timescale, ticks = header.read(">IQ", 20) if header.read("B", 0)[0] == 1 else header.read(">II", 12)
    codec = b"".join(found[b"stsd"].read("4c", 12)).decode("latin-1")
    same, n = found[b"stsz"].read(">II", 4)
    sizes = None if same else found[b"stsz"].read(f">{n}I", 12) if 4 * n <= len(data) else None
    if not same and sizes is None:
        raise ValueError("b'stsz' is cut short")
    offsets = [x for (x,) in (found[b"co64"].rows(1, "Q") if b"co64" in found else found[b"stco"].rows(1))]
    runs = found[b"stsc"].rows(3)
    counts: list[int] = []
    for i, (first, each, _) in enumerate(runs):
        until = runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1
        if not first == len(counts) + 1 <= until <= len(offsets) + 1:
            raise ValueError("the sample tables disagree")
        counts += [each] * (until - first)
    if len(counts) != len(offsets) or sum(counts) != n:
        raise ValueError("the sample tables disagree")
    if sum(c * d for c, d in found[b"stts"].rows(2)) != ticks:
        raise ValueError("stts and mdhd disagree")
    # Chunks first: once they are known to lie in the file, there are no more samples of a size than it has bytes.
    chunks, sample = [], 0
    for offset, count in zip(offsets, counts):
        at = offset + (count * same if same else sum(sizes[sample : sample + count]))
        if at > len(data):
            raise ValueError("a chunk reaches past the file")
        chunks.append((offset, at))
        sample += count
    if sum(b - a for a, b in chunks) > len(data):
        raise ValueError("chunks overlap")
    ranges, sample = [], 0
    wanted = iter([k for (k,) in found[b"stss"].rows(1)] if b"stss" in found else range(1, n + 1))
    key = next(wanted, None)
    for offset, count in zip(offsets, counts):
        at = offset
        for k in range(sample, sample + count) if not same else ():
            if key == k + 1:
                ranges.append((at, sizes[k]))
                key = next(wanted, None)
            at += sizes[k]
        while same and key is not None and sample < key <= sample + count:
            ranges.append((offset + (key - 1 - sample) * same, same))
            key = next(wanted, None)
        sample += count
    if key is not None:
        raise ValueError("stss names no sample, or not in order")
    return {"codec": codec, "timescale": timescale, "duration": ticks, "samples": n, "chunks": chunks, "keyframes": ranges}


def stored_payload(data: bytes, info: dict) -> bytes:
    """The track's bytes, chunk by chunk."""
    return b"".join(data[a:b] for a, b in info["chunks"])


def store_media(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_bytes`` and ``media``, the text as a file."""
    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
            return {"n_bytes": [len(b) for b in raw], "media": [write_media(payload_of(b)) for b in raw]}

        return work

    return map_arrow(df, text, make, added)


_RANGE = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
MEDIA_FIELDS = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("timescale", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("samples", T.LongType()),
        T.StructField("keyframes", T.ArrayType(_RANGE)),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what the boxes of its column ``media`` say, and digests of the stored bytes."""

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"error": "null"}
        out = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            info = read_media(data)
        except ValueError as e:
            return out | {"error": str(e) or type(e).__name__}
        payload = stored_payload(data, info)
        return out | {
            "codec": info["codec"], "timescale": info["timescale"], "duration": info["duration"], "samples": info["samples"],
            "keyframes": [{"offset": a, "length": n} for a, n in info["keyframes"]],
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        }

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = [one(x) for x in batch.column(media).to_pylist()]
            return {f.name: [r.get(f.name) for r in rows] for f in MEDIA_FIELDS.fields}

        return work

    return map_arrow(df, media, make, MEDIA_FIELDS)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from sedgeway.runtime import table

    stored = store_media(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    read = media_columns(stored).drop("media")
    ranges = F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"].cast("string"), k["length"].cast("string"))))
    feature = F.concat(
        F.lit("codec="), F.trim("codec"), F.lit(";seconds="), F.format_string("%.3f", F.col("duration") / F.col("timescale")),
        F.lit(";samples="), F.col("samples").cast("string"), F.lit(";keyframes="), ranges,
    )
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
