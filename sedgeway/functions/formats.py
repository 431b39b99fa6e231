"""Exact sizes of files by their own structure, for carving them out of raw bytes.

A format is a function of a ``View``. It returns the file's size and a note; reading past the bytes at hand
raises ``More``, anything that can't be such a file raises ``Bad``. ``measure`` turns that into a ``Found``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

MB = 1 << 20


class Bad(Exception):
    """Not a file of this format."""


class More(Exception):
    """Valid as far as it goes. ``so_far`` bytes are a file of their own; ``total`` is what the format states."""

    def __init__(self, so_far: int = 0, total: int = 0, note: str | None = None):
        super().__init__()
        self.so_far, self.total, self.note = so_far, total, note


class Found(NamedTuple):
    status: str  # ok, reject or more
    size: int
    info: str | None
    required: int


class View:
    """Bytes with typed reads that raise More past the end."""

    def __init__(self, data):
        self.b = bytes(data)
        self.n = len(self.b)

    def need(self, end: int) -> None:
        if end > self.n:
            raise More()

    def take(self, at: int, n: int) -> bytes:
        self.need(at + n)
        return self.b[at : at + n]

    def num(self, at: int, form: str) -> int:
        self.need(at + struct.calcsize(form))
        return struct.unpack_from(form, self.b, at)[0]

    def u8(self, at: int) -> int:
        return self.num(at, "B")

    def total(self, size: int) -> int:
        """A stated size: the bytes must be there."""
        if size > self.n:
            raise More(total=size)
        return size


def _check(ok: bool) -> None:
    if not ok:
        raise Bad()


def _size(w: int, h: int) -> str:
    return f"{w}×{h}"


def duration(seconds: float) -> str:
    """m:ss, or h:mm:ss from an hour on; nothing for what can't be a duration."""
    if not 0 <= seconds <= 366 * 86400:
        return ""
    s = int(seconds)
    return f"{s // 3600}:{s % 3600 // 60:02}:{s % 60:02}" if s >= 3600 else f"{s // 60}:{s % 60:02}"


def _khz(rate: int) -> str:
    return f"{round(rate / 1000, 1):g} kHz"


def _channels(n: int) -> str:
    return {1: "mono", 2: "stereo"}.get(n, f"{n} ch")


# --- images

_SCAN_END = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff]).", re.DOTALL)


def jpeg(v: View):
    _check(v.take(0, 4)[:3] == b"\xff\xd8\xff")
    at, note = 2, None
    while True:
        lead, kind = v.take(at, 2)
        _check(lead == 0xFF and kind != 0)
        if kind == 0xFF:
            at += 1
        elif kind == 0xD9:
            return at + 2, note
        elif kind in (0xD8, 0x01) or 0xD0 <= kind <= 0xD7:
            at += 2
        else:
            length = v.num(at + 2, ">H")
            _check(length >= 2)
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and note is None:
                h, w = struct.unpack(">HH", v.take(at + 5, 4))
                note = _size(w, h)
            at += 2 + length
            if kind == 0xDA:  # coded data up to the next real marker
                m = _SCAN_END.search(v.b, at)
                if not m:
                    raise More()
                at = m.start()


def png(v: View):
    _check(v.take(0, 8) == b"\x89PNG\r\n\x1a\n")
    at, note = 8, None
    while True:
        length, kind = struct.unpack(">I4s", v.take(at, 8))
        _check(length < 1 << 31 and kind.isalpha())
        body = v.take(at + 4, 4 + length)
        _check(zlib.crc32(body) == v.num(at + 8 + length, ">I"))
        if kind == b"IHDR" and length >= 8:
            note = _size(*struct.unpack_from(">II", body, 4))
        at += 12 + length
        if kind == b"IEND":
            return at, note


def _sub_blocks(v: View, at: int) -> int:
    while n := v.u8(at):
        at += 1 + n
    return at + 1


def gif(v: View):
    head = v.take(0, 13)
    _check(head[:6] in (b"GIF87a", b"GIF89a"))
    colours = lambda f: 3 << ((f & 7) + 1) if f & 0x80 else 0
    at = 13 + colours(head[10])
    while True:
        kind = v.u8(at)
        if kind == 0x3B:
            return at + 1, _size(*struct.unpack_from("<HH", head, 6))
        if kind == 0x2C:
            at = _sub_blocks(v, at + 11 + colours(v.take(at, 10)[9]))
        else:
            _check(kind == 0x21)
            at = _sub_blocks(v, at + 2)


def bmp(v: View):
    head = v.take(0, 30)
    _check(head[:2] == b"BM")
    size, data, dib = (struct.unpack_from("<I", head, k)[0] for k in (2, 10, 14))
    _check(dib in (12, 40, 52, 56, 108, 124) and size >= 14 + dib and 14 + dib <= data <= size)
    note = None
    if dib >= 40:
        w, h = struct.unpack_from("<ii", head, 18)
        _check(0 < w <= 1 << 16 and 0 < abs(h) <= 1 << 16)
        note = _size(w, abs(h))
    return v.total(size), note


#: Bytes of TIFF field types 1..13. Fixed values.
_TIFF_BYTES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4)


def tiff(v: View):
    e = {b"II*\0": "<", b"MM\0*": ">"}.get(v.take(0, 8)[:4])
    _check(e is not None)
    extent, at, dims, seen = 8, v.num(4, e + "I"), {}, 0
    while at and seen < 64:
        seen += 1
        _check(at >= 8 and at % 2 == 0)
        n = v.num(at, e + "H")
        _check(0 < n <= 4096)
        end = at + 2 + 12 * n + 4
        v.need(end)
        extent = max(extent, end)
        lists = {}
        for k in range(n):
            here = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(e + "HHI", v.b, here)
            if not 1 <= kind < len(_TIFF_BYTES):
                continue
            total = count * _TIFF_BYTES[kind]
            place = here + 8 if total <= 4 else v.num(here + 8, e + "I")
            if total > 4:
                extent = max(extent, place + total)
            if tag in (256, 257) and count == 1:
                dims[tag] = v.num(here + 8, e + ("H" if kind == 3 else "I"))
            role = {273: "at", 324: "at", 279: "len", 325: "len"}.get(tag)
            if role:
                lists[role] = (kind, count, place)
        if len(lists) == 2:
            (k1, n1, p1), (k2, n2, p2) = lists["at"], lists["len"]
            _check(n1 == n2 <= 1 << 20 and {k1, k2} <= {3, 4})
            form = {3: "H", 4: "I"}
            a = struct.unpack(f"{e}{n1}{form[k1]}", v.take(p1, n1 * _TIFF_BYTES[k1]))
            b = struct.unpack(f"{e}{n2}{form[k2]}", v.take(p2, n2 * _TIFF_BYTES[k2]))
            extent = max([extent, *map(sum, zip(a, b))])
        at = v.num(end - 4, e + "I")
    note = _size(dims[256], dims[257]) if dims.get(256) and dims.get(257) else None
    return v.total(extent), note


def webp(v: View):
    h = v.take(0, 30)
    _check(h[:4] == b"RIFF" and h[8:12] == b"WEBP")
    size, kind, note = struct.unpack_from("<I", h, 4)[0] + 8, h[12:16], None
    _check(size >= 30 and kind in (b"VP8 ", b"VP8L", b"VP8X"))
    if kind == b"VP8 " and h[23:26] == b"\x9d\x01\x2a":
        note = _size(*(x & 0x3FFF for x in struct.unpack_from("<HH", h, 26)))
    elif kind == b"VP8L" and h[20] == 0x2F:
        bits = struct.unpack_from("<I", h, 21)[0]
        note = _size((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
    elif kind == b"VP8X":
        note = _size(int.from_bytes(h[24:27], "little") + 1, int.from_bytes(h[27:30], "little") + 1)
    return v.total(size), note


# --- sound and video


def riff(v: View):
    h = v.take(0, 12)
    size, form, note = struct.unpack_from("<I", h, 4)[0] + 8, h[8:12], None
    _check(h[:4] == b"RIFF" and size >= 12 and form in (b"WAVE", b"AVI "))
    if form == b"WAVE":
        at = 12
        while at + 8 <= min(v.n, size):
            kind, n = struct.unpack_from("<4sI", v.b, at)
            if kind == b"fmt " and n >= 16 and at + 24 <= v.n:
                channels, rate = struct.unpack_from("<HI", v.b, at + 10)
                note = f"{_khz(rate)} · {struct.unpack_from('<H', v.b, at + 22)[0]}-bit · {_channels(channels)}"
                break
            at += 8 + n + n % 2
            _check(at <= size)
    elif v.n >= 72 and v.b[12:16] == b"LIST" and v.b[20:28] == b"hdrlavih":
        per, frames, w, hh = (struct.unpack_from("<I", v.b, k)[0] for k in (32, 48, 64, 68))
        note = _size(w, hh) + (f" · {duration(frames * per / 1e6)}" if per else "")
    return v.total(size), note


#: Boxes that may stand at the top of an ISO media file. Fixed values.
_TOP_BOXES = frozenset(b"ftyp moov mdat free skip wide meta uuid moof mfra sidx styp pdin junk pnot PICT".split())


def _boxes(b: bytes, at: int, end: int):
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", b, at)
        if n < 8 or at + n > end:
            return
        yield kind, at + 8, at + n
        at += n


def _movie_note(b: bytes, at: int, end: int) -> str | None:
    dims = length = None
    for kind, s, e in _boxes(b, at, end):
        if kind == b"mvhd" and e - s >= 24:
            scale, ticks = struct.unpack_from(">IQ", b, s + 20) if b[s] == 1 and e - s >= 36 else struct.unpack_from(">II", b, s + 12)
            length = duration(ticks / scale) if scale else None
        elif kind == b"trak" and dims is None:
            for k2, _, e2 in _boxes(b, s, e):
                if k2 == b"tkhd":
                    w, h = (x >> 16 for x in struct.unpack_from(">II", b, e2 - 8))
                    dims = _size(w, h) if w and h else None
                    break
    return " · ".join(x for x in (dims, length) if x) or None


def iso_media(v: View):
    _check(v.take(0, 12)[4:8] == b"ftyp")
    at, body, note = 0, False, None
    while True:
        if at + 8 > v.n:
            raise More(at if body and at > 8 else 0, note=note)
        size, kind = struct.unpack_from(">I4s", v.b, at)
        if size == 0:
            _check(body)
            return at, note  # zeros after the movie
        if size == 1:
            size = v.num(at + 8, ">Q")
            _check(16 <= size < 1 << 62)
        _check(size >= 8)
        if kind not in _TOP_BOXES:
            _check(at > 0 and body)
            return at, note
        if kind == b"moov" and at + size <= v.n:
            note = _movie_note(v.b, at + 8, at + size)
        body = body or kind in (b"moov", b"mdat")
        at = v.total(at + size)
        if at == v.n and body:
            raise More(at, note=note)


def _ebml_id(v: View, at: int) -> tuple[int, int]:
    first = v.u8(at)
    n = 5 - (first >> 4).bit_length() if first >> 4 else 0
    _check(n > 0)
    return int.from_bytes(v.take(at, n), "big"), at + n


def _ebml_size(v: View, at: int) -> tuple[int | None, int]:
    """Size (None if unknown) and where the body starts."""
    first = v.u8(at)
    _check(first > 0)
    n = 9 - first.bit_length()
    value = int.from_bytes(v.take(at, n), "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


_INFO = 0x1549A966
#: Elements that may stand in a Matroska segment. Fixed values.
_SEGMENT_CHILDREN = frozenset((0x114D9B74, _INFO, 0x1F43B675, 0x1654AE6B, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367, 0xEC))


def _segment_note(v: View, at: int, end: int) -> str | None:
    scale, ticks = 1_000_000, 0.0
    try:
        while at < end:
            kind, q = _ebml_id(v, at)
            n, q = _ebml_size(v, q)
            if n is None:
                return None
            if kind == _INFO:
                stop = q + n
                while q < stop:
                    k2, r = _ebml_id(v, q)
                    m, r = _ebml_size(v, r)
                    raw = v.take(r, m or 0)
                    if k2 == 0x2AD7B1:
                        scale = int.from_bytes(raw, "big")
                    elif k2 == 0x4489 and len(raw) in (4, 8):
                        ticks = struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0]
                    q = r + len(raw)
                return duration(ticks * scale / 1e9) if ticks > 0 else None
            at = q + n
    except (More, Bad):
        pass
    return None


def matroska(v: View):
    _check(v.take(0, 8)[:4] == b"\x1aE\xdf\xa3")
    head, at = _ebml_size(v, 4)
    _check(head is not None)
    _check(v.take(at + head, 4) == b"\x18S\x80g")
    size, start = _ebml_size(v, at + head + 4)
    if size is not None:
        return v.total(start + size), _segment_note(v, start, min(start + size, start + MB))
    at, note = start, None
    while True:
        if at + 2 > v.n:
            raise More(at if at > start else 0, note=note)
        try:
            kind, q = _ebml_id(v, at)
        except Bad:
            kind = q = 0
        if kind not in _SEGMENT_CHILDREN:
            _check(at > start)
            return at, note
        n, q = _ebml_size(v, q)
        _check(n is not None)
        if kind == _INFO and q + n <= v.n:
            note = note or _segment_note(v, at, q + n)
        at = v.total(q + n)


def ogg(v: View):
    at = 0
    _check(v.take(0, 27)[:4] == b"OggS")
    while True:
        h = v.take(at, 27)
        _check(h[:5] == b"OggS\0")
        at += 27 + h[26] + sum(v.take(at + 27, h[26]))
        v.need(at)
        if h[5] & 4:
            return at, None


#: kbit/s of the bit rate numbers 1..14, for version 1 layers 1, 2, 3 and version 2 layers 1 and 2-3. Fixed values.
_BIT_RATES = (
    (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
)
_SAMPLE_RATES = (44100, 48000, 32000)


def _mpeg_frame(h: bytes) -> tuple[int, str] | None:
    """Length and note of the frame that begins with four bytes ``h``."""
    bits = int.from_bytes(h, "big")
    version, layer, rate, hz, pad = bits >> 19 & 3, 4 - (bits >> 17 & 3), bits >> 12 & 15, bits >> 10 & 3, bits >> 9 & 1
    if bits >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    first = version == 3
    kbps = _BIT_RATES[layer - 1 if first else 3 if layer == 1 else 4][rate - 1]
    sample = _SAMPLE_RATES[hz] // {3: 1, 2: 2, 0: 4}[version]
    if layer == 1:
        n = (12_000 * kbps // sample + pad) * 4
    else:
        n = (144_000 if first or layer == 2 else 72_000) * kbps // sample + pad
    return n, f"{kbps} kbps · {_khz(sample)}"


def mp3(v: View):
    h = v.take(0, 10)
    at = 0
    if h[:3] == b"ID3":
        _check(all(x < 128 for x in h[6:10]))
        at = 10 + (h[6] << 21 | h[7] << 14 | h[8] << 7 | h[9]) + (10 if h[5] & 0x10 else 0)
    else:
        _check(h[0] == 0xFF and h[1] >= 0xE0)
    frames, note = 0, None
    while True:
        if at + 4 > v.n:
            raise More(at if frames >= 4 else 0, note=note)
        f = _mpeg_frame(v.b[at : at + 4])
        if f is None:
            _check(frames >= 4)
            return (v.total(at + 128) if v.b[at : at + 3] == b"TAG" else at), note
        note = note or f[1]
        if at + f[0] > v.n:
            raise More(at if frames >= 4 else 0, note=note)
        at, frames = at + f[0], frames + 1


def _crc8(data: bytes) -> int:
    crc = 0
    for x in data:
        crc ^= x
        for _ in range(8):
            crc = (crc << 1 ^ (0x07 if crc & 0x80 else 0)) & 0xFF
    return crc


def _flac_frame(b: bytes, at: int) -> bool:
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return False
    block, rate, lead = b[at + 2] >> 4, b[at + 2] & 15, b[at + 4]
    ones = 8 - (lead ^ 0xFF).bit_length()
    if ones == 1 or block == 0 or rate == 15:
        return False
    end = at + 4 + min(max(ones, 1), 7) + {6: 1, 7: 2}.get(block, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return end < len(b) and _crc8(b[at:end]) == b[end]


_FLAC_SYNC = re.compile(rb"\xff[\xf8\xf9]")


def flac(v: View):
    _check(v.take(0, 42)[:4] == b"fLaC")
    at, note, first = 4, None, True
    while True:
        kind, n = v.take(at, 4)[0], int.from_bytes(v.b[at + 1 : at + 4], "big")
        _check(not first or (kind & 0x7F == 0 and n == 34))
        if first:
            bits = int.from_bytes(v.take(at + 14, 8), "big")
            rate, channels, samples = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
            if rate:
                note = f"{_khz(rate)} · {_channels(channels)}" + (f" · {duration(samples / rate)}" if samples else "")
        at, first = at + 4 + n, False
        if kind & 0x80:
            break
    frames = 0
    while True:
        if at + 16 > v.n:
            raise More(at if frames else 0, note=note)
        if not _flac_frame(v.b, at):
            _check(frames > 0)
            return at, note
        stop = min(v.n - 2, at + MB)
        nxt = next((m.start() for m in _FLAC_SYNC.finditer(v.b, at + 16, stop + 1) if m.start() < stop and _flac_frame(v.b, m.start())), None)
        if nxt is None:
            if stop >= v.n - 2:
                raise More(at if frames else 0, note=note)
            _check(frames > 0)
            return at, note
        at, frames = nxt, frames + 1


# --- documents, archives, programs

_PDF_GOES_ON = re.compile(rb"[ \t\r\n]*(?:xref|trailer|startxref|%|\d+ \d+ obj)")
_PDF_PAGES = re.compile(rb"/Type ?/Pages")


def pdf(v: View):
    _check(v.take(0, 8)[:5] == b"%PDF-")
    last = v.b.rfind(b"%%EOF")
    if last < 0:
        raise More()
    end = last + 5
    while end < v.n and v.b[end] in b"\r\n":
        end += 1
    if _PDF_GOES_ON.match(v.b, end):
        raise More(end)
    note = None
    if m := _PDF_PAGES.search(v.b):
        c = re.search(rb"/Count (\d+)", v.b[m.start() : m.start() + 200])
        if c and (n := int(c[1][:7])):
            note = f"{n} page{'s' * (n != 1)}"
    return end, note


_ZIP_NEXT = re.compile(rb"PK(?:\x03\x04|\x01\x02|\x05\x06)")
#: Kinds of a ZIP by what its first entry and its bytes say. Fixed values.
_ZIP_OFFICE = ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx"))
_ZIP_MIME = (
    (b"application/epub+zip", "epub"), (b"application/vnd.oasis.opendocument.text", "odt"),
    (b"application/vnd.oasis.opendocument.spreadsheet", "ods"), (b"application/vnd.oasis.opendocument.presentation", "odp"),
)


def zip_kind(first: bytes, data: bytes) -> str | None:
    if first == b"[Content_Types].xml":
        return next((k for mark, k in _ZIP_OFFICE if mark in data), "ooxml")
    if first == b"mimetype":
        at = data.find(b"application/")
        return next((k for mark, k in _ZIP_MIME if at >= 0 and data.startswith(mark, at)), None)
    return "jar" if first.startswith(b"META-INF/") else None


def zip_archive(v: View):
    _check(v.take(0, 30)[:4] == b"PK\x03\x04")
    at, first, central = 0, None, False
    while True:
        sig = v.take(at, 4)
        if sig == b"PK\x03\x04":
            flags, stored = v.num(at + 6, "<H"), v.num(at + 18, "<I")
            name, extra = struct.unpack("<HH", v.take(at + 26, 4))
            text = v.take(at + 30, name)
            first = text if first is None else first
            at += 30 + name + extra
            if flags & 8 and stored == 0:  # the size stands after the data
                v.need(at)
                m = _ZIP_NEXT.search(v.b, at)
                if not m:
                    raise More()
                at = m.start()
            else:
                at = v.total(at + stored)
                if flags & 8 and v.b[at : at + 4] == b"PK\x07\x08":
                    at += 16
        elif sig == b"PK\x01\x02":
            central = True
            at += 46 + sum(struct.unpack_from("<HHH", v.take(at, 46), 28))
        elif sig == b"PK\x05\x06":
            _check(central)
            return v.total(at + 22 + v.num(at + 20, "<H")), zip_kind(first or b"", v.b)
        elif sig == b"PK\x06\x06":
            at += 12 + min(v.num(at + 4, "<Q"), 1 << 30)
        else:
            _check(sig == b"PK\x06\x07")
            at += 20


def seven_zip(v: View):
    _check(v.take(0, 32)[:6] == b"7z\xbc\xaf\x27\x1c")
    offset, size = struct.unpack_from("<QQ", v.b, 12)
    _check(max(offset, size) < 1 << 31)
    return v.total(32 + offset + size), None


def _vint(v: View, at: int) -> tuple[int, int]:
    value = 0
    for i in range(10):
        x = v.u8(at + i)
        value |= (x & 0x7F) << 7 * i
        if x < 0x80:
            return value, at + i + 1
    raise More()


def rar(v: View):
    head = v.take(0, 8)
    _check(head[:6] == b"Rar!\x1a\x07")
    if head[6] == 0:
        at = 7
        while True:
            kind, flags, n = struct.unpack_from("<BHH", v.take(at, 7), 2)
            _check(n >= 7 and 0x72 <= kind <= 0x7B)
            at = v.total(at + n + (v.num(at + 7, "<I") if flags & 0x8000 else 0))
            if kind == 0x7B:
                return at, None
    _check(head[6:8] == b"\x01\x00")
    at = 8
    while True:
        v.need(at + 7)
        n, body = _vint(v, at + 4)
        kind, q = _vint(v, body)
        flags, q = _vint(v, q)
        _check(n <= 1 << 24 and 1 <= kind <= 5)
        end = body + n
        if flags & 2:
            if flags & 1:
                _, q = _vint(v, q)
            data, _ = _vint(v, q)
            _check(data < 1 << 62)
            end += data
        at = v.total(end)
        if kind == 5:
            return at, None


def gzip_member(v: View):
    h = v.take(0, 18)
    _check(h[:3] == b"\x1f\x8b\x08")
    at = 10
    if h[3] & 4:
        at += 2 + v.num(at, "<H")
    for bit in (8, 16):
        if h[3] & bit:
            end = v.b.find(0, at)
            if end < 0:
                raise More()
            at = end + 1
    at += 2 if h[3] & 2 else 0
    v.need(at + 1)
    inflate, total, block = zlib.decompressobj(-15), 0, v.b[at:]
    try:
        while block and not inflate.eof:
            total += len(inflate.decompress(block, 1 << 20))
            block = inflate.unconsumed_tail
            _check(total <= 1 << 32)
    except zlib.error:
        raise Bad() from None
    if not inflate.eof:
        raise More()
    return v.total(v.n - len(inflate.unused_data) + 8), None


def sqlite(v: View):
    _check(v.take(0, 100)[:16] == b"SQLite format 3\0")
    page, pages = v.num(16, ">H"), v.num(28, ">I")
    page = 65536 if page == 1 else page
    _check(page >= 512 and page & (page - 1) == 0 and pages > 0)
    return v.total(page * pages), f"{pages:,} page{'s' * (pages != 1)} of {page}"


def program(v: View):
    _check(v.take(0, 64)[:2] == b"MZ")
    pe = v.num(60, "<I")
    _check(64 <= pe <= 4096)
    sig, machine, sections, optional, flags = struct.unpack("<4sHH12xHH", v.take(pe, 24))
    _check(sig == b"PE\0\0" and 0 < sections <= 96)
    at = pe + 24 + optional
    v.need(at + 40 * sections)
    end = at + 40 * sections
    place = {0x20B: 112, 0x10B: 96}.get(v.num(pe + 24, "<H")) if optional >= 2 else None
    if place and optional >= place + 40:
        off, n = struct.unpack_from("<II", v.b, pe + 24 + place + 32)
        if n and 0 < off < 1 << 31:
            end = max(end, off + n)
    for k in range(sections):
        n, off = struct.unpack_from("<II", v.b, at + 40 * k + 16)
        _check(max(n, off) <= 1 << 31)
        end = max(end, n + off)
    arch = {0x8664: "x64", 0x14C: "x86", 0xAA64: "ARM64"}.get(machine, f"machine 0x{machine:X}")
    return v.total(end), f"{arch} {'DLL' if flags & 0x2000 else 'EXE'}"


#: Streams by which a compound file shows its kind. Fixed values.
_OLE_KINDS = (("WordDocument", "doc"), ("Workbook", "xls"), ("Book\0", "xls"), ("PowerPoint Document", "ppt"), ("__properties_version", "msg"))
_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE


def compound(v: View):
    _check(v.take(0, 512)[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")
    shift = v.num(30, "<H")
    _check(shift in (9, 12))
    sector = 1 << shift
    wanted, more_at, more_n = v.num(44, "<I"), v.num(68, "<I"), v.num(72, "<I")
    _check(0 < wanted <= 1 << 20 and more_n <= 65536)
    tables: dict[int, None] = {}

    def collect(numbers) -> None:
        for s in numbers:
            if s == _FREE or len(tables) == wanted:
                return
            _check(s < 0xFFFFFFFA and s not in tables)
            tables[s] = None

    collect(struct.unpack_from("<109I", v.b, 76))
    met = set()
    while len(met) < more_n and more_at not in (_END, _FREE) and len(tables) < wanted:
        _check(more_at not in met)
        met.add(more_at)
        *numbers, following = struct.unpack(f"<{sector // 4}I", v.take(512 + more_at * sector, sector))
        before = len(tables)
        collect(numbers)
        _check(len(tables) > before)
        more_at = following
    highest = -1
    for k, s in enumerate(tables):
        cells = struct.unpack(f"<{sector // 4}I", v.take(512 + s * sector, sector))
        used = max((i for i, x in enumerate(cells) if x != _FREE), default=-1)
        if used >= 0:
            highest = k * (sector // 4) + used
    _check(highest >= 0)
    size = v.total(512 + (highest + 1) * sector)
    return size, next((k for name, k in _OLE_KINDS if name.encode("utf-16-le") in v.b[:size]), None)


_RTF_MARKS = re.compile(rb"\\.|[{}\0]", re.DOTALL)


def rtf(v: View):
    _check(v.take(0, 5) == b"{\\rtf")
    depth = 0
    for m in _RTF_MARKS.finditer(v.b):
        c = m.group()
        if c == b"{":
            depth += 1
        elif c == b"}":
            depth -= 1
            _check(depth >= 0)
            if depth == 0:
                return m.end(), None
        elif c == b"\0":
            _check(depth != 1 or m.start() <= 64)
    raise More()


def pst(v: View):
    _check(v.take(0, 200)[:4] == b"!BDN")
    version = v.num(10, "<H")
    _check(version in (14, 15) or version >= 23)
    old = version < 23
    size = v.num(0xA8, "<I") if old else v.num(0xB8, "<q")
    _check(size >= 512)
    return v.total(size), f"{'ANSI' if old else 'Unicode'} PST"


_LNK_HEAD = b"\x4c\0\0\0\x01\x14\x02\0\0\0\0\0\xc0\0\0\0\0\0\0\x46"


def shortcut(v: View):
    _check(v.take(0, 76)[:20] == _LNK_HEAD)
    flags, at = v.num(20, "<I"), 76
    if flags & 1:
        at += 2 + v.num(at, "<H")
    if flags & 2:
        n = v.num(at, "<I")
        _check(28 <= n <= MB)
        at += n
    for bit in range(2, 7):
        if flags >> bit & 1:
            at += 2 + v.num(at, "<H") * (2 if flags & 0x80 else 1)
    for _ in range(64):
        n = v.num(at, "<I")
        if n < 4:
            return at + 4, None
        _check(n <= MB)
        at += n
    raise Bad()


@dataclass(frozen=True)
class Format:
    id: str
    label: str
    ext: str
    category: str
    max_size: int
    magics: tuple[bytes, ...]
    reader: Callable[[View], tuple[int, str | None]]
    offset: int = 0

    def starts(self, head: bytes) -> bool:
        return any(head[self.offset : self.offset + len(m)] == m for m in self.magics)


#: The formats; the first that fits wins. Fixed values.
FORMATS = (
    Format("jpg", "JPEG image", ".jpg", "Image", 64 * MB, (b"\xff\xd8\xff",), jpeg),
    Format("png", "PNG image", ".png", "Image", 64 * MB, (b"\x89PNG\r\n\x1a\n",), png),
    Format("gif", "GIF image", ".gif", "Image", 32 * MB, (b"GIF87a", b"GIF89a"), gif),
    Format("bmp", "Bitmap image", ".bmp", "Image", 128 * MB, (b"BM",), bmp),
    Format("tif", "TIFF image", ".tif", "Image", 512 * MB, (b"II*\0", b"MM\0*"), tiff),
    Format("webp", "WebP image", ".webp", "Image", 64 * MB, (b"RIFF",), webp),
    Format("wav", "WAV audio", ".wav", "Audio", 2048 * MB, (b"RIFF",), riff),
    Format("mp4", "MP4 / MOV video", ".mp4", "Video", 4096 * MB, (b"ftyp",), iso_media, 4),
    Format("mkv", "Matroska / WebM video", ".mkv", "Video", 4096 * MB, (b"\x1aE\xdf\xa3",), matroska),
    Format("ogg", "OGG audio", ".ogg", "Audio", 512 * MB, (b"OggS",), ogg),
    Format("mp3", "MP3 audio", ".mp3", "Audio", 512 * MB, (b"ID3", b"\xff\xfb", b"\xff\xfa", b"\xff\xf3", b"\xff\xf2"), mp3),
    Format("flac", "FLAC audio", ".flac", "Audio", 1024 * MB, (b"fLaC",), flac),
    Format("pdf", "PDF document", ".pdf", "Document", 512 * MB, (b"%PDF-",), pdf),
    Format("zip", "ZIP archive", ".zip", "Archive", 4096 * MB, (b"PK\x03\x04",), zip_archive),
    Format("7z", "7-Zip archive", ".7z", "Archive", 4096 * MB, (b"7z\xbc\xaf\x27\x1c",), seven_zip),
    Format("rar", "RAR archive", ".rar", "Archive", 4096 * MB, (b"Rar!\x1a\x07",), rar),
    Format("gz", "GZIP archive", ".gz", "Archive", 256 * MB, (b"\x1f\x8b\x08",), gzip_member),
    Format("sqlite", "SQLite database", ".sqlite", "Document", 2048 * MB, (b"SQLite format 3\0",), sqlite),
    Format("exe", "Windows program", ".exe", "App", 512 * MB, (b"MZ",), program),
    Format("ole", "Office 97-2003 document", ".doc", "Document", 512 * MB, (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",), compound),
    Format("rtf", "Rich Text document", ".rtf", "Document", 64 * MB, (b"{\\rtf",), rtf),
    Format("pst", "Outlook data file", ".pst", "Document", 4096 * MB, (b"!BDN",), pst),
    Format("lnk", "Windows shortcut", ".lnk", "Other", MB, (_LNK_HEAD[:8],), shortcut),
)
BY_ID = {f.id: f for f in FORMATS}


def measure(f: Format, data) -> Found:
    """What a format says about bytes that may be a file of it. Never raises."""
    try:
        size, note = f.reader(View(data))
        return Found("ok", size, note, 0)
    except Bad:
        return Found("reject", 0, None, 0)
    except More as m:
        return Found("more", m.so_far, m.note, m.total)
    except (struct.error, OverflowError, MemoryError, IndexError):
        return Found("reject", 0, None, 0)


def extension_for(f: Format, info: str | None) -> str:
    """The format's extension, or that of the kind its note names."""
    kinds = {"zip": ("docx", "xlsx", "pptx", "epub", "odt", "ods", "odp", "jar"), "ole": ("xls", "ppt", "msg")}.get(f.id, ())
    if info in kinds:
        return f".{info}"
    return ".dll" if f.id == "exe" and info and info.endswith("DLL") else f.ext


#: First bytes by extension. Fixed values.
HEADERS = {
    "jpg jpeg": (b"\xff\xd8\xff",), "png": (b"\x89PNG",), "gif": (b"GIF8",), "bmp": (b"BM",), "webp wav avi": (b"RIFF",), "tif tiff": (b"II*\0", b"MM\0*"),
    "pdf": (b"%PDF",), "zip docx xlsx pptx jar apk epub odt": (b"PK\x03\x04",), "7z": (b"7z\xbc\xaf",), "rar": (b"Rar!",), "gz": (b"\x1f\x8b",),
    "exe dll": (b"MZ",), "mp3": (b"ID3", b"\xff\xfb", b"\xff\xf3", b"\xff\xf2"), "flac": (b"fLaC",), "ogg": (b"OggS",), "mkv webm": (b"\x1aE\xdf\xa3",),
    "sqlite db": (b"SQLite format 3",), "doc xls ppt msg": (b"\xd0\xcf\x11\xe0",), "rtf": (b"{\\rtf",), "psd": (b"8BPS",),
}
_HEADER_OF = {e: m for exts, m in HEADERS.items() for e in exts.split()}
_MOVIES = frozenset("mp4 m4a m4v mov heic heif 3gp".split())


def looks_like(ext: str, head: bytes) -> bool | None:
    """Whether first bytes suit an extension; None without an opinion."""
    ext = ext.lower().lstrip(".")
    if ext in _MOVIES:
        return None if len(head) < 8 else head[4:8] == b"ftyp"
    for m in _HEADER_OF.get(ext, ()):
        if len(head) < len(m):
            return None
        if head.startswith(m):
            return True
    return False if ext in _HEADER_OF else None


def zip_listing(data: bytes, most: int = 200) -> list[tuple[str, int]]:
    """Names and sizes of a ZIP's entries, from its local headers where it has no directory."""
    import io
    import zipfile

    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, i.file_size) for i in z.infolist()[:most]]
    except (zipfile.BadZipFile, ValueError, OSError):
        return []
