import random
import struct
import zlib

import pytest

from sedgeway.functions import formats as f


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def samples():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as q:
        q.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        q.writestr("a/b.txt", "hello" * 60)
    sector = lambda cells: struct.pack("<128I", *(cells + [0xFFFFFFFF] * (128 - len(cells))))
    ole = bytearray(512)
    ole[:8], ole[30:32], ole[44:48] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", struct.pack("<H", 9), struct.pack("<I", 1)
    ole[68:76] = struct.pack("<II", 0xFFFFFFFE, 0)
    ole[76:] = struct.pack("<109I", *([0] + [0xFFFFFFFF] * 108))
    pe = bytearray(512)
    pe[:2], pe[60:64], pe[64:68] = b"MZ", struct.pack("<I", 64), b"PE\0\0"
    pe[68:70], pe[70:72], pe[84:86], pe[86:88] = struct.pack("<H", 0x8664), struct.pack("<H", 1), struct.pack("<H", 0), struct.pack("<H", 0x2000)
    pe[88 + 16 : 88 + 24] = struct.pack("<II", 100, 412)
    frame = bytes([0xFF, 0xFB, 0x90, 0]) + bytes(413)
    head = b"\xff\xf8\x69\x08\x00\x0f"
    flac_frame = head + bytes([f._crc8(head)]) + bytes(40)
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + bytes(16)
    ebml = b"\x1aE\xdf\xa3\x84abcd" + b"\x18S\x80g\x88" + bytes(8)
    mvhd = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 65_000) + bytes(80))
    tkhd = box(b"trak", box(b"tkhd", bytes(76) + struct.pack(">II", 640 << 16, 480 << 16)))
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01\x00\x00\x00\xff\xda\x00\x02xx\xff\x00y\xff\xd0z\xff\xd9"
    tif = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 4) + b"".join(struct.pack("<HHII", *e) for e in ((256, 4, 1, 5), (257, 4, 1, 6), (273, 4, 1, 100), (279, 4, 1, 30))) + struct.pack("<I", 0)
    lnk = f._LNK_HEAD + struct.pack("<I", 0x81 | 0x04) + bytes(52) + struct.pack("<H", 2) + b"ab" + struct.pack("<H", 3) + "xyz".encode("utf-16-le") + bytes(4)
    pst = bytearray(600)
    pst[:4], pst[10:12], pst[0xB8:0xC0] = b"!BDN", struct.pack("<H", 23), struct.pack("<Q", 600)
    sq = bytearray(2048)
    sq[:16], sq[16:18], sq[28:32] = b"SQLite format 3\0", struct.pack(">H", 1024), struct.pack(">I", 2)
    rar4 = b"Rar!\x1a\x07\x00" + struct.pack("<HBHH", 0, 0x73, 0, 13) + bytes(6) + struct.pack("<HBHH", 0, 0x7B, 0, 7)
    return {
        "jpg": (jpg, "3×2"), "png": (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IEND", b""), "3×2"),
        "gif": (b"GIF89a" + struct.pack("<HHBBB", 4, 5, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(9) + b"\x02\x01x\x00\x3b", "4×5"), "bmp": (b"BM" + struct.pack("<IIIIii", 80, 0, 54, 40, 7, -8) + bytes(54), "7×8"),
        "tif": (tif.ljust(130, b"\0"), "5×6"), "webp": (b"RIFF" + struct.pack("<I", 26) + b"WEBPVP8X" + bytes(8) + b"\x01\0\0\x02\0\0" + bytes(4), "2×3"),
        "wav": (b"RIFF" + struct.pack("<I", 44) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", 8) + bytes(8), "44.1 kHz · 16-bit · stereo"),
        "mp4": (box(b"ftyp", b"isom") + box(b"moov", mvhd + tkhd) + box(b"mdat", b"x" * 20), "640×480 · 1:05"), "mkv": (ebml, None), "ogg": (b"OggS\0\x04" + bytes(20) + b"\x02\x03\x04" + bytes(7), None),
        "mp3": (frame * 5, "128 kbps · 44.1 kHz"), "flac": (b"fLaC\x80\0\0\x22" + info + flac_frame * 3, "44.1 kHz · stereo · 0:02"), "pdf": (b"%PDF-1.4\n1 0 obj /Type /Pages /Count 3\n%%EOF\n", "3 pages"),
        "zip": (z.getvalue(), "epub"), "7z": (b"7z\xbc\xaf\x27\x1c" + bytes(6) + struct.pack("<QQ", 5, 6) + bytes(4 + 11), None), "rar": (rar4, None), "gz": (gzip.compress(b"hello" * 99), None),
        "sqlite": (bytes(sq), "2 pages of 1024"), "exe": (bytes(pe), "x64 DLL"), "ole": (bytes(ole) + sector([0xFFFFFFFD, 0xFFFFFFFE]) + "Workbook".encode("utf-16-le").ljust(512, b"\0"), "xls"),
        "rtf": (b"{\\rtf1 {a} \\} b}", None), "pst": (bytes(pst), "Unicode PST"), "lnk": (lnk, None),
    }


SAMPLES = samples()
#: Formats without an end of their own: more bytes could follow.
OPEN = {"mp4", "mp3", "flac"}


def test_every_format_has_a_sample():
    assert set(SAMPLES) == set(f.BY_ID) and len(f.FORMATS) == 23


@pytest.mark.parametrize("kind", SAMPLES)
def test_sizes(kind):
    data, note = SAMPLES[kind]
    size = len(data) - (len(data) - 500) % 1 if kind != "flac" else len(data) - 47
    r = f.measure(f.BY_ID[kind], data + (b"" if kind == "pdf" else b"\0" * 40) + b"tail" * 400_000 * (kind == "flac"))
    assert f.BY_ID[kind].starts(data) and r.status == "ok" and r.info == note
    assert r.size == (len(data) if kind != "flac" else size)
    cut = f.measure(f.BY_ID[kind], data[: len(data) // 2])
    assert cut.status in ("more", "reject") and (cut.status == "more" or kind in ("gif", "flac"))
    if kind in OPEN:
        assert f.measure(f.BY_ID[kind], data).status == "more"


@pytest.mark.parametrize("kind", SAMPLES)
def test_damage_never_raises_nor_reads_past_the_end(kind):
    rng = random.Random(kind)
    for _ in range(300):
        x = bytearray(SAMPLES[kind][0])
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        x = bytes(x[: rng.randint(0, len(x))]) if rng.random() < 0.3 else bytes(x)
        r = f.measure(f.BY_ID[kind], x)
        assert r.status in ("ok", "reject", "more") and 0 <= r.size <= len(x)


def test_subtypes_and_headers():
    assert f.extension_for(f.BY_ID["zip"], "epub") == ".epub" and f.extension_for(f.BY_ID["exe"], "x64 DLL") == ".dll" and f.extension_for(f.BY_ID["ole"], None) == ".doc"
    assert f.looks_like("PNG", b"\x89PNGxx") is True and f.looks_like("png", b"\x89P") is None and f.looks_like("png", b"zzzzz") is False and f.looks_like("zzz", b"x") is None and f.looks_like("mp4", b"0000ftyp") is True
    assert f.zip_listing(SAMPLES["zip"][0]) == [("mimetype", 20), ("a/b.txt", 300)] and f.zip_listing(b"x") == []
