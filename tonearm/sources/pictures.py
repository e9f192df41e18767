"""Width, height, depth and palette size of pictures from their headers."""

from __future__ import annotations

import struct


def metrics(data: bytes) -> tuple[str, int, int, int, int] | None:
    """(mime_type, width, height, colour depth, colours of the palette or 0); None for other or broken data."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            width, height, bits, kind = struct.unpack_from(">IIBB", data, 16)
            if kind == 3:
                at, colours = 8, 0
                while at + 8 <= len(data) and not colours:
                    size, name = struct.unpack_from(">I4s", data, at)
                    colours = size // 3 if name == b"PLTE" else 0
                    at += 12 + size
                return "image/png", width, height, 24, colours
            return "image/png", width, height, bits * {0: 1, 2: 3, 4: 2, 6: 4}[kind], 0
        if data[:3] == b"GIF":
            width, height, flags = struct.unpack_from("<HHB", data, 6)
            return "image/gif", width, height, 24, 2 << (flags & 7)
        if data[:2] == b"BM":
            width, height, _, bits = struct.unpack_from("<iiHH", data, 18)
            colours = struct.unpack_from("<I", data, 46)[0]
            return "image/x-ms-bmp", width, abs(height), bits, colours
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
    except (struct.error, KeyError, IndexError):
        pass
    return None


def _jpeg(data: bytes) -> tuple[str, int, int, int, int] | None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD8:  # fill and marks without a body
            at += 1 if mark == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            bits, height, width, parts = struct.unpack_from(">BHHB", data, at + 4)
            return "image/jpeg", width, height, bits * parts, 0
        at += 2 + size
    return None


def _tiff(data: bytes) -> tuple[str, int, int, int, int]:
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(e + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
        form, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("I", 4))
        where = at + 10 + 12 * k
        if n * size > 4:
            where = struct.unpack_from(e + "I", data, where)[0]
        found[tag] = n if tag == 0x0140 else sum(struct.unpack_from(f"{e}{n}{form}", data, where)) if tag == 0x0102 else struct.unpack_from(e + form, data, where)[0]
    return "image/tiff", found[0x0100], found[0x0101], found.get(0x0102, 1), found.get(0x0140, 0) // 3
