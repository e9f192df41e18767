"""Structure of other containers: MP4 atoms, Ogg pages, WavPack and FLAC blocks, each as rows."""

from __future__ import annotations

import struct

#: Atoms that hold atoms.
_HOLDERS = frozenset(b"moov trak mdia minf stbl dinf udta meta ilst".split())


def atoms(data: bytes, path: str = "", start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    """(path, offset, size) of all atoms, those within others behind them."""
    end, at, out = len(data) if end is None else end, start, []
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            break
        here = f"{path}/{name.decode('latin-1')}" if path else name.decode("latin-1")
        out.append((here, at, size))
        if name in _HOLDERS or path.endswith("/ilst"):
            out += atoms(data, here, at + head + (4 if name == b"meta" else 0), at + size)
        at += size
    return out


def atom(data: bytes, path: str) -> bytes | None:
    """The content of the first atom at a path."""
    return next((data[at + 8 : at + size] for p, at, size in atoms(data) if p == path), None)


def ogg_pages(data: bytes) -> list[tuple[int, int, int, int, list[int]]]:
    """(stream, number, granule position, offset of the content, lengths of the segments) of each page."""
    at, out = 0, []
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        granule, stream, number = struct.unpack_from("<qII", data, at + 6)
        n = data[at + 26]
        sizes = list(data[at + 27 : at + 27 + n])
        out.append((stream, number, granule, at + 27 + n, sizes))
        at += 27 + n + sum(sizes)
    return out


def ogg_packets(data: bytes) -> list[bytes]:
    """The packets of the first stream: segments are joined up to one shorter than 255 bytes."""
    pages = ogg_pages(data)
    out, part = [], b""
    for stream, _, _, at, sizes in pages:
        if stream != pages[0][0]:
            continue
        for size in sizes:
            part += data[at : at + size]
            at += size
            if size < 255:
                out.append(part)
                part = b""
    return out


def flac_blocks(data: bytes) -> list[tuple[int, int, int]]:
    """(kind, offset, size) of the metadata blocks."""
    at, out = 4, []
    if data[:4] != b"fLaC":
        return out
    while at + 4 <= len(data):
        head = struct.unpack_from(">I", data, at)[0]
        out.append((head >> 24 & 0x7F, at + 4, head & 0xFFFFFF))
        if head >> 31:
            break
        at += 4 + (head & 0xFFFFFF)
    return out


def wavpack_blocks(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, size, samples) of the blocks."""
    at, out = 0, []
    while data[at : at + 4] == b"wvpk" and at + 32 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        out.append((at, size + 8, struct.unpack_from("<I", data, at + 20)[0]))
        at += size + 8
    return out
