"""Tags of audio files as (key, value) pairs, and what can be read from the first bytes of a file.

Readers take the bytes of a tag and give its text items in order, repeated keys included; broken items end the list.
"""

from __future__ import annotations

import struct

#: ID3v2 text encodings by their byte.
_TEXT = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
#: The tag keys of three systems for the fields of a track.
FIELDS = {
    "track_name": ("TIT2", "TITLE", "Title"),
    "album_name": ("TALB", "ALBUM", "Album"),
    "artist_name": ("TPE1", "ARTIST", "Artist"),
    "performer_name": ("TPE2", "PERFORMER", "Performer"),
    "composer_name": ("TCOM", "COMPOSER", "Composer"),
    "publisher": ("TPUB", "PUBLISHER", "Publisher"),
    "isrc": ("TSRC", "ISRC", "ISRC"),
    "year": ("TYER", "YEAR", "Year"),
}


def sync_safe(four: bytes) -> int:
    """A number in four bytes of 7 bits."""
    out = 0
    for b in four:
        out = out << 7 | b & 0x7F
    return out


def to_sync_safe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def from_id3v1(data: bytes) -> list[tuple[str, str]]:
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return []
    tag = data[-128:]
    text = lambda a, n: tag[a : a + n].split(b"\0")[0].decode("latin-1").rstrip()
    out = [("TITLE", text(3, 30)), ("ARTIST", text(33, 30)), ("ALBUM", text(63, 30)), ("YEAR", text(93, 4)), ("COMMENT", text(97, 28))]
    if not tag[125] and tag[126]:
        out.append(("TRACK", str(tag[126])))
    return [(k, v) for k, v in out if v]


def id3v2_size(data: bytes) -> int:
    """The bytes of all ID3v2 tags at the start."""
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        at += 10 + sync_safe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 0x10 else 0)
    return at


def from_id3v2(data: bytes) -> list[tuple[str, str]]:
    """Text frames of an ID3v2.2, 2.3 or 2.4 tag; several values of a frame are several items."""
    if data[:3] != b"ID3" or len(data) < 10:
        return []
    version = data[3]
    end, at, out = min(len(data), 10 + sync_safe(data[6:10])), 10, []
    key_len, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= end and data[at]:
        key = data[at : at + key_len].decode("latin-1")
        size = int.from_bytes(data[at + 3 : at + 6], "big") if version == 2 else sync_safe(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + head : min(end, at + head + size)]
        at += head + size
        if key[0] == "T" and body and body[0] in _TEXT:
            text = body[1:].decode(_TEXT[body[0]], "replace").rstrip("\0")
            out += [(key, v) for v in text.split("\0")]
    return out


def to_id3v2(items: list[tuple[str, str]]) -> bytes:
    """An ID3v2.4 tag of text frames in UTF-8."""
    body = b""
    for key, value in items:
        text = b"\x03" + value.encode()
        body += key.encode("latin-1") + to_sync_safe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + to_sync_safe(len(body)) + body


def from_vorbis(data: bytes) -> list[tuple[str, str]]:
    """The comments of a Vorbis comment block; keys in capitals."""
    try:
        at = 4 + struct.unpack_from("<I", data)[0]
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        out = []
        for _ in range(n):
            size = struct.unpack_from("<I", data, at)[0]
            key, eq, value = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
            at += 4 + size
            if eq:
                out.append((key.upper(), value))
    except struct.error:
        return []
    return out


def to_vorbis(items: list[tuple[str, str]], vendor: str = "tonearm") -> bytes:
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    return text(vendor) + struct.pack("<I", len(items)) + b"".join(text(f"{k}={v}") for k, v in items)


def from_ape(data: bytes) -> list[tuple[str, str]]:
    """The text items of an APEv2 tag, found by its footer."""
    at = data.rfind(b"APETAGEX")
    if at < 0 or len(data) < at + 32:
        return []
    _, size, n, flags = struct.unpack_from("<IIII", data, at + 8)
    pos = at if flags & 0x20000000 else at + 32 - size
    if flags & 0x20000000:
        pos += 32
    out = []
    for _ in range(n):
        if pos < 0 or pos + 8 > len(data):
            break
        length, kind = struct.unpack_from("<II", data, pos)
        stop = data.find(b"\0", pos + 8)
        if stop < 0:
            break
        if not kind >> 1 & 3:
            out += [(data[pos + 8 : stop].decode("latin-1"), v) for v in data[stop + 1 : stop + 1 + length].decode("utf-8", "replace").split("\0")]
        pos = stop + 1 + length
    return out


def to_ape(items: list[tuple[str, str]]) -> bytes:
    body = b"".join(struct.pack("<II", len(v.encode()), 0) + k.encode("latin-1") + b"\0" + v.encode() for k, v in items)
    return body + b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(items), 0) + bytes(8)


READERS = {"id3v1": from_id3v1, "id3v2": from_id3v2, "vorbis": from_vorbis, "ape": from_ape}


def sniff(data: bytes) -> str | None:
    """The format of a file by its first bytes, behind ID3v2 tags if there are any; null if unknown."""
    data = data[id3v2_size(data) :]
    marks = ((b"fLaC", "flac"), (b"wvpk", "wv"), (b"TTA1", "tta"), (b"MAC ", "ape"), (b".snd", "au"), (b"MPCK", "mpc"), (b"MP+", "mpc"))
    for mark, name in marks:
        if data.startswith(mark):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "wav"
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        return "aiff"
    if data[:4] == b"OggS":
        return "opus" if data[28:36] == b"OpusHead" else "flac" if data[29:33] == b"FLAC" else "ogg" if data[29:35] == b"vorbis" else None
    if data[4:8] == b"ftyp":
        return "alac" if b"alac" in data[:4096] else "m4a"
    if len(data) > 2 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0 and data[1] >> 1 & 3:
        return {1: "mp3", 2: "mp2"}.get(data[1] >> 1 & 3)
    return None
