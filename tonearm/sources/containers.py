"""Sampled streams in WAV, AIFF and AU files: chunks, headers, samples, and writing them.

Bytes in, numpy arrays of shape (frames, channels) out, and back. A file that isn't what it claims to be raises
ValueError with the reason. Odd chunks are padded to even lengths on reading and writing; unknown chunks are kept in
the list of chunks, so that a rewritten file can carry them along.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The codec GUID tail of an extensible WAV header, and AU's codes for whole samples by their bits.
_EXTENSIBLE = bytes.fromhex("0100000000001000800000aa00389b71")
_AU_BITS = {2: 8, 3: 16, 4: 24, 5: 32}
#: Bits of a sample that all of the containers can hold.
WIDTHS = (8, 16, 24, 32)


@dataclass
class Sound:
    """A decoded stream. ``samples`` has a row for each frame; ``chunks`` are (name, bytes) besides format and data."""

    rate: int
    bits: int
    mask: int
    samples: np.ndarray
    chunks: list[tuple[bytes, bytes]] = field(default_factory=list)

    @property
    def channels(self) -> int:
        return self.samples.shape[1]


def whole(data: bytes, bits: int, big: bool, signed: bool) -> np.ndarray:
    """Samples of 8, 16, 24 or 32 bits from packed bytes; unsigned ones are moved to be around 0."""
    if bits not in WIDTHS:
        raise ValueError(f"samples of {bits} bits")
    step = bits // 8
    raw = np.frombuffer(data[: len(data) // step * step], np.uint8).reshape(-1, step).astype(np.int64)
    if big:
        raw = raw[:, ::-1]
    value = (raw << (8 * np.arange(step))).sum(axis=1)
    return np.where(value >= 1 << (bits - 1), value - (1 << bits), value) if signed else value - (1 << (bits - 1))


def width(samples: np.ndarray, least: int) -> int:
    """The fewest bits, from ``least`` on, that hold all of the samples; ValueError if no container has as many."""
    low, high = (int(samples.min()), int(samples.max())) if samples.size else (0, 0)
    for bits in WIDTHS:
        if bits >= least and -(1 << (bits - 1)) <= low and high < 1 << (bits - 1):
            return bits
    raise ValueError(f"a sample doesn't fit {WIDTHS[-1]} bits")


def packed(samples: np.ndarray, bits: int, big: bool, signed: bool) -> bytes:
    """The reverse of ``whole``; ValueError for samples out of range."""
    flat = np.asarray(samples, np.int64).reshape(-1)
    if flat.size and (flat.min() < -(1 << (bits - 1)) or flat.max() >= 1 << (bits - 1)):
        raise ValueError(f"a sample doesn't fit {bits} bits")
    value = flat % (1 << bits) if signed else flat + (1 << (bits - 1))
    out = ((value[:, None] >> (8 * np.arange(bits // 8))) & 255).astype(np.uint8)
    return (out[:, ::-1] if big else out).tobytes()


def chunks(data: bytes, big: bool) -> list[tuple[bytes, int, int]]:
    """(name, offset of the content, length) of the chunks of a RIFF or IFF file; a cut last chunk ends with the file."""
    at, out = 12, []
    while at + 8 <= len(data):
        name, size = struct.unpack_from(">4sI" if big else "<4sI", data, at)
        out.append((name, at + 8, min(size, len(data) - at - 8)))
        at += 8 + size + size % 2
    return out


def _framed(flat: np.ndarray, channels: int) -> np.ndarray:
    if not channels:
        raise ValueError("no channels")
    return flat[: len(flat) // channels * channels].reshape(-1, channels)


def from_wav(data: bytes) -> Sound:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    form = sound = None
    others = []
    for name, at, size in chunks(data, False):
        body = data[at : at + size]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            mask = 0
            if code == 0xFFFE:
                if body[24:40] != _EXTENSIBLE:
                    raise ValueError("not whole samples")
                mask = struct.unpack_from("<I", body, 20)[0]
            elif code != 1:
                raise ValueError("not whole samples")
            form = channels, rate, bits, mask
        elif name == b"data":
            if form is None:
                raise ValueError("data before the format")
            channels, rate, bits, mask = form
            sound = Sound(rate, bits, mask, _framed(whole(body, bits, False, bits > 8), channels))
        else:
            others.append((name, body))
    if sound is None:
        raise ValueError("no data")
    sound.chunks = others
    return sound


def _chunk(name: bytes, body: bytes, big: bool = False) -> bytes:
    return struct.pack(">4sI" if big else "<4sI", name, len(body)) + body + b"\0" * (len(body) % 2)


def to_wav(sound: Sound) -> bytes:
    step = sound.bits // 8 * sound.channels
    if sound.channels > 2 or sound.bits > 16:
        form = struct.pack("<HHIIHHHHI", 0xFFFE, sound.channels, sound.rate, sound.rate * step, step, sound.bits, 22, sound.bits, sound.mask) + _EXTENSIBLE
    else:
        form = struct.pack("<HHIIHH", 1, sound.channels, sound.rate, sound.rate * step, step, sound.bits)
    body = b"WAVE" + _chunk(b"fmt ", form) + b"".join(_chunk(*c) for c in sound.chunks) + _chunk(b"data", packed(sound.samples, sound.bits, False, sound.bits > 8))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_extended(ten: bytes) -> float:
    """An 80-bit float."""
    head, fraction = struct.unpack(">HQ", ten)
    sign, power = -1.0 if head >> 15 else 1.0, head & 0x7FFF
    return 0.0 if not power and not fraction else sign * fraction * 2.0 ** (power - 16383 - 63)


def to_extended(value: float) -> bytes:
    if not value:
        return bytes(10)
    fraction, power = np.frexp(abs(value))
    return struct.pack(">HQ", (0x8000 if value < 0 else 0) | int(power) + 16382, int(float(fraction) * (1 << 64)))


def from_aiff(data: bytes) -> Sound:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise ValueError("not an AIFF file")
    form = sound = None
    others = []
    for name, at, size in chunks(data, True):
        body = data[at : at + size]
        if name == b"COMM":
            channels, _, bits = struct.unpack_from(">hIh", body)
            form = channels, int(from_extended(body[8:18])), bits, body[18:22] == b"sowt"
        elif name == b"SSND":
            if form is None:
                raise ValueError("data before the format")
            channels, rate, bits, little = form
            skip = struct.unpack_from(">I", body)[0]
            sound = Sound(rate, bits, 0, _framed(whole(body[8 + skip :], bits, not little, True), channels))
        else:
            others.append((name, body))
    if sound is None:
        raise ValueError("no data")
    sound.chunks = others
    return sound


def to_aiff(sound: Sound) -> bytes:
    form = struct.pack(">hIh", sound.channels, len(sound.samples), sound.bits) + to_extended(sound.rate)
    body = b"AIFF" + _chunk(b"COMM", form, True) + b"".join(_chunk(*c, True) for c in sound.chunks) + _chunk(b"SSND", bytes(8) + packed(sound.samples, sound.bits, True, True), True)
    return b"FORM" + struct.pack(">I", len(body)) + body


def from_au(data: bytes) -> Sound:
    if data[:4] != b".snd":
        raise ValueError("not an AU file")
    at, size, code, rate, channels = struct.unpack_from(">IIIII", data, 4)
    if code not in _AU_BITS:
        raise ValueError("not whole samples")
    body = data[at:] if size == 0xFFFFFFFF else data[at : at + size]
    return Sound(rate, _AU_BITS[code], 0, _framed(whole(body, _AU_BITS[code], True, True), channels))


def to_au(sound: Sound) -> bytes:
    body = packed(sound.samples, sound.bits, True, True)
    return struct.pack(">4sIIIII", b".snd", 24, len(body), {b: c for c, b in _AU_BITS.items()}[sound.bits], sound.rate, sound.channels) + body


READERS = {"wav": from_wav, "aiff": from_aiff, "au": from_au}
WRITERS = {"wav": to_wav, "aiff": to_aiff, "au": to_au}


def faults(data: bytes) -> list[str]:
    """What is wrong with a WAV or AIFF file's structure; nothing for a sound one."""
    big = data[:4] == b"FORM"
    if not big and data[:4] != b"RIFF":
        return ["neither RIFF nor FORM"]
    out = []
    said = struct.unpack_from(">I" if big else "<I", data, 4)[0] if len(data) >= 8 else 0
    if said + 8 != len(data):
        out.append(f"{len(data)} bytes, the header says {said + 8}")
    seen = [n for n, _, _ in chunks(data, big)]
    form, body = (b"COMM", b"SSND") if big else (b"fmt ", b"data")
    for name in (form, body):
        if seen.count(name) != 1:
            out.append(f"{seen.count(name)} chunks {name.decode().strip()}")
    if form in seen and body in seen and seen.index(form) > seen.index(body):
        out.append("data before the format")
    return out
