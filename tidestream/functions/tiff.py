"""Reading and writing the TIFF files of the camera: 8-bit gray or RGB in strips, with dates and positions."""

from __future__ import annotations

import functools
import struct
import zlib
from fractions import Fraction
from typing import Any

import numpy as np

# Tag numbers, and byte sizes and codes of their value types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
DATE_TIME, GPS = 306, 34853
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
SIZES = {code: struct.calcsize("=" + code) for code in TYPES.values()}


class Tiff:
    """Tags of the first image (and its GPS part), and where the file ends."""

    def __init__(self, data: bytes):
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        self.data, self.order, self.end = data, order, 8
        self.tags = self._directory(struct.unpack_from(f"{order}I", data, 4)[0])
        self.gps = self._directory(self.tags[GPS][0]) if GPS in self.tags else {}
        if STRIP_OFFSETS in self.tags and STRIP_SIZES in self.tags:
            self.end = max(self.end, *(a + n for a, n in zip(self.tags[STRIP_OFFSETS], self.tags[STRIP_SIZES], strict=True)))

    def _directory(self, at: int) -> dict[int, Any]:
        (count,) = struct.unpack_from(f"{self.order}H", self.data, at)
        self.end = max(self.end, at + 6 + 12 * count)
        entries = struct.unpack_from(self.order + "HHII" * count, self.data, at + 2)
        return dict(self._entry(at + 10 + 12 * k, *entries[4 * k : 4 * k + 4]) for k in range(count))

    def _entry(self, where: int, tag: int, kind: int, count: int, pointer: int) -> tuple[int, Any]:
        """The value is at where, or at pointer if it is longer than that."""
        code = TYPES.get(kind, "B")
        size = count * SIZES[code]
        if size > 4:
            where = pointer
            self.end = max(self.end, where + size)
        elif kind == 4 and count == 1:
            return tag, (pointer,)
        if code == "s":
            return tag, bytes(self.data[where : where + count]).split(b"\0")[0].decode("latin-1")
        values = struct.unpack_from(f"{self.order}{code * count}", self.data, where)
        if len(code) == 2:
            values = tuple(Fraction(a, b) if b else Fraction(0) for a, b in zip(values[::2], values[1::2], strict=True))
        return tag, values

    def pixels(self) -> np.ndarray:
        """Height x width x samples."""
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        if set(self.tags.get(BITS, (8,))) != {8}:
            raise ValueError("only 8 bits a sample are read")
        width, length, samples, packed = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(COMPRESSION, 1)
        strips = [bytes(self.data[a : a + n]) for a, n in zip(self.tags[STRIP_OFFSETS], self.tags[STRIP_SIZES], strict=True)]
        if packed in (8, 32946):
            strips = [zlib.decompress(s) for s in strips]
        elif packed == 32773:
            strips = [_unpack_bits(s) for s in strips]
        elif packed != 1:
            raise ValueError(f"compression {packed} is not read")
        return np.frombuffer(b"".join(strips), np.uint8, width * length * samples).reshape(length, width, samples)


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def of_file(data: bytes) -> Tiff:
    """The tags of a TIFF, or of those that a JPEG carries."""
    if data[:2] != b"\xff\xd8":
        return Tiff(data)
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        (size,) = struct.unpack_from(">H", data, at + 2)
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return Tiff(data[at + 10 : at + 2 + size])
        at += 2 + size
    raise ValueError("no tags")


def encode(pixels: np.ndarray, date_time: str | None = None, position: tuple[tuple, str, tuple, str] | None = None) -> bytes:
    """An uncompressed little-endian TIFF. position: latitude as degrees, minutes, seconds, its reference, and the longitude's."""
    pixels = np.ascontiguousarray(pixels if pixels.ndim == 3 else pixels[:, :, None], np.uint8)
    return _head(pixels.shape, date_time, position and tuple(x if isinstance(x, str) else tuple(x) for x in position)) + pixels.tobytes()


@functools.lru_cache(maxsize=64)
def _head(shape: tuple[int, int, int], date_time: str | None, position: tuple[tuple, str, tuple, str] | None) -> bytes:
    """What comes before the pixels."""
    height, width, samples = shape
    entries: list[tuple[int, int, Any]] = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (STRIP_OFFSETS, 4, [0]), (SAMPLES, 3, [samples]), (ROWS_PER_STRIP, 4, [height]), (STRIP_SIZES, 4, [height * width * samples])]
    if date_time is not None:
        entries.append((DATE_TIME, 2, date_time.encode() + b"\0"))
    if position is not None:
        entries.append((GPS, 4, [0]))
    size_of = lambda es: 6 + 12 * len(es) + sum(n + n % 2 for _, _, v in es if (n := len(v)) > 4 and isinstance(v, bytes))

    def packed(kind: int, value: Any) -> bytes:
        if isinstance(value, bytes):
            return value
        if kind == 5:
            return b"".join(struct.pack("<II", f.numerator, f.denominator) for f in (Fraction(x).limit_denominator(10**6) for x in value))
        return struct.pack(f"<{len(value)}{TYPES[kind]}", *value)

    entries = [(tag, kind, packed(kind, v)) for tag, kind, v in entries]
    gps: list[tuple[int, int, Any]] = []
    if position is not None:
        lat, lat_ref, lon, lon_ref = position
        gps = [(tag, kind, packed(kind, v)) for tag, kind, v in ((LAT_REF, 2, lat_ref.encode() + b"\0"), (LAT, 5, lat), (LON_REF, 2, lon_ref.encode() + b"\0"), (LON, 5, lon))]
    gps_at = 8 + size_of(entries)
    data_at = gps_at + (size_of(gps) if gps else 0)
    known = {STRIP_OFFSETS: struct.pack("<I", data_at), GPS: struct.pack("<I", gps_at)}

    def directory(es: list, at: int) -> bytes:
        rows, more, free = struct.pack("<H", len(es)), b"", at + 6 + 12 * len(es)
        for tag, kind, value in es:
            value = known.get(tag, value) if kind == 4 else value
            count = len(value) // struct.calcsize("=" + TYPES[kind]) if kind != 2 else len(value)
            if len(value) > 4:
                inline, value = struct.pack("<I", free + len(more)), value + b"\0" * (len(value) % 2)
                more += value
            else:
                inline = value.ljust(4, b"\0")
            rows += struct.pack("<HHI", tag, kind, count) + inline
        return rows + struct.pack("<I", 0) + more

    return b"II*\0" + struct.pack("<I", 8) + directory(entries, 8) + (directory(gps, gps_at) if gps else b"")
