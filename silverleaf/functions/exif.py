"""EXIF blocks of image files, read from their bytes: a TIFF directory, wherever it is packed."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

#: Bytes and struct code of each TIFF value type; 2 is text, 7 raw bytes, 5 and 10 fractions.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
#: Directories that a tag points to, and the names under which they are nested.
NESTED = {0x8769: "ExifIFD", 0x8825: "GPSIFD"}
#: Names of the common tags of the EXIF standard; others are named by number.
NAMES = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation",
    0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x0213: "YCbCrPositioning", 0x8298: "Copyright",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue",
    0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubsecTime",
    0xA000: "FlashPixVersion", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA217: "SensingMethod", 0xA401: "CustomRendered", 0xA402: "ExposureMode",
    0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_NAMES = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 8: "GPSSatellites",
    12: "GPSSpeedRef", 13: "GPSSpeed", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 27: "GPSProcessingMethod", 29: "GPSDateStamp",
}
SHORTEST = 14


def block(data: bytes) -> bytes | None:
    """The TIFF block of a JPEG, PNG or TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _directory(tiff: bytes, at: int, order: str) -> Iterator[tuple[int, int, list]]:
    """(tag, type, values) of one directory; entries that point outside the block are left out."""
    if not 0 < at <= len(tiff) - 2:
        return
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(min(n, (len(tiff) - at - 2) // 12)):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        width, code = TYPES.get(kind, (0, ""))
        place = at + 10 + 12 * k
        if width * count > 4:
            (place,) = struct.unpack_from(order + "I", tiff, place)
        if not width or place + width * count > len(tiff):
            continue
        raw = tiff[place : place + width * count]
        if code == "s":
            yield tag, kind, [raw]
        else:
            numbers = struct.unpack(order + code * count, raw)
            yield tag, kind, [a / b if b else 0.0 for a, b in zip(numbers[::2], numbers[1::2])] if len(code) == 2 else list(numbers)


def _text(raw: bytes, kind: int) -> str:
    raw = raw.rstrip(b"\0") if kind == 2 else raw
    return raw.decode("utf-8", "strict") if _is_utf8(raw) else raw.decode("latin-1")


def _is_utf8(raw: bytes) -> bool:
    return raw.decode("utf-8", "replace").encode("utf-8") == raw


def fields(data: bytes | None) -> list[tuple[str, str, object]]:
    """(section, name, value) of every tag; the section of the first directory is empty."""
    tiff = block(data or b"")
    if tiff is None or len(tiff) < SHORTEST:
        return []
    order = "<" if tiff[:2] == b"II" else ">"
    out, todo = [], [("", struct.unpack_from(order + "I", tiff, 4)[0])]
    while todo:
        section, at = todo.pop(0)
        names = GPS_NAMES if section == "GPSIFD" else NAMES
        for tag, kind, values in _directory(tiff, at, order):
            if not section and tag in NESTED:
                todo += [(NESTED[tag], values[0])] if values and isinstance(values[0], int) else []  # else it points nowhere
                continue
            plain = [_text(v, kind) if isinstance(v, bytes) else v for v in values]
            out.append((section, names.get(tag, f"Tag_0x{tag:04x}"), plain[0] if len(plain) == 1 else plain))
    return out


def document(data: bytes | None) -> str | None:
    """The fields as indented JSON, sections nested; None without any."""
    found: dict = {}
    for section, name, value in fields(data):
        (found.setdefault(section, {}) if section else found)[name] = value
    return json.dumps(found, indent=2, ensure_ascii=False) if found else None
