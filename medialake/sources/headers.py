"""Sizes, dates, makers, lenses and places from the headers of pictures and videos, read by range in Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .files import opened

#: Seconds from 1904, where videos count from, to 1970.
VIDEO_EPOCH = 2_082_844_800
FIELDS = ("width", "height", "orientation", "taken_text", "make", "model", "duration", "created_at", "lens", "iso", "f_number", "exposure", "focal_length", "gps_lat", "gps_lon")
KINDS = "path string, width int, height int, orientation int, taken_text string, make string, model string, duration double, created_at double, lens string, iso int, f_number double, exposure double, focal_length double, gps_lat double, gps_lon double"
#: Tags of pictures, and of the block of the place.
TEXTS = {0x010F: "make", 0x0110: "model", 0x9003: "taken_text", 0xA434: "lens"}
NUMBERS = {0x829A: "exposure", 0x829D: "f_number", 0x920A: "focal_length"}
CAMERA_BLOCK, PLACE_BLOCK = 0x8769, 0x8825
ISO_6709 = re.compile(r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)")


def png(data) -> dict:
    w, h = struct.unpack(">II", data[16:24])
    return {"width": w, "height": h}


def entries(data, order: str, at: int) -> Iterator[tuple[int, object]]:
    """(tag, value) of a block: texts, whole numbers (one or several), fractions as pairs; other kinds are left out."""
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            return
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        letter, width = {2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("I", 8), 10: ("i", 8)}.get(kind, ("", 0))
        if not width or n > 4096:
            continue
        where = struct.unpack(order + "I", entry[8:])[0]
        raw = entry[8 : 8 + n * width] if n * width <= 4 else data[where : where + n * width]
        if kind == 2:
            yield tag, raw.replace(b"\0", b" ").decode("utf-8", "replace").strip() or None
        elif len(raw) == n * width and n:
            numbers = struct.unpack(order + letter * (n * width // struct.calcsize(letter)), raw)
            yield tag, numbers if kind < 5 else tuple(zip(numbers[::2], numbers[1::2]))


def fraction(value) -> float | None:
    if not value:
        return None
    one = value[0]
    return (one[0] / one[1] if one[1] else None) if isinstance(one, tuple) else float(one)


def place(tags: dict) -> dict:
    """Degrees from the tags of the place: reference letters 1 and 3, degrees, minutes and seconds 2 and 4."""
    out = {}
    for field, letter, value, negative in (("gps_lat", 1, 2, "S"), ("gps_lon", 3, 4, "W")):
        parts = tags.get(value)
        if isinstance(parts, tuple) and len(parts) >= 3:
            degrees = sum((fraction((p,)) or 0.0) / 60**k for k, p in enumerate(parts[:3]))
            degrees = -degrees if str(tags.get(letter) or "").upper().startswith(negative) else degrees
            if -180 <= degrees <= 180:
                out[field] = degrees
    return out


def exif(data) -> dict:
    """Maker, model, lens, orientation, date, exposure and place of a TIFF block; tags that can't be read are left out.

    Zero apertures, times and focal lengths are no measurements.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        return {}
    out: dict = {}
    todo, seen = [(struct.unpack(order + "I", data[4:8])[0], False)], set()
    while todo:
        at, here = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        found = {}
        for tag, value in entries(data, order, at):
            found[tag] = value
            if here:
                continue
            if tag in (CAMERA_BLOCK, PLACE_BLOCK) and isinstance(value, tuple):
                todo.append((value[0], tag == PLACE_BLOCK))
            elif tag in TEXTS and (value is None or isinstance(value, str)):
                out.setdefault(TEXTS[tag], value)
            elif tag == 0x0112 and isinstance(value, tuple) and isinstance(value[0], int):
                out["orientation"] = value[0] if 1 <= value[0] <= 8 else 1
            elif tag == 0x8827 and isinstance(value, tuple) and isinstance(value[0], int):
                out["iso"] = value[0]
            elif tag in NUMBERS and isinstance(value, tuple) and (fraction(value) or 0) > 0:
                out[NUMBERS[tag]] = fraction(value)
        if here:
            out |= place(found)
    return out


def jpeg(data) -> dict:
    out: dict = {}
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            out |= exif(body[6:])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", body[1:5])
            out |= {"width": w, "height": h}
            break
        at += 2 + size
    if (out.get("orientation") or 1) >= 5 and "width" in out:  # a quarter turn
        out["width"], out["height"] = out["height"], out["width"]
    return out


def boxes(data, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, name, head = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield name, at + head, min(end, at + size)
        at += size


def located(text: str) -> dict:
    """A place in the spelling of ISO 6709; (0, 0) is none."""
    m = ISO_6709.match(text.strip())
    lat, lon = (float(m[1]), float(m[2])) if m else (0.0, 0.0)
    return {"gps_lat": lat, "gps_lon": lon} if (lat or lon) and -90 <= lat <= 90 and -180 <= lon <= 180 else {}


def said(data, a: int, b: int) -> str:
    """A text of user data: its length, a language, then the text; some writers leave the first two out."""
    raw = data[a : min(b, a + 512)]
    n = struct.unpack(">H", raw[:2])[0] if len(raw) >= 4 else 0
    return (raw[4 : 4 + n] if 0 < n <= len(raw) - 4 else raw).decode("utf-8", "replace").strip("\0 ")


def named_values(data, a: int, b: int) -> dict[str, str]:
    """The values of a block of named items: a list of names, and boxes whose kind is the number of a name."""
    a += 0 if data[a + 4 : a + 8] == b"hdlr" else 4  # MP4 has version and flags first
    inside = {name: (x, y) for name, x, y in boxes(data, a, b)}
    if b"keys" not in inside or b"ilst" not in inside:
        return {}
    at, names, out = inside[b"keys"][0] + 8, [], {}
    for _ in range(min(256, struct.unpack(">I", data[at - 4 : at])[0])):
        size = struct.unpack(">I", data[at : at + 4])[0]
        if size < 8:
            break
        names.append(data[at + 8 : at + size].decode("utf-8", "replace"))
        at += size
    for kind, x, y in boxes(data, *inside[b"ilst"]):
        k = struct.unpack(">I", kind)[0]
        for name, u, v in boxes(data, x, y):
            if name == b"data" and 1 <= k <= len(names):
                out[names[k - 1]] = data[u + 8 : min(v, u + 520)].decode("utf-8", "replace").strip("\0")
    return out


def video(data) -> dict:
    """Size, length, date, maker and place of an ISO video; only the heads of other boxes are read."""
    out: dict = {}
    todo = [(0, len(data))]
    while todo:
        for name, a, b in boxes(data, *todo.pop()):
            if name in (b"moov", b"trak", b"udta"):
                todo.append((a, b))
            elif name == b"mvhd" and b - a >= 20:
                wide = data[a] == 1
                created, scale, length = struct.unpack(">QxxxxxxxxIQ" if wide else ">IxxxxII", data[a + 4 : a + 4 + (28 if wide else 16)])
                out["created_at"] = float(created - VIDEO_EPOCH) if created > VIDEO_EPOCH else None
                out["duration"] = length / scale if scale else None
            elif name == b"tkhd" and b - a >= 84:
                w, h = struct.unpack(">II", data[b - 8 : b])
                if w and h:
                    out |= {"width": w >> 16, "height": h >> 16}
            elif name == b"\xa9xyz":
                out |= located(said(data, a, b))
            elif name in (b"\xa9mak", b"\xa9mod"):
                out[{b"\xa9mak": "make", b"\xa9mod": "model"}[name]] = said(data, a, b) or None
            elif name == b"meta" and b - a >= 12:
                values = named_values(data, a, b)
                apple = "com.apple.quicktime."
                out |= located(values.get(apple + "location.ISO6709", "")) | {f: values[apple + f] for f in ("make", "model") if values.get(apple + f)}
    return out


def probe(data) -> dict:
    """What the header of a PNG, JPEG or ISO video says; {} for anything else, and for broken ones."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return png(data)
        if data[:2] == b"\xff\xd8":
            return jpeg(data)
        if data[4:8] in (b"ftyp", b"moov"):
            return video(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return exif(data)
    except (struct.error, IndexError):
        pass
    return {}


def probed(files: DataFrame) -> DataFrame:
    """path and FIELDS of listed files that have a readable header; a file is read in pages, where its header is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                if (data := opened(path)) is not None:
                    with data:
                        if found := probe(data):
                            rows.append((path, *(found.get(f) for f in FIELDS)))
            yield pd.DataFrame(rows, columns=["path", *FIELDS], dtype=object)

    return files.select("path").mapInPandas(run, KINDS)


def xmp(text: str) -> dict[str, str]:
    """Attributes and simple elements of an XMP packet."""
    found = re.findall(r'([A-Za-z]+:[A-Za-z]+)="([^"]*)"', text) + re.findall(r"<([A-Za-z]+:[A-Za-z]+)>([^<]*)</", text)
    return {k: v for k, v in found if not k.startswith("xmlns") and v.strip()}
