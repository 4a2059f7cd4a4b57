"""Typed metadata from the headers of media files, as an Arrow operator over paths or contents.

Every container becomes a list of tagged spans (JPEG segments, PNG and RIFF chunks, TIFF directories, ISO boxes); what is read from
spans goes into one flat record. Readers never raise: a failure leaves `extractor` = error and structure_ok null.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

Read = Callable[[int, int], bytes]

_TYPES = {"S": StringType(), "L": LongType(), "I": IntegerType(), "D": DoubleType(), "B": BooleanType()}
_FIELDS = "format S,width L,height L,orientation I,make S,model S,software S,date_taken S,date_taken_ts L,date_source S,user_comment S,content_id S,duration_ms L,codec S,bitrate L,fps D,has_preview B,preview_kind S,preview_offset L,preview_length L,camera_known B,structure_ok B,extractor S"
MEDIA_INFO = StructType([StructField(n, _TYPES[t]) for n, t in (x.split() for x in _FIELDS.split(","))])

# Brands, TIFF tags and codes of the formats.
HEIF_BRANDS = {b"heic", b"heix", b"hevc", b"hevx", b"heim", b"heis", b"hevm", b"hevs", b"mif1", b"msf1", b"avif", b"avis"}
TAG = {"width": 0x100, "height": 0x101, "make": 0x10F, "model": 0x110, "strip": 0x111, "orientation": 0x112, "strip_bytes": 0x117, "software": 0x131, "modified": 0x132, "subs": 0x14A, "thumb": 0x201, "thumb_bytes": 0x202, "exif": 0x8769, "original": 0x9003, "maker": 0x927C, "comment": 0x9286, "exif_width": 0xA002, "exif_height": 0xA003, "compression": 0x103}
APPLE_CONTENT_ID = 0x11
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
# Sample entry names of video tracks and the codecs that they stand for.
CODECS = {
    b"hvc1": "hevc",
    b"hev1": "hevc",
    b"avc1": "h264",
    b"avc3": "h264",
    b"mp4v": "mpeg4",
    b"av01": "av1",
    b"vp09": "vp9",
    b"jpeg": "mjpeg",
    b"mjpa": "mjpeg",
    b"apch": "prores",
    b"apcn": "prores",
    b"apcs": "prores",
    b"apco": "prores",
    b"ap4h": "prores",
    b"s263": "h263",
    b"dvhe": "hevc",
    b"dvh1": "hevc",
}
RAW_TIFF = {"cr2", "nef", "arw", "pef", "srw", "dng", "orf", "rw2"}
MAC_EPOCH = datetime(1904, 1, 1, tzinfo=UTC)
EXIF_DATE = re.compile(r"\s*(\d{4})[:\-/](\d\d)[:\-/](\d\d)[ T](\d\d):(\d\d):(\d\d)")
LOCAL_DATE = re.compile(r"\s*(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)")


def sniff_format(head: Column, ext: Column) -> Column:
    """The container family from magic bytes, on the JVM; the extension only tells TIFF-based RAW files apart."""

    def starts(*magics: bytes, at: int = 1) -> Column:
        out = F.lit(False)
        for m in magics:
            out = out | (F.substring(head, at, len(m)) == F.lit(bytearray(m)))
        return out

    boxed = starts(b"ftyp", at=5)
    return (
        F.when(starts(b"\xff\xd8"), "jpeg")
        .when(starts(b"\x89PNG\r\n\x1a\n"), "png")
        .when(starts(b"RIFF") & starts(b"WEBP", at=9), "webp")
        .when(starts(b"GIF87a", b"GIF89a"), "gif")
        .when(starts(b"II*\x00", b"MM\x00*", b"IIRO", b"MMOR", b"IIRS", b"IIU\x00"), F.when(ext.isin(*RAW_TIFF), ext).otherwise("tiff"))
        .when(starts(b"FUJIFILMCCD-RAW "), "raf")
        .when(boxed & starts(b"crx ", at=9), "crx")
        .when(boxed & starts(*sorted(HEIF_BRANDS), at=9), "heif")
        .when(boxed | starts(b"moov", b"mdat", b"wide", b"free", b"skip", b"pnot", at=5), "isobmff")
        .otherwise("unknown")
    )


def family(head: bytes) -> str:
    """`sniff_format` for bytes at hand."""
    if head[4:8] == b"ftyp":
        return "crx" if head[8:12] == b"crx " else "heif" if head[8:12] in HEIF_BRANDS else "isobmff"
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    known = {"jpeg": (b"\xff\xd8",), "png": (b"\x89PNG\r\n\x1a\n",), "gif": (b"GIF87a", b"GIF89a"), "tiff": (b"II*\x00", b"MM\x00*", b"IIRO", b"MMOR", b"IIRS", b"IIU\x00"), "raf": (b"FUJIFILMCCD-RAW ",)}
    for name, magics in known.items():
        if head.startswith(magics):
            return name
    return "isobmff" if len(head) >= 8 and head[4:8] in (b"moov", b"mdat", b"wide", b"free", b"skip", b"pnot") else "unknown"


def clean(value: object, limit: int = 200) -> str | None:
    """Text up to the first NUL, trimmed and cut; null if nothing is left."""
    if isinstance(value, bytes):
        value = value.decode("utf-8", "replace")
    return str(value).partition("\0")[0].strip()[:limit] or None if value is not None else None


def exif_iso(text: str | None) -> str | None:
    found = EXIF_DATE.match(text or "")
    if not found:
        return None
    y, mo, d, h, mi, s = map(int, found.groups())
    fine = y >= 1900 and 1 <= mo <= 12 and 1 <= d <= 31 and h < 24 and mi < 60 and s < 60
    return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}" if fine else None


#: Bytes of a directory's value that are read; a longer one is left out.
MOST_VALUE = 4 << 20


def directory(read: Read, base: int, at: int, order: str) -> tuple[dict[int, object], int]:
    """tag -> value of a TIFF directory, and where the next one is. Offsets count from `base`; anything out of bounds is left out."""
    raw = read(base + at, 2)
    if len(raw) < 2:
        return {}, 0
    count = struct.unpack(order + "H", raw)[0]
    rows, out = read(base + at + 2, 12 * count + 4), {}
    for k in range(min(count, len(rows) // 12)):
        tag, kind, n = struct.unpack_from(order + "HHI", rows, 12 * k)
        length = SIZES.get(kind, 0) * n
        if not 0 < length <= MOST_VALUE:
            continue
        own = rows[12 * k + 8 : 12 * k + 12] if length <= 4 else read(base + struct.unpack_from(order + "I", rows, 12 * k + 8)[0], length)
        own = own[:length]
        if len(own) < length:
            continue
        if kind == 2:
            out[tag] = clean(own)
        elif kind == 7:
            out[tag] = own
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * n, own)
            out[tag] = list(zip(pairs[::2], pairs[1::2], strict=True))
        else:
            values = struct.unpack(order + CODES[kind] * n, own)
            out[tag] = values[0] if n == 1 else list(values)
    following = struct.unpack_from(order + "I", rows, 12 * count)[0] if len(rows) >= 12 * count + 4 else 0
    return out, following


def user_comment(raw: bytes, order: str) -> str | None:
    """The text behind an 8-byte character code; without a known code, all of it."""
    codes = {b"ASCII": "ascii", b"UNICODE": "utf-16-be" if order == ">" else "utf-16-le", b"JIS": "iso2022_jp", b"\0" * 8: "utf-8"}
    for code, encoding in codes.items():
        if raw[:8].startswith(code):
            body = raw[8:]
            marked = encoding.startswith("utf-16") and body[:2] in (b"\xff\xfe", b"\xfe\xff")
            return clean(body.decode("utf-16" if marked else encoding, "replace"), 1000)
    return clean(raw, 1000)


def apply_tiff(info: dict, read: Read, base: int) -> tuple[dict[int, object], str]:
    """Puts what the TIFF structure at `base` says into `info`; gives its first directory and byte order."""
    order = {b"II": "<", b"MM": ">"}.get(read(base, 2))
    head = read(base, 8)
    if order is None or len(head) < 8:
        return {}, "<"
    first, following = directory(read, base, struct.unpack(order + "I", head[4:8])[0], order)
    exif = directory(read, base, first[TAG["exif"]], order)[0] if isinstance(first.get(TAG["exif"]), int) else {}
    for name in ("make", "model", "software"):
        info[name] = clean(first.get(TAG[name]))
    if isinstance(first.get(TAG["orientation"]), int) and first[TAG["orientation"]]:
        info["orientation"] = first[TAG["orientation"]]
    comment, maker = exif.get(TAG["comment"]), exif.get(TAG["maker"])
    info["user_comment"] = user_comment(comment, order) if isinstance(comment, bytes) else clean(comment, 1000)
    taken = exif_iso(exif.get(TAG["original"])) or exif_iso(first.get(TAG["modified"]))
    if taken:
        info |= {"date_taken": taken, "date_source": "exif"}
    if isinstance(maker, bytes) and maker.startswith(b"Apple iOS\0") and len(maker) >= 16:
        apple = directory(lambda at, n: maker[at : at + n] if at >= 0 else b"", 0, 14, "<" if maker[12:14] == b"II" else ">")[0]
        info["content_id"] = clean(apple.get(APPLE_CONTENT_ID)) or info.get("content_id")
    if not info.get("width") and isinstance(exif.get(TAG["exif_width"]), int):
        info |= {"width": exif[TAG["exif_width"]], "height": exif.get(TAG["exif_height"])}
    if following and "_thumb" in info:
        second = directory(read, base, following, order)[0]
        if isinstance(second.get(TAG["thumb"]), int) and isinstance(second.get(TAG["thumb_bytes"]), int):
            info["_thumb"] = (base + second[TAG["thumb"]], second[TAG["thumb_bytes"]])
    return {**first}, order


def preview(info: dict, offset: int, length: int, size: int, kind: str = "jpeg") -> None:
    if length > 0 and 0 < offset and offset + length <= size:
        info |= {"has_preview": True, "preview_kind": kind, "preview_offset": offset, "preview_length": length}


def jpeg(read: Read, size: int) -> dict:
    """Segments up to the scan; sound if a frame header and a scan were met."""
    info = {"format": "jpeg", "extractor": "jpeg", "camera_known": True, "_thumb": None}
    at, frame, scan, exif = 2, False, False, False
    while at + 4 <= size and not scan:
        lead, marker, length = struct.unpack(">BBH", read(at, 4).ljust(4, b"\0"))
        if lead != 0xFF or marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        if marker == 1 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        if length < 2 or at + 2 + length > size:
            break
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and length >= 7:
            info["height"], info["width"] = struct.unpack(">HH", read(at + 5, 4))
            frame = True
        elif marker == 0xE1 and not exif and read(at + 4, 6) == b"Exif\0\0":
            exif = True
            start, stop = at + 10, at + 2 + length
            sizes = {k: info.get(k) for k in ("width", "height")}
            apply_tiff(info, lambda a, n, start=start, stop=stop: read(a, min(n, stop - a)) if start <= a < stop else b"", start)
            info |= {k: v for k, v in sizes.items() if v}
        scan = marker == 0xDA
        at += 2 + length
    if info["_thumb"]:
        preview(info, *info["_thumb"], size)
    return info | {"structure_ok": frame and scan}


def png(read: Read, size: int) -> dict:
    """Chunks; sound if header, data and end were met. Texts and EXIF may also stand behind the image data."""
    info, seen = {"format": "png", "extractor": "png", "camera_known": True}, set()
    texts: dict[str, str] = {}
    at = 8
    while at + 12 <= size:
        length, kind = struct.unpack(">I4s", read(at, 8))
        seen.add(kind)
        if kind == b"IHDR":
            info["width"], info["height"] = struct.unpack(">II", read(at + 8, 8))
        elif kind == b"eXIf":
            apply_tiff(info, read, at + 8)
        elif kind in (b"tEXt", b"iTXt"):
            key, _, rest = read(at + 8, min(length, 1 << 16)).partition(b"\0")
            if kind == b"iTXt":
                rest = rest[2:].split(b"\0", 2)[-1]
            texts[key.decode("latin-1").lower()] = clean(rest, 1000) or ""
        if kind == b"IEND":
            break
        at += 12 + length
    info["user_comment"] = info.get("user_comment") or texts.get("comment") or texts.get("usercomment")
    info["software"] = info.get("software") or texts.get("software")
    return info | {"structure_ok": {b"IHDR", b"IDAT", b"IEND"} <= seen}


def webp(read: Read, size: int) -> dict:
    info, at, found = {"format": "webp", "extractor": "webp", "camera_known": True}, 12, False
    while at + 8 <= size:
        kind, length = struct.unpack("<4sI", read(at, 8))
        body = read(at + 8, 10)
        if kind == b"VP8X" and len(body) == 10:
            info["width"], info["height"] = int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
            found = True
        elif kind == b"VP8 " and len(body) == 10 and body[3:6] == b"\x9d\x01\x2a":
            info.setdefault("width", struct.unpack("<H", body[6:8])[0] & 0x3FFF)
            info.setdefault("height", struct.unpack("<H", body[8:10])[0] & 0x3FFF)
            found = True
        elif kind == b"VP8L" and body[:1] == b"\x2f":
            bits = int.from_bytes(body[1:5], "little")
            info.setdefault("width", (bits & 0x3FFF) + 1)
            info.setdefault("height", (bits >> 14 & 0x3FFF) + 1)
            found = True
        elif kind == b"EXIF":
            apply_tiff(info, read, at + 8 + 6 * (body[:6] == b"Exif\0\0"))
        at += 8 + length + (length & 1)
    return info | {"structure_ok": found}


def gif(read: Read, size: int) -> dict:
    head = read(0, 10)
    sized = len(head) == 10
    width, height = struct.unpack("<HH", head[6:10]) if sized else (None, None)
    return {"format": "gif", "extractor": "gif", "camera_known": True, "width": width, "height": height, "structure_ok": sized and read(size - 1, 1) == b";"}


def tiff(read: Read, size: int, fmt: str = "tiff") -> dict:
    """The largest image of the first directory and its sub-directories; a JPEG strip among them is the preview."""
    info = {"format": fmt, "extractor": "tiff", "camera_known": fmt in ("tiff", "dng")}
    first, order = apply_tiff(info, read, 0)
    subs = first.get(TAG["subs"], [])
    tables = [first] + [directory(read, 0, at, order)[0] for at in (subs if isinstance(subs, list) else [subs])[:8]]
    area = 0
    for own in tables:
        w, h = own.get(TAG["width"]), own.get(TAG["height"])
        if isinstance(w, int) and isinstance(h, int) and w * h > area:
            area = w * h
            info["width"], info["height"] = w, h
        for where, length in ((TAG["thumb"], TAG["thumb_bytes"]), (TAG["strip"], TAG["strip_bytes"])):
            at, n = own.get(where), own.get(length)
            if isinstance(at, int) and isinstance(n, int) and n > (info.get("preview_length") or 0) and read(at, 2) == b"\xff\xd8":
                preview(info, at, n, size)
    return info | {"structure_ok": bool(first)}


def boxes(read: Read, start: int, end: int, most: int = 10_000) -> Iterator[tuple[bytes, int, int]]:
    """type, first byte of the content, end of every ISO box between `start` and `end`."""
    at = start
    for _ in range(most):
        head = read(at, 16)
        if at + 8 > end or len(head) < 8:
            return
        length, kind = struct.unpack(">I4s", head[:8])
        lead = 8
        if length == 1 and len(head) == 16:
            length, lead = struct.unpack(">Q", head[8:16])[0], 16
        stop = end if length == 0 else at + length
        if stop > end or stop < at + lead:
            return
        yield kind, at + lead, stop
        at = stop


def find(read: Read, start: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
    """Contents of all boxes under a path of types."""
    for kind, a, b in boxes(read, start, end):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from find(read, a + 4 * (kind == b"meta"), b, *path[1:])


def number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def heif(read: Read, size: int) -> dict:
    """Primary item's size and rotation, EXIF item and thumbnail of a HEIF file."""
    info = {"format": "heic", "extractor": "isobmff", "camera_known": True, "_thumb": None}
    meta = next(find(read, 0, size, b"meta"), None)
    if meta is None:
        return info | {"structure_ok": False}
    parts = {kind: (a, b) for kind, a, b in boxes(read, meta[0] + 4, meta[1])}
    primary = None
    if b"pitm" in parts:
        a = parts[b"pitm"][0]
        primary = number(read(a + 4, 2 if read(a, 1) == b"\0" else 4))
    kinds: dict[int, bytes] = {}
    if b"iinf" in parts:
        a, b = parts[b"iinf"]
        for kind, x, _ in boxes(read, a + (6 if read(a, 1) == b"\0" else 8), b):
            if kind == b"infe" and number(read(x, 1)) >= 2:
                wide = 4 if number(read(x, 1)) == 3 else 2
                kinds[number(read(x + 4, wide))] = read(x + 6 + wide, 4)
    places = item_places(read, parts[b"iloc"]) if b"iloc" in parts else {}
    props, owned = [], {}
    if b"iprp" in parts:
        for kind, a, b in boxes(read, *parts[b"iprp"]):
            if kind == b"ipco":
                props = list(boxes(read, a, b))
            elif kind == b"ipma":
                owned |= property_links(read, a, b)
    for k in owned.get(primary, []):
        if 0 < k <= len(props):
            kind, a, _ = props[k - 1]
            if kind == b"ispe":
                info["width"], info["height"] = number(read(a + 4, 4)), number(read(a + 8, 4))
            elif kind == b"irot":
                info["orientation"] = {0: None, 1: 8, 2: 3, 3: 6}[number(read(a, 1)) & 3]
    rotation, sizes = info.get("orientation"), (info.get("width"), info.get("height"))
    for item, kind in kinds.items():
        if kind == b"Exif" and item in places:
            at, length = places[item]
            start = at + 4 + number(read(at, 4))
            apply_tiff(info, lambda a, n, end=at + length: read(a, min(n, max(0, end - a))), start)
            if sizes[0]:
                info["width"], info["height"] = sizes
            info["orientation"] = rotation or info.get("orientation")
    if b"iref" in parts:
        a, b = parts[b"iref"]
        wide = 2 if read(a, 1) == b"\0" else 4
        for kind, x, _ in boxes(read, a + 4, b):
            if kind == b"thmb" and number(read(x + wide + 2, wide)) == primary and number(read(x, wide)) in places:
                preview(info, *places[number(read(x, wide))], size, "heif_thumb")
    return info | {"structure_ok": primary is not None and primary in places and any(k == b"mdat" or k == b"idat" for k, _, _ in boxes(read, 0, size)) or bool(parts.get(b"idat"))}


def item_places(read: Read, span: tuple[int, int]) -> dict[int, tuple[int, int]]:
    """item -> offset and length of its first extent, for items stored by file offset."""
    a, b = span
    data = read(a, min(b - a, 1 << 20))
    version, sizes = data[0], data[4:6]
    widths = [sizes[0] >> 4, sizes[0] & 15, sizes[1] >> 4, sizes[1] & 15 if version else 0]
    at, out = 6, {}

    def take(n: int) -> int:
        nonlocal at
        at += n
        return number(data[at - n : at])

    for _ in range(take(4 if version == 2 else 2)):
        item = take(4 if version == 2 else 2)
        method = take(2) & 15 if version else 0
        take(2)
        base = take(widths[2])
        for k in range(take(2)):
            take(widths[3])
            offset, length = take(widths[0]), take(widths[1])
            if k == 0 and method == 0:
                out[item] = (base + offset, length)
    return out


def property_links(read: Read, a: int, b: int) -> dict[int, list[int]]:
    data = read(a, min(b - a, 1 << 20))
    item_bytes, wide = (4 if data[0] else 2), data[3] & 1
    at, out = 8, {}
    for _ in range(number(data[4:8])):
        item, n = number(data[at : at + item_bytes]), data[at + item_bytes] if at + item_bytes < len(data) else 0
        at += item_bytes + 1
        step = 2 if wide else 1
        out[item] = [number(data[at + k * step : at + (k + 1) * step]) & (0x7FFF if wide else 0x7F) for k in range(n)]
        at += n * step
    return out


def video_track(read: Read, a: int, b: int) -> dict:
    """Handler, codec, size, rotation and timing of a track."""
    own: dict = {"handler": b"", "codec": b"", "scale": 0, "length": 0, "samples": 0, "rotation": 0}
    for x, y in find(read, a, b, b"tkhd"):
        long = read(x, 1) == b"\1"
        data = read(x + (52 if long else 40), 44)
        if len(data) == 44:
            m = struct.unpack(">9i", data[:36])
            own["rotation"] = {(0, 1): 90, (-1, 0): 180, (0, -1): 270}.get(((m[0] > 0) - (m[0] < 0), (m[1] > 0) - (m[1] < 0)), 0)
            own["width"], own["height"] = number(data[36:38]), number(data[40:42])
    for x, y in find(read, a, b, b"mdia", b"mdhd"):
        long = read(x, 1) == b"\1"
        own["scale"], own["length"] = (number(read(x + 20, 4)), number(read(x + 24, 8))) if long else (number(read(x + 12, 4)), number(read(x + 16, 4)))
    for x, y in find(read, a, b, b"mdia", b"hdlr"):
        own["handler"] = read(x + 8, 4)
    for x, y in find(read, a, b, b"mdia", b"minf", b"stbl", b"stsd"):
        own["codec"] = read(x + 12, 4)
        if read(x + 40, 4):
            own["width"] = number(read(x + 40, 2)) or own.get("width")
            own["height"] = number(read(x + 42, 2)) or own.get("height")
    for x, y in find(read, a, b, b"mdia", b"minf", b"stbl", b"stts"):
        data = read(x + 8, min(8 * number(read(x + 4, 4)), y - x - 8, 1 << 20))
        own["samples"] = sum(number(data[k : k + 4]) for k in range(0, len(data) - 7, 8))
    return own


def named_values(read: Read, a: int, b: int) -> dict[str, str]:
    """Values of a metadata box by the names of its key table."""
    start = a if read(a + 4, 4) == b"hdlr" else a + 4
    names: list[str] = []
    out: dict[str, str] = {}
    for x, y in find(read, start, b, b"keys"):
        names += [read(p, q - p).decode("utf-8", "replace") for _, p, q in boxes(read, x + 8, y)]
    for x, y in find(read, start, b, b"ilst"):
        for kind, p, q in boxes(read, x, y):
            name = names[number(kind) - 1] if 0 < number(kind) <= len(names) else None
            for u, v in find(read, p, q, b"data"):
                form, body = number(read(u, 4)), read(u + 8, min(v - u - 8, 4096))
                if name and form in (21, 22, 23) and body:
                    out[name] = str(int.from_bytes(body, "big", signed=form == 21))
                elif name and (form in (1, 2) or form == 0 and name.startswith("com.android")):
                    out[name] = clean(body, 500) or ""
    return out


def movie(read: Read, size: int) -> dict:
    """Movie header, first video track and metadata of MOV, MP4 and 3GP."""
    info = {"format": "mp4", "extractor": "isobmff", "camera_known": True}
    brand = next((read(a, 4) for a, _ in find(read, 0, size, b"ftyp")), b"")
    info["format"] = "mov" if brand == b"qt  " else "3gp" if brand[:3] in (b"3gp", b"3ge", b"3gg") else "mp4"
    moov = next(find(read, 0, size, b"moov"), None)
    if moov is None:
        return info | {"structure_ok": False}
    scale = length = created = 0
    for a, _ in find(read, *moov, b"mvhd"):
        if read(a, 1) == b"\1":
            created, scale, length = number(read(a + 4, 8)), number(read(a + 20, 4)), number(read(a + 24, 8))
        else:
            created, scale, length = (number(read(a + k, 4)) for k in (4, 12, 16))
    if scale and length:
        info["duration_ms"] = length * 1000 // scale
        if info["duration_ms"]:
            info["bitrate"] = size * 8000 // info["duration_ms"]
    track = next((t for t in (video_track(read, a, b) for a, b in find(read, *moov, b"trak")) if t["handler"] == b"vide"), None)
    if track:
        info["codec"] = CODECS.get(track["codec"]) or clean(track["codec"].decode("latin-1"))
        if track.get("width") and track.get("height"):
            info["width"], info["height"] = track["width"], track["height"]
        info["orientation"] = {90: 6, 180: 3, 270: 8}.get(track["rotation"])
        if track["samples"] and track["scale"] and track["length"]:
            info["fps"] = round(track["samples"] * track["scale"] / track["length"], 3)
    keys: dict[str, str] = {}
    for kind, a, b in boxes(read, *moov):
        if kind == b"meta":
            keys |= named_values(read, a, b)
        elif kind == b"udta":
            for own, x, y in boxes(read, a, b):
                if own == b"meta":
                    keys |= named_values(read, x, y)
                elif own[:1] == b"\xa9":
                    keys.setdefault(own[1:].decode("latin-1"), clean(read(x + 4, number(read(x, 2)))) or "")
    for field, short in (("make", "mak"), ("model", "mod"), ("software", "swr")):
        info[field] = keys.get(f"com.apple.quicktime.{field}") or keys.get(short) or None
    if not info["software"] and "com.android.version" in keys:
        info["software"] = f"Android {keys['com.android.version']}"
    info["content_id"] = keys.get("com.apple.quicktime.content.identifier")
    local = LOCAL_DATE.match(keys.get("com.apple.quicktime.creationdate") or keys.get("day") or "")
    if local:
        info |= {"date_taken": "T".join(local.groups()), "date_source": "quicktime"}
    elif 0 < created < 1 << 36:
        info |= {"date_taken": (MAC_EPOCH + timedelta(seconds=created)).strftime("%Y-%m-%dT%H:%M:%S"), "date_source": "quicktime_utc"}
    return info | {"structure_ok": scale > 0}


def media_info(read: Read, size: int, ext: str, mtime_ns: int) -> dict:
    """The record of one file. Empty files and unknown magic bytes are not sound; a failing reader says nothing about soundness."""
    if size == 0:
        info = {"extractor": "empty", "camera_known": False, "structure_ok": False}
    else:
        found = family(read(0, 16))
        fmt = ext if ext in RAW_TIFF else "tiff"
        readers = {"jpeg": jpeg, "png": png, "webp": webp, "gif": gif, "heif": heif, "isobmff": movie, "tiff": lambda r, n: tiff(r, n, fmt)}
        try:
            if found in readers:
                info = readers[found](read, size)
            elif found == "unknown":
                info = {"extractor": "magic", "camera_known": False, "structure_ok": False}
            else:
                info = {"format": "cr3" if found == "crx" else found, "extractor": "magic", "camera_known": False, "structure_ok": True}
        except (struct.error, ValueError, IndexError, KeyError, TypeError, OverflowError):
            info = {"format": found, "extractor": "error", "camera_known": False, "structure_ok": None}
    if not info.get("date_taken"):
        info |= {"date_taken": datetime.fromtimestamp(mtime_ns // 1_000_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%S"), "date_source": "mtime"}
    try:
        info["date_taken_ts"] = int(datetime.fromisoformat(info["date_taken"]).replace(tzinfo=UTC).timestamp())
    except ValueError:
        info["date_taken_ts"] = None
    info["has_preview"] = bool(info.get("has_preview"))
    return {f.name: info.get(f.name) for f in MEDIA_INFO}


class FileWindow:
    """Reads of a file through a cached head and tail, so that headers cost two reads."""

    def __init__(self, path: str, size: int, head: int = 1 << 18, tail: int = 1 << 16):
        self.handle = open(path, "rb", buffering=0)  # noqa: SIM115
        self.size, self.head = size, self.handle.read(head)
        self.tail_at = max(len(self.head), size - tail)
        self.handle.seek(self.tail_at)
        self.tail = self.handle.read(tail) if self.tail_at < size else b""

    def __call__(self, at: int, n: int) -> bytes:
        if at < 0 or n <= 0 or at >= self.size:
            return b""
        if at + n <= len(self.head) or at < len(self.head) == self.size:
            return self.head[at : at + n]
        if at >= self.tail_at:
            return self.tail[at - self.tail_at : at - self.tail_at + n]
        self.handle.seek(at)
        return self.handle.read(n)


def with_media_info(files: DataFrame, *, path: str = "path", content: str | None = None) -> DataFrame:
    """`files` (ext, size, mtime_ns and `path` or binary `content`) with the record's fields as a struct `media`."""

    @F.pandas_udf(MEDIA_INFO)
    def described(source: pd.Series, ext: pd.Series, size: pd.Series, mtime: pd.Series) -> pd.DataFrame:
        rows = []
        for own, e, n, m in zip(source, ext, size, mtime, strict=True):
            try:
                window = FileWindow(own, n) if content is None else (lambda at, k, own=own: bytes(own[at : at + k]) if at >= 0 and k > 0 else b"")
                rows.append(media_info(window, n, e, m))
                if content is None:
                    window.handle.close()
            except OSError:
                rows.append({"extractor": "error", "camera_known": False})
        return pd.DataFrame(rows, columns=MEDIA_INFO.names).astype(object)

    return files.withColumn("media", described(F.col(content or path), "ext", "size", "mtime_ns"))
