"""Sizes of images from their headers, before anything is decoded."""

from __future__ import annotations

import io
import struct
from contextlib import suppress

from leafmill.schema import ReadError

BAD_FRAME = "image frame could not be read: it has no size"


def frames(content: bytes) -> list[tuple[int, int] | None]:
    """Width and height of each frame of a PNG, JPEG, GIF, BMP, WEBP or TIFF; None for a damaged frame beside others."""
    try:
        for magic, size in ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8\xff", _jpeg), (b"GIF8", _gif), (b"BM", _bmp), (b"RIFF", _webp)):
            if content.startswith(magic):
                return [size(content)]
        if content[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(content)
    except (struct.error, IndexError, ValueError) as e:
        raise ReadError("CorruptFile", f"image could not be opened: {e}") from None
    raise ReadError("CorruptFile", "not a readable image: no known signature")


def _png(c: bytes) -> tuple[int, int]:
    if c[12:16] != b"IHDR":
        raise ValueError("a PNG without its header chunk")
    return struct.unpack(">II", c[16:24])


def _gif(c: bytes) -> tuple[int, int]:
    return struct.unpack("<HH", c[6:10])


def _bmp(c: bytes) -> tuple[int, int]:
    if struct.unpack("<I", c[14:18])[0] == 12:
        return struct.unpack("<HH", c[18:22])
    w, h = struct.unpack("<ii", c[18:26])
    return abs(w), abs(h)


def _exif_sides(c: bytes) -> tuple[int, int]:
    """PixelXDimension and PixelYDimension of an Exif segment; 0 for what it doesn't say."""
    order = "<" if c[:2] == b"II" else ">"
    side = {0xA002: 0, 0xA003: 0}

    def entries(at: int):
        for k in range(struct.unpack(f"{order}H", c[at : at + 2])[0]):
            tag, kind, _, raw = struct.unpack(f"{order}HHI4s", c[at + 2 + 12 * k : at + 14 + 12 * k])
            yield tag, struct.unpack(f"{order}H", raw[:2])[0] if kind == 3 else struct.unpack(f"{order}I", raw)[0]

    with suppress(struct.error):  # metadata that is cut short says nothing
        for tag, value in entries(struct.unpack(f"{order}I", c[4:8])[0]):
            if tag == 0x8769:
                side |= {t: v for t, v in entries(value) if t in side}
    return side[0xA002], side[0xA003]


def _jpeg(c: bytes) -> tuple[int, int]:
    """A frame's header has 16 bits for a side. One that says 0 leaves it open: then Exif's 32 bits count."""
    at, told = 2, (0, 0)
    while True:
        while c[at] != 0xFF:
            at += 1
        while c[at] == 0xFF:
            at += 1
        marker = c[at]
        at += 1
        if marker in (0x01, *range(0xD0, 0xD9)):
            continue
        if marker == 0xD9:
            raise ValueError("a JPEG without a frame")
        length = struct.unpack(">H", c[at : at + 2])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", c[at + 3 : at + 7])
            return w or told[0], h or told[1]
        if marker == 0xE1 and c[at + 2 : at + 8] == b"Exif\0\0":
            told = _exif_sides(c[at + 8 : at + length])
        at += length


def _webp(c: bytes) -> tuple[int, int]:
    kind = c[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(c[24:27], "little"), 1 + int.from_bytes(c[27:30], "little")
    if kind == b"VP8L":
        bits = struct.unpack("<I", c[21:25])[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", c[26:30])
        return w & 0x3FFF, h & 0x3FFF
    raise ValueError("a WEBP of an unknown kind")


def _tiff(c: bytes) -> list[tuple[int, int] | None]:
    order = "<" if c[:2] == b"II" else ">"
    at, out, seen = struct.unpack(f"{order}I", c[4:8])[0], [], set()
    while at and at not in seen:
        seen.add(at)
        try:
            size, at = _tiff_frame(c, at, order)
        except struct.error:  # nor is there a way to a next one
            size, at = None, 0
        out.append(size)
    if not any(out):
        raise ValueError("a TIFF without a frame that can be read")
    return out


def _tiff_frame(c: bytes, at: int, order: str) -> tuple[tuple[int, int] | None, int]:
    """Size of the frame described at a place, None without one, and the place of the next description or 0."""
    n = struct.unpack(f"{order}H", c[at : at + 2])[0]
    size = {}
    for k in range(n):
        tag, kind, _, raw = struct.unpack(f"{order}HHI4s", c[at + 2 + 12 * k : at + 14 + 12 * k])
        if tag in (256, 257):
            size[tag] = struct.unpack(f"{order}H", raw[:2])[0] if kind == 3 else struct.unpack(f"{order}I", raw)[0]
    following = struct.unpack(f"{order}I", c[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return ((size[256], size[257]) if 256 in size and 257 in size else None), following


def _no_frame() -> tuple[int, int]:
    raise ReadError("CorruptFile", BAD_FRAME)


def embedded(blob: bytes, name: str, reason: str, **more) -> dict:
    """An item for an image within a document, or for its failure."""
    try:
        w, h = frames(blob)[0] or _no_frame()
    except ReadError as e:
        return {"what": "error", "kind": "image", "reason": reason, "name": name, "error_type": e.kind, "message": e.message, **more}
    return {"what": "image", "kind": "image", "reason": reason, "name": name, "blob": blob, "embedded": True, "frame": 0, "width_px": w, "height_px": h, "label": "image", **more}


def read(content: bytes, pages: list[tuple[int, int | None]] | None = None, spec: str | None = None) -> list[dict]:
    """An item for each frame that the page ranges name; a single frame is always taken."""
    sizes = frames(content)
    many = len(sizes) > 1
    wanted = [k for k in range(1, len(sizes) + 1) if not (many and pages) or any(a <= k <= (b or k) for a, b in pages)]
    if not wanted:
        return [{"what": "note", "message": f"--pages {spec!r} selected no frame of this image"}]
    reason = "image file (pixels only, no text layer)"
    return [
        {"what": "error", "kind": "page", "reason": "image frame could not be read", "page": k, "frame": k - 1, "error_type": "CorruptFile", "message": BAD_FRAME} if sizes[k - 1] is None else
        {
            "what": "image", "kind": "page" if many else "image", "reason": reason, "page": k if many else None, "embedded": False, "frame": k - 1,
            "width_px": sizes[k - 1][0], "height_px": sizes[k - 1][1], "label": f"image frame {k}" if many else "image",
        }
        for k in wanted
    ]


def upright_png(content: bytes, frame: int = 0) -> bytes:
    """A frame as an upright RGB PNG, transparency on white, where Pillow is there; else the file as it is."""
    try:
        from PIL import Image, ImageOps
    except ImportError:
        return content
    image = Image.open(io.BytesIO(content))
    image.seek(frame)
    image = ImageOps.exif_transpose(image)
    if image.mode.startswith("I"):  # 16 bits
        image = image.point(lambda v: v / 256).convert("L")
    if "transparency" in image.info or image.mode in ("RGBA", "LA"):
        image = image.convert("RGBA")
        white = Image.new("RGBA", image.size, "white")
        image = Image.alpha_composite(white, image)
    image.convert("RGB").save(out := io.BytesIO(), format="PNG")
    return out.getvalue()
