"""TIFF files as RGB arrays, from their bytes: for tiles that arrive as a column, and names that Spark's file sources hide.

Read are classic files of either byte order, with 8 or 16 bits a sample, in strips or tiles, chunky or planar, without
compression or with PackBits, LZW or Deflate (with or without differencing), as grey, inverted grey, palette or RGB; further
samples, such as alpha, are left out and 16 bits are cut to the upper 8. Anything else is a ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Tags of the format, sizes of its field types and their struct codes, and its numbers of compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELDS = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Pixels of an image, at most: a header can claim any size.
MOST_PIXELS = 1 << 28


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, held, bits, before = list(first), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("a code that is not in the table")
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data)
    raise ValueError(f"compression {compression} is not read")


def tags(content: bytes) -> tuple[dict[int, tuple[int, ...]], str]:
    """(integer fields of the first directory, byte order)."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(content[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", content, 4)[0]
    found = {}
    for i in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        if kind in FIELDS:
            code = f"{order}{n}{FIELDS[kind]}"
            size = struct.calcsize(code)
            place = at + 10 + 12 * i
            found[tag] = struct.unpack_from(code, content, place if size <= 4 else struct.unpack_from(order + "I", content, place)[0])
    return found, order


def decode(content: bytes) -> np.ndarray:
    """The first image as (row, column, 3) bytes."""
    try:
        return _decode(content)
    except (struct.error, zlib.error, IndexError, KeyError, MemoryError) as error:
        raise ValueError(f"not a readable TIFF file: {error!r}") from error


def _decode(content: bytes) -> np.ndarray:
    t, order = tags(content)
    one = lambda tag, default: t.get(tag, (default,))[0]
    w, h, samples, bits = t[WIDTH][0], t[HEIGHT][0], one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16) or len(set(t[BITS])) != 1 or one(SAMPLE_FORMAT, 1) != 1:
        raise ValueError(f"samples of {t.get(BITS)} bits are not read")
    if not 0 < w * h * samples <= MOST_PIXELS:
        raise ValueError(f"an image of {w} x {h}")
    kind = np.dtype(f"{order}u{bits // 8}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    if TILE_OFFSETS in t:
        tw, th, offsets, sizes = t[TILE_WIDTH][0], t[TILE_HEIGHT][0], t[TILE_OFFSETS], t[TILE_BYTES]
    else:
        tw, th, offsets, sizes = w, min(h, one(STRIP_ROWS, h)), t[STRIP_OFFSETS], t.get(STRIP_BYTES, (len(content),))
    across, down = -(-w // tw), -(-h // th)
    image = np.zeros((h, w, samples), np.uint16 if bits == 16 else np.uint8)
    for i, (plane, y, x) in enumerate((p, y, x) for p in range(planes) for y in range(down) for x in range(across)):
        rows = th if TILE_OFFSETS in t else min(th, h - y * th)
        data = unpacked(content[offsets[i] : offsets[i] + sizes[i]], one(COMPRESSION, NONE))
        part = np.frombuffer(data, kind, rows * tw * each).reshape(rows, tw, each)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, 1, dtype=image.dtype)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("this predictor is not read")
        place = image[y * th : y * th + rows, x * tw : x * tw + tw, plane * each : plane * each + each]
        place[...] = part[: place.shape[0], : place.shape[1]]
    photometric = one(PHOTOMETRIC, 1)
    if photometric == 3:
        colours = np.array(t[PALETTE], np.uint16).reshape(3, -1)
        return (colours[:, image[:, :, 0]] >> 8).astype(np.uint8).transpose(1, 2, 0)
    if photometric not in (0, 1, 2):
        raise ValueError(f"photometric interpretation {photometric} is not read")
    out = (image >> 8).astype(np.uint8) if bits == 16 else image
    if photometric == 2:
        if samples < 3:
            raise ValueError("fewer than three samples of RGB")
        return np.ascontiguousarray(out[:, :, :3])
    return np.repeat(255 - out[:, :, :1] if photometric == 0 else out[:, :, :1], 3, 2)


def encode(rgb: np.ndarray, compression: int = NONE) -> bytes:
    """An 8-bit RGB image as one strip; not compressed, or by Deflate or PackBits."""
    h, w, _ = rgb.shape
    data = rgb.astype(np.uint8).tobytes()
    if compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.compress(data)
    elif compression == PACKBITS:
        data = b"".join(bytes([len(part) - 1]) + part for part in (data[i : i + 128] for i in range(0, len(data), 128)))
    elif compression != NONE:
        raise ValueError(f"compression {compression} is not written")
    fields = [(WIDTH, w), (HEIGHT, h), (BITS, None), (COMPRESSION, compression), (PHOTOMETRIC, 2), (STRIP_OFFSETS, 8), (SAMPLES, 3), (STRIP_ROWS, h), (STRIP_BYTES, len(data)), (PLANAR, 1)]
    body = data + b"\0" * (len(data) % 2)
    bits_at = 8 + len(body)
    out = struct.pack("<2sHI", b"II", 42, bits_at + 6) + body + struct.pack("<3H", 8, 8, 8) + struct.pack("<H", len(fields))
    for tag, value in fields:
        short = tag in (COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR)  # readers want these in two bytes
        out += struct.pack("<HHII", tag, 3, 3, bits_at) if value is None else struct.pack("<HHII", tag, 3 if short else 4, 1, value)
    return out + struct.pack("<I", 0)


def substituted(contents: Iterator[bytes | None], side: int) -> Iterator[tuple[bool, np.ndarray]]:
    """(readable, image): a black square of this side for what cannot be read."""
    for content in contents:
        try:
            yield True, decode(content or b"")
        except ValueError:
            yield False, np.zeros((side, side, 3), np.uint8)
