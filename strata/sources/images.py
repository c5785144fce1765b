"""Images: PNG decoded and encoded without other libraries; JPEG kept as bytes, with its size read from the header."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .container import ContainerError, LimitExceeded, Limits, image_type

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # gray, RGB, gray and alpha, RGBA
_PALETTE = 3
#: Fixed values of PNG: first column, first row, steps between columns and between rows of each pass of an interlaced image.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def size(data: bytes) -> tuple[int, int]:
    """Width and height, from the header alone."""
    if image_type(data) == "png":
        return struct.unpack(">II", data[16:24])
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            break
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + length
    raise ContainerError("Error: image has no size")


def check_limits(data: bytes, limits: Limits) -> None:
    width, height = size(data)
    if limits.image_dim is not None and max(width, height) > limits.image_dim:
        raise LimitExceeded("Error: safety limit exceeded")
    if limits.image_bytes is not None and width * height * 4 > limits.image_bytes:
        raise LimitExceeded("Error: safety limit exceeded")


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _predicted(kind: int, line: bytes, above: bytes, step: int) -> np.ndarray:
    """A row stored as differences from the mean of, or the nearest of, its neighbours: each byte needs the one before."""
    done, up = bytearray(step), bytes(step) + above
    for i, x in enumerate(line):
        a, b, c = done[i], up[i + step], up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        done.append((x + guess) & 255)
    return np.frombuffer(done, np.uint8)[step:]


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a filter's number and bytes, as bytes. step: bytes of a pixel."""
    out = np.zeros((len(raw) + 1, raw.shape[1] - 1), np.uint8)
    for y, (kind, line, above) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], out)):
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            out[y + 1] = _predicted(kind, line.tobytes(), above.tobytes(), step)
        else:
            raise ContainerError(f"PNG filter {kind} is unknown")
    return out[1:]


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Height x width x channels of samples of 1 to 16 bits."""
    if depth == 16:
        return rows.view(">u2").astype(np.uint16).reshape(len(rows), width, channels)
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :width, None]


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x channels, of 8 or 16 bits: gray, gray and alpha, RGB or RGBA. Grays of less than 8 bits are spread over 0 to 255, palettes
    become their colors, and a transparent color becomes an alpha channel. Interlaced images are put together."""
    if image_type(data) != "png":
        raise ContainerError("only PNG images are decoded")
    parts = list(_chunks(data))
    width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if color not in (*_CHANNELS, _PALETTE) or depth not in (1, 2, 4, 8, 16) or (depth < 8 and color not in (0, _PALETTE)) or (depth == 16 and color == _PALETTE):
        raise ContainerError("this kind of PNG isn't decoded")
    channels = _CHANNELS.get(color, 1)
    raw = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), np.uint8)
    out = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x, y, dx, dy in _PASSES if interlace else [(0, 0, 1, 1)]:
        place = out[y::dy, x::dx]
        if place.size:
            line = 1 + (place.shape[1] * channels * depth + 7) // 8
            rows = raw[at : at + place.shape[0] * line]
            if len(rows) < place.shape[0] * line:
                raise ContainerError("PNG image is cut short")
            place[:] = _samples(_unfiltered(rows.reshape(-1, line), max(1, channels * depth // 8)), place.shape[1], channels, depth)
            at += len(rows)
    extra = dict(parts)
    clear = extra.get(b"tRNS")
    if color == _PALETTE:
        palette = np.frombuffer(extra.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if out.size and out.max() >= len(palette):
            raise ContainerError("PNG palette has too few colors")
        if clear:
            alpha = np.frombuffer(clear, np.uint8)
            palette = np.column_stack([palette, np.append(alpha, np.full(len(palette) - len(alpha), 255, np.uint8))])
        return palette[out[..., 0]]
    most = 65535 if depth == 16 else 255
    if clear and color in (0, 2):
        see = (out != np.frombuffer(clear, ">u2")[:channels]).any(axis=2, keepdims=True)
        alpha = np.where(see, most, 0).astype(out.dtype)
    if depth < 8:
        out = out * np.uint8(255 // ((1 << depth) - 1))
    return np.concatenate([out, alpha], axis=2) if clear and color in (0, 2) else out


def encode_png(pixels: np.ndarray) -> bytes:
    """Of height x width x channels of 8 or 16 bits."""
    height, width, channels = pixels.shape
    depth = 8 * pixels.dtype.itemsize
    rows = pixels.astype(">u2").view(np.uint8).reshape(height, -1) if depth == 16 else pixels.reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    color = {v: k for k, v in _CHANNELS.items()}[channels]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
