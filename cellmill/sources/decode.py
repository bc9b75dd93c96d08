"""Decoding of binary columns: PNG images and masks, NPY and NPZ arrays, each held to a contract of shape and type.

Bytes are decoded batch by batch beside the rows. What can't be decoded, or breaks its contract, gives a row with an error and no values, so a torn file
never ends a job. PNG: grey, palette and colour, with or without alpha, 1 to 16 bits, all five row filters; interlaced files are refused.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: its first bytes, and the numbers of a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in grey, in 65,536ths.
LUMA = (19595, 38470, 7471)
KINDS = ("depth", "mask", "grey", "rgb", "pose", "array")
DECODED = "struct<shape:array<int>,dtype:string,values:array<double>,error:string>"


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """The chunks by name, image data joined; each must have its check sum, and the last its place."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, out = len(SIGNATURE), {}
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(name + body)):
            raise ValueError("torn or damaged chunk")
        out[name] = out.get(name, b"") + body
        at += 12 + size
        if name == b"IEND":
            return out
    raise ValueError("torn file")


def _paeth(left: int, up: int, corner: int) -> int:
    guess = left + up - corner
    far = abs(guess - left), abs(guess - up), abs(guess - corner)
    return left if far[0] <= far[1] and far[0] <= far[2] else up if far[1] <= far[2] else corner


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """rows: (height, 1 + bytes), each with its filter in front. step: bytes of a pixel."""
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0], rows[:, 1:])):
        if kind == 0:
            out[y] = line
        elif kind == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(line[c::step], dtype=np.uint64)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            now, raw, up = [0] * (len(line) + step), line.tolist(), [0] * step + above.tolist()
            for i, value in enumerate(raw):
                left, over, corner = now[i], up[i + step], up[i]
                now[i + step] = (value + ((left + over) // 2 if kind == 3 else _paeth(left, over, corner))) & 255
            out[y] = now[step:]
        else:
            raise ValueError(f"unknown row filter {kind}")
        above = out[y]
    return out


def png(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Pixels (height, width) or (height, width, channels), uint8 or uint16, and the palette's colours."""
    chunks = _chunks(data)
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if interlaced or colour not in CHANNELS:
        raise ValueError("interlaced or unknown kind of PNG")
    n = CHANNELS[colour]
    line = (width * n * bits + 7) // 8
    raw = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8)
    if len(raw) != height * (line + 1):
        raise ValueError("image data of another size")
    rows = _unfiltered(raw.reshape(height, line + 1), max(1, n * bits // 8))
    if bits == 16:
        pixels = rows.view(">u2").astype(np.uint16)
    elif bits == 8:
        pixels = rows
    else:
        pixels = np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
        pixels = pixels[:, :width].astype(np.uint8) * (255 // ((1 << bits) - 1) if colour == 0 else 1)
    palette = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3) if b"PLTE" in chunks else None
    return pixels.reshape((height, width, n) if n > 1 else (height, width)), palette


def _colours(pixels: np.ndarray, palette: np.ndarray | None) -> np.ndarray:
    if pixels.dtype != np.uint8:
        raise ValueError(f"8 bits expected, found {pixels.dtype}")
    if palette is not None and pixels.ndim == 2:
        return palette[pixels]
    grey = pixels if pixels.ndim == 2 else pixels[..., 0] if pixels.shape[2] == 2 else None
    return np.repeat(grey[..., None], 3, axis=2) if grey is not None else pixels[..., :3]


def decoded(data: bytes, kind: str) -> np.ndarray:
    """The array that bytes hold, by the contract of kind; ValueError and the like otherwise.

    depth: (H, W) uint16 of a 16-bit grey PNG; mask: (H, W) int32 of a grey or palette PNG; grey: (H, W) uint8; rgb: (H, W, 3) uint8; pose: seven
    float64 (place, then quaternion xyzw) of an NPY vector or of an NPZ file's position and orientation; array: any numeric NPY array."""
    if kind in ("pose", "array"):
        held = np.load(io.BytesIO(data), allow_pickle=False)
        if not isinstance(held, np.ndarray):
            held = np.concatenate([np.reshape(held["position"], 3), np.reshape(held["orientation"], 4)])
        if held.dtype.kind not in "biuf":
            raise ValueError(f"numbers expected, found {held.dtype}")
        if kind == "pose" and held.shape != (7,):
            raise ValueError(f"a pose has shape (7,), found {held.shape}")
        return held.astype(np.float64) if kind == "pose" else held
    pixels, palette = png(data)
    if kind == "depth":
        if pixels.dtype != np.uint16 or pixels.ndim != 2:
            raise ValueError(f"(H, W) uint16 expected, found {pixels.shape} {pixels.dtype}")
        return pixels
    if kind == "mask":
        if pixels.ndim != 2:
            raise ValueError(f"(H, W) expected, found {pixels.shape}")
        return pixels.astype(np.int32)
    if kind == "rgb":
        return _colours(pixels, palette)
    if kind == "grey":
        if pixels.ndim == 2 and palette is None and pixels.dtype == np.uint8:
            return pixels
        return ((_colours(pixels, palette).astype(np.int64) @ np.array(LUMA) + 32768) >> 16).astype(np.uint8)
    raise ValueError(f"unknown kind {kind}")


def decode(data: Column, kind: str) -> Column:
    """A struct of shape, dtype, values (in order of rows) and error. Null bytes give null fields and no error."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    @F.arrow_udf(DECODED)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for item in column:
            try:
                held = decoded(item.as_py(), kind) if item.is_valid else None
                out.append({"shape": list(held.shape), "dtype": str(held.dtype), "values": held.astype(np.float64).ravel(), "error": None} if held is not None else {})
            except Exception as e:
                out.append({"error": f"{type(e).__name__}: {e}"})
        fields = [("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("values", pa.list_(pa.float64())), ("error", pa.string())]
        return pa.array(out, pa.struct(fields))

    return run(data)


def npy(values: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.save(held, values, allow_pickle=False)
    return held.getvalue()


def encoded_png(pixels: np.ndarray, palette: np.ndarray | None = None) -> bytes:
    """A PNG of (H, W) or (H, W, 1 to 4) uint8 or uint16 pixels; rows take the filters that need no neighbour to the left in turn."""
    deep = pixels.reshape(*pixels.shape[:2], -1)
    height, width, n = deep.shape
    bits = 16 if pixels.dtype == np.uint16 else 8
    rows = deep.astype(">u2" if bits == 16 else np.uint8).reshape(height, -1).view(np.uint8)
    above = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    lines = b"".join(bytes([2]) + (row - up).tobytes() if y % 2 else bytes([0]) + row.tobytes() for y, (row, up) in enumerate(zip(rows, above)))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    colour = 3 if palette is not None else {1: 0, 2: 4, 3: 2, 4: 6}[n]
    middle = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + middle + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
