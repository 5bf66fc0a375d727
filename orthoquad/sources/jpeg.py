"""A small baseline JPEG encoder for workers that have no image library.

Huffman codes have one length for all symbols, which is a valid table, so none
has to be listed; zigzag order and quantisation follow rules.
"""

from __future__ import annotations

import struct

import numpy as np

_ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
_ORDER = np.array([r * 8 + c for r, c in _ZIGZAG])
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Of a block's 64 values, row by row, its coefficients in zigzag order; of R, G, B the Y, Cb, Cr.
_BLOCK = np.ascontiguousarray(np.kron(_DCT, _DCT)[_ORDER].T)
_LUMA = np.array([0.299, 0.587, 0.114])
_COLOURS = np.array([_LUMA, (np.array([0, 0, 1]) - _LUMA) * 0.5 / 0.886, (np.array([1, 0, 0]) - _LUMA) * 0.5 / 0.701])
#: Symbols in the order of their codes: sizes of differences; end of block, a run of 16, and runs with sizes.
_DC = list(range(12))
_AC = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
_DC_BITS, _AC_BITS = 4, 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, bits: int, symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(len(symbols) if i + 1 == bits else 0 for i in range(16)) + bytes(symbols))


def _number(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that a number needs, and the number as the format writes it: negative ones less one."""
    size = np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words and their lengths for blocks in zigzag order; the first column holds differences."""
    n = len(rows)
    size, extra = _number(rows[:, 0])
    flat = np.flatnonzero(rows.ravel() != 0)
    flat = flat[flat % 64 > 0]
    at, k = flat // 64, flat % 64
    before = np.where(np.append(True, at[1:] != at[:-1])[: len(at)], 0, np.append(0, k[:-1])[: len(at)])
    run = k - before - 1
    width, digits = _number(rows[at, k])
    long = np.repeat(np.arange(len(at)), run // 16)  # runs of 16 zeros before a number
    last = np.zeros(n, np.int64)
    np.maximum.at(last, at, k)
    ended = np.flatnonzero(last < 63)
    place = np.concatenate([np.arange(n) * 256, at * 256 + 2 * k + 1, at[long] * 256 + 2 * k[long], ended * 256 + 255])
    word = np.concatenate([size << size | extra, (2 + run % 16 * 10 + width - 1) << width | digits, np.ones(len(long), np.int64), np.zeros(len(ended), np.int64)])
    bits = np.concatenate([_DC_BITS + size, _AC_BITS + width, np.full(len(long) + len(ended), _AC_BITS)])
    order = np.argsort(place, kind="stable")
    return word[order], bits[order]


def coefficients(pixels: np.ndarray, step: int = 4) -> np.ndarray:
    """Quantised coefficients by block, plane (Y, Cb, Cr) and zigzag order; all blocks are one product of matrices."""
    height, width = pixels.shape[:2]
    whole = np.pad(pixels, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge") if height % 8 or width % 8 else pixels
    cut = whole.reshape(whole.shape[0] // 8, 8, whole.shape[1] // 8, 8, 3).transpose(4, 0, 2, 1, 3)
    planes = _COLOURS @ cut.reshape(3, -1).astype(np.float64)
    planes[0] -= 128
    return np.rint(planes.reshape(-1, 64) @ _BLOCK / step).astype(np.int64).reshape(3, -1, 64).transpose(1, 0, 2)


def encode(pixels: np.ndarray, step: int = 4) -> bytes:
    """JPEG bytes of an array of rows of R, G, B; ``step`` is the quantiser of all coefficients."""
    height, width = pixels.shape[:2]
    rows = coefficients(pixels, step).copy()
    rows[1:, :, 0] -= rows[:-1, :, 0].copy()
    word, bits = _codes(rows.reshape(-1, 64))
    ends = np.cumsum(bits)
    shift = np.repeat(ends, bits) - np.arange(ends[-1]) - 1
    stream = (np.repeat(word, bits) >> shift & 1).astype(np.uint8)
    data = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + _segment(0xDB, bytes([0]) + bytes([step] * 64))
    head += _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += _table(0x00, _DC_BITS, _DC) + _table(0x10, _AC_BITS, _AC)
    return head + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
