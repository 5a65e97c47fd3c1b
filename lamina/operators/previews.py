"""Preview images: size fit, nearest resampling, choice by role, and a small PNG writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ints import int_div

#: Roles from the most to the least wanted. Fixed values of the format.
ROLE_ORDER = (1, 0, 2, 3)
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def fit(width: Column, height: Column, most: tuple[int, int] = (400, 300)) -> tuple[Column, Column]:
    """The size that keeps the aspect within `most`, never larger than the source and at least one pixel."""
    w, h = most
    small = (width <= w) & (height <= h)
    tall = int_div(height * w, width)
    wide = tall <= h
    one = F.lit(1)
    return (
        F.when(small, width).when(wide, w).otherwise(F.greatest(int_div(width * h, height), one)).cast("long"),
        F.when(small, height).when(wide, F.greatest(tall, one)).otherwise(h).cast("long"),
    )


def role_rank(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLE_ORDER)), role)


def nearest_index(target: Column, source: Column, size: Column) -> Column:
    """The source row or column of a target one: centres, rounded down, clamped."""
    return F.least(int_div((target * 2 + 1) * source, size * 2), source - 1)


def resample(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    rows = np.minimum((2 * np.arange(height) + 1) * pixels.shape[0] // (2 * height), pixels.shape[0] - 1)
    cols = np.minimum((2 * np.arange(width) + 1) * pixels.shape[1] // (2 * width), pixels.shape[1] - 1)
    return pixels[rows][:, cols]


def png(pixels: np.ndarray) -> bytes:
    """A grayscale image (height by width, bytes) as PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = pixels.shape
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = pixels
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def pgm(pixels: np.ndarray) -> bytes:
    """A grayscale image as binary PGM."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()
