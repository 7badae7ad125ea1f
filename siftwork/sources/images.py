"""Sizes of images from their headers, and measures of grey pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.sources.uploads import MAX_PIXELS

SHORTEST_SIDE = 32
LEAST_SHARPNESS = 40.0
BINS = 32
#: Laplacians that count as text and as a stroke, classes that hold text, and what makes reading worth it.
DENSE, STROKE = 50, 30
TEXT_CLASSES = ("book", "cell phone", "tv", "laptop", "stop sign", "person")
LEAST_DENSITY, LEAST_ENTROPY = 0.01, 0.05


def header_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, JPEG or WebP file, None if the header is none of them."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        if content[12:16] == b"VP8X":
            return int.from_bytes(content[24:27], "little") + 1, int.from_bytes(content[27:30], "little") + 1
        if content[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", content[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if content[12:16] == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def with_sizes(files: DataFrame) -> DataFrame:
    """Add width, height and status (ok, corrupt, too_many_pixels) to files (path, content)."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [header_size(bytes(c)) or (None, None) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "width": [w for w, _ in found], "height": [h for _, h in found]}).astype(
                {"width": "Int64", "height": "Int64"}
            )

    sized = files.select("path", "content").mapInPandas(sizes, "path string, width long, height long")
    status = (
        F.when(F.col("width").isNull(), "corrupt")
        .when(F.col("width") * F.col("height") > MAX_PIXELS, "too_many_pixels")
        .otherwise("ok")
    )
    return sized.withColumn("status", status)


def quality_gate(width: Column, height: Column, sharpness: Column) -> Column:
    return (
        F.when(width.isNull() | height.isNull() | sharpness.isNull(), "CORRUPT")
        .when(F.least(width, height) < SHORTEST_SIDE, "LOW_RES")
        .when(sharpness < LEAST_SHARPNESS, "BLUR")
        .otherwise("OK")
    )


def _sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.pad(x, 1, mode="edge")
    gx = (e[:-2, 2:] + 2 * e[1:-1, 2:] + e[2:, 2:]) - (e[:-2, :-2] + 2 * e[1:-1, :-2] + e[2:, :-2])
    gy = (e[2:, :-2] + 2 * e[2:, 1:-1] + e[2:, 2:]) - (e[:-2, :-2] + 2 * e[:-2, 1:-1] + e[:-2, 2:])
    return gx, gy


def edges(pixels: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge pixels: ridges of the gradient (|dx| + |dy|) above ``low`` that touch one above ``high``."""
    gx, gy = _sobel(pixels.astype(np.float64))
    size = np.abs(gx) + np.abs(gy)
    padded = np.pad(size, 1)
    flat, steep = np.abs(gy) <= np.abs(gx) * np.tan(np.pi / 8), np.abs(gy) > np.abs(gx) * np.tan(3 * np.pi / 8)
    falling = (gx >= 0) == (gy >= 0)
    h, w = size.shape

    def at(dy: int, dx: int) -> np.ndarray:
        return padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    before = np.select([flat, steep, falling], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, falling], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    weak = (size > before) & (size >= after) & (size > low)
    strong = weak & (size > high)
    while True:
        p = np.pad(strong, 1)
        near = np.logical_or.reduce([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        grown = weak & near
        if (grown == strong).all():
            return strong
        strong = grown


def grey_measures(pixels: np.ndarray) -> dict[str, float]:
    """Measures of a grey image: sharpness (variance of the Laplacian), share of pixels with a Laplacian above
    ``DENSE``, share of edge pixels, and entropy of 32 grey levels among the pixels above ``STROKE`` (0 to 1).

    Beyond the border the image is mirrored. An image without pixels has zeros.
    """
    x = pixels.astype(np.float64)
    if not x.size:
        return {"sharpness": 0.0, "text_density": 0.0, "edge_density": 0.0, "entropy": 0.0}
    # mirrored about the border pixel; a side of one pixel has nothing to mirror
    wide = np.pad(x, [(1, 1)] * 2, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    laplace = np.abs(wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * x)
    signed = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * x
    strokes = x[laplace > STROKE]
    share = np.histogram(strokes, BINS, (0, 256))[0] / max(1, strokes.size)
    share = share[share > 0]
    return {
        "sharpness": float(signed.var()),
        "text_density": float((laplace > DENSE).mean()),
        "edge_density": float(edges(x).mean()),
        "entropy": float(-(share * np.log2(share)).sum() / np.log2(BINS)) + 0.0,
    }


def measured(images: DataFrame) -> DataFrame:
    """(image, sharpness, text_density, edge_density, entropy) of grey images (image, width, pixels row by row, one byte each).

    Pixels that are null or do not fill whole rows give nulls.
    """
    kind = images.schema["image"].dataType.simpleString()
    names = ("sharpness", "text_density", "edge_density", "entropy")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image, width, raw in batch[["image", "width", "pixels"]].itertuples(index=False):
                whole = raw is not None and width and len(raw) and len(raw) % int(width) == 0
                found = grey_measures(np.frombuffer(raw, np.uint8).reshape(-1, int(width))) if whole else {}
                rows.append((image, *[found.get(n) for n in names]))
            yield pd.DataFrame(rows, columns=["image", *names])

    return images.select("image", "width", "pixels").mapInPandas(measure, f"image {kind}, " + ", ".join(f"{n} double" for n in names))


def text_gate(classes: Column, density: Column, entropy: Column, triggers: tuple[str, ...] = TEXT_CLASSES) -> Column:
    """True if reading an image's text is worth it: a telling object, dense strokes, or varied levels."""
    seen = F.arrays_overlap(F.transform(classes, lambda c: F.lower(c)), F.array(*[F.lit(t) for t in triggers]))
    return F.coalesce(seen | (density > LEAST_DENSITY) | (entropy > LEAST_ENTROPY), seen, F.lit(False))
