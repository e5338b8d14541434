"""Ruled lines of page scans, with numpy only: grey PGM images to rows of line positions.

An image is one row of a binary scan and is worked on by itself, so memory is bounded by one page
a task.  Images that are no readable PGM give no lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def decode_pgm(blob: bytes) -> np.ndarray | None:
    """A binary grey image (P5, 8 bit), or None."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(blob) and blob[at : at + 1].isspace():
            at += 1
        if blob[at : at + 1] == b"#":
            at = blob.find(b"\n", at)
            if at < 0:
                return None
            continue
        end = at
        while end < len(blob) and not blob[end : end + 1].isspace():
            end += 1
        if end == at:
            return None
        fields.append(blob[at:end])
        at = end
    if fields[0] != b"P5" or not all(f.isdigit() for f in fields[1:]) or int(fields[3]) > 255:
        return None
    width, height = int(fields[1]), int(fields[2])
    pixels = np.frombuffer(blob, dtype=np.uint8, offset=at + 1)
    return pixels[: width * height].reshape(height, width) if width * height and len(pixels) >= width * height else None


def encode_pgm(image: np.ndarray) -> bytes:
    height, width = image.shape
    return b"P5\n%d %d\n255\n" % (width, height) + image.astype(np.uint8).tobytes()


def otsu(image: np.ndarray) -> float:
    """Grey level that parts ink from paper best."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    total, levels = counts.sum(), np.arange(256)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * levels)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def skew(ink: np.ndarray, most: float = 3.0, step: float = 0.1) -> float:
    """Angle, in degrees, at which the rows' ink is most concentrated."""
    ys, xs = np.nonzero(ink)
    if not len(ys):
        return 0.0
    best, found = -1.0, 0.0
    for angle in sorted(np.arange(-most, most + step / 2, step), key=abs):
        rows = np.round(ys - np.tan(np.radians(angle)) * (xs - ink.shape[1] / 2)).astype(int)
        profile = np.bincount(rows - rows.min()).astype(float)
        score = float((profile**2).sum())
        if score > best * 1.0001:
            best, found = score, float(angle)
    return round(found, 2)


def profile_lines(ink: np.ndarray, axis: int, share: float = 0.3, gap: int = 4) -> list[int]:
    """Positions whose ink exceeds a share of the length; runs within ``gap`` are one line."""
    profile = ink.sum(axis=1 - axis)
    hits = np.flatnonzero(profile > share * ink.shape[1 - axis])
    if not len(hits):
        return []
    runs = np.split(hits, np.flatnonzero(np.diff(hits) > gap) + 1)
    return [int(r.mean()) for r in runs]


def panels(image: np.ndarray) -> list[tuple[int, int]]:
    """Column ranges of the panels of a spread, the right page first: cut at the darkest column
    of the middle third if it is a gutter, else one panel."""
    means = image.mean(axis=0)
    wide = max(15, len(means) // 80)  # wider than a ruling
    smooth = np.convolve(means, np.ones(wide) / wide, mode="same")
    low, high = int(0.35 * len(means)), int(0.65 * len(means))
    if high - low < 3:
        return [(0, len(means))]
    cut = low + int(smooth[low:high].argmin())
    if smooth[cut] > 0.6 * np.median(means):
        return [(0, len(means))]
    return [(cut, len(means)), (0, cut)]


def detected_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, panel, skew, axis, pos)`` of every ruled line of every image under a path."""
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, blob in zip(batch["path"], batch["content"]):
                image = decode_pgm(bytes(blob))
                if image is None:
                    continue
                for number, (left, right) in enumerate(panels(image)):
                    part = image[:, left:right]
                    ink = part < otsu(part) + 1
                    angle = skew(ink)
                    out += [(name, number, angle, "h", float(p)) for p in profile_lines(ink, 0)]
                    out += [(name, number, angle, "v", float(p + left)) for p in profile_lines(ink, 1)]
            yield pd.DataFrame(out, columns=["path", "panel", "skew", "axis", "pos"])

    return images.mapInPandas(run, "path string, panel int, skew double, axis string, pos double")
