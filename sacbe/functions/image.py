"""Preparing page images with numpy: threshold, skew, rotation; and the hook for a recogniser."""

from __future__ import annotations

import numpy as np

# Fixed values of the method: angles tried, least angle corrected, least ink, width of the thumbnail.
ANGLES = np.arange(-5.0, 5.01, 0.25)
LEAST_ANGLE, LEAST_INK, THUMBNAIL = 0.3, 100, 800


def otsu(gray: np.ndarray) -> int:
    """Threshold that separates the gray values best; for a flat image its value."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    total, values = n.sum(), np.arange(256)
    below, mass = np.cumsum(n), np.cumsum(n * values)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def blur(gray: np.ndarray) -> np.ndarray:
    """Three by three binomial blur."""
    p = np.pad(gray.astype(float), 1, mode="edge")
    rows = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return np.rint((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 4).astype(np.uint8)


def binarize(gray: np.ndarray) -> np.ndarray:
    """White paper (255) and black ink (0)."""
    soft = blur(gray)
    return np.where(soft > otsu(soft), 255, 0).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """The image turned about its middle, nearest pixels, same size."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.rint(np.cos(a) * (x - cx) + np.sin(a) * (y - cy) + cx).astype(int)
    sy = np.rint(-np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(image, fill)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def skew(binary: np.ndarray) -> float:
    """Angle whose correction makes the rows of ink sharpest; 0 for images with little ink."""
    step = max(1, binary.shape[1] // THUMBNAIL)
    ink = (binary[::step, ::step] == 0).astype(np.uint8)
    if ink.sum() < LEAST_INK:
        return 0.0
    sharp = [(np.diff(rotate(ink, a, 0).sum(axis=1).astype(float)) ** 2).sum() for a in ANGLES]
    return float(ANGLES[int(np.argmax(sharp))])


def prepare(gray: np.ndarray) -> np.ndarray:
    """Binary, straightened image of a page."""
    b = binarize(gray)
    a = skew(b)
    return rotate(b, a) if abs(a) >= LEAST_ANGLE else b
