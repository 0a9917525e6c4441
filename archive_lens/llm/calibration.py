"""Isotonic calibration from binned scores."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the weighted isotonic fit of y on x (pool adjacent violators); x ascending."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        if c <= 0:
            continue
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.5, 0.5])
    s = np.array(blocks)
    return s[:, 0] / s[:, 2], s[:, 1] / s[:, 2]


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probability between the knots; a thousandth of a sigmoid keeps the order of raw scores that the fit ties."""
    return np.clip(0.999 * np.interp(raw, *knots) + 0.001 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30))), 0, 1)
