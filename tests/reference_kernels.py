"""Numpy forms of resizing, shifts, windows and clipping, one image at a time, that the library's columns are held against."""

from __future__ import annotations

import numpy as np

from orbitframe.functions.geo import ECCENTRICITY, MINOR

#: Gauss-Legendre nodes and weights for the area below a side.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(8)


def image(pixels, h: int, w: int) -> np.ndarray:
    return np.asarray(pixels, float).reshape(int(h), int(w))


def _weights(n: int, m: int, mode: str) -> np.ndarray:
    """(m, n) interpolation matrix with half-pixel centres; the kernel is widened when shrinking, borders are clamped."""
    scale = n / m
    wide = max(scale, 1.0)
    at = (np.arange(m) + 0.5) * scale - 0.5
    reach = (1 if mode == "bilinear" else 2) * wide
    low = np.floor(at - reach).astype(int)
    out = np.zeros((m, n))
    for k in range(int(2 * reach) + 3):
        j = low + k
        t = np.abs((j - at) / wide)
        if mode == "bilinear":
            v = np.maximum(0, 1 - t)
        else:
            a = -0.75 if wide == 1 else -0.5
            v = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0))
        np.add.at(out, (np.arange(m), np.clip(j, 0, n - 1)), v)
    return out / out.sum(axis=1, keepdims=True)


def resize(a: np.ndarray, h: int, w: int, mode: str = "bilinear") -> np.ndarray:
    return _weights(a.shape[0], h, mode) @ a @ _weights(a.shape[1], w, mode).T


def lanczos_kernel(shift: float, a: int = 3) -> np.ndarray:
    """Normalised taps at -a..a for a shift in pixels; the small offset keeps the centre defined."""
    x = np.arange(-a, a + 1) - shift + 1e-3
    k = a * np.sin(np.pi * x) * np.sin(np.pi * x / a) / (np.pi * x) ** 2
    k = np.where(np.abs(x) < a, k, 0)
    return k / k.sum()


def _along(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    r = len(k) // 2
    padded = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="reflect")
    n = a.shape[axis]
    return sum(w * np.take(padded, np.arange(2 * r - i, 2 * r - i + n), axis=axis) for i, w in enumerate(k))


def lanczos_shift(a: np.ndarray, dx: float, dy: float, size: int = 3) -> np.ndarray:
    """Move the content by (dx, dy) pixels: right and down for positive ones."""
    whole_x, whole_y = int(np.round(dx)), int(np.round(dy))
    out = _along(_along(a, lanczos_kernel(dx - whole_x, size), 1), lanczos_kernel(dy - whole_y, size), 0)
    pad = max(abs(whole_x), abs(whole_y))
    if not pad:
        return out
    padded = np.pad(out, pad, mode="reflect")
    return padded[pad - whole_y : pad - whole_y + a.shape[0], pad - whole_x : pad - whole_x + a.shape[1]]


def gaussian(size: int = 5, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def ssim_loss(p: np.ndarray, t: np.ndarray, size: int = 5, top: float = 1.0) -> float:
    """Mean of clamp((1 - ssim) / 2, 0, 1) over a Gaussian window."""
    k = gaussian(size)

    def blur(a):
        return _along(_along(a, k, 0), k, 1)

    mp, mt = blur(p), blur(t)
    vp, vt, vc = blur(p * p) - mp * mp, blur(t * t) - mt * mt, blur(p * t) - mp * mt
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    ssim = (2 * mp * mt + c1) * (2 * vc + c2) / ((mp**2 + mt**2 + c1) * (vp + vt + c2) + 1e-12)
    return float(np.clip((1 - ssim) / 2, 0, 1).mean())


def ring_overlap(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The part of a polygon within a box (lon_min, lat_min, lon_max, lat_max), cut side by side."""
    points = [tuple(p) for p in ring]
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for i, p in enumerate(points):
            q = points[i - 1]
            inside_p, inside_q = sign * (p[axis] - limit) >= 0, sign * (q[axis] - limit) >= 0
            if inside_p != inside_q:
                f = (limit - q[axis]) / (p[axis] - q[axis])
                out.append(tuple(q[k] + f * (p[k] - q[k]) for k in (0, 1)))
            if inside_p:
                out.append(p)
        points = out
        if not points:
            return []
    return points


def ring_area_km2(ring: list[tuple[float, float]]) -> float:
    """Ellipsoidal area of a small polygon with straight sides in longitude and latitude: the integral of the zone area."""
    if len(ring) < 3:
        return 0.0
    pts = np.radians(np.asarray(ring, float))
    nxt = np.roll(pts, -1, axis=0)
    mid, half = (pts[:, 1] + nxt[:, 1]) / 2, (nxt[:, 1] - pts[:, 1]) / 2
    s = np.sin(mid[:, None] + half[:, None] * NODES)
    es = ECCENTRICITY * s
    zone = MINOR**2 / 2 * (s / (1 - es**2) + np.log((1 + es) / (1 - es)) / (2 * ECCENTRICITY))
    return abs(float(((nxt[:, 0] - pts[:, 0]) / 2 * (zone @ WEIGHTS)).sum())) / 1e6
