"""Picture features in numpy: decoded pixels to fingerprints, mean colour, colourfulness.

Arrays are height x width x 3, red first, 8 bits; Spark's image source decodes them in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Pixels = np.ndarray
#: A detector of codes: pixels to polygons, a list of points each. None is built in.
Detector = Callable[[Pixels], list[list[tuple[float, float]]]]


def gray(image: Pixels) -> np.ndarray:
    """Luma by the weights of ITU-R 601, rounded down from 16 bits as decoders do."""
    r, g, b = (image[..., i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _filter(size: int, to: int, support: float, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights that resample ``size`` samples to ``to``, widened when shrinking."""
    scale = max(1.0, size / to)
    centers = (np.arange(to) + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - centers[:, None]) / scale
    w = np.where(np.abs(x) < support, kernel(x), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def resized(channel: np.ndarray, height: int, width: int, smooth: bool = True) -> np.ndarray:
    """A channel at another size: Lanczos if ``smooth``, else bilinear."""
    support, kernel = (3.0, _lanczos) if smooth else (1.0, _triangle)
    rows, columns = _filter(channel.shape[0], height, support, kernel), _filter(channel.shape[1], width, support, kernel)
    return np.clip(np.rint(rows @ channel.astype(np.float64) @ columns.T), 0, 255)


def packed(bits: np.ndarray) -> int:
    """Bits in rows, the first one highest, as a signed 64-bit integer."""
    return int(np.packbits(bits.ravel().astype(np.uint8)).view(">i8")[0])


def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def frequency_bits(channel: np.ndarray, side: int) -> np.ndarray:
    """Which of the lowest ``side`` x ``side`` cosine coefficients lie over their median."""
    n = 4 * side
    small = resized(channel, n, n)
    c = _cosines(n)
    low = (c @ small @ c.T)[:side, :side]
    return low > np.median(low)


def phash(channel: np.ndarray) -> int:
    return packed(frequency_bits(channel, 8))


def wide_hash(channel: np.ndarray, side: int) -> bytes:
    """A byte a bit, of a larger block of coefficients."""
    return frequency_bits(channel, side).astype(np.uint8).tobytes()


def whash(channel: np.ndarray) -> int:
    """Haar coefficients of the 8 x 8 level without the overall mean, over their median."""
    scale = max(8, 1 << (min(channel.shape).bit_length() - 1))
    x = resized(channel, scale, scale) / 255.0
    while x.shape[0] > 8:
        x = (x[::2] + x[1::2]) / 2
        x = (x[:, ::2] + x[:, 1::2]) / 2
    x = x - x.mean()
    return packed(x > np.median(x))


def grid(channel: np.ndarray) -> list[int]:
    """Fingerprints of 4 x 4 cells in rows; none where an edge is under 32 pixels."""
    h, w = channel.shape
    if min(h, w) < 32:
        return []
    return [phash(channel[h * r // 4 : h * (r + 1) // 4, w * c // 4 : w * (c + 1) // 4]) for r in range(4) for c in range(4)]


def mean_hsv(image: Pixels) -> tuple[float, float, float]:
    """Arithmetic means of hue in degrees, saturation and value, of the picture at 32 x 32."""
    rgb = np.stack([resized(image[..., i], 32, 32, smooth=False) for i in range(3)], axis=-1) / 255.0
    top, low = rgb.max(axis=-1), rgb.min(axis=-1)
    spread = np.where(top > low, top - low, 1.0)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    sector = np.where(top == r, ((g - b) / spread) % 6, np.where(top == g, (b - r) / spread + 2, (r - g) / spread + 4))
    hue = np.where(top > low, sector * 60.0, 0.0)
    return float(hue.mean()), float(np.where(top > 0, (top - low) / np.where(top > 0, top, 1.0), 0.0).mean()), float(top.mean())


def _lab(image: Pixels) -> np.ndarray:
    """CIE a and b of sRGB under D65, shifted by 128 as 8-bit pictures hold them."""
    c = image.astype(np.float64) / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    to_xyz = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = c @ to_xyz.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1) + 128


def is_colorful(image: Pixels, least: float = 15.0) -> bool:
    """Spread of the colour axes and a share of their mean's distance from gray, on 400 pixels a side at most."""
    step = max(1, -(-max(image.shape[:2]) // 400))
    ab = _lab(image[::step, ::step]).reshape(-1, 2)
    return bool(np.sqrt(ab.var(axis=0).sum()) + 0.3 * np.sqrt(((ab.mean(axis=0) - 128) ** 2).sum()) > least)


def cropped(image: Pixels, white: int = 240) -> Pixels:
    """Without white borders; a landscape is turned upright. An all-white picture stays as it is."""
    g = gray(image).astype(np.float64)
    low, high = np.percentile(g, 2), np.percentile(g, 98)
    g = np.clip((g - low) * 255 / (high - low), 0, 255) if high > low else g
    ink = g < white
    if ink.any():
        rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
        image = image[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    return np.rot90(image) if image.shape[1] > image.shape[0] else image


def equalized(channel: np.ndarray) -> np.ndarray:
    """Gray levels spread so that each is about as frequent."""
    counts = np.bincount(channel.ravel(), minlength=256)
    step = (counts.sum() - counts[np.flatnonzero(counts)[-1]]) // 255
    if not step:
        return channel
    table = (np.cumsum(counts) - counts + step // 2) // step
    return np.clip(table, 0, 255).astype(np.uint8)[channel]


@dataclass(frozen=True)
class Wanted:
    """Which features to compute, so that one decoding serves all."""

    rotations: bool = False
    preprocess: bool = False
    whash: bool = True
    color: bool = True
    detector: Detector | None = None
    only_colorful_codes: bool = False


def features(image: Pixels, want: Wanted = Wanted()) -> dict:  # noqa: B008
    """All wanted features of one picture; wavelet hash and colour are of the cropped picture always."""
    trimmed = cropped(image)
    base = gray(trimmed if want.preprocess else image)
    base = equalized(base) if want.preprocess else base
    out = {
        "width": int(image.shape[1]), "height": int(image.shape[0]), "phash": phash(base), "grid": grid(base),
        "phash_256": wide_hash(base, 16), "phash_1024": wide_hash(base, 32), "features_at": 1,
    }
    if want.rotations:
        turned = {d: np.rot90(base, -d // 90) for d in (90, 180, 270)}
        out["phash_rot"] = {d: phash(x) for d, x in turned.items()}
        out["grid_rot"] = {d: grid(x) for d, x in turned.items()}
    if want.whash:
        out["whash"] = whash(gray(trimmed))
        out["features_at"] |= 2
    if want.color:
        h, s, v = mean_hsv(trimmed)
        out |= {"hsv": {"h": h, "s": s, "v": v}, "is_colorful": is_colorful(image)}
        out["features_at"] |= 4
    if want.detector is not None and (out.get("is_colorful", True) or not want.only_colorful_codes):
        found = want.detector(image)
        out["qr_points"] = [[{"x": float(x), "y": float(y)} for x, y in polygon] for polygon in found] or None
        out["features_at"] |= 8
    return out


def difference(a: Pixels, b: Pixels) -> float:
    """Mean absolute difference of two pictures at the first one's size, four times over and clipped."""
    b = np.stack([resized(b[..., i], *a.shape[:2]) for i in range(3)], axis=-1)
    return float(np.clip(np.abs(a.astype(np.float64) - b) * 4, 0, 255).mean())


#: How regions that may hold a code are proposed: the longest side that is looked at, the least
#: gradient, the side of the square that closes gaps, the least area, the largest share, and the aspects.
REGION_SIDE, REGION_GRADIENT, REGION_CLOSE, REGION_AREA, REGION_SHARE, REGION_ASPECT = 800, 50, 11, 400, 0.5, (0.3, 3.5)


def _spread(mask: np.ndarray, side: int, of: np.ufunc, outside: bool) -> np.ndarray:
    """Combine each pixel's square neighbourhood, rows first and columns then."""
    half = side // 2
    for axis in (0, 1):
        padded = np.pad(mask, [(half, half) if a == axis else (0, 0) for a in (0, 1)], constant_values=outside)
        mask = of.reduce(np.lib.stride_tricks.sliding_window_view(padded, side, axis=axis), axis=-1)
    return mask


def _components(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, width, height) of the connected parts of a mask, corners included: runs of rows joined by union."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mask[y], [False])).astype(np.int8)))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            own = len(parent)
            parent.append(own)
            boxes.append([a, y, b, y + 1])
            for a2, b2, other in above:
                if a <= b2 and a2 <= b and root(other) != root(own):
                    parent[root(own)] = root(other)
            now.append((a, b, own))
        above = now
    found: dict[int, list[int]] = {}
    for i, (a, t, b, u) in enumerate(boxes):
        box = found.setdefault(root(i), [a, t, b, u])
        box[:] = [min(box[0], a), min(box[1], t), max(box[2], b), max(box[3], u)]
    return [(a, t, b - a, u - t) for a, t, b, u in found.values()]


def code_regions(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, width, height) of a picture that may hold a code: dense edges of a fair shape, by rows."""
    plane = gray(image).astype(np.float64) if image.ndim == 3 else image.astype(np.float64)
    scale = min(1.0, REGION_SIDE / max(plane.shape))
    if scale < 1.0:
        plane = _shrunk(plane, max(1, round(plane.shape[0] * scale)), max(1, round(plane.shape[1] * scale)))
    p = np.pad(plane, 1, mode="reflect" if min(plane.shape) > 1 else "edge")
    smooth = lambda a: a[:-2] + 2 * a[1:-1] + a[2:]
    dx = smooth(p)[:, 2:] - smooth(p)[:, :-2]
    dy = smooth(p.T)[:, 2:].T - smooth(p.T)[:, :-2].T
    edge = np.minimum(np.rint(np.hypot(dx, dy)), 255) > REGION_GRADIENT
    closed = _spread(_spread(edge, REGION_CLOSE, np.logical_or, False), REGION_CLOSE, np.logical_and, True)
    out = []
    for x, y, w, h in _components(closed):
        if REGION_AREA <= w * h <= REGION_SHARE * closed.size and REGION_ASPECT[0] <= w / h <= REGION_ASPECT[1]:
            out.append((int(x / scale), int(y / scale), int(w / scale), int(h / scale)))
    return sorted(out, key=lambda b: (b[1], b[0]))


def _shrunk(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """A smaller picture by the mean over each pixel's area."""
    for axis, size in ((0, height), (1, width)):
        sums = np.concatenate([np.zeros_like(plane.take([0], axis=axis)), np.cumsum(plane, axis=axis)], axis=axis)
        cuts = np.linspace(0, plane.shape[axis], size + 1)
        low = np.floor(cuts).astype(int)
        part = (cuts - low).reshape([-1 if a == axis else 1 for a in (0, 1)])
        at = sums.take(low, axis=axis) * (1 - part) + sums.take(np.minimum(low + 1, plane.shape[axis]), axis=axis) * part
        plane = np.diff(at, axis=axis) / (plane.shape[axis] / size)
    return plane
