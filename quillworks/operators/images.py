"""Grey images as (image_id, height, width, channels, data): kernels in numpy, one pass a pipeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scale, median blur, threshold method, block, C, morphology, kernel, sharpening of each preset.
PRESETS = {
    "clean": dict(scale=1.5, median=3, method="otsu", block=25, c=8, morph="none", kernel=0, sharpen=0.2),
    "shadow": dict(scale=1.8, median=3, method="gaussian", block=45, c=12, morph="close", kernel=2, sharpen=0.1),
    "thin": dict(scale=2.2, median=0, method="gaussian", block=25, c=6, morph="close", kernel=2, sharpen=0.3),
}


def grey(a: np.ndarray) -> np.ndarray:
    """BGR to luma; one channel stays."""
    if a.ndim == 2:
        return a
    return np.clip(np.rint(a[..., 0] * 0.114 + a[..., 1] * 0.587 + a[..., 2] * 0.299), 0, 255).astype(np.uint8)


def padded(a: np.ndarray, k: int) -> np.ndarray:
    return np.pad(a, k, mode="edge")


def neighbours(a: np.ndarray, size: int) -> np.ndarray:
    """size x size values around each pixel, as a last axis."""
    return np.lib.stride_tricks.sliding_window_view(padded(a, size // 2), (size, size)).reshape(*a.shape, -1)


def median_blur(a: np.ndarray, size: int = 3) -> np.ndarray:
    return a if size < 3 else np.median(neighbours(a, size), axis=-1).astype(np.uint8)


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Means of size x size squares by a summed-area table."""
    t = np.pad(padded(a.astype(np.float64), size // 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (t[size:, size:] - t[:-size, size:] - t[size:, :-size] + t[:-size, :-size]) / size**2


def blur(a: np.ndarray, size: int, sigma: float = 0) -> np.ndarray:
    """Gaussian means, one axis after the other. Without a sigma, one that goes with the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    p, n = padded(a.astype(float), size // 2), size
    p = sum(w * p[i : i + a.shape[0]] for i, w in enumerate(k / k.sum()))
    return sum(w * p[:, i : i + a.shape[1]] for i, w in zip(range(n), k / k.sum(), strict=True))


def otsu(a: np.ndarray) -> int:
    """The threshold with the greatest variance between classes."""
    n = np.bincount(a.ravel(), minlength=256).astype(float)
    w, m = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def threshold(a: np.ndarray, method: str = "otsu", block: int = 21, c: float = 10) -> np.ndarray:
    """Black and white by one threshold, by local means (gaussian: weighted), or by local mean and spread (sauvola)."""
    if method == "otsu":
        return np.where(a > otsu(a), 255, 0).astype(np.uint8)
    if method == "gaussian":
        return np.where(a > np.rint(blur(a, block)) - c, 255, 0).astype(np.uint8)
    mean = box_mean(a, block)
    if method == "sauvola":
        spread = np.sqrt(np.maximum(box_mean(a.astype(np.float64) ** 2, block) - mean**2, 0))
        return np.where(a > mean * (1 + 0.1 * (spread / 128 - 1)), 255, 0).astype(np.uint8)
    return np.where(a > mean - c, 255, 0).astype(np.uint8)


def extreme(a: np.ndarray, height: int, width: int, pick) -> np.ndarray:
    """The greatest or least value of a rectangle around each pixel, one axis after the other."""
    for axis, size in ((0, height), (1, width)):
        p = np.pad(a, [(size // 2, size - 1 - size // 2) if x == axis else (0, 0) for x in (0, 1)], mode="edge")
        a = pick.reduce([np.take(p, range(i, i + a.shape[axis]), axis=axis) for i in range(size)])
    return a


def dilate(a: np.ndarray, height: int, width: int | None = None) -> np.ndarray:
    return extreme(a, height, width or height, np.maximum)


def erode(a: np.ndarray, height: int, width: int | None = None) -> np.ndarray:
    return extreme(a, height, width or height, np.minimum)


def morphology(a: np.ndarray, kind: str, height: int = 3, width: int | None = None) -> np.ndarray:
    """open drops small white spots, close small black ones; an even rectangle is turned about for its second half."""
    if kind == "open":
        return dilate(erode(a, height, width)[::-1, ::-1], height, width)[::-1, ::-1]
    return erode(dilate(a, height, width)[::-1, ::-1], height, width)[::-1, ::-1] if kind == "close" else a


def equalize(a: np.ndarray) -> np.ndarray:
    n = np.bincount(a.ravel(), minlength=256).cumsum()
    low = n[n > 0][0]
    return a if n[-1] == low else np.clip(np.rint((n - low) * 255.0 / (n[-1] - low)), 0, 255).astype(np.uint8)[a]


def unsharp(a: np.ndarray, amount: float = 0.5, size: int = 5, sigma: float = 1.0) -> np.ndarray:
    return np.clip(np.rint(a * (1 + amount) - blur(a, size, sigma) * amount), 0, 255).astype(np.uint8)


def invert_if_dark(a: np.ndarray) -> np.ndarray:
    return 255 - a if a.mean() < 127 else a


def _taps(n: int, size: int, scale: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each of n output places, the input places that it reads and their weights, which add up to 1; the edge repeats."""
    middle = (np.arange(n) + 0.5) / scale - 0.5
    if kind == "area" and scale < 1:  # what each place covers, parts included
        wide = int(np.ceil(1 / scale)) + 1
        at = np.floor(np.arange(n) / scale).astype(int)[:, None] + np.arange(wide)
        w = np.clip(np.minimum(at + 1, ((np.arange(n) + 1) / scale)[:, None]) - np.maximum(at, (np.arange(n) / scale)[:, None]), 0, None)
    elif kind == "lanczos":  # wider where it shrinks, so that nothing is skipped
        wide = 3 * max(1.0, 1 / scale)
        at = np.floor(middle - wide).astype(int)[:, None] + np.arange(int(2 * wide) + 2)
        x = (at - middle[:, None]) / max(1.0, 1 / scale)
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0) * ((at >= 0) & (at < size))
    elif kind == "cubic":
        at = np.floor(middle).astype(int)[:, None] + np.arange(-1, 3)
        x = np.abs(at - middle[:, None])
        w = np.where(x <= 1, (1.25 * x - 2.25) * x**2 + 1, np.where(x < 2, -0.75 * (((x - 5) * x + 8) * x - 4), 0))
    else:
        at = np.floor(middle).astype(int)[:, None] + np.arange(2)
        w = np.clip(1 - np.abs(at - middle[:, None]), 0, 1)
    return np.clip(at, 0, size - 1), w / w.sum(axis=1, keepdims=True)


def resize(a: np.ndarray, scale: float, kind: str = "cubic") -> np.ndarray:
    """By cubic pieces, linear ones, covered area or a Lanczos window, one axis after the other."""
    out = a.astype(float)
    for axis in (0, 1):
        at, w = _taps(max(1, round(a.shape[axis] * scale)), a.shape[axis], scale, kind)
        out = np.moveaxis(out, axis, 0)
        out = np.moveaxis(sum(w[:, k].reshape(-1, *[1] * (out.ndim - 1)) * out[at[:, k]] for k in range(w.shape[1])), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def laplacian(a: np.ndarray) -> np.ndarray:
    p = padded(a.astype(float), 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def spots(a: np.ndarray, corners: bool = False) -> np.ndarray:
    """A number for each connected spot of true pixels, 0 for the others; ``corners``: joined at corners too.

    Numbers start as places and sink to the least one of the spot: along pairs of neighbours, then through what a number points to.
    """
    place = np.arange(1, a.size + 1).reshape(a.shape)
    pairs = [(a[:, 1:] & a[:, :-1], place[:, 1:], place[:, :-1]), (a[1:] & a[:-1], place[1:], place[:-1])]
    if corners:
        pairs += [(a[1:, 1:] & a[:-1, :-1], place[1:, 1:], place[:-1, :-1]), (a[1:, :-1] & a[:-1, 1:], place[1:, :-1], place[:-1, 1:])]
    u, v = (np.concatenate([p[k][p[0]] for p in pairs]) for k in (1, 2))
    number = np.arange(a.size + 1)
    while len(u):
        low = np.minimum(number[u], number[v])
        np.minimum.at(number, number[u], low)
        np.minimum.at(number, number[v], low)
        while (number[number] != number).any():
            number = number[number]
        open_ = number[u] != number[v]
        u, v = u[open_], v[open_]
    return np.where(a, number[place], 0)


def drop_specks(a: np.ndarray, least: int = 20) -> np.ndarray:
    """White spots of fewer than ``least`` pixels, joined at edges, turn black."""
    number = spots(a > 0)
    return np.where(np.bincount(number.ravel(), minlength=a.size + 1)[number] < least, 0, a).astype(np.uint8)


def canny(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: ridges of the gradient above ``low`` that are joined to one above ``high``."""
    p = padded(a.astype(float), 1)
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.abs(dx) + np.abs(dy)
    m, t = np.pad(size, 1), np.tan(np.pi / 8)
    at = lambda y, x: m[1 + y : m.shape[0] - 1 + y, 1 + x : m.shape[1] - 1 + x]
    flat, steep = np.abs(dy) < np.abs(dx) * t, np.abs(dy) > np.abs(dx) / t
    same = (dx < 0) == (dy < 0)
    ridge = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(same, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))))
    weak = ridge & (size > low)
    number = spots(weak, True)
    strong = np.zeros(a.size + 1, bool)
    strong[number[weak & (size > high)]] = True
    return np.where(strong[number] & weak, 255, 0).astype(np.uint8)


def hough_lines(edges: np.ndarray, least: int = 100) -> list[tuple[float, float]]:
    """(rho, theta) of straight lines through more than ``least`` edge pixels, one degree apart, those with most pixels first."""
    y, x = np.nonzero(edges)
    theta, reach = np.arange(180) * np.pi / 180, int(np.ceil(np.hypot(*edges.shape))) + 1
    votes = np.stack([np.bincount(np.rint(x * np.cos(t) + y * np.sin(t)).astype(int) + reach, minlength=2 * reach + 1) for t in theta])
    m = np.pad(votes, 1)
    top = (votes > least) & (votes > m[1:-1, :-2]) & (votes >= m[1:-1, 2:]) & (votes > m[:-2, 1:-1]) & (votes >= m[2:, 1:-1])
    t, r = np.nonzero(top)
    order = np.lexsort((t, r, -votes[t, r]))
    return [(float(r[k] - reach), float(theta[t[k]])) for k in order]


def quality(a: np.ndarray) -> float:
    """0 to 1 from sharpness, contrast and brightness."""
    return float(0.4 * min(1.0, laplacian(a).var() / 1000) + 0.4 * a.std() / 255 + 0.2 * (1 - 2 * abs(a.mean() / 255 - 0.5)))


def level(a: np.ndarray, n: int) -> np.ndarray:
    """Preprocessing from none (0) to strong (3)."""
    a = grey(a)
    if n >= 1:
        a = resize(a, 600 / min(a.shape), "cubic") if 0 < min(a.shape) < 600 else a
        a = unsharp(median_blur(clahe(a, 4.0)), 0.5, sigma=1.5)
    if n >= 2:
        a = np.maximum(np.maximum(threshold(a), threshold(a, "gaussian", 21, 10)), threshold(a, "mean", 21, 10))
        a = unsharp(a, 2.0, sigma=0)
    if n >= 3:
        a = equalize(morphology(morphology(morphology(a, "close", 1, 3), "close", 3, 1), "open", 2))
    return a


def apply_preset(a: np.ndarray, p: dict) -> np.ndarray:
    """Within 800 pixels, grey, scaled, denoised, black and white, closed or opened, sharpened."""
    a = resize(a, 800 / max(a.shape), "area") if (a := grey(a)).size and max(a.shape) > 800 else a
    a = median_blur(resize(a, p["scale"]), p["median"])
    a = threshold(a, p["method"], p["block"], p["c"])
    a = morphology(a, p["morph"], p["kernel"]) if p["kernel"] else a
    return unsharp(a, p["sharpen"]) if p["sharpen"] else a


def preset(a: np.ndarray, name: str) -> np.ndarray:
    return apply_preset(a, PRESETS.get(name, PRESETS["clean"]))


SCHEMA = "image_id string, height int, width int, channels int, data binary, quality double"


def preprocess(images: DataFrame, steps=(lambda a: level(a, 1),)) -> DataFrame:
    """All steps on each image in one pass, with its quality. An image that cannot be read has null data and quality 0.5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples():
                try:
                    a = np.frombuffer(x.data, np.uint8).reshape((x.height, x.width) if x.channels == 1 else (x.height, x.width, x.channels))
                    for step in steps:
                        a = step(a)
                    rows.append((x.image_id, a.shape[0], a.shape[1], 1, grey(a).tobytes(), quality(grey(a))))
                except (ValueError, TypeError):
                    rows.append((x.image_id, None, None, None, None, 0.5))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    return images.mapInPandas(run, SCHEMA)


# ---- further kernels ------------------------------------------------------------------------------------------------


def gaussian(a: np.ndarray, size: int = 3, sigma: float = 0.5) -> np.ndarray:
    return np.clip(np.rint(blur(a, size, sigma)), 0, 255).astype(np.uint8)


def sharpen_kernel(a: np.ndarray, blend: float = 0.3) -> np.ndarray:
    """A cross kernel of 5 and -1, mixed with the image."""
    sharp = a.astype(float) - laplacian(a)
    return np.clip(np.rint(a * (1 - blend) + sharp * blend), 0, 255).astype(np.uint8)


def bilateral(a: np.ndarray, size: int = 9, colour: float = 75, space: float = 75) -> np.ndarray:
    """Each pixel as its neighbours' mean, weighted by nearness in place and value."""
    n, at = neighbours(a, size).astype(float), np.arange(size) - size // 2
    w = np.exp(-((at[:, None] ** 2 + at[None, :] ** 2).ravel()) / (2 * space**2)) * np.exp(-((n - a[..., None]) ** 2) / (2 * colour**2))
    return np.clip(np.rint((n * w).sum(-1) / w.sum(-1)), 0, 255).astype(np.uint8)


def nonlocal_means(a: np.ndarray, h: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Each pixel as the mean of its surroundings, weighted by how alike the patches around them are."""
    p = padded(a.astype(float), search // 2)
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for dy in range(search):
        for dx in range(search):
            moved = p[dy : dy + a.shape[0], dx : dx + a.shape[1]]
            w = np.exp(-np.maximum(box_mean((moved - a) ** 2, patch), 0) / h**2)
            total, weight = total + w * moved, weight + w
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def clahe(a: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast by tile: clipped histograms equalised, and mapped bilinearly between the centres of tiles."""
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) * tiles - min(h, w) else "edge")
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * th * tw / 256)
            n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256
            maps[i, j] = n.cumsum() * 255 / (th * tw)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1), (y - y0)[:, None], (x - x0)[None, :]
    of = lambda i, j: maps[i[:, None], j[None, :], a]
    return np.clip(np.rint((of(y0, x0) * (1 - fx) + of(y0, x1) * fx) * (1 - fy) + (of(y1, x0) * (1 - fx) + of(y1, x1) * fx) * fy), 0, 255).astype(np.uint8)


def rotate(a: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned about the middle on a canvas that holds all of it, bilinear."""
    r = np.deg2rad(degrees)
    h, w = a.shape
    nh, nw = int(np.ceil(abs(h * np.cos(r)) + abs(w * np.sin(r)) - 1e-9)), int(np.ceil(abs(w * np.cos(r)) + abs(h * np.sin(r)) - 1e-9))
    y, x = np.mgrid[:nh, :nw] - np.array([(nh - 1) / 2, (nw - 1) / 2])[:, None, None]
    sy, sx = np.cos(r) * y + np.sin(r) * x + (h - 1) / 2, -np.sin(r) * y + np.cos(r) * x + (w - 1) / 2
    inside = (sy > -0.5) & (sy < h - 0.5) & (sx > -0.5) & (sx < w - 0.5)
    sy, sx = np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)
    y0, x0 = sy.astype(int), sx.astype(int)
    y1, x1, fy, fx, f = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), sy - y0, sx - x0, a.astype(float)
    out = (f[y0, x0] * (1 - fx) + f[y0, x1] * fx) * (1 - fy) + (f[y1, x0] * (1 - fx) + f[y1, x1] * fx) * fy
    return np.where(inside, np.clip(np.rint(out), 0, 255), fill).astype(np.uint8)


def skew(a: np.ndarray, most: float = 10, step: float = 0.25) -> float:
    """Degrees to turn by so that dark lines lie level: the turn whose row sums vary most, from the edge pixels alone."""
    edge = np.abs(np.diff(a.astype(int), axis=0)) > 50
    y, x = np.nonzero(edge)
    if len(y) < 100:
        return 0.0
    best, score = 0.0, -1.0
    for d in np.arange(-most, most + step, step):
        r = np.deg2rad(d)
        n = np.bincount(np.rint(y * np.cos(r) - x * np.sin(r) + max(a.shape)).astype(int)).astype(float)
        if (s := (n**2).sum()) > score:
            best, score = float(d), s
    return best


def lean(a: np.ndarray) -> float:
    """The median angle in degrees of straight lines within 45 degrees of upright; 0 without any."""
    angles = [t * 180 / np.pi for _, t in hough_lines(canny(threshold(a, "gaussian", 11, 2), 50, 150))]
    near = [x if x < 45 else x - 180 for x in angles if x < 45 or x > 135]
    return float(np.median(near)) if near else 0.0


def deskew(a: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Turned back if its upright lines lean by more than ``least`` degrees; without such lines, if its level ones do."""
    d = lean(a) or skew(a)
    return rotate(a, d) if abs(d) > least else a


def wavelet_shrink(a: np.ndarray) -> np.ndarray:
    """One Haar level with soft thresholds for each detail band: noise variance / signal spread."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    if not h or not w:
        return a
    p = a[:h, :w].astype(float)
    q = [p[i::2, j::2] for i in (0, 1) for j in (0, 1)]
    low, *details = (q[0] + q[1] + q[2] + q[3]) / 2, (q[0] - q[1] + q[2] - q[3]) / 2, (q[0] + q[1] - q[2] - q[3]) / 2, (q[0] - q[1] - q[2] + q[3]) / 2
    noise = (np.median(np.abs(details[2])) / 0.6745) ** 2
    b, c, d = (np.sign(x) * np.maximum(np.abs(x) - noise / max(1e-9, np.sqrt(max(x.var() - noise, 0))), 0) if x.var() > noise else x * 0 for x in details)
    out = a.astype(float)
    out[0:h:2, 0:w:2], out[0:h:2, 1:w:2], out[1:h:2, 0:w:2], out[1:h:2, 1:w:2] = (low + b + c + d) / 2, (low - b + c - d) / 2, (low + b - c - d) / 2, (low - b - c + d) / 2
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def fit(a: np.ndarray, least: tuple[int, int] = (600, 800), most: int = 3000) -> np.ndarray:
    """Twice as large if it is small, and within ``most`` pixels."""
    a = resize(a, 2, "lanczos") if a.shape[0] < least[0] or a.shape[1] < least[1] else a
    return resize(a, most / max(a.shape), "lanczos") if max(a.shape) > most else a


def contrast(a: np.ndarray, factor: float = 1.2) -> np.ndarray:
    """Further from the mean, or nearer to it."""
    mean = np.rint(a.mean()) if a.size else 0
    return np.clip(np.rint(mean + (a - mean) * factor), 0, 255).astype(np.uint8)


def sharpness(a: np.ndarray, factor: float = 1.1) -> np.ndarray:
    """Further from a smoothed copy: neighbours weigh 1, the pixel 5."""
    smooth = np.rint((neighbours(a, 3).astype(float).sum(-1) + 4.0 * a) / 13)
    return np.clip(np.rint(smooth + (a - smooth) * factor), 0, 255).astype(np.uint8)


def page_score(a: np.ndarray) -> float:
    """0 to 100 for a page: edges (30), spread of the histogram (25), share of black and white (25), less one for each hundred specks (10).

    A speck is an ink spot whose outline encloses less than 10: by Pick's rule its pixels less half of those at its rim less one.
    """
    if a.size == 0:
        return 50.0
    edges = min(30.0, (canny(a, 100, 200) > 0).mean() * 500)
    spread = min(25.0, np.bincount(a.ravel(), minlength=256).var() / 10_000)
    ink = a < 255
    m, number = np.pad(ink, 1), spots(ink, True)
    rim = ink & ~(m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:])
    pixels, outer = (np.bincount(number[x], minlength=a.size + 1) for x in (ink, rim))
    area = np.where(pixels == outer, 0, pixels - outer / 2 - 1)
    specks = ((pixels > 0) & (area < 10)).sum()
    return float(np.clip(edges + spread + np.isin(a, (0, 255)).mean() * 25 - min(10.0, specks / 100), 0, 100))


def best_preset(a: np.ndarray) -> tuple[str, np.ndarray]:
    """The preset whose result scores best, the first of equals; without any score, clean and the image as it is."""
    name, out, score = "clean", a, 0.0
    for k in PRESETS:
        made = preset(a, k)
        if (s := page_score(made)) > score:
            name, out, score = k, made, s
    return name, out


def parameter_sets(rounds: int = 50, seed: int = 0) -> list[dict]:
    """Random parameter sets; the seed makes them repeatable."""
    rng = np.random.default_rng(seed)
    pick = lambda values: values[rng.integers(len(values))]
    some = {"median": (0, 3, 5), "method": ("otsu", "gaussian"), "block": tuple(range(25, 72, 2)), "c": tuple(range(3, 21)), "morph": ("none", "open", "close"), "kernel": (0, 2, 3)}
    return [{"scale": float(rng.uniform(1.2, 2.5)), **{k: pick(v) for k, v in some.items()}, "sharpen": float(rng.uniform(0, 0.5))} for _ in range(rounds)]


def tune(images: DataFrame, rounds: int = 50, seed: int = 0) -> tuple[dict, float]:
    """The set of ``rounds`` random ones with the best mean page score over all images, the first of equals; clean without any score.

    Each task scores its pages under every set; means by set are an aggregate, one row a set.
    """
    sets = parameter_sets(rounds, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [np.frombuffer(x.data, np.uint8).reshape((x.height, x.width) if x.channels == 1 else (x.height, x.width, x.channels)) for x in batch.itertuples() if x.data is not None]
            yield pd.DataFrame([(k, page_score(apply_preset(a, p))) for a in pages for k, p in enumerate(sets)], columns=["set", "score"])

    means = images.select("height", "width", "channels", "data").mapInPandas(run, "set long, score double").groupBy("set").agg(F.avg("score").alias("score"))
    best = max(means.collect(), key=lambda r: (r["score"], -r["set"]), default=None)  # ``rounds`` rows
    return (sets[best["set"]], best["score"]) if best and best["score"] > 0 else (PRESETS["clean"], 0.0)


def mild_sharpen(a: np.ndarray) -> np.ndarray:
    """A 3 x 3 kernel of 1.8 in the middle and -0.1 around; the edge is mirrored."""
    p = np.pad(a.astype(float), 1, mode="reflect" if min(a.shape) > 1 else "edge")
    around = sum(p[y : y + a.shape[0], x : x + a.shape[1]] for y in range(3) for x in range(3)) - a
    return np.clip(np.rint(1.8 * a - 0.1 * around), 0, 255).astype(np.uint8)


#: Named pipelines; a step can be left out by name.
PIPELINES = {
    "web": {"fit": fit, "contrast": contrast, "sharpen": sharpness},
    "full": {"scale": lambda a: resize(a, 300 / 72) if max(a.shape) < 400 else a, "denoise": gaussian, "deskew": deskew, "contrast": lambda a: clahe(a, 3.0), "sharpen": sharpen_kernel, "binarize": lambda a: np.minimum(threshold(a), threshold(a, "gaussian", 11, 2)), "morphology": lambda a: morphology(morphology(a, "open", 2), "close", 2)},
    "research": {"bilateral": bilateral, "contrast": lambda a: clahe(a, 3.0), "binarize": lambda a: np.maximum(threshold(a, "sauvola", 25), threshold(a)), "specks": drop_specks, "wavelet": wavelet_shrink, "sharpen": lambda a: unsharp(a, 1.5)},
    "conservative": {"contrast": lambda a: clahe(a, 1.2), "denoise": median_blur, "sharpen": mild_sharpen},
}


def pipeline(name: str, leave_out=()):
    """The steps of a named pipeline, for preprocess()."""
    return (grey, *(step for k, step in PIPELINES[name].items() if k not in leave_out))


def stages(images: DataFrame, name: str, leave_out=()) -> DataFrame:
    """(image_id, place, stage, height, width, data): the image after each step of a named pipeline. An image that cannot be read has none."""
    steps = [("grey", grey), *((k, step) for k, step in PIPELINES[name].items() if k not in leave_out)]
    columns = ["image_id", "place", "stage", "height", "width", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples():
                try:
                    a = np.frombuffer(x.data, np.uint8).reshape((x.height, x.width) if x.channels == 1 else (x.height, x.width, x.channels))
                except (ValueError, TypeError):
                    continue
                for k, (stage, step) in enumerate(steps):
                    a = step(a)
                    rows.append((x.image_id, k, stage, *a.shape, a.tobytes()))
            yield pd.DataFrame(rows, columns=columns)

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, "image_id string, place int, stage string, height int, width int, data binary")
