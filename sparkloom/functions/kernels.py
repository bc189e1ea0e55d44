"""Array kernels in numpy for grouped maps: rasters of a mask or channel fit one task."""

from __future__ import annotations

import numpy as np


def footprint(kind: str, r: int) -> np.ndarray:
    """disk, box or cross of radius r."""
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return {"disk": x * x + y * y <= r * r, "box": np.ones_like(x, bool), "cross": (x == 0) | (y == 0)}[kind]


def _shifted(mask: np.ndarray, foot: np.ndarray, outside: bool, all_: bool) -> np.ndarray:
    r = foot.shape[0] // 2
    p = np.pad(mask, r, constant_values=outside)
    out = np.full(mask.shape, all_)
    for i, j in np.argwhere(foot):
        part = p[i : i + mask.shape[0], j : j + mask.shape[1]]
        out = out & part if all_ else out | part
    return out


def dilate(mask: np.ndarray, foot: np.ndarray) -> np.ndarray:
    return _shifted(mask.astype(bool), foot[::-1, ::-1], False, False)


def erode(mask: np.ndarray, foot: np.ndarray, outside: bool = False) -> np.ndarray:
    """`outside` says what pixels beyond the raster count as."""
    return _shifted(mask.astype(bool), foot, outside, True)


def close(mask: np.ndarray, foot: np.ndarray) -> np.ndarray:
    return erode(dilate(mask, foot), foot, True)


def open_(mask: np.ndarray, foot: np.ndarray) -> np.ndarray:
    return dilate(erode(mask, foot), foot)


def components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Labels 1, 2, ... in scan order of each component's first pixel, 0 outside. Labels spread as
    minima along rows and columns both ways until they rest."""
    mask = mask.astype(bool)
    big = mask.size + 1
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), big)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    while True:
        was = lab.copy()
        for dy, dx in steps:
            a = (slice(dy, None), slice(max(dx, 0), mask.shape[1] + min(dx, 0)))
            b = (slice(0, mask.shape[0] - dy), slice(max(-dx, 0), mask.shape[1] - max(dx, 0)))
            low = np.where(mask[a] & mask[b], np.minimum(lab[a], lab[b]), big)
            lab[a] = np.where(mask[a], np.minimum(lab[a], low), big)
            lab[b] = np.where(mask[b], np.minimum(lab[b], low), big)
        root = np.append(0, np.where(mask, lab, 0).ravel())  # a label's pixel knows a smaller one
        lab = np.where(mask, root[np.where(mask, lab, 0)], big)
        if np.array_equal(lab, was):
            break
    return np.where(mask, np.searchsorted(np.unique(lab[mask]), lab) + 1, 0) if mask.any() else np.zeros(mask.shape, int)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that does not reach the border by 4-neighbours becomes mask."""
    lab = components(~np.pad(mask.astype(bool), 1))
    return (lab != lab[0, 0])[1:-1, 1:-1]


def drop_small(mask: np.ndarray, least: int, eight: bool = True) -> np.ndarray:
    lab = components(mask, eight)
    size = np.bincount(lab.ravel())
    size[0] = 0
    return size[lab] >= max(least, 1)


def gaussian(a: np.ndarray, sigma: float, mode: str = "edge") -> np.ndarray:
    """Separable blur, radius int(4 sigma + 0.5); mode as in numpy.pad (edge, symmetric)."""
    r = int(4 * sigma + 0.5)
    if r == 0:
        return a.astype(float)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if x == axis else (0, 0) for x in (0, 1)], mode=mode)
        a = sum(w * np.take(p, range(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return a


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each mask pixel to the nearest pixel outside, 0 outside; without any
    pixel outside, infinite."""
    mask = mask.astype(bool)
    far = float(sum(mask.shape) * 4)
    g = np.where(mask, far, 0.0)
    for order in (range(1, g.shape[0]), range(g.shape[0] - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        for i in order:
            g[i] = np.minimum(g[i], g[i - step] + 1)
    x = np.arange(mask.shape[1])
    d2 = (x[:, None] - x[None, :]) ** 2
    out = np.stack([(d2 + row[None, :] ** 2).min(1) for row in g])
    return np.where(out >= far * far, np.inf, np.sqrt(out))


def signed_distance(mask: np.ndarray, clip: float = 60.0, sigma: float = 0.0) -> np.ndarray:
    """Outside minus inside distance, clipped, smoothed."""
    d = np.clip(distance(~mask.astype(bool)), 0, clip) - np.clip(distance(mask), 0, clip)
    return gaussian(d, sigma, "symmetric") if sigma else d


def sdf_correlation(a: np.ndarray, b: np.ndarray, band: float = 20.0) -> float:
    """Correlation of signed distances where either is within the band, mapped to [0, 1]; fewer
    than 10 pixels or a constant give 0."""
    x, y = signed_distance(a, 1e6), signed_distance(b, 1e6)
    near = (np.abs(x) <= band) | (np.abs(y) <= band)
    if near.sum() < 10 or x[near].std() == 0 or y[near].std() == 0:
        return 0.0
    return float((np.corrcoef(x[near], y[near])[0, 1] + 1) / 2)


def thickness(mask: np.ndarray, q: float = 0.75) -> float:
    d = distance(mask)[mask.astype(bool)]
    return float(np.quantile(d, q)) if len(d) else 0.0


def clean(mask: np.ndarray, close_r: int = 2, open_r: int = 1, least: int = 30) -> np.ndarray:
    """Close, open, fill, smooth by half, drop small parts."""
    m = close(mask, footprint("disk", close_r)) if close_r else mask.astype(bool)
    m = open_(m, footprint("disk", open_r)) if open_r else m
    m = gaussian(fill_holes(m).astype(float), 1.0) > 0.5
    return drop_small(m, least)


def soft_mask(iy: np.ndarray, ix: np.ndarray, shape: tuple[int, int], sigma: float = 2.0, threshold: float = 0.08, close_r: int = 2, least: int = 0) -> np.ndarray:
    """Blurred point counts over their maximum, thresholded, closed, filled."""
    n = np.zeros(shape)
    np.add.at(n, (iy, ix), 1)
    g = gaussian(n, sigma, "symmetric")
    m = g / max(g.max(), 1e-12) >= threshold
    m = fill_holes(close(m, footprint("disk", close_r)))
    return drop_small(m, least) if least else m


def _corners(h: int, w: int, y: np.ndarray, x: np.ndarray):
    """The four pixels about coordinates (clipped to the raster), and the place between them."""
    yc, xc = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(yc.astype(int), max(h - 2, 0)), np.minimum(xc.astype(int), max(w - 2, 0))
    return y0, x0, np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), yc - y0, xc - x0


def bilinear(field: np.ndarray, y: np.ndarray, x: np.ndarray, outside: str = "zeros") -> np.ndarray:
    """Values of field (..., H, W) at pixel coordinates; outside: zeros or border."""
    h, w = field.shape[-2:]
    inside = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    y0, x0, y1, x1, fy, fx = _corners(h, w, y, x)
    v = (field[..., y0, x0] * (1 - fx) + field[..., y0, x1] * fx) * (1 - fy) + (field[..., y1, x0] * (1 - fx) + field[..., y1, x1] * fx) * fy
    return np.where(inside, v, 0.0) if outside == "zeros" else v


def bilinear_slopes(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of `bilinear` (border) by y and by x."""
    h, w = field.shape[-2:]
    y0, x0, y1, x1, fy, fx = _corners(h, w, y, x)
    a, b, c, d = field[..., y0, x0], field[..., y0, x1], field[..., y1, x0], field[..., y1, x1]
    return ((c - a) * (1 - fx) + (d - b) * fx) * ((y >= 0) & (y <= h - 1)), ((b - a) * (1 - fy) + (d - c) * fy) * ((x >= 0) & (x <= w - 1))


def bilinear_spread(v: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The transpose of `bilinear` (border): v (C, H, W), read at pixel coordinates, summed at the pixels it was read from."""
    h, w = v.shape[-2:]
    y0, x0, y1, x1, fy, fx = _corners(h, w, y, x)
    parts = ((y0, x0, (1 - fy) * (1 - fx)), (y0, x1, (1 - fy) * fx), (y1, x0, fy * (1 - fx)), (y1, x1, fy * fx))
    return np.stack([sum(np.bincount((i * w + j).ravel(), (p * c).ravel(), h * w) for i, j, p in parts) for c in v]).reshape(v.shape)


def _spline_basis(x: np.ndarray, df: int, degree: int = 3) -> np.ndarray:
    """B-spline basis with an intercept, df columns, inner knots at quantiles."""
    inner = np.quantile(x, np.linspace(0, 1, df - degree + 1)[1:-1])
    t = np.concatenate(([x.min()] * (degree + 1), inner, [x.max()] * (degree + 1)))
    b = np.array([(t[i] <= x) & (x < t[i + 1]) for i in range(len(t) - 1)], float)
    b[np.flatnonzero(t[:-1] < t[1:])[-1], x == x.max()] = 1
    for k in range(1, degree + 1):
        n = len(t) - 1 - k
        left = np.array([(x - t[i]) / (t[i + k] - t[i]) if t[i + k] > t[i] else 0 * x for i in range(n)])
        right = np.array([(t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) if t[i + k + 1] > t[i + 1] else 0 * x for i in range(n)])
        b = left * b[:n] + right * b[1 : n + 1]
    return b.T


def spline_hat(times: np.ndarray, df: int = 8, degree: int = 3, ridge: float = 1e-2) -> np.ndarray:
    """Smoother matrix of a ridge B-spline over the times; df is at most their number."""
    b = _spline_basis(np.asarray(times, float), max(degree + 1, min(df, len(times))), degree)
    return b @ np.linalg.solve(b.T @ b + ridge * np.eye(b.shape[1]), b.T)


def rw2_smooth(z: np.ndarray, lam: float = 25.0) -> np.ndarray:
    """(I + lam D'D)^-1 z with second differences D."""
    n = len(z)
    d = np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((0, n))
    return np.linalg.solve(np.eye(n) + lam * d.T @ d, z)


def ward(points: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Ward linkage of a few dozen points: merges (a, b, height), new nodes n, n + 1, ..."""
    n = len(points)
    w = {i: float(1 if weights is None else weights[i]) for i in range(n)}
    c = {i: np.asarray(points[i], float) for i in range(n)}
    out = []
    for new in range(n, 2 * n - 1):
        keys = sorted(c)
        cost, a, b = min((w[i] * w[j] / (w[i] + w[j]) * float(((c[i] - c[j]) ** 2).sum()), i, j) for x, i in enumerate(keys) for j in keys[x + 1 :])
        out.append((a, b, (2 * cost) ** 0.5))
        w[new] = w[a] + w[b]
        c[new] = (w[a] * c[a] + w[b] * c[b]) / w[new]
        for k in (a, b):
            del w[k], c[k]
    return out


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int) -> list[int]:
    """Labels 0.. of n leaves after all but k - 1 merges, numbered by first leaf."""
    parent = list(range(2 * n - 1))
    for i, (a, b, _) in enumerate(merges[: n - k]):
        parent[a] = parent[b] = n + i

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    seen: dict[int, int] = {}
    return [seen.setdefault(root(i), len(seen)) for i in range(n)]


def hierarchy_levels(n: int, levels: int) -> list[int]:
    """Cluster numbers of the levels, round(i n / levels), strictly rising within 1..n."""
    out: list[int] = []
    for i in range(1, levels + 1):
        out.append(min(n - (levels - i), max(round(i * n / levels), (out[-1] if out else 0) + 1)))
    return out
