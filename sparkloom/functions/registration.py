"""Diffeomorphic registration of multi-channel rasters and flow of points, in numpy.

Large-deformation matching by L-BFGS on a time-dependent velocity (the variational form whose
minimisers are the geodesics that shooting follows): a smooth kernel (id - a^2 laplacian)^-2p in the
Fourier domain, semi-Lagrangian transport, gradients of the transport as it is computed, backtracking steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .kernels import bilinear, bilinear_slopes, bilinear_spread


class Field:
    """Velocities (steps, 2, H, W) in pixels over unit time; component 0 is y."""

    def __init__(self, shape: tuple[int, int], steps: int = 5, a: float = 3.0, power: int = 1):
        self.v = np.zeros((steps, 2, *shape))
        fy, fx = np.fft.fftfreq(shape[0])[:, None], np.fft.fftfreq(shape[1])[None, :]
        lap = 2 * (1 - np.cos(2 * np.pi * fy)) + 2 * (1 - np.cos(2 * np.pi * fx))
        self.kernel = 1 / (1 + a * a * lap) ** (2 * power)
        self.grid = np.mgrid[: shape[0], : shape[1]].astype(float)

    def smooth(self, m: np.ndarray, power: float = 1.0) -> np.ndarray:
        """The kernel to a power; 1/2 leads from coordinates in which the energy is a plain sum of squares."""
        return np.real(np.fft.ifft2(np.fft.fft2(m) * self.kernel**power))

    def energy(self) -> float:
        return float(sum((np.abs(np.fft.fft2(v)) ** 2 / self.kernel).sum() / v[0].size for v in self.v) / len(self.v))

    def back(self) -> list[np.ndarray]:
        """For every time: where a pixel was at time 0."""
        dt = 1 / len(self.v)
        back = [self.grid.copy()]
        for v in self.v:
            y, x = self.grid - dt * v
            back.append(np.stack([bilinear(back[-1][k] - self.grid[k], y, x, "border") + (y, x)[k] for k in (0, 1)]))
        return back

    def maps(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """`back`, and for every time where a pixel will be at time 1."""
        dt = 1 / len(self.v)
        ahead = [self.grid.copy()]
        for v in self.v[::-1]:
            y, x = self.grid + dt * v
            ahead.append(np.stack([bilinear(ahead[-1][k] - self.grid[k], y, x, "border") + (y, x)[k] for k in (0, 1)]))
        return self.back(), ahead[::-1]

    def through(self, back: list[np.ndarray], pull: np.ndarray) -> np.ndarray:
        """From a loss's gradient by the last map (2, H, W), that by the velocities, over the length of a step."""
        dt, out = 1 / len(self.v), np.empty_like(self.v)
        for t in reversed(range(len(self.v))):
            at = self.grid - dt * self.v[t]
            by_y, by_x = bilinear_slopes(back[t] - self.grid, *at)
            out[t] = -pull - np.stack([(pull * by_y).sum(0), (pull * by_x).sum(0)])
            pull = bilinear_spread(pull, *at)
        return out


def jacobian(phi: np.ndarray) -> np.ndarray:
    yy, yx = np.gradient(phi[0])
    xy, xx = np.gradient(phi[1])
    return yy * xx - yx * xy


def mismatch(source: np.ndarray, target: np.ndarray, end: np.ndarray, sigma: float) -> tuple[float, np.ndarray]:
    """|moved source - target|^2 / (2 sigma^2) for channels (C, H, W) read at the map `end`, and its gradient by that map
    (2, H, W); both are sums over channels."""
    d = (bilinear(source, *end, "border") - target) / sigma
    return 0.5 * float((d * d).sum()), np.stack([(d * slope).sum(0) for slope in bilinear_slopes(source, *end)]) / sigma


def descend(f: Field, look: Callable, iterations: int, step: float = 0.5, tolerance: float = 1e-7, memory: int = 8) -> list[float]:
    """Lower energy / 2 + mismatch in f by L-BFGS; `look` gives `mismatch` at a map. The first step is at most `step` pixels.
    A step that does not lower the loss is undone and halved, so the returned losses never rise; it ends where a step
    lowers the loss by less than `tolerance` of it, from new pairs too."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        f.v = f.smooth(w, 0.5)
        back = f.back()
        off, pull = look(back[-1])
        return 0.5 * float((w * w).sum()) / len(w) + off, w + f.smooth(f.through(back, pull), 0.5)

    w = f.smooth(f.v, -0.5)
    now, grad = at(w)
    losses, pairs = [now], []
    for _ in range(iterations):
        d, parts = -grad, []
        for s, y, sy in reversed(pairs):
            parts.append((s * d).sum() / sy)
            d = d - parts[-1] * y
        if pairs:
            s, y, sy = pairs[-1]
            d = d * (sy / (y * y).sum())
        for (s, y, sy), part in zip(pairs, reversed(parts)):
            d = d + s * (part - (y * d).sum() / sy)
        slope = float((d * grad).sum()) / len(w)
        size, new = 1.0 if pairs else step / max(np.abs(f.smooth(d, 0.5)).max(), step), np.inf
        while size > 1e-6 and slope < 0:
            new, there = at(w + size * d)
            if new <= now + 1e-4 * size * slope:
                break
            new, size = np.inf, size / 2
        fell = now - new
        if fell > 0:
            pair = size * d, there - grad
            w, now, grad = w + pair[0], new, there
            losses.append(now)
        if fell > tolerance * now:
            if (sy := float((pair[0] * pair[1]).sum())) > 0:
                pairs = [*pairs, (*pair, sy)][-memory:]
        elif pairs:
            pairs = []  # once more along the gradient alone
        else:
            break
    f.v = f.smooth(w, 0.5)
    return losses


def register(source: np.ndarray, target: np.ndarray, steps: int = 5, iterations: int = 60, a: float = 3.0, power: int = 1, sigma: float = 0.02, step: float = 0.5) -> tuple[Field, list[float]]:
    """Match channels (C, H, W) in one process."""
    f = Field(source.shape[-2:], steps, a, power)
    return f, descend(f, lambda end: mismatch(source, target, end, sigma), iterations, step)


def flow(v: np.ndarray, y: np.ndarray, x: np.ndarray, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Carry points (pixel coordinates) along the velocities, or back; zero velocity outside."""
    dt = 1 / len(v)
    y, x = np.array(y, float), np.array(x, float)
    for u in v[::-1] if inverse else v:
        d = bilinear(u, y, x)
        s = -dt if inverse else dt
        y, x = y + s * d[0], x + s * d[1]
    return y, x
