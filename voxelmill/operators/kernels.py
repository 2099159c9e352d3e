"""NumPy kernels on dense images and volumes, for Arrow batches: no per-element Python."""

from __future__ import annotations

import numpy as np


def block_mean(a: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
    """Mean over blocks of the last axes; a remainder at the far end is trimmed first. In float32."""
    n = len(factors)
    sizes = [s // f for s, f in zip(a.shape[-n:], factors, strict=True)]
    if min(sizes) < 1:
        raise ValueError(f"blocks of {factors} leave nothing of shape {a.shape}")
    trimmed = a[(..., *[slice(0, s * f) for s, f in zip(sizes, factors, strict=True)])]
    split = trimmed.reshape(*a.shape[:-n], *[x for s, f in zip(sizes, factors, strict=True) for x in (s, f)])
    return split.mean(axis=tuple(range(split.ndim - 2 * n + 1, split.ndim, 2)), dtype=np.float64).astype(np.float32)


def crop(a: np.ndarray, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    rows, cols = a.shape[-2:]
    if top + bottom >= rows or left + right >= cols:
        raise ValueError("the crop leaves nothing")
    return a[..., top : rows - bottom, left : cols - right]


def flat_dark(image: np.ndarray, flat: np.ndarray | None, dark: np.ndarray | None, epsilon: float, clip: tuple[float, float] | None) -> np.ndarray:
    """Transmission. Without a flat field the dark field has no use either, and the image stays as it is, but for the clip."""
    out = image
    if flat is not None:
        out = (image - dark) / np.maximum(flat - dark, epsilon) if dark is not None else image / np.maximum(flat, epsilon)
    return (out if clip is None else np.clip(out, *clip)).astype(np.float32)


def attenuation(transmission: np.ndarray, epsilon: float, most: float, clip_negative: bool) -> np.ndarray:
    out = -np.log(np.clip(transmission, epsilon, most))
    return (np.maximum(out, 0) if clip_negative else out).astype(np.float32)


def truncation_pad(image: np.ndarray, fraction: float) -> np.ndarray:
    """Mirror-extended columns on both sides under a ramp from 0 at the outer edge to 1."""
    n = int(image.shape[-1] * fraction)
    if fraction <= 0 or n <= 0:
        raise ValueError(f"a fraction of {fraction} extends {image.shape[-1]} columns by nothing")
    wide = np.pad(image, [(0, 0)] * (image.ndim - 1) + [(n, n)], mode="symmetric").astype(np.float32)
    ramp = np.linspace(0, 1, n, dtype=np.float32)
    wide[..., :n] *= ramp
    wide[..., -n:] *= ramp[::-1]
    return wide


def _source_index(x: np.ndarray, n: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Whole source indexes inside an axis of n by boundary mode, and whether they are inside at all."""
    if mode == "nearest":
        return np.clip(x, 0, n - 1), np.ones(x.shape, bool)
    if mode == "wrap":
        return np.mod(x, n), np.ones(x.shape, bool)
    if mode in ("reflect", "mirror"):
        period = 2 * n if mode == "reflect" else max(1, 2 * n - 2)
        y = np.mod(x, period)
        return np.where(y < n, y, period - y - (mode == "reflect")), np.ones(x.shape, bool)
    if mode == "constant":
        return np.clip(x, 0, n - 1), (x >= 0) & (x < n)
    raise ValueError(f"unknown boundary mode {mode}")


def bspline(x: np.ndarray, order: int) -> np.ndarray:
    """The centred cardinal B-spline."""
    if order == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(np.float64)
    half = (order + 1) / 2
    return ((half + x) * bspline(x + 0.5, order - 1) + (half - x) * bspline(x - 0.5, order - 1)) / order


def _shift_axis(a: np.ndarray, by: float, axis: int, order: int, mode: str) -> np.ndarray:
    """a moved by a number of pixels along an axis: output i takes what lies at i - by.

    Orders 0 to 5: the pixels are the coefficients of a B-spline, there is no filter before. Places beyond the ends are drawn to the end
    (nearest), are 0 (constant), or are folded; a constant outside is mirrored for the pixels that reach over the end from inside.
    """
    if order not in range(6):
        raise ValueError("orders 0 to 5 only")
    n = a.shape[axis]
    at, inside = np.arange(n) - by, np.ones(n)
    if mode == "nearest":
        at = np.clip(at, 0, n - 1)
    elif mode == "constant":
        inside, mode = ((at >= 0) & (at <= n - 1)).astype(np.float64), "mirror"
    base = (np.rint(at) if order == 0 else np.floor(at + (0.5 if order % 2 == 0 else 0.0)) - order // 2).astype(int)
    out = np.zeros(a.shape, np.float64)
    shape = [n if k == axis else 1 for k in range(a.ndim)]
    for k in range(order + 1):
        index, _ = _source_index(base + k, n, mode)
        w = np.ones(n) if order == 0 else bspline(at - base - k, order)
        out += np.take(a, index, axis=axis) * (w * inside).reshape(shape)
    return out


def shift_image(image: np.ndarray, rows: float, cols: float, order: int = 1, mode: str = "nearest") -> np.ndarray:
    return _shift_axis(_shift_axis(image, rows, image.ndim - 2, order, mode), cols, image.ndim - 1, order, mode).astype(np.float32)


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian over all axes, cut at four sigma, edges reflected."""
    if sigma <= 0:
        return a.astype(np.float64)
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    out = a.astype(np.float64)
    for axis in range(a.ndim):
        n, total = a.shape[axis], np.zeros_like(out)
        for k, x in zip(range(-r, r + 1), w, strict=True):
            index, _ = _source_index(np.arange(n) + k, n, "reflect")
            total += x * np.take(out, index, axis=axis)
        out = total
    return out


def _neighbours(mask: np.ndarray, dilate: bool) -> np.ndarray:
    out = mask.copy()
    for axis in range(mask.ndim):
        for step in (1, -1):
            moved = np.roll(mask, step, axis)
            edge = [slice(None)] * mask.ndim
            edge[axis] = 0 if step == 1 else -1
            moved[tuple(edge)] = False
            out = out | moved if dilate else out & moved
    return out


def dilate(mask: np.ndarray, n: int = 1) -> np.ndarray:
    """n steps to face neighbours; outside is empty."""
    for _ in range(n):
        mask = _neighbours(mask, True)
    return mask


def close(mask: np.ndarray) -> np.ndarray:
    """Dilation, then erosion, with the outside empty for both."""
    return _neighbours(_neighbours(mask, True), False)


def grad3(x: np.ndarray) -> np.ndarray:
    """(3, z, y, x): forward differences along x, y and z; 0 at the far end."""
    g = np.zeros((3, *x.shape), np.float64)
    g[0, :, :, :-1] = np.diff(x, axis=2)
    g[1, :, :-1] = np.diff(x, axis=1)
    g[2, :-1] = np.diff(x, axis=0)
    return g


def grad3_adjoint(p: np.ndarray) -> np.ndarray:
    out = np.zeros(p.shape[1:], np.float64)
    for component, axis in ((0, 2), (1, 1), (2, 0)):
        inner = np.moveaxis(p[component], axis, 0)[:-1]
        moved = np.moveaxis(out, axis, 0)
        moved[:-1] -= inner
        moved[1:] += inner
    return out


def tv_gradient(x: np.ndarray, epsilon: float) -> np.ndarray:
    """Gradient of the smoothed isotropic total variation."""
    g = grad3(x)
    return grad3_adjoint(g / np.sqrt((g * g).sum(axis=0) + epsilon**2))


def tv_norm(x: np.ndarray, epsilon: float) -> float:
    g = grad3(x)
    return float(np.sqrt((g * g).sum(axis=0) + epsilon**2).sum())


def tv_denoise(z: np.ndarray, weight: float, epsilon: float, iterations: int) -> np.ndarray:
    """Gradient descent on half the squared distance to z plus weight times the smoothed total variation."""
    step, x = min(0.2, 1 / (1 + 6 * weight)), z.astype(np.float64).copy()
    for _ in range(iterations):
        x -= step * (x - z + weight * tv_gradient(x, epsilon))
    return x


def slabs(depth: int, slab: int, overlap: int) -> list[tuple[int, int]]:
    """Slices of each slab: slab deep, overlap slices shared with the next."""
    if slab <= 0 or slab >= depth:
        return [(0, depth)]
    step, out, a = max(1, slab - overlap), [], 0
    while True:
        out.append((a, min(depth, a + slab)))
        if a + slab >= depth:
            return out
        a += step


def support_mask(x: np.ndarray, sigma: float, dilation: int) -> np.ndarray:
    """Where the smoothed volume stands out of the fifth percentile of the finite values, closed and dilated.

    NaN counts as 0 when smoothing. Everywhere, if no value is finite or none stands out.
    """
    finite = x[np.isfinite(x)]
    if not finite.size:
        return np.ones(x.shape, bool)
    low, high = np.percentile(finite, [5, 95])
    mask = gaussian(np.nan_to_num(x, nan=0.0), sigma) > low + 0.02 * max(high - low, 1e-6)
    return dilate(close(mask), dilation) if mask.any() else np.ones(x.shape, bool)


def mad(x: np.ndarray) -> float:
    """Median absolute deviation of the finite values, as a standard deviation; 0 if there are none."""
    x = x[np.isfinite(x)]
    return float(1.4826 * np.median(np.abs(x - np.median(x)))) if x.size else 0.0


def confidence(delta: np.ndarray, loss: np.ndarray, support: np.ndarray, tau_loss: float, sigma: float, low: float, high: float) -> np.ndarray:
    """How far a correction can be trusted: it falls with the correction and with the lost gradient."""
    tau = 2 * float(np.median(delta[support])) + 1e-12 if support.any() else 1e-12
    return np.clip(gaussian(np.exp(-((delta / tau) ** 2)) * np.exp(-((loss / tau_loss) ** 2)), sigma), low, high).astype(np.float32)


def phase_shift(a: np.ndarray, b: np.ndarray, upsample: int = 10) -> tuple[float, float]:
    """(rows, cols) that move b onto a, by phase correlation, to 1 / upsample of a pixel.

    The whole-pixel peak comes from an inverse transform; round it, over three quarters of a pixel either way, the transform is taken on the finer grid
    as two matrix products.
    """
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(np.float64).eps)
    peak = np.unravel_index(np.argmax(np.abs(np.fft.ifft2(cross))), cross.shape)
    at = [float(k - n if k > n // 2 else k) for k, n in zip(peak, cross.shape, strict=True)]
    if upsample > 1:
        reach = int(np.ceil(1.5 * upsample)) // 2
        grids = [k + np.arange(-reach, reach + 1) / upsample for k in at]
        rows, cols = [np.exp(2j * np.pi * np.outer(g, np.fft.fftfreq(n))) for g, n in zip(grids, cross.shape, strict=True)]
        fine = np.unravel_index(np.argmax(np.abs(rows @ cross @ cols.T)), (len(grids[0]), len(grids[1])))
        at = [float(g[k]) for g, k in zip(grids, fine, strict=True)]
    return tuple(0.0 if n == 1 else k for k, n in zip(at, cross.shape, strict=True))


def ssim(a: np.ndarray, b: np.ndarray, span: float | None = None) -> float:
    """Mean structural similarity over 7 x 7 windows inside the image, sample covariance."""
    w = np.lib.stride_tricks.sliding_window_view
    x, y = w(a.astype(float), (7, 7)), w(b.astype(float), (7, 7))
    span = float(a.max() - a.min()) if span is None else span
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    mx, my = x.mean((2, 3)), y.mean((2, 3))
    k = 49 / 48
    vx, vy, cov = k * ((x * x).mean((2, 3)) - mx**2), k * ((y * y).mean((2, 3)) - my**2), k * ((x * y).mean((2, 3)) - mx * my)
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def metric_image(image: np.ndarray, margin: float = 0.1) -> np.ndarray:
    """The inner part, clipped at its percentiles 1 and 99 and scaled to [0, 1]; all zeros if it is even."""
    m = min(float(margin), 0.45)
    r, c = int(image.shape[0] * m), int(image.shape[1] * m)
    x = np.nan_to_num(image[r : image.shape[0] - r, c : image.shape[1] - c].astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    low, high = np.percentile(x, [1, 99])
    return (np.clip(x, low, high) - low) / (high - low) if high > low else np.zeros_like(x)


def focus_metrics(x: np.ndarray, bins: int = 256) -> tuple[float, float, float]:
    """Gradient energy, Laplacian variance and entropy of an image in [0, 1]."""
    energy = 0.0
    if min(x.shape) >= 2:
        gy, gx = np.gradient(x)
        energy = float((gx * gx + gy * gy).mean())
    lap = np.zeros_like(x)
    lap[1:-1, 1:-1] = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    p = np.bincount(np.minimum((x * bins).astype(int), bins - 1).reshape(-1)) / x.size
    p = p[p > 0]
    return energy, float(lap.var()), max(0.0, float(-(p * np.log(p + 1e-12)).sum()))
