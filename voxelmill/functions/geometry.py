"""Cone-beam geometry: parameters on the driver, ray weights by Siddon's method (1985)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class Geometry:
    """Lengths in mm; pairs are (vertical, horizontal), triples (z, y, x)."""

    source_detector: float
    source_origin: float
    detector_pixels: tuple[int, int]
    detector_pixel: tuple[float, float]
    volume_voxels: tuple[int, int, int]
    voxel: tuple[float, float, float]
    detector_offset_px: tuple[float, float] = (0.0, 0.0)
    origin_offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    centre_offset_px: float = 0.0
    centre_sign: float = 1.0
    centre_method: str = "detector_offset"
    use_centre: bool = True
    invert_angles: bool = True

    def __post_init__(self):
        if not self.source_detector > self.source_origin > 0:
            raise ValueError("the source must be nearer to the origin than to the detector")

    @property
    def detector_offset(self) -> tuple[float, float]:
        """In mm, with the centre correction where that moves the detector."""
        v, h = (o * p for o, p in zip(self.detector_offset_px, self.detector_pixel, strict=True))
        moved = self.centre_sign * self.centre_offset_px * self.detector_pixel[1] if self.use_centre and self.centre_method == "detector_offset" else 0.0
        return v, h + moved

    @property
    def image_shift(self) -> float:
        """Pixels by which projections are moved instead, with the method image_shift."""
        return self.centre_sign * self.centre_offset_px if self.use_centre and self.centre_method == "image_shift" else 0.0

    def angles(self, angles: np.ndarray) -> np.ndarray:
        return -np.asarray(angles, np.float64) if self.invert_angles else np.asarray(angles, np.float64)

    def binned(self, by: int, bx: int, volume: int = 1) -> Geometry:
        """The geometry of block-averaged projections and, by a factor, of a coarser volume."""
        rows, cols = self.detector_pixels[0] // by, self.detector_pixels[1] // bx
        return replace(self, detector_pixels=(rows, cols), detector_pixel=(self.detector_pixel[0] * by, self.detector_pixel[1] * bx), volume_voxels=tuple(max(1, n // volume) for n in self.volume_voxels), voxel=tuple(v * volume for v in self.voxel), detector_offset_px=(self.detector_offset_px[0] / by, self.detector_offset_px[1] / bx), centre_offset_px=self.centre_offset_px / bx)

    def coarser(self, by: int, bx: int, detector: tuple[int, int], transposed: bool = False) -> Geometry:
        """The geometry of a quick run: projections of the given size after further binning, voxels coarser by the same factors (z with rows)."""
        r, c = (bx, by) if transposed else (by, bx)
        factors = (r, c, c)
        binned = replace(self, detector_pixel=(self.detector_pixel[0] * r, self.detector_pixel[1] * c), volume_voxels=tuple(max(1, n // f) for n, f in zip(self.volume_voxels, factors, strict=True)), voxel=tuple(v * f for v, f in zip(self.voxel, factors, strict=True)), detector_offset_px=(self.detector_offset_px[0] / r, self.detector_offset_px[1] / c), centre_offset_px=self.centre_offset_px / c)
        return replace(binned, detector_pixels=tuple(detector))

    def low_resolution(self, factor: int) -> Geometry:
        """Everything coarser by a factor, or unchanged if a size does not divide by it."""
        if factor <= 1 or any(n % factor for n in (*self.detector_pixels, *self.volume_voxels)):
            return self
        return self.binned(factor, factor, factor)


def resolve(source_detector: float, source_origin: float, pixels: tuple[int, int], effective_um: float | None = None, detector_pixel: tuple[float | None, float | None] = (None, None), volume: tuple[int | None, ...] = (None, None, None), voxel: tuple[float, float, float] = (0.011, 0.011, 0.011), **more) -> Geometry:
    """Defaults filled in: the detector pixel from its effective size, the volume from the detector (rows, cols, cols)."""
    if not source_detector > source_origin > 0:
        raise ValueError("the source must be nearer to the origin than to the detector")
    scale = None if effective_um is None else effective_um * 1e-3 * source_detector / source_origin
    size = tuple(p if p is not None else scale for p in detector_pixel)
    if None in size:
        raise ValueError("a detector pixel size or an effective pixel size is needed")
    voxels = tuple(v if v is not None else d for v, d in zip(volume, (pixels[0], pixels[1], pixels[1]), strict=True))
    return Geometry(source_detector, source_origin, tuple(pixels), size, voxels, tuple(voxel), **more)


def linspace_angles(start: float, end: float, n: int, endpoint: bool = False, degrees: bool = True, clockwise: bool = False) -> np.ndarray:
    a = np.linspace(start, end, n, endpoint=endpoint)
    a = np.deg2rad(a) if degrees else a
    return -a if clockwise else a


def ray_weights(g: Geometry, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixel, voxel, length) of all rays of a view: pixel and voxel are flat row-major indexes, length in mm.

    The source circles the z axis; between the planes of the grid a ray lies in one voxel, found from the interval's middle.
    """
    rows, cols = g.detector_pixels
    dv, dh = g.detector_offset
    c, s = np.cos(angle), np.sin(angle)
    v = (np.arange(rows) - (rows - 1) / 2) * g.detector_pixel[0] + dv
    h = (np.arange(cols) - (cols - 1) / 2) * g.detector_pixel[1] + dh
    vv, hh = [x.reshape(-1) for x in np.meshgrid(v, h, indexing="ij")]
    back = g.source_detector - g.source_origin
    source = np.array([0.0, g.source_origin * s, g.source_origin * c])  # z, y, x
    target = np.stack([vv, -back * s + hh * c, -back * c - hh * s], axis=1)
    ray = target - source
    size, n = np.array(g.voxel), np.array(g.volume_voxels)
    low = np.array(g.origin_offset) - size * n / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        near, far = (low - source) / ray, (low + size * n - source) / ray
    inside = (source >= low) & (source <= low + size * n)
    still = np.abs(ray) < 1e-12
    near, far = np.where(still, np.where(inside, -np.inf, np.inf), near), np.where(still, np.where(inside, np.inf, -np.inf), far)
    enter, leave = np.clip(np.minimum(near, far).max(axis=1), 0, 1), np.clip(np.maximum(near, far).min(axis=1), 0, 1)
    hit = np.flatnonzero(leave > enter)
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    crossings = [enter[hit, None], leave[hit, None]]
    for axis in range(3):
        planes = low[axis] + size[axis] * np.arange(n[axis] + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (planes[None, :] - source[axis]) / ray[hit, axis][:, None]
        crossings.append(np.clip(np.nan_to_num(t, nan=0.0, posinf=0.0, neginf=0.0), enter[hit, None], leave[hit, None]))
    t = np.sort(np.concatenate(crossings, axis=1), axis=1)
    step, middle = np.diff(t, axis=1), (t[:, 1:] + t[:, :-1]) / 2
    ray_of, k = np.nonzero(step > 1e-12)
    place = source + middle[ray_of, k][:, None] * ray[hit][ray_of]
    index = np.clip(np.floor((place - low) / size).astype(np.int64), 0, n - 1)
    length = step[ray_of, k] * np.linalg.norm(ray[hit], axis=1)[ray_of]
    return hit[ray_of], (index[:, 0] * n[1] + index[:, 1]) * n[2] + index[:, 2], length


#: The names of the filters.
FILTERS = ("ram_lak", "shepp_logan", "cosine", "hamming", "hann")


def ramp_filter(n: int, spacing: float, name: str) -> np.ndarray:
    """Frequency response over rfft bins of a length-n line: the band-limited ramp under a window."""
    k = np.arange(-(n // 2), n - n // 2)
    h = np.zeros(n)
    h[k == 0] = 1 / (4 * spacing**2)
    odd = k % 2 != 0
    h[odd] = -1 / (np.pi * k[odd] * spacing) ** 2
    response = np.abs(np.fft.rfft(np.fft.ifftshift(h))) * spacing
    w = np.linspace(0, 1, len(response))
    if name == "ram_lak":
        window = np.ones_like(w)
    elif name == "shepp_logan":
        window = np.sinc(w / 2)
    elif name == "cosine":
        window = np.cos(np.pi * w / 2)
    elif name == "hamming":
        window = 0.54 + 0.46 * np.cos(np.pi * w)
    elif name == "hann":
        window = 0.5 + 0.5 * np.cos(np.pi * w)
    else:
        raise ValueError(f"unknown filter {name}")
    return response * window


def filter_projection(image: np.ndarray, g: Geometry, name: str) -> np.ndarray:
    """Cosine-weighted and ramp-filtered rows (Feldkamp, Davis and Kress 1984), at the detector scaled to the origin."""
    rows, cols = image.shape
    dv, dh = g.detector_offset
    v = ((np.arange(rows) - (rows - 1) / 2) * g.detector_pixel[0] + dv)[:, None]
    h = ((np.arange(cols) - (cols - 1) / 2) * g.detector_pixel[1] + dh)[None, :]
    weighted = image * g.source_detector / np.sqrt(g.source_detector**2 + v**2 + h**2)
    n = 1 << int(np.ceil(np.log2(2 * cols)))
    spacing = g.detector_pixel[1] * g.source_origin / g.source_detector
    return np.fft.irfft(np.fft.rfft(weighted, n, axis=1) * ramp_filter(n, spacing, name), n, axis=1)[:, :cols]


def backproject_filtered(filtered: np.ndarray, g: Geometry, angle: float, z: np.ndarray) -> np.ndarray:
    """The contribution of one view to the slices z: (len(z), ny, nx), bilinear on the detector."""
    nz, ny, nx = g.volume_voxels
    at = [(np.arange(n) - (n - 1) / 2) * s + o for n, s, o in zip((nz, ny, nx), g.voxel, g.origin_offset, strict=True)]
    y, x = np.meshgrid(at[1], at[2], indexing="ij")
    c, s = np.cos(angle), np.sin(angle)
    depth = g.source_origin - (x * c + y * s)  # from the source along the axis
    scale = g.source_detector / depth
    dv, dh = g.detector_offset
    rows, cols = filtered.shape
    col = ((y * c - x * s) * scale - dh) / g.detector_pixel[1] + (cols - 1) / 2
    weight = (g.source_origin / depth) ** 2
    out = np.zeros((len(z), ny, nx))
    c0 = np.floor(col).astype(int)
    tc = col - c0
    for k, slice_ in enumerate(z):
        row = (at[0][slice_] * scale - dv) / g.detector_pixel[0] + (rows - 1) / 2
        r0 = np.floor(row).astype(int)
        tr = row - r0
        for dr, wr in ((0, 1 - tr), (1, tr)):
            for dc, wc in ((0, 1 - tc), (1, tc)):
                r, q = r0 + dr, c0 + dc
                ok = (r >= 0) & (r < rows) & (q >= 0) & (q < cols)
                out[k] += np.where(ok, filtered[np.clip(r, 0, rows - 1), np.clip(q, 0, cols - 1)], 0) * wr * wc
        out[k] *= weight
    return out
