"""Fits of two-dimensional Gaussians to images of any size, and convolution to a common beam.

A step of a fit is one pass over the pixels: every task adds up the normal equations of its pixels, for all planes and for
a few candidate moves at once, and only these sums are shuffled and reach the driver, which solves them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite
from ..scratch import stored
from .stats import mad
from .tiles import SIDE, by_tiles

FWHM = math.sqrt(8 * math.log(2))
PARAMS = ("cx", "cy", "amp", "fwhm_x", "fwhm_y", "pa")
#: Factors of the damping that a pass tries at once, and the damping at which no smaller move is tried.
TRIES, MOST_DAMPED = (0.25, 1.0, 16.0, 1024.0), 1e12
#: Planes up to which their parameters are broadcast to make model images.
BROADCAST_PLANES = 50_000
PLANE = ("stokes", "z")


def _axes(component: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Cosine and sine of the first axis, and the distances from the centre along both axes in units of sigma and of pixels."""
    cx, cy, _, wx, wy, pa_ = component
    a = math.radians(pa_ - 90)
    c, s = math.cos(a), math.sin(a)
    u, w = (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s
    return c, s, u * FWHM / wx, w * FWHM / wy, FWHM / wx, FWHM / wy


def model(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of Gaussians (cx, cy, amp, fwhm_x, fwhm_y, pa) and the background, which comes last.

    pa: the angle of the first axis in degrees, counterclockwise from the y axis.
    """
    out = np.full(x.shape, p[-1], np.float64)
    for component in p[:-1].reshape(-1, 6):
        _, _, u, w, _, _ = _axes(component, x, y)
        out += component[2] * np.exp(-0.5 * (u * u + w * w))
    return out


def slopes(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of the model by each parameter, one column each."""
    out = np.empty((len(x), len(p)))
    for k, component in enumerate(p[:-1].reshape(-1, 6)):
        c, s, u, w, ru, rw = _axes(component, x, y)
        shape = np.exp(-0.5 * (u * u + w * w))
        g = component[2] * shape
        out[:, 6 * k : 6 * k + 6] = np.stack(
            [g * (u * ru * c - w * rw * s), g * (u * ru * s + w * rw * c), shape, g * u * u / component[3], g * w * w / component[4], g * u * w * (rw / ru - ru / rw) * math.pi / 180], axis=1
        )
    out[:, -1] = 1.0
    return out


def _normal_sums(pixels: DataFrame, trial: dict[tuple, list[np.ndarray]], free: np.ndarray) -> dict[tuple, np.ndarray]:
    """For each (stokes, z, candidate): pixels, sum of squared residuals, J'r and the rows of J'J, flat."""
    index = np.flatnonzero(free)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            s, z, x, y, v = (b.column(k).to_numpy() for k in range(5))
            for plane in {*zip(s.tolist(), z.tolist(), strict=True)}:
                here = (s == plane[0]) & (z == plane[1])
                px, py, pv = x[here].astype(np.float64), y[here].astype(np.float64), v[here].astype(np.float64)
                for k, p in enumerate(trial.get(plane, ())):
                    j, r = slopes(p, px, py)[:, index], pv - model(p, px, py)
                    part = np.concatenate([[len(r), r @ r], j.T @ r, (j.T @ j).ravel()])
                    sums[*plane, k] = sums.get((*plane, k), 0) + part
        rows = [(*key, i, value) for key, part in sums.items() for i, value in enumerate(part.tolist())]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], ["stokes", "z", "k", "i", "value"])

    part = pixels.mapInArrow(run, "stokes int, z int, k int, i int, value double")
    found: dict[tuple, np.ndarray] = {}
    for r in part.groupBy("stokes", "z", "k", "i").agg(F.sum("value").alias("value")).collect():
        found.setdefault((r["stokes"], r["z"], r["k"]), np.zeros(2 + len(index) * (len(index) + 1)))[r["i"]] = r["value"]
    return found


class _Plane:
    """The state of one plane's fit."""

    def __init__(self, start: np.ndarray, index: np.ndarray):
        self.p, self.index, self.damp, self.steps = start.copy(), index, 1e-3, 0
        self.done, self.converged, self.moves = False, False, [np.zeros(len(index))]

    def candidates(self) -> list[np.ndarray]:
        if self.steps:
            scale = np.diag(np.diag(self.normal) + 1e-12)
            self.moves = [np.linalg.lstsq(self.normal + self.damp * f * scale, self.right, rcond=None)[0] for f in TRIES]
        out = [self.p.copy() for _ in self.moves]
        for p, move in zip(out, self.moves, strict=True):
            p[self.index] += move
        return out

    def take(self, tried: list[np.ndarray], sums: list[np.ndarray], steps: int, tol: float) -> None:
        """The best of the candidates, if it is better than what there is."""
        k, first = len(self.index), not self.steps
        best = min(range(len(sums)), key=lambda i: sums[i][1] if np.isfinite(sums[i]).all() else np.inf)
        n, cost = sums[best][:2]
        self.steps += 1
        if first or cost < self.cost:
            small = not first and (self.cost - cost <= tol * max(self.cost, 1e-300) or np.all(np.abs(self.moves[best]) <= tol * (np.abs(self.p[self.index]) + tol)))
            self.p, self.cost, self.n = tried[best], cost, int(n)
            self.right, self.normal = sums[best][2 : 2 + k], sums[best][2 + k :].reshape(k, k)
            self.damp *= 1.0 if first else TRIES[best]
        else:
            small = False
            self.damp *= 4 * TRIES[-1]
        self.converged = small or self.cost == 0 or self.damp > MOST_DAMPED or not k
        self.done = self.converged or self.n < k or self.steps > steps


def errors(component: np.ndarray, noise: float, beam: float | None = None, unit: str | None = None) -> tuple[list[float], float | None, float | None]:
    """Errors of a component's parameters, its integrated flux and the error of that (J. J. Condon, PASP 109, 166, 1997).

    beam: FWHM in pixels of a round beam over which the noise is correlated, None for independent pixels. The flux is that of
    a unit that has one: per beam (with a beam) or per pixel (without).
    """
    _, _, amp, wx, wy, pa_ = map(float, component)
    signal = (amp / noise) ** 2 if noise > 0 else math.inf
    if beam:
        base, gx, gy = wx * wy / (4 * beam * beam) * signal, 1 + (beam / wx) ** 2, 1 + (beam / wy) ** 2
        on_amp, on_x, on_y = (base * gx**i * gy**j for i, j in ((1.5, 1.5), (2.5, 0.5), (0.5, 2.5)))
    else:
        on_amp = on_x = on_y = math.pi * wx * wy / FWHM**2 * signal
    root = lambda v: math.sqrt(v) if v >= 0 else math.nan
    per = lambda v, rho: v * v * 2 / rho if rho else math.inf
    a = math.radians(pa_)
    along, across = per(wx, on_x) / FWHM**2, per(wy, on_y) / FWHM**2
    cx, cy = root(along * math.sin(a) ** 2 + across * math.cos(a) ** 2), root(along * math.cos(a) ** 2 + across * math.sin(a) ** 2)
    ratio = wx * wy / (wx * wx - wy * wy) if wx != wy else math.inf
    found = [cx, cy, root(per(amp, on_amp)), root(per(wx, on_x)), root(per(wy, on_y)), math.degrees(root(2 * per(ratio, on_y)))]
    if unit not in ("Jy/beam", "Jy/pixel") or (unit == "Jy/beam") != bool(beam):
        return found, None, None
    flux = integrated_flux(amp, wx, wy, math.pi * beam * beam / (4 * math.log(2)) if beam else None)
    share = 2 / on_amp + beam * beam / (wx * wy) * (2 / on_x + 2 / on_y) if beam else 2 / on_amp
    return found, flux, abs(flux) * root(share)


def integrated_flux(amp: float, fwhm_x: float, fwhm_y: float, beam_pixels: float | None = None) -> float:
    """Flux of a fitted Gaussian: its volume, in units of the beam area where one is given."""
    volume = amp * fwhm_x * fwhm_y * math.pi / (4 * math.log(2))
    return volume / beam_pixels if beam_pixels else volume


FIT = ["stokes", "z", "component", *PARAMS, *[f"{p}_error" for p in PARAMS], "flux", "flux_error", "background", "background_error", "converged", "steps", "message"]


def fit_gaussians(
    cube: DataFrame, start: list[tuple[float, ...]], fixed: set[str] = frozenset(), background: float = 0.0, fit_background: bool = False, beam: float | None = None, unit: str | None = None, steps: int = 100, tol: float = 1e-8
) -> DataFrame:
    """One row per (stokes, z, component): parameters, errors, flux, background, convergence, steps and a message where a fit failed.

    Planes of any size are fitted together by damped least squares, one pass over the pixels a step; NaN takes no part. A plane
    with fewer pixels than free parameters keeps its start values. Fixed parameters have no error. What reaches the driver
    is the sums of each plane: a few dozen numbers for every plane and candidate.
    """
    p0 = np.array([c for comp in start for c in comp] + [background], np.float64)
    free = np.array([n not in fixed for _ in start for n in PARAMS] + [fit_background])
    pixels = stored(cube.where(finite(F.col("v"))).select("stokes", "z", "x", "y", "v"), "fit")
    noise = {(r["stokes"], r["z"]): r["mad"] for r in mad(pixels, *PLANE).collect()}
    planes = {(r["stokes"], r["z"]): _Plane(p0, np.flatnonzero(free)) for r in cube.select("stokes", "z").distinct().collect()}
    for plane, state in planes.items():
        state.done, state.n, state.cost = plane not in noise, 0, math.nan
    while any(not s.done for s in planes.values()):
        tried = {plane: s.candidates() for plane, s in planes.items() if not s.done}
        sums = _normal_sums(pixels, tried, free)
        for plane, candidates in tried.items():
            planes[plane].take(candidates, [sums[*plane, k] for k in range(len(candidates))], steps, tol)
    rows = []
    for (stokes, z), s in sorted(planes.items()):
        some, std = s.n >= max(1, int(free.sum())), noise.get((stokes, z), math.nan)
        last = None
        if fit_background and some:
            spread = math.sqrt(s.cost / max(1, s.n - int(free.sum())))
            last = max(std, spread) * math.sqrt(max(0.0, np.linalg.pinv(s.normal)[-1, -1]))
        message = None if s.converged or (some and s.steps > steps) else "insufficient data points" if not some else "fit did not converge"
        for k, component in enumerate(s.p[:-1].reshape(-1, 6)):
            found, flux, flux_error = errors(component, std, beam, unit) if some else ([math.nan] * 6, None, None)
            kept = [e if f else 0.0 for e, f in zip(found, free[6 * k : 6 * k + 6], strict=True)]
            rows.append((stokes, z, k, *map(float, component), *map(float, kept), flux, flux_error, float(s.p[-1]), last if fit_background else 0.0, bool(s.converged), s.steps, message))
    kinds = {"stokes": "int", "z": "int", "component": "int", "steps": "int", "converged": "boolean", "message": "string"}
    return cube.sparkSession.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'double')}" for n in FIT))


def model_column(components: Column, background: Column) -> Column:
    """The model at a pixel (x, y) from an array of its components, in built-in functions."""

    def shape(c: Column) -> Column:
        a = F.radians(c["pa"] - 90)
        dx, dy = F.col("x") - c["cx"], F.col("y") - c["cy"]
        u, w = (dx * F.cos(a) + dy * F.sin(a)) * FWHM / c["fwhm_x"], (dy * F.cos(a) - dx * F.sin(a)) * FWHM / c["fwhm_y"]
        return c["amp"] * F.exp(-0.5 * (u * u + w * w))

    return F.aggregate(components, background, lambda total, c: total + shape(c))


def fit_images(cube: DataFrame, fitted: DataFrame) -> DataFrame:
    """stokes, z, y, x, v, model, residual: the images of a fit; residual is v less the model, NaN where v is."""
    planes = fitted.groupBy(*PLANE).agg(F.collect_list(F.struct(*PARAMS)).alias("components"), F.first("background").alias("background"))
    if planes.count() <= BROADCAST_PLANES:
        planes = F.broadcast(planes)
    found = cube.join(planes, list(PLANE)).withColumn("model", model_column(F.col("components"), F.col("background")))
    return found.select("stokes", "z", "y", "x", "v", "model", (F.col("v").cast("double") - F.col("model")).alias("residual"))


def convolution_kernel(sigma_x: float, sigma_y: float, angle: float) -> np.ndarray:
    """Gaussian of unit height on an odd grid that reaches 5 sigma."""
    side = max(2 * (int(5 * s + 0.5) + 1) for s in (sigma_x, sigma_y)) | 1
    c = np.arange(side) - side // 2
    x, y = np.meshgrid(c, c)
    a = math.radians(angle)
    u, w = x * math.cos(a) + y * math.sin(a), y * math.cos(a) - x * math.sin(a)
    return np.exp(-0.5 * ((u / sigma_x) ** 2 + (w / sigma_y) ** 2))


def beam_difference(beam: tuple[float, float, float], target: tuple[float, float, float]) -> tuple[float, float, float]:
    """The Gaussian (major, minor, angle) that turns one beam into a larger one."""

    def matrix(b):
        a = math.radians(b[2])
        r = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
        return r @ np.diag([b[0] ** 2, b[1] ** 2]) @ r.T

    values, axes = np.linalg.eigh(matrix(target) - matrix(beam))
    if values.min() < -1e-9:
        raise ValueError("the target beam must not be smaller than the plane's")
    values = np.sqrt(np.maximum(values, 0))
    return float(values[1]), float(values[0]), math.degrees(math.atan2(axes[1, 1], axes[0, 1]))


def convolve_planes(cube: DataFrame, beams: dict[int, tuple[float, float, float]], target: tuple[float, float, float], side: int = SIDE) -> DataFrame:
    """Every channel convolved to a common beam (FWHM in pixels), v double; channels that have it already are copied. NaN counts as 0 and stays NaN.

    Tiles with an apron of half a kernel, each by one Fourier transform. A channel without a beam is refused, as is a beam
    larger than the target.
    """
    kernels = {}
    for z, beam in beams.items():
        major, minor, angle = beam_difference(beam, target)
        if major >= 1e-5:
            kernel = convolution_kernel(max(major, 1e-3) / FWHM, max(minor, 1e-3) / FWHM, angle)
            kernels[z] = kernel / kernel.sum()
    apron = max((k.shape[0] // 2 for k in kernels.values()), default=0)

    def work(data: np.ndarray, at: dict) -> np.ndarray:
        if at["z"] not in beams:
            raise ValueError(f"channel {at['z']} has no beam")
        kernel = kernels.get(at["z"])
        if kernel is None:
            return data
        shape = [a + b - 1 for a, b in zip(data.shape, kernel.shape, strict=True)]
        full = np.fft.irfft2(np.fft.rfft2(np.nan_to_num(data), shape) * np.fft.rfft2(kernel, shape), shape)
        h = kernel.shape[0] // 2
        return np.where(np.isnan(data), np.nan, full[h : h + data.shape[0], h : h + data.shape[1]])

    return by_tiles(cube, apron, work, "stokes", "z", side=side)
