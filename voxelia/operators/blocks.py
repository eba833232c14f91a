"""Large kernels on volumes and images cut into blocks with halos.

A cell goes to its own block and to those whose halo it lies in, itself or mirrored or wrapped at the border, so a
kernel of radius r on blocks of side b moves (1 + 2 r / b) rows an axis and cell instead of one for each
offset. A block is a dense array of known size and one task's work; all kernels are applied to it by the
Fourier transform, and only what the halo makes whole is kept.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BORDERS = ("wrap", "reflect", "replicate", "zero")


def images(at: Column, n: int, reach: int, border: str) -> Column:
    """All places from -reach to n - 1 + reach at which the border rule shows the cell at ``at`` of an axis of n cells."""
    if border == "zero":
        return F.array(at)
    every = F.sequence(F.lit(-reach), F.lit(n - 1 + reach))
    if border == "wrap":
        shown = lambda p: F.pmod(p, F.lit(n))
    elif border == "reflect":
        period = max(2 * (n - 1), 1)
        shown = lambda p: F.least(F.pmod(p, F.lit(period)), period - F.pmod(p, F.lit(period))) if n > 1 else F.lit(0)
    else:
        shown = lambda p: F.greatest(F.lit(0), F.least(p, F.lit(n - 1)))
    # inside, a cell is shown at its own place; only the reach on both sides has to be looked through
    outside = F.filter(F.concat(*[s for s in (F.slice(every, 1, reach), F.slice(every, n + reach + 1, reach))]), lambda p: shown(p) == at) if reach else F.array().cast("array<int>")
    return F.concat(F.array(at), outside)


def correlated(v: DataFrame, kernels: dict[str, np.ndarray], sizes: dict[str, int], border: str = "reflect", keys: tuple[str, ...] = (), block: int = 32) -> DataFrame:
    """(keys, axes, a column for each kernel): sums of kernel[d] * v(place + d) over the offsets d around the kernel's middle cell.

    v has the keys, the axes of sizes (integers from 0) and v; kernels have odd sides; a complex kernel gives the
    magnitude of its response. Cells that are missing, null or NaN count as zero, and cells outside follow
    the border rule: wrap, reflect (edge not repeated), replicate or zero. A block without any cell has no rows; in
    the others every cell of the grid has one. Other columns are not read.
    """
    if border not in BORDERS:
        raise ValueError(f"unknown border rule {border}")
    axes = list(sizes)
    if any(k.ndim != len(axes) or any(n % 2 == 0 for n in k.shape) for k in kernels.values()):
        raise ValueError("kernels need an odd side on every axis")
    reach = [max(k.shape[i] for k in kernels.values()) // 2 for i in range(len(axes))]
    side = [min(block, sizes[a]) for a in axes]
    span = [s + 2 * r for s, r in zip(side, reach, strict=True)]
    cells = v.select(*keys, *[F.col(a).cast("int").alias(a) for a in axes], F.col("v").cast("double").alias("v"))
    for a, s, r in zip(axes, side, reach, strict=True):
        last = (sizes[a] - 1) // s
        cells = cells.withColumn("p", F.explode(images(F.col(a), sizes[a], r, border))).drop(a)
        first = F.greatest(F.lit(0), F.ceil((F.col("p") - (s - 1) - r) / s)).cast("int")
        final = F.least(F.lit(last), F.floor((F.col("p") + r) / s)).cast("int")
        # a place beyond the last block's halo belongs to none
        cells = cells.where(first <= final).withColumn(f"b_{a}", F.explode(F.sequence(first, final))).withColumn(f"i_{a}", F.col("p") - F.col(f"b_{a}") * s + r).drop("p")
    spectra = {}
    for name, k in kernels.items():
        whole = np.zeros(span, k.dtype)
        whole[tuple(slice(r - n // 2, r - n // 2 + n) for r, n in zip(reach, k.shape, strict=True))] = k
        spectra[name] = (np.conj(np.fft.fftn(whole.real)), np.conj(np.fft.fftn(whole.imag)) if np.iscomplexobj(k) and k.imag.any() else None)
    at = [f"b_{a}" for a in axes]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(span)
        dense[tuple(rows[f"i_{a}"].to_numpy() for a in axes)] = np.nan_to_num(rows["v"].to_numpy(float))
        spectrum = np.fft.fftn(dense)
        low = [int(rows[b].iloc[0]) * s for b, s in zip(at, side, strict=True)]
        inside = tuple(slice(0, min(s, sizes[a] - lo)) for a, s, lo in zip(axes, side, low, strict=True))
        grid = np.meshgrid(*[np.arange(lo, lo + i.stop) for lo, i in zip(low, inside, strict=True)], indexing="ij")
        out = {k: rows[k].iloc[0] for k in keys} | {a: g.ravel() for a, g in zip(axes, grid, strict=True)}
        for name, (real, imag) in spectra.items():
            part = np.fft.ifftn(spectrum * real).real[inside]
            out[name] = (part if imag is None else np.hypot(part, np.fft.ifftn(spectrum * imag).real[inside])).ravel()
        return pd.DataFrame(out, columns=[*keys, *axes, *spectra])

    kinds = [f"{k} {v.schema[k].dataType.simpleString()}" for k in keys] + [f"{a} bigint" for a in axes] + [f"`{n}` double" for n in kernels]
    return cells.groupBy(*keys, *at).applyInPandas(run, ", ".join(kinds))


def ball(sizes: dict[str, int], radius: float) -> np.ndarray:
    """1 within the radius; on each axis no further than the offsets an axis of that size has, from -n / 2 up to n / 2, the last left out."""
    reach = [min(math.floor(radius), n // 2) for n in sizes.values()]
    out = np.zeros([2 * r + 1 for r in reach])
    for d in product(*[range(-r, r + 1) for r in reach]):
        if sum(x * x for x in d) <= radius * radius and all(math.ceil(-n / 2) <= x < math.ceil(n / 2) for x, n in zip(d, sizes.values(), strict=True)):
            out[tuple(x + r for x, r in zip(d, reach, strict=True))] = 1.0
    return out


def less_ball_mean(v: DataFrame, radius: float, sizes: dict[str, int], keys: tuple[str, ...] = (), block: int = 32) -> DataFrame:
    """(keys, axes, v): v less the size of its mean over the ball around it, wrapping round; under 1e-10, zero."""
    kernel = ball(sizes, radius)
    mean = correlated(v, {"__mean": kernel / kernel.sum()}, sizes, "wrap", keys, block)
    left = F.col("v") - F.abs("__mean")
    return v.join(mean, [*keys, *sizes]).select(*keys, *sizes, F.when(F.abs(left) < 1e-10, 0.0).otherwise(left).alias("v"))


def gabor(frequency: float, theta: float, sigma: float, deviations: float = 3.0) -> np.ndarray:
    """A complex wave of the frequency along theta under a Gaussian of sigma, cut off after so many deviations."""
    reach = [math.ceil(max(abs(deviations * sigma * math.cos(theta)), abs(deviations * sigma * math.sin(theta)), 1)) for _ in range(2)]
    y, x = np.mgrid[-reach[0] : reach[0] + 1, -reach[1] : reach[1] + 1]
    along = x * math.cos(theta) + y * math.sin(theta)
    return np.exp(-0.5 * (x * x + y * y) / sigma**2) / (2 * math.pi * sigma**2) * np.exp(2j * math.pi * frequency * along)


def ring_cosine(frequency: float, sigma: float, extent: int = 7) -> np.ndarray:
    """|cos(r f) exp(-(r / sigma)^2)| over its sum."""
    r = np.hypot(*np.mgrid[math.ceil(-extent / 2) : math.ceil(extent / 2), math.ceil(-extent / 2) : math.ceil(extent / 2)])
    k = np.abs(np.cos(r * frequency) * np.exp(-((r / sigma) ** 2)))
    return k / abs(k.sum())


def bank() -> dict[str, np.ndarray]:
    """The kernels of textons: Gabor's real parts at 8 angles, 2 sigmas and 2 frequencies, 2 ring cosines, the image itself."""
    out = {f"gabor_{a}_{s}_{f}": gabor(0.9 + 2.3 * f, math.pi * a / 7, 1.0 + s).real for a in range(8) for s in range(2) for f in range(2)}
    out |= {f"ring_{f}": ring_cosine(2.0 + 3.0 * f, 3.0) for f in range(2)}
    one = np.zeros((3, 3))
    one[1, 1] = 1.0
    return out | {"intensity": one}
