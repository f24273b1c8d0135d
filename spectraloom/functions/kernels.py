"""Constant matrices of linear filters, and Arrow UDFs that apply them to whole batches.

Wide linear maps (hundreds of bands in and out) are one matrix product per Arrow
batch; interpreted array lambdas would cost a call per coefficient.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.catalog import EPS


def savgol_matrix(z: int, window: int, order: int, deriv: int = 0) -> np.ndarray:
    """Z x Z map of local polynomial filtering on index spacing.

    The first and last half-windows are read off the polynomial fitted to the
    first and last full window.  An even window reaches one point further to the
    right, and its fit is read at its middle, half a step off the point.
    """
    if window > z or order >= window:
        raise ValueError("window must be at most the spectrum length, and above the order")
    half = window // 2
    x = np.arange(window) - half
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    powers = np.arange(order + 1)
    factor = np.array([math.perm(p, deriv) if p >= deriv else 0 for p in powers], dtype=float)

    def row_at(position: float) -> np.ndarray:
        lowered = np.array([position ** max(p - deriv, 0) for p in powers], dtype=float)
        return (factor * lowered) @ fit

    m = np.zeros((z, z))
    for k in range(z):
        if k < half or k >= z - half:
            start = 0 if k < half else z - window
            position = float(k - start)
        else:
            start = k - (window - 1) // 2
            position = (window - 1) / 2
        m[k, start : start + window] = row_at(position - half)
    return m


def gradient_matrix(wn: np.ndarray) -> np.ndarray:
    """Second-order central differences on an uneven axis, one-sided at the ends."""
    z = len(wn)
    m = np.zeros((z, z))
    h = np.diff(wn)
    m[0, 0], m[0, 1] = -1 / h[0], 1 / h[0]
    m[-1, -2], m[-1, -1] = -1 / h[-1], 1 / h[-1]
    for i in range(1, z - 1):
        a, b = h[i - 1], h[i]
        m[i, i - 1 : i + 2] = -b / (a * (a + b)), (b - a) / (a * b), a / (b * (a + b))
    return m


def detrend_matrix(wn: np.ndarray, degree: int) -> np.ndarray:
    """I - Q Q', removing the least-squares polynomial on the standardised axis."""
    x = (wn - wn.mean()) / (wn.std() + EPS)
    q, _ = np.linalg.qr(np.vander(x, degree + 1, increasing=True))
    return np.eye(len(wn)) - q @ q.T


def moving_average_matrix(z: int, window: int) -> np.ndarray:
    """Odd-window mean with the signal mirrored about its end points."""
    window = max(3, int(window) | 1)
    half = window // 2
    m = np.zeros((z, z))
    for k in range(z):
        for i in range(k - half, k + half + 1):
            j = -i if i < 0 else 2 * (z - 1) - i if i >= z else i
            m[k, j] += 1.0 / window
    return m


def _to_matrix(spectra: pa.Array) -> np.ndarray:
    spectra = spectra.combine_chunks() if isinstance(spectra, pa.ChunkedArray) else spectra
    n = len(spectra)
    flat = spectra.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def _to_lists(matrix: np.ndarray) -> pa.Array:
    n, z = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * z, z, dtype=np.int32) if z else np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def apply_matrix(spectrum: Column, matrix: np.ndarray) -> Column:
    """``matrix @ spectrum`` per row; spectra must be present and of matching length."""
    turned = np.ascontiguousarray(matrix.T)

    @F.arrow_udf("array<double>")
    def product(spectra: pa.Array) -> pa.Array:
        x = _to_matrix(spectra)
        return _to_lists(x @ turned if len(x) else np.zeros((0, turned.shape[1])))

    return product(spectrum)


def apply_matrix_filled(spectrum: Column, matrix: np.ndarray, min_good: int) -> Column:
    """``apply_matrix`` after filling undefined bands from their neighbours.

    Only incomplete spectra are touched one by one; those with fewer than
    ``min_good`` finite bands give NULL.
    """
    turned = np.ascontiguousarray(matrix.T)

    @F.arrow_udf("array<double>")
    def product(spectra: pa.Array) -> pa.Array:
        x = np.array(_to_matrix(spectra))
        if not len(x):
            return _to_lists(np.zeros((0, turned.shape[1])))
        good = np.isfinite(x)
        bands = np.arange(x.shape[1])
        hopeless = good.sum(axis=1) < min_good
        for i in np.nonzero(~good.all(axis=1) & ~hopeless)[0]:
            x[i] = np.interp(bands, bands[good[i]], x[i][good[i]])
        x[hopeless] = 0.0
        lists = _to_lists(x @ turned)
        if not hopeless.any():
            return lists
        return pc.if_else(pa.array(hopeless), pa.scalar(None, lists.type), lists)

    return product(spectrum)


def emsc_solver(reference: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Model columns (offset, reference, powers) and their pseudo-inverse."""
    x = np.linspace(0.0, 1.0, len(reference))
    model = np.column_stack([np.ones_like(reference), reference, *[x**i for i in range(1, degree + 1)]])
    return model, np.linalg.pinv(model)


def apply_emsc(spectrum: Column, reference: np.ndarray, degree: int, iterations: int) -> Column:
    model, inverse = emsc_solver(np.asarray(reference, float), degree)
    model[:, 1] = 0.0  # the reference part is kept, everything else is removed
    turned, removed = inverse.T.copy(), model.T.copy()

    @F.arrow_udf("array<double>")
    def correct(spectra: pa.Array) -> pa.Array:
        x = _to_matrix(spectra)
        if len(x):
            for _ in range(iterations):
                c = x @ turned
                x = (x - c @ removed) / c[:, 1:2]
        return _to_lists(x)

    return correct(spectrum)


def blur_lines(places: Column, values: Column, length: Column, weights: list[float]) -> Column:
    """Convolve image lines with a centred kernel, mirroring at both ends.

    A line comes as its pixel places and values; a missing pixel leaves NaN at
    every place it would reach.
    """
    kernel = np.asarray(weights)[::-1].copy()
    radius = len(weights) // 2

    @F.arrow_udf("array<double>")
    def blur(at: pa.Array, v: pa.Array, n: pa.Array) -> pa.Array:
        lines = []
        for places, line, size in zip(at, v, n):
            dense = np.full(size.as_py(), np.nan)
            dense[places.values.to_numpy()] = line.values.to_numpy(zero_copy_only=False)
            lines.append(np.convolve(np.pad(dense, radius, mode="symmetric"), kernel, mode="valid"))
        return pa.array(lines, pa.list_(pa.float64()))

    return blur(places, values, length)


def als_baselines(y: np.ndarray, lam: float, p: float, rounds: int) -> np.ndarray:
    """Asymmetric least squares for a batch of spectra.

    Each round solves (W + lam D D') z = W y, a symmetric system of bandwidth two,
    by elimination along the bands with all spectra of the batch side by side.
    """
    n, z = y.shape
    d = np.zeros((z, z - 2))
    i = np.arange(z - 2)
    d[i, i], d[i + 1, i], d[i + 2, i] = 1.0, -2.0, 1.0
    penalty = lam * (d @ d.T)
    main, one, two = np.diag(penalty).copy(), np.diag(penalty, 1).copy(), np.diag(penalty, 2).copy()
    w = np.ones_like(y)
    for _ in range(rounds):
        diag = np.empty((z, n))
        up1, up2, rhs = np.zeros((z, n)), np.zeros((z, n)), np.empty((z, n))
        wt, yt = w.T, y.T
        for k in range(z):
            a0, b, e = main[k] + wt[k], one[k] if k < z - 1 else 0.0, two[k] if k < z - 2 else 0.0
            f = wt[k] * yt[k]
            if k >= 2:
                a0 = a0 - up2[k - 2] ** 2 * diag[k - 2]
                f = f - up2[k - 2] * rhs[k - 2] * diag[k - 2]
            if k >= 1:
                a0 = a0 - up1[k - 1] ** 2 * diag[k - 1]
                b = b - up1[k - 1] * up2[k - 1] * diag[k - 1]
                f = f - up1[k - 1] * rhs[k - 1] * diag[k - 1]
            diag[k] = a0
            up1[k], up2[k] = b / a0, e / a0
            rhs[k] = f / a0
        out = rhs
        for k in range(z - 2, -1, -1):
            out[k] -= up1[k] * out[k + 1]
            if k < z - 2:
                out[k] -= up2[k] * out[k + 2]
        base = out.T
        w = p * (y > base) + (1 - p) * (y < base)
    return base


def apply_als(spectrum: Column, lam: float, p: float, rounds: int) -> Column:
    @F.arrow_udf("array<double>")
    def flatten(spectra: pa.Array) -> pa.Array:
        y = _to_matrix(spectra)
        return _to_lists(y - als_baselines(y, lam, p, rounds) if len(y) else y)

    return flatten(spectrum)
