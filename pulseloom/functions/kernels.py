"""Signal kernels in numpy, from published definitions. One series each; NaN-free input."""

from __future__ import annotations

import numpy as np

# -- filters ---------------------------------------------------------------------------


def butterworth(order: int, low: float | None, high: float | None, fs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Digital zeros, poles and gain: band-pass with both edges, else high- or low-pass."""
    k = np.arange(1, order + 1)
    p = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is not None and high is not None:
        w0, bw = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        q = p * bw / 2
        root = np.sqrt(q * q - w0 * w0)
        z, p, gain = np.zeros(order, complex), np.concatenate([q + root, q - root]), bw**order
    elif low is not None:
        w = warp(low)
        z, p, gain = np.zeros(order, complex), w / p, np.real(1 / np.prod(-p))
    else:
        w = warp(high)
        z, p, gain = np.zeros(0, complex), p * w, w**order
    c = 2 * fs
    zd, pd = (c + z) / (c - z), (c + p) / (c - p)
    gain = gain * np.real(np.prod(c - z) / np.prod(c - p))
    return np.concatenate([zd, -np.ones(len(p) - len(z))]), pd, float(gain)


def sections(z: np.ndarray, p: np.ndarray, gain: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2): conjugate poles together, the gain in the first."""
    pairs = p[np.imag(p) > 1e-12]
    real = np.sort(np.real(p[np.abs(np.imag(p)) <= 1e-12]))
    den = [np.array([1, -2 * x.real, abs(x) ** 2]) for x in pairs]
    den += [np.array([1, -(real[i] + real[i + 1]), real[i] * real[i + 1]]) for i in range(0, len(real) - 1, 2)]
    if len(real) % 2:
        den.append(np.array([1, -real[-1], 0.0]))
    zs = np.sort(np.real(z))
    # Zeros lie at 1 and -1 here; one from each end goes to a section.
    num, i, j = [], 0, len(zs) - 1
    for d in den:
        if d[2] == 0.0 or i == j:
            num.append(np.array([1, -zs[i], 0.0]))
            i += 1
        else:
            num.append(np.array([1, -(zs[i] + zs[j]), zs[i] * zs[j]]))
            i, j = i + 1, j - 1
    out = np.array([np.concatenate([b, a]) for b, a in zip(num, den, strict=True)])
    out[0, :3] *= gain
    return out


def _biquad(x: np.ndarray, s: np.ndarray, state: np.ndarray, block: int = 256) -> np.ndarray:
    """One section over x from a state (transposed direct form II), a block at a time.

    The response to the input inside a block is a product with the Toeplitz matrix of the
    impulse response; states go from block to block.
    """
    b, a1, a2 = s[:3], s[4], s[5]
    h = np.zeros(block)
    z1 = z2 = 0.0
    for i in range(block):
        v = 1.0 if i == 0 else 0.0
        h[i] = b[0] * v + z1
        z1, z2 = b[1] * v - a1 * h[i] + z2, b[2] * v - a2 * h[i]
    free = np.zeros((block, 2))
    for k in (0, 1):
        z = [1.0 - k, float(k)]
        for i in range(block):
            free[i, k] = z[0]
            z = [-a1 * z[0] + z[1], -a2 * z[0]]
    toeplitz = np.tril(h[np.subtract.outer(np.arange(block), np.arange(block))])
    pad = -len(x) % block
    rows = np.concatenate([x, np.zeros(pad)]).reshape(-1, block)
    y = rows @ toeplitz.T
    z = state.astype(float)
    for r in range(len(rows)):
        y[r] += free @ z
        last, prev = y[r, -1], y[r, -2]
        xl, xp = rows[r, -1], rows[r, -2]
        z2 = b[2] * xl - a2 * last
        z = np.array([b[1] * xl - a1 * last + b[2] * xp - a2 * prev, z2])
    return y.ravel()[: len(x)]


def settled(sos: np.ndarray) -> np.ndarray:
    """States of a cascade, two a section, after a constant input of 1."""
    out, level = [], 1.0
    for s in sos:
        gain = s[:3].sum() / s[3:].sum()
        z2 = s[2] - s[5] * gain
        out += [(s[1] - s[4] * gain + z2) * level, z2 * level]
        level *= gain
    return np.array(out)


def cascaded(x: np.ndarray, sos: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output, state at the end) of sections one after the other; x has two values at least."""
    y, ends = np.asarray(x, float), []
    for k, s in enumerate(sos):
        u, y = y, _biquad(y, s, state[2 * k : 2 * k + 2])
        ends += [s[1] * u[-1] - s[4] * y[-1] + s[2] * u[-2] - s[5] * y[-2], s[2] * u[-1] - s[5] * y[-1]]
    return y, np.array(ends)


def free_step(sos: np.ndarray) -> np.ndarray:
    """The matrix that takes a cascade's state one sample on, without input."""
    width = 2 * len(sos)
    out = np.zeros((width, width))
    for j in range(width):
        z, u = np.eye(width)[j], 0.0
        for k, s in enumerate(sos):
            y = s[0] * u + z[2 * k]
            out[2 * k, j], out[2 * k + 1, j] = s[1] * u - s[4] * y + z[2 * k + 1], s[2] * u - s[5] * y
            u = y
    return out


def filtered(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Zero-phase filtering: forward and backward, odd extension, states settled at the first value."""
    pad = min(3 * (2 * len(sos) + 1), len(x) - 1)
    if pad < 1:
        return x.astype(float)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]).astype(float)
    for _ in range(2):
        ext = cascaded(ext, sos, settled(sos) * ext[0])[0][::-1]
    return ext[pad : len(ext) - pad]


def bandpass(x: np.ndarray, fs: float, low: float = 0.5, high: float = 40.0, order: int = 4) -> np.ndarray:
    return filtered(np.asarray(x, float), sections(*butterworth(order, low, high, fs)))


def highpass_detrend(x: np.ndarray, t: np.ndarray, cutoff: float = 0.003, order: int = 4) -> np.ndarray:
    """Slow trends removed on an even grid of 4 Hz or twice the mean rate; a least-squares line instead where that is too short to filter."""
    n, span = len(x), float(t[-1] - t[0]) if len(t) > 1 else 0.0
    fs = max(4.0, 2 * n / span) if span > 0 else 4.0
    m = int(span * fs)
    if m > 3 * (2 * ((order + 1) // 2) + 1):
        grid = np.linspace(t[0], t[-1], m)
        return np.interp(t, grid, filtered(np.interp(grid, t, x), sections(*butterworth(order, cutoff, None, fs))))
    i = np.arange(n, dtype=float)
    return x - np.polyval(np.polyfit(i, x, 1), i) if n > 1 else x - x.mean() if n else x


# -- peaks -----------------------------------------------------------------------------


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Indices of strict maxima; the middle of a plateau, rounded down."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.append(0, change + 1), np.append(change, len(x) - 1)
    v = x[starts]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (starts[top] + ends[top]) // 2


def highest_apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Of places nearer than ``distance`` the higher stays, the later on ties, highest first."""
    keep = np.ones(len(at), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            near = slice(np.searchsorted(at, at[i] - distance, "right"), np.searchsorted(at, at[i] + distance, "left"))
            keep[near] = False
            keep[i] = True
    return at[keep]


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima of at least ``height`` that are ``distance`` apart."""
    at = local_maxima(x)
    at = at[x[at] >= height]
    return highest_apart(at, x[at], distance)


def r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """R-peaks of an ECG: maxima of the z-scored signal, half a deviation high, 0.3 s apart."""
    sd = x.std()
    return peaks((x - x.mean()) / sd, 0.5, int(0.3 * fs)) if sd > 1e-12 else np.zeros(0, np.int64)


def spectral_peaks(p: np.ndarray, height: float = 0.1, distance: int = 10) -> np.ndarray:
    top = p.max(initial=0.0)
    return peaks(p / top, height, distance) if top > 0 else np.zeros(0, np.int64)


# -- interpolation ---------------------------------------------------------------------


def _hermite(t: np.ndarray, y: np.ndarray, d: np.ndarray, at: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 2)
    h = t[i + 1] - t[i]
    s = (at - t[i]) / h
    return (1 + 2 * s) * (1 - s) ** 2 * y[i] + s * (1 - s) ** 2 * h * d[i] + s * s * (3 - 2 * s) * y[i + 1] + s * s * (s - 1) * h * d[i + 1]


def cubic_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the not-a-knot cubic spline, by a banded elimination."""
    n = len(t)
    h, m = np.diff(t), np.diff(y) / np.diff(t)
    if n == 2:
        return np.array([m[0], m[0]])
    if n == 3:  # one parabola
        c = (m[1] - m[0]) / (t[2] - t[0])
        return np.array([m[0] - c * h[0], m[0] + c * h[0], m[1] + c * h[1]])
    low, mid, up, rhs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    low[1:-1], mid[1:-1], up[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    rhs[1:-1] = 3 * (h[1:] * m[:-1] + h[:-1] * m[1:])
    mid[0], up[0] = h[1], h[0] + h[1]
    rhs[0] = ((h[0] + 2 * up[0]) * h[1] * m[0] + h[0] ** 2 * m[1]) / up[0]
    mid[-1], low[-1] = h[-2], h[-1] + h[-2]
    rhs[-1] = (h[-1] ** 2 * m[-2] + (2 * low[-1] + h[-1]) * h[-2] * m[-1]) / low[-1]
    # Plain floats: each step needs the one before, and these are quicker one by one.
    low, mid, up, rhs = low.tolist(), mid.tolist(), up.tolist(), rhs.tolist()
    for i in range(1, n):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    d = [0.0] * n
    d[-1] = rhs[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        d[i] = (rhs[i] - up[i] * d[i + 1]) / mid[i]
    return np.array(d)


def pchip_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the monotone cubic of Fritsch and Carlson, with weighted harmonic means."""
    h, m = np.diff(t), np.diff(y) / np.diff(t)
    if len(t) == 2:
        return np.array([m[0], m[0]])
    d = np.zeros(len(t))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    ok = m[:-1] * m[1:] > 0
    d[1:-1][ok] = (w1 + w2)[ok] / (w1[ok] / m[:-1][ok] + w2[ok] / m[1:][ok])

    def edge(h0: float, h1: float, m0: float, m1: float) -> float:
        e = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        if e * m0 <= 0:
            return 0.0
        return 3 * m0 if m0 * m1 < 0 and abs(e) > 3 * abs(m0) else e

    d[0], d[-1] = edge(h[0], h[1], m[0], m[1]), edge(h[-1], h[-2], m[-1], m[-2])
    return d


def akima_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of Akima's interpolation, with two segments extrapolated on each side."""
    m = np.diff(y) / np.diff(t)
    if len(t) == 2:
        return np.array([m[0], m[0]])
    m = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    w1, w2 = np.abs(m[3:] - m[2:-1]), np.abs(m[1:-2] - m[:-3])
    total = w1 + w2
    flat = total <= 1e-9 * total.max(initial=0.0)
    return np.where(flat, (m[1:-2] + m[2:-1]) / 2, (w1 * m[1:-2] + w2 * m[2:-1]) / np.where(flat, 1, total))


SLOPES = {"cubic": cubic_slopes, "pchip": pchip_slopes, "akima": akima_slopes}


def resampled(t: np.ndarray, y: np.ndarray, fs: float = 4.0, method: str = "cubic") -> tuple[np.ndarray, np.ndarray]:
    """(grid, values) at ``fs`` from the first time on, the last excluded; non-finite and repeated times go."""
    if method not in {*SLOPES, "linear"}:
        raise ValueError(f"unknown interpolation: {method}")
    ok = np.isfinite(t) & np.isfinite(y)
    t, first = np.unique(t[ok], return_index=True)
    y = y[ok][first]
    if len(t) < 2:
        return np.zeros(0), np.zeros(0)
    grid = t[0] + np.arange(int(np.ceil((t[-1] - t[0]) * fs - 1e-9))) / fs
    return grid, np.interp(grid, t, y) if method == "linear" else _hermite(t, y, SLOPES[method](t, y), grid)


def fourier_resampled(x: np.ndarray, fs: float, to: float) -> np.ndarray:
    """A signal at another rate, by cutting or padding its spectrum."""
    n, m = len(x), round(len(x) * to / fs)
    if n == m or not n:
        return np.asarray(x, float)
    spec = np.fft.rfft(x)
    out = np.zeros(m // 2 + 1, complex)
    k = min(len(spec), len(out))
    out[:k] = spec[:k]
    if min(n, m) % 2 == 0:
        out[min(n, m) // 2] *= 2 if m < n else 0.5
        if m < n:
            out[m // 2] = out[m // 2].real
    return np.fft.irfft(out, m) * (m / n)


# -- spectra ---------------------------------------------------------------------------


def welch(x: np.ndarray, fs: float, segment: int, overlap: int | None = None, detrend: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density by averaged Hann-windowed segments."""
    segment = min(segment, len(x))
    if segment < 1:
        return np.zeros(0), np.zeros(0)
    overlap = segment // 2 if overlap is None else min(overlap, segment - 1)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment) if segment > 1 else np.ones(1)
    parts = np.lib.stride_tricks.sliding_window_view(x, segment)[:: segment - overlap]
    if detrend:
        parts = parts - parts.mean(axis=1, keepdims=True)
    p = (np.abs(np.fft.rfft(parts * w, axis=1)) ** 2).mean(axis=0) / (fs * (w * w).sum())
    p[1 : (len(p) if segment % 2 else len(p) - 1)] *= 2
    return np.fft.rfftfreq(segment, 1 / fs), p


#: Points that a value is spread to on the fine grid, and how much finer that is than the spectrum: errors stay below 1e-12 of the sum of moduli.
_SPREAD, _FINER = 14, 2


def nonuniform_sums(t: np.ndarray, weights: np.ndarray, low: float, step: float, n: int) -> np.ndarray:
    """Sums of weights * exp(2 pi i f t) at n frequencies, low, low + step, and so on, for a row of weights each.

    Each value is spread to a few neighbouring points of an even grid by a Kaiser-Bessel bump,
    one transform is taken of the grid, and the bump's own transform divided out: n log n in
    place of a product for each value and frequency.
    """
    weights = np.atleast_2d(weights)
    size = 1 << int(np.ceil(np.log2(max(_FINER * n, 2 * _SPREAD))))
    beta = np.pi * np.sqrt((_SPREAD * (1 - 0.5 / _FINER)) ** 2 - 0.8)
    middle = n // 2  # modes around 0 lose least
    place = (t * step % 1.0) * size
    first = np.ceil(place - _SPREAD / 2).astype(np.int64)
    at = first[:, None] + np.arange(_SPREAD)
    bump = np.i0(beta * np.sqrt(np.maximum(0.0, 1 - (2 * (at - place[:, None]) / _SPREAD) ** 2)))
    turned = weights * np.exp(2j * np.pi * (low + middle * step) * t)
    modes = np.arange(n) - middle
    z = np.sqrt((beta**2 - (np.pi * _SPREAD * modes / size) ** 2).astype(complex))
    own = _SPREAD * np.real(np.sinh(z) / z)
    out = np.empty((len(weights), n), complex)
    cell = (at % size).ravel()
    for row, w in zip(out, turned, strict=True):
        v = (w[:, None] * bump).ravel()
        grid = np.bincount(cell, v.real, size) + 1j * np.bincount(cell, v.imag, size)
        row[:] = np.fft.ifft(grid)[modes % size] * size / own
    return out


def lomb_scargle(t: np.ndarray, y: np.ndarray, f: np.ndarray, normalise: bool = False) -> np.ndarray:
    """The Lomb-Scargle periodogram of values less their mean at even frequencies ``f``, with the phase that makes it shift-invariant."""
    y, step = y - y.mean(), (f[-1] - f[0]) / max(1, len(f) - 1)
    values = nonuniform_sums(t, y, f[0], step, len(f))[0]
    double = nonuniform_sums(t, np.ones(len(t)), 2 * f[0], 2 * step, len(f))[0]
    # By half the phase of the double frequency, cosines and sines become orthogonal.
    turn = np.exp(-0.5j * np.angle(double))
    z = values * turn
    cc, ss = (len(t) + np.abs(double)) / 2, (len(t) - np.abs(double)) / 2
    p = 0.5 * (z.real**2 / cc + np.where(ss > 1e-9 * len(t), z.imag**2 / np.maximum(ss, 1e-300), 0.0))
    return p * 2 / (y @ y) if normalise and (y @ y) > 0 else p


def lomb_density(t: np.ndarray, y: np.ndarray, low: float = 0.003, high: float = 0.5, n: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Lomb-Scargle power scaled so that its sum times the step is the population variance."""
    f = np.linspace(low, high, n)
    p = lomb_scargle(t, y, f)
    total = p.sum() * (f[1] - f[0])
    return f, p * y.var() / total if total > 0 else p


def band_power(f: np.ndarray, p: np.ndarray, low: float, high: float) -> float:
    """Trapezoid over low <= f <= high; 0 for fewer than two points, never negative."""
    at = (f >= low) & (f <= high)
    f, p = f[at], p[at]
    return max(0.0, float(((p[1:] + p[:-1]) / 2 * np.diff(f)).sum())) if len(f) > 1 else 0.0


VLF, LF, HF = (0.003, 0.04), (0.04, 0.15), (0.15, 0.4)


def frequency_features(rr_s: np.ndarray, t_s: np.ndarray) -> dict[str, float]:
    """Powers in square milliseconds of a series resampled to 4 Hz; zeros for fewer than 9 beats."""
    names = ("TOTAL_POWER", "VLF_POWER", "LF_POWER", "HF_POWER", "VLF_NORM", "LF_NORM", "HF_NORM", "LF_TO_HF")
    if len(rr_s) < 9:
        return dict.fromkeys(names, 0.0)
    _, x = resampled(t_s, rr_s)
    if len(x) < 10:
        beat = np.arange(len(rr_s), dtype=float)
        f = np.linspace(0.001, 0.5, 1000)
        p = lomb_scargle(beat, rr_s, f, normalise=True)
    else:
        f, p = welch(x, 4.0, min(256, max(1, len(x) // 2)))
    total = band_power(f, p, f[0], f[-1])
    vlf, lf, hf = (band_power(f, p, *b) for b in (VLF, LF, HF))
    norm = lambda x: 100 * x / total if total > 0 else 0.0
    values = (total * 1e6, vlf * 1e6, lf * 1e6, hf * 1e6, norm(vlf), norm(lf), norm(hf), lf / hf if hf > 0 else 0.0)
    return dict(zip(names, values, strict=True))


# -- entropies -------------------------------------------------------------------------


def _within(x: np.ndarray, r: float) -> np.ndarray:
    """Whether values i and j lie within r; templates are diagonal runs of this one matrix.

    Distinct values are compared, which sampled intervals have few of, and then spread.
    """
    u, at = np.unique(x, return_inverse=True)
    return (np.abs(u[:, None] - u[None]) <= r).take(at, axis=0).take(at, axis=1)


def _near(within: np.ndarray, m: int, n: int) -> np.ndarray:
    """Whether templates i and j of length m, i and j < n, lie within r in all places."""
    out = within[:n, :n]
    for k in range(1, m):
        out = out & within[k : k + n, k : k + n]
    return out


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, version: int = 1) -> float:
    """Sample entropy; 0 where a count is 0.

    Version 1 scales the series to unit deviation but keeps r times the raw deviation as
    tolerance, counts templates of length m up to the end, and corrects the ratio by
    (n - m + 2) / (n - m). Version 2 works on the raw series with n - m templates of both lengths.
    """
    n, sd = len(x), float(x.std())
    if n < m + 2 or sd == 0:
        return 0.0
    z, tol = ((x - x.mean()) / sd, r * sd) if version == 1 else (x, r * sd)
    templates, e = n - m, _within(z, tol)
    if version == 1:
        b = int(np.count_nonzero(_near(e, m, n - m + 1)[:templates])) - templates
        a = int(np.count_nonzero(_near(e, m + 1, templates))) - templates
        return float(-np.log(a / b * (n - m + 2) / (n - m))) if a > 0 and b > 0 else 0.0
    b = int(np.count_nonzero(_near(e, m, templates))) - templates
    a = int(np.count_nonzero(_near(e, m + 1, templates))) - templates
    return float(-np.log(a / b)) if a > 0 and b > 0 else 0.0


def template_pairs(x: np.ndarray, m: int = 2, r: float = 0.2) -> tuple[int, int]:
    """(B, A): pairs of templates of length m and m + 1 within r times the deviation, among the first n - m for both."""
    n = len(x) - m
    if n < 1:
        return 0, 0
    near = _near(e := _within(x, r * float(x.std())), m, n)
    return tuple(int(np.count_nonzero(v) - n) // 2 for v in (near, near & e[m:, m:]))


def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, version: int = 1) -> float:
    """Approximate entropy, self-matches counted; versions scale as in :func:`sample_entropy`.

    Version 2 divides the mean logarithm by the number of templates less m - 1.
    """
    n, sd = len(x), float(x.std())
    if n < m + 2 or sd == 0:
        return 0.0
    z, tol = ((x - x.mean()) / sd, r * sd) if version == 1 else (x, r * sd)
    e = _within(z, tol)
    near, phis = _near(e, m, n - m + 1), []
    for k in (m, m + 1):
        if k > m:  # templates longer by one: those that were near, and whose next values are
            near = near[:-1, :-1] & e[m:, m:]
        count = n - k + 1
        c = near.sum(axis=1, dtype=np.int32) / count
        phis.append(float(np.log(c).sum() / (count if version == 1 else count - k + 1)))
    return phis[0] - phis[1]


# -- cleaning --------------------------------------------------------------------------


def winsorise(rr: np.ndarray, t: np.ndarray, retime: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Values outside 1.5 IQR are set to the quartile on their side; fewer than 4 stay."""
    if len(rr) < 4:
        return rr, t
    q1, q3 = np.percentile(rr, [25, 75])
    wide = 1.5 * (q3 - q1)
    out = np.where(rr < q1 - wide, q1, np.where(rr > q3 + wide, q3, rr))
    return out, t[0] + np.append(0.0, np.cumsum(out[:-1])) if retime else t


def preprocessed(rr: np.ndarray, t: np.ndarray, cutoff: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """Winsorise on the times as they are, remove mean and slow trends; empty below 4 intervals."""
    if len(rr) < 4:
        return np.zeros(0), np.zeros(0)
    rr, t = winsorise(rr, t, False)
    return highpass_detrend(rr - rr.mean(), t, cutoff), t
