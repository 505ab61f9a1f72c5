"""Numerical kernels in numpy that run inside grouped UDFs: smoothing, tests, densities, bases."""

from __future__ import annotations

import math
from itertools import product

import numpy as np


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


def smooth(x: np.ndarray, sigma: float, keep_nan: bool = True) -> np.ndarray:
    """Gaussian smoothing along the last axis, edges repeated; NaN has no weight and, if kept, stays."""
    x = np.asarray(x, dtype=float)
    if sigma <= 0 or x.shape[-1] == 0:
        return x.copy()
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    ok = np.isfinite(x)
    pad = [(0, 0)] * (x.ndim - 1) + [(r, r)]
    value, weight = np.pad(np.where(ok, x, 0.0), pad, mode="edge"), np.pad(ok.astype(float), pad, mode="edge")
    window = np.lib.stride_tricks.sliding_window_view
    num, den = window(value, len(k), axis=-1) @ k, window(weight, len(k), axis=-1) @ k
    out = np.divide(num, den, out=np.full(x.shape, np.nan), where=den > 0)
    return np.where(ok, out, np.nan) if keep_nan else out


def smooth_2d(x: np.ndarray, sigma: float, keep_nan: bool = True) -> np.ndarray:
    """Smoothing along both axes, normalised once by the smoothed weights."""
    ok = np.isfinite(x)

    def both(a: np.ndarray) -> np.ndarray:
        return smooth(smooth(a, sigma).T, sigma).T

    num, den = both(np.where(ok, x, 0.0)), both(ok.astype(float))
    out = np.divide(num, den, out=np.full(x.shape, np.nan), where=den > 0)
    return np.where(ok, out, np.nan) if keep_nan else out


def speed(xy: np.ndarray, fps: float, sigma: float) -> np.ndarray:
    """Speed in cm/s of the mean of nodes (frames x nodes x dims, in m); the first frame has none."""
    mid = np.nanmean(xy, axis=1) if xy.size else np.zeros((len(xy), 2))
    v = np.full(len(mid), np.nan)
    v[1:] = np.sqrt((np.diff(mid, axis=0) ** 2).sum(axis=1)) * 100 * fps
    return smooth(v, sigma)


def average_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.searchsorted(s, s, side="left")
    last = np.searchsorted(s, s, side="right")
    out = np.empty(len(x))
    out[order] = (first + last + 1) / 2
    return out


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon(x: np.ndarray, y: np.ndarray) -> tuple[float, float, int]:
    """Signed-rank statistic (the lesser sum), two-sided p, and pairs that differ or not.

    Zeros are split between both sides. Up to 25 pairs the distribution is counted out; above it is
    normal with tie and continuity correction.
    """
    d = np.asarray(x, float) - np.asarray(y, float)
    d = d[np.isfinite(d)]
    n = len(d)
    if n == 0 or not d.any():
        return (0.0, 1.0, n)
    r = average_ranks(np.abs(d))
    zero = r[d == 0].sum() / 2
    plus, minus = r[d > 0].sum() + zero, r[d < 0].sum() + zero
    w = min(plus, minus)
    if n <= 25:
        doubled = np.rint(2 * r).astype(int)
        ways = np.zeros(doubled.sum() + 1)
        ways[0] = 1
        for k in doubled:
            ways[k:] += ways[:-k].copy() if k else ways
        p = 2 * ways[: int(math.floor(2 * w + 1e-9)) + 1].sum() / ways.sum()
        return (float(w), float(min(1.0, p)), n)
    mu = n * (n + 1) / 4
    _, ties = np.unique(np.abs(d), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    n0 = int((d == 0).sum())
    var -= n0 * (n0 + 1) * (2 * n0 + 1) / 24
    z = (w - mu + 0.5) / math.sqrt(var) if var > 0 else 0.0
    return (float(w), float(min(1.0, 2 * normal_sf(-z))), n)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + k * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + k / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_cdf(t: float, nu: float) -> float:
    tail = 0.5 * incomplete_beta(nu / 2, 0.5, nu / (nu + t * t))
    return 1 - tail if t > 0 else tail


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3 or not math.isfinite(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t = r * math.sqrt((n - 2) / (1 - r * r))
    return 2 * (1 - t_cdf(abs(t), n - 2))


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def kde(samples: np.ndarray, queries: np.ndarray, period: float | None = None, bandwidth: float | None = None) -> np.ndarray:
    """Gaussian density at the queries (Scott's bandwidth); on a torus the samples are laid in nine images."""
    n, d = samples.shape
    factor = n ** (-1 / (d + 4)) if bandwidth is None else bandwidth
    cov = np.atleast_2d(np.cov(samples.T)) * factor**2
    inv = np.linalg.inv(cov)
    norm = 1 / (n * math.sqrt((2 * math.pi) ** d * np.linalg.det(cov)))
    return kernel_sums(samples, queries, inv, period) * norm


def kernel_sums(samples: np.ndarray, queries: np.ndarray, inv: np.ndarray, period: float | None = None) -> np.ndarray:
    """Sum of the samples' kernels at the queries, a block of each at a time; sums of parts of the samples add up."""
    shifts = np.array(list(product((-period, 0, period), repeat=samples.shape[1]))) if period else np.zeros((1, samples.shape[1]))
    out = np.zeros(len(queries))
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        for k in range(0, len(samples), 16_384):
            for s in shifts:
                diff = q[:, None, :] - (samples[k : k + 16_384] + s)[None, :, :]
                out[i : i + 256] += np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", diff, inv, diff)).sum(axis=1)
    return out


def inverse_density_weights(points: np.ndarray, clip_percentile: float, eps: float, period: float | None) -> np.ndarray:
    w = 1 / (kde(points, points, period) + eps)
    w = np.minimum(w, np.percentile(w, clip_percentile))
    return w / w.mean()


def distance_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """From double-centred distances; 0 where either doesn't vary."""

    def centred(x: np.ndarray) -> np.ndarray:
        x = x.reshape(len(x), -1)
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()

    p, q = centred(np.asarray(a, float)), centred(np.asarray(b, float))
    v = (p * p).mean() * (q * q).mean()
    return float(math.sqrt(max((p * q).mean(), 0) / math.sqrt(v))) if v > 0 else 0.0


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Biased autocorrelation by FFT, zero-padded to a power of two; NaN as the mean; all 0 but lag 0 if constant."""
    x = np.where(np.isfinite(x), x, np.nanmean(x) if np.isfinite(x).any() else 0.0)
    x = x - x.mean()
    size = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.rfft(x, size)
    acf = np.fft.irfft(f * np.conj(f), size)[: lags + 1]
    return acf / acf[0] if acf[0] > 0 else np.r_[1.0, np.zeros(lags)]


def integrated_time(acf: np.ndarray) -> float:
    """1 + 2 * sum of correlations up to the first that is 0 or less."""
    stop = np.flatnonzero(acf[1:] <= 0)
    return float(1 + 2 * acf[1 : 1 + (stop[0] if len(stop) else len(acf) - 1)].sum())


def first_below(acf: np.ndarray, threshold: float) -> int | None:
    at = np.flatnonzero(acf < threshold)
    return int(at[0]) if len(at) else None


def variance_inflation(x: np.ndarray) -> np.ndarray:
    """1 / (1 - R2) of each column on the others: inf if constant or determined, NaN with too few rows."""
    n, p = x.shape
    out = np.full(p, np.nan)
    if n <= p + 1:
        return out
    for j in range(p):
        y = x[:, j]
        total = ((y - y.mean()) ** 2).sum()
        if total <= 0:
            out[j] = np.inf
            continue
        a = np.column_stack([np.ones(n), np.delete(x, j, axis=1)])
        rest = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        r2 = 1 - (rest**2).sum() / total
        out[j] = np.inf if r2 >= 1 - 1e-12 else 1 / (1 - r2)
    return out


def condition_number(x: np.ndarray) -> float:
    s = np.linalg.svd((x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1), compute_uv=False)
    return float(s[0] / s[-1]) if s[-1] > 0 else math.inf


# bases for histories


#: Keeps the logarithm of 0 finite.
LOG_FLOOR = 1e-20


def raised_cosine(n_identity: int, n_cosines: int, peaks: tuple[float, float], offset: float, width: int | None = None, n_bases: int | None = None) -> np.ndarray:
    """time x bases, time running towards the event: one base for each of the last ``n_identity`` steps, before them cosine bumps.

    Bumps have their peaks from the first to the last of ``peaks`` evenly on the axis log(time +
    offset), reach two spacings to either side, and time goes to two spacings behind the last peak.
    ``n_bases`` cuts bases or adds empty ones, ``width`` cuts the oldest steps or adds empty ones;
    columns have length 1 at the end, empty ones stay empty.
    """
    low, high = (math.log(x + offset + LOG_FLOOR) for x in peaks)
    spacing = (high - low) / (n_cosines - 1)
    end = math.exp(high + 2 * spacing) - LOG_FLOOR - offset
    steps = np.arange(math.ceil(end))
    distance = np.log(steps + offset + LOG_FLOOR)[:, None] - np.linspace(low, high, n_cosines)[None, :]
    bumps = (1 + np.cos(np.clip(distance * math.pi / (2 * spacing), -math.pi, math.pi))) / 2
    out = np.zeros((n_identity + len(steps), n_identity + n_cosines))
    out[:n_identity, :n_identity] = np.eye(n_identity)
    out[n_identity:, n_identity:] = bumps
    bases, rows = n_bases or out.shape[1], width or len(out)
    fitted = np.zeros((rows, bases))
    keep, columns = min(rows, len(out)), min(bases, out.shape[1])
    fitted[rows - keep :, :columns] = out[::-1][len(out) - keep :, :columns]
    size = np.sqrt((fitted**2).sum(axis=0))
    return np.divide(fitted, size, out=np.zeros_like(fitted), where=size > 0)


def laplacian_pyramid(width: int, levels: int, step: float, fwhm: float, normalise: bool = True) -> np.ndarray:
    """time x bases: Gaussians on centred grids whose spacing, and with it their width, doubles with each whole level.

    Levels go from 0 to ``levels`` by ``step``. The grid of a level has a spacing of 2^(level - 1) and
    int(width / spacing - 1) places; its first place has no base. Without any base, ValueError.
    """
    x, columns = np.arange(width), []
    for level in np.arange(0, levels, step):
        spacing = 2.0 ** (level - 1)
        places = int(width / spacing - 1)
        if places < 1:
            continue
        grid = np.floor((width - ((places - 1) * spacing + 1)) / 2 + spacing / 2 + spacing * np.arange(places)) + 1
        for centre in grid[1:]:
            g = np.exp(-((x - centre) ** 2) / (2 * (spacing / 2.35 * fwhm) ** 2))
            columns.append(g / np.linalg.norm(g) if normalise else g)
    if not columns:
        raise ValueError(f"no base fits into {width} steps at levels below {levels} by {step}")
    return np.column_stack(columns)


def spline_knots(positions: np.ndarray, degree: int, periodic: bool) -> np.ndarray:
    """Knots of the spline of this degree that interpolates at the positions.

    Inner knots are positions (between them, for an even degree), as many as leave one coefficient a
    position; the ends are repeated, or, if periodic, inner knots go on by whole periods.
    """
    x, k = np.asarray(positions, dtype=float), degree
    between = x if k % 2 else (x[1:] + x[:-1]) / 2
    if not periodic:
        first = k // 2 + 1 if k % 2 else k // 2
        return np.r_[[x[0]] * (k + 1), between[first : first + len(x) - k - 1], [x[-1]] * (k + 1)]
    inner = np.r_[x[0], between[1:-1] if k % 2 else between[: len(x) - 2], x[-1]]
    period = x[-1] - x[0]
    cycle = inner[:-1]
    many = np.concatenate([cycle + i * period for i in range(-k - 1, k + 2)])
    at = (k + 1) * len(cycle)
    return many[at - k : at + len(cycle) + k + 1]


def bsplines(width: int, positions: np.ndarray, degree: int = 3, periodic: bool = False) -> np.ndarray:
    """time x bases, latest step first: the first B-splines, one a position, at steps 0 to width - 1; beyond the ends the outer pieces go on."""
    t, k, x = spline_knots(positions, degree, periodic), degree, np.arange(width, dtype=float)
    span = np.clip(np.searchsorted(t, x, side="right") - 1, k, len(t) - k - 2)
    piece = np.zeros((len(t) - 1, width))
    piece[span, np.arange(width)] = 1
    for d in range(1, k + 1):
        rise = [(x - t[i]) / (t[i + d] - t[i]) * piece[i] if t[i + d] > t[i] else np.zeros(width) for i in range(len(t) - d)]
        fall = [(t[i + d] - x) / (t[i + d] - t[i]) * piece[i] if t[i + d] > t[i] else np.zeros(width) for i in range(len(t) - d)]
        piece = np.array([rise[i] + fall[i + 1] for i in range(len(t) - d - 1)])
    return piece[: len(positions), ::-1].T


def identity_basis(width: int) -> np.ndarray:
    """One base a step, the first of them the latest step."""
    return np.eye(width)[::-1]


# lattices


def korobov(a: int, dims: int, n: int) -> np.ndarray:
    """i * (a^k mod n) / n, not reduced."""
    return np.arange(n)[:, None] * np.array([pow(a, k, n) for k in range(dims)])[None, :] / n


def fibonacci_lattice(m: int) -> np.ndarray:
    """i * [1, F(m - 1)] / F(m), not reduced."""
    f = [1, 1]
    while len(f) < m:
        f.append(f[-1] + f[-2])
    n, before = f[m - 1], f[m - 2]
    return np.arange(n)[:, None] * np.array([1, before])[None, :] / n


def roberts(n: int, dims: int, iterations: int = 64) -> np.ndarray:
    """i * (1 - g^-k) for the root g of x^(dims + 1) = x + 1, by Newton's method."""
    g = 1.5
    for _ in range(iterations):
        g -= (g ** (dims + 1) - g - 1) / ((dims + 1) * g**dims - 1)
    return np.arange(n)[:, None] * (1 - g ** -np.arange(1.0, dims + 1))[None, :]


# signals


def spectrum(segment: np.ndarray, nperseg: int, hop: int) -> np.ndarray:
    """Power of a Hann-windowed short-time transform, frequencies x frames."""
    if len(segment) < nperseg:
        return np.zeros((nperseg // 2 + 1, 0))
    frames = np.lib.stride_tricks.sliding_window_view(segment, nperseg)[::hop]
    return (np.abs(np.fft.rfft(frames * np.hanning(nperseg), axis=1)) ** 2).T


def spectrogram(channels: np.ndarray, nperseg: int, hop: int, shape: tuple[int, int]) -> np.ndarray:
    """Channels weighted by their variance, in dB, resized in time to ``shape`` and scaled to [0, 1]."""
    w = channels.var(axis=1)
    w = w / w.sum() if w.sum() > 0 else np.full(len(channels), 1 / len(channels))
    p = sum(wi * spectrum(c, nperseg, hop) for wi, c in zip(w, channels, strict=True))
    db = 10 * np.log10(p[: shape[0]] + 1e-12)
    if db.shape[1] == 0:
        return np.zeros(shape)
    at = np.linspace(0, db.shape[1] - 1, shape[1])
    out = np.array([np.interp(at, np.arange(db.shape[1]), row) for row in db])
    out = np.pad(out, ((0, shape[0] - len(out)), (0, 0)), constant_values=out.min())
    span = out.max() - out.min()
    return (out - out.min()) / span if span > 0 else np.zeros(shape)


def spectral_moments(spec: np.ndarray, freqs: np.ndarray, mask: np.ndarray | None = None, low: float = 0.05, high: float = 0.95) -> dict[str, float]:
    """Of masked energy: mean and peak frequency, bandwidth between shares of the energy, amplitudes, entropy."""
    s = spec if mask is None else np.where(mask, spec, 0.0)
    energy = s.sum(axis=1)
    names = ("mean_freq", "peak_freq", "bandwidth", "mean_amplitude", "max_amplitude", "entropy")
    if energy.sum() <= 0:
        return dict.fromkeys(names, math.nan)
    p = energy / energy.sum()
    c = np.cumsum(p)
    inside = s[s > 0]
    width = freqs[min(np.searchsorted(c, high), len(freqs) - 1)] - freqs[np.searchsorted(c, low)]
    q = p[p > 0]
    values = ((freqs * p).sum(), freqs[energy.argmax()], width, inside.mean(), s.max(), -(q * np.log2(q)).sum() / math.log2(len(p)))
    return {k: float(v) for k, v in zip(names, values, strict=True)}


def watershed_segments(starts: np.ndarray, stops: np.ndarray, channels: np.ndarray, bin_s: float, peak_min: int, valley: float) -> list[tuple[float, float]]:
    """Detections on channels as events: bins by channels that are active, regions cut at valleys and trimmed.

    A region is a run of covered bins whose peak reaches ``peak_min``. It is cut where coverage falls
    below ``valley`` of the lesser of the peaks on both sides, and each part trimmed to that level.
    """
    if not len(starts):
        return []
    first, last = np.floor(starts / bin_s + 1e-9).astype(int), np.ceil(stops / bin_s - 1e-9).astype(int)
    base = first.min()
    seen = np.zeros((len(np.unique(channels)), last.max() - base + 1), dtype=bool)
    at = np.searchsorted(np.unique(channels), channels)
    for k, a, b in zip(at, first, np.maximum(last, first + 1), strict=True):
        seen[k, a - base : b - base] = True
    cover = seen.sum(axis=0)
    edge = np.flatnonzero(np.diff(np.r_[0, (cover > 0).astype(int), 0]))
    out = []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            c = cover[x:y]
            if not len(c) or c.max() < peak_min:
                continue
            left, right = np.maximum.accumulate(c), np.maximum.accumulate(c[::-1])[::-1]
            deep = np.minimum(left, right)
            cut = np.flatnonzero((c < valley * deep) & (deep >= peak_min))
            if len(cut):
                k = int(cut[c[cut].argmin()])
                todo += [(x, x + k), (x + k + 1, y)]
                continue
            on = np.flatnonzero(c >= valley * c.max())
            out.append(((base + x + on[0]) * bin_s, (base + x + on[-1] + 1) * bin_s))
    return sorted(out)


def merge_boxes(boxes: list[tuple[float, float, float, float]], time_gap: float, freq_gap: float) -> list[tuple[float, float, float, float]]:
    """Boxes (t0, t1, f0, f1) near in both time and frequency become one, until none are."""
    boxes = sorted(boxes)
    while True:
        for i, j in ((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes))):
            a, b = boxes[i], boxes[j]
            if max(a[0], b[0]) - min(a[1], b[1]) <= time_gap and max(a[2], b[2]) - min(a[3], b[3]) <= freq_gap:
                one = (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
                boxes = sorted([x for k, x in enumerate(boxes) if k not in (i, j)] + [one])
                break
        else:
            return boxes


def amplitude_cv(amplitudes: np.ndarray, at: np.ndarray, n_samples: int, rate: float, per_bin: int = 50, least_bins: int = 10) -> tuple[float, float]:
    """Median and spread (p95 - p5) of deviation over mean of amplitudes in bins of about ``per_bin`` spikes."""
    if not len(amplitudes) or n_samples <= 0:
        return math.nan, math.nan
    seconds = n_samples / rate
    bins = int(len(amplitudes) / per_bin)
    if bins < least_bins:
        return math.nan, math.nan
    k = np.minimum((at / rate / seconds * bins).astype(int), bins - 1)
    cv = [np.std(amplitudes[k == b]) / abs(amplitudes[k == b].mean()) for b in range(bins) if (k == b).sum() > 1 and amplitudes[k == b].mean()]
    return (float(np.median(cv)), float(np.percentile(cv, 95) - np.percentile(cv, 5))) if len(cv) >= least_bins else (math.nan, math.nan)


def censored(at: np.ndarray, period: float) -> np.ndarray:
    """Which sorted points stay if each that follows the last kept one too closely goes."""
    keep, last = np.zeros(len(at), dtype=bool), -math.inf
    for i, t in enumerate(at):
        if t - last > period:
            keep[i], last = True, t
    return keep


def medoid(points: np.ndarray, iterations: int = 200, tol: float = 1e-9) -> int:
    """The point nearest to the geometric median (Weiszfeld)."""
    m = points.mean(axis=0)
    for _ in range(iterations):
        d = np.sqrt(((points - m) ** 2).sum(axis=1))
        w = 1 / np.maximum(d, 1e-12)
        new = (points * w[:, None]).sum(axis=0) / w.sum()
        if np.abs(new - m).max() < tol:
            break
        m = new
    return int(((points - m) ** 2).sum(axis=1).argmin())


def geodesic_matrix(edges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Shortest paths between all nodes of an undirected graph, by Dijkstra's method from each."""
    import heapq

    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    out = np.full((n, n), np.inf)
    for s in range(n):
        out[s, s] = 0
        heap = [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > out[s, u]:
                continue
            for v, w in near[u]:
                if d + w < out[s, v]:
                    out[s, v] = d + w
                    heapq.heappush(heap, (d + w, v))
    return out
