"""Masks over spectrograms: windows, unions, merging of instances, boxes, ridges, masked resynthesis."""

from __future__ import annotations

import numpy as np

from sonolith.functions.numeric import smooth_2d


def time_window(duration: float, longest: float, n_freq: int, n_time: int) -> np.ndarray:
    """True over the share of the time bins that an event of this duration fills, one bin at least."""
    on = max(1, int(np.ceil(n_time * min(duration / longest, 1.0)))) if longest > 0 else n_time
    out = np.zeros((n_freq, n_time), dtype=bool)
    out[:, :on] = True
    return out


def union(masks: list[np.ndarray], fallback: np.ndarray) -> np.ndarray:
    """Where any mask is; the fallback if there are none or they are empty."""
    out = np.any(masks, axis=0) if masks else np.zeros_like(fallback)
    return out if out.any() else fallback


def merge_instances(masks: list[np.ndarray], iou: float, containment: float) -> list[np.ndarray]:
    """Masks that overlap enough, or of which one holds the other, become one, until none do; the largest first."""
    out = [m.copy() for m in sorted(masks, key=lambda m: -int(m.sum())) if m.any()]
    while True:
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                both, any_ = (out[i] & out[j]).sum(), (out[i] | out[j]).sum()
                if both / any_ >= iou or both / min(out[i].sum(), out[j].sum()) >= containment:
                    out[i] |= out.pop(j)
                    break
            else:
                continue
            break
        else:
            return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of regions that touch by sides or corners, 0 outside."""
    label = np.zeros(mask.shape, dtype=np.int64)
    label[mask] = np.arange(1, int(mask.sum()) + 1)
    while True:
        padded = np.pad(label, 1)
        most = label.copy()
        for di in range(3):
            for dj in range(3):
                most = np.maximum(most, padded[di : di + label.shape[0], dj : dj + label.shape[1]])
        most[~mask] = 0
        if (most == label).all():
            break
        label = most
    _, out = np.unique(label, return_inverse=True)
    return out.reshape(mask.shape) + (0 if (~mask).any() else 1)


def ridge_map(spec: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothed, less its median, over 1.4826 times the median absolute deviation."""
    s = smooth_2d(spec, sigma)
    mid = np.median(s)
    scale = 1.4826 * np.median(np.abs(s - mid))
    return (s - mid) / scale if scale > 0 else np.zeros_like(s)


def boxes(spec: np.ndarray, sigma: float, threshold: float, least: int) -> list[tuple[int, int, int, int]]:
    """Boxes (t0, t1, f0, f1), half-open, of regions over the threshold with ``least`` cells or more."""
    label = components(ridge_map(spec, sigma) > threshold)
    out = []
    for k in range(1, int(label.max()) + 1):
        f, t = np.nonzero(label == k)
        if len(f) >= least:
            out.append((int(t.min()), int(t.max()) + 1, int(f.min()), int(f.max()) + 1))
    return sorted(out)


def masked_waveform(wave: np.ndarray, mask: np.ndarray, nperseg: int, hop: int) -> np.ndarray:
    """The wave resynthesised from the masked part of its short-time transform, by weighted overlap-add."""
    window = np.hanning(nperseg + 2)[1:-1]
    n = max(0, (len(wave) - nperseg) // hop + 1)
    out, weight = np.zeros(len(wave)), np.zeros(len(wave))
    for k in range(n):
        at = slice(k * hop, k * hop + nperseg)
        f = np.fft.rfft(wave[at] * window)
        f[~mask[: len(f), min(k, mask.shape[1] - 1)]] = 0
        out[at] += np.fft.irfft(f, nperseg) * window
        weight[at] += window**2
    return np.divide(out, weight, out=np.zeros(len(wave)), where=weight > 1e-8)


def spiral_order(points: np.ndarray, centre: np.ndarray, turns: float, n: int) -> np.ndarray:
    """Places of n points, each the nearest unused one to a step of a spiral out from the centre."""
    far = np.sqrt(((points - centre) ** 2).sum(axis=1)).max() if len(points) else 0.0
    free, out = np.ones(len(points), dtype=bool), []
    for k in range(min(n, len(points))):
        r, a = far * np.sqrt((k + 0.5) / n), 2 * np.pi * turns * np.sqrt((k + 0.5) / n)
        d = ((points - centre - r * np.array([np.cos(a), np.sin(a)])) ** 2).sum(axis=1)
        at = int(np.where(free, d, np.inf).argmin())
        free[at] = False
        out.append(at)
    return np.array(out, dtype=int)
