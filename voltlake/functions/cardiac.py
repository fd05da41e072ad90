"""Heartbeat detection: R waves from ECG-like traces, ballistocardiogram pulses from many channels."""

from __future__ import annotations

import numpy as np

from voltlake.functions.dsp import band_pass, symmetric_eigen

ALGORITHMS = ("simple", "pan_tompkins", "hamilton", "wfdb", "wavelet", "christov")


#: Windows in seconds, and for each algorithm the shares of the threshold and the least values of starting level and floor.
BASELINE, HIGH_PASS, SMOOTHING, SPACING, REFINEMENT = 0.60, 0.20, 0.035, 0.080, 0.080
LEVELS = {"pan_tompkins": (0.45, 0.90, 0.25, 0.55), "hamilton": (0.55, 1.00, 0.30, 0.65), "wfdb": (0.50, 0.95, 0.28, 0.60), "wavelet": (0.48, 0.90, 0.25, 0.55), "christov": (0.52, 0.95, 0.30, 0.60)}


def samples_of(seconds: float, rate: float, least: int = 1) -> int:
    return max(int(seconds * rate + 0.5), least)


def moving_average(x: np.ndarray, width: int) -> np.ndarray:
    """Mean of the finite values within width // 2 to both sides, shorter at the ends; 0 where there are none."""
    if width <= 1:
        return np.array(x, float)
    r = max(1, width // 2)
    ok = np.isfinite(x)
    total, count = (np.concatenate([[0.0], np.cumsum(v)]) for v in (np.where(ok, x, 0.0), ok))
    n = np.arange(len(x))
    low, high = np.maximum(n - r, 0), np.minimum(n + r + 1, len(x))
    held = count[high] - count[low]
    return np.where(held > 0, (total[high] - total[low]) / np.maximum(held, 1), 0.0)


def derivative(x: np.ndarray) -> np.ndarray:
    return np.gradient(x) if len(x) > 1 else np.array(x, float)


def robust_level(x: np.ndarray) -> tuple[float, float] | None:
    """Median, and the largest of 1.4826 MAD, a third of p95 - median, a tenth of the rms about the median, 1e-6; of all finite samples, None for fewer than 8."""
    x = x[np.isfinite(x)]
    if len(x) < 8:
        return None
    c = float(np.median(x))
    return c, float(max(1.4826 * np.median(np.abs(x - c)), (np.percentile(x, 95) - c) / 3, 0.1 * np.sqrt(np.mean((x - c) ** 2)), 1e-6))


def without_baseline(x: np.ndarray, rate: float) -> np.ndarray:
    x = np.asarray(x, float)
    slow = moving_average(x, 2 * max(int(BASELINE * rate / 2 + 0.5), 1))
    return np.where(np.isfinite(x), x - slow, 0.0)


def envelope(y: np.ndarray, rate: float, algorithm: str) -> np.ndarray:
    """A non-negative trace of a filtered lead that is high on QRS complexes."""
    mean = lambda x, seconds, least=3: moving_average(x, samples_of(seconds, rate, least))
    d = derivative(y)
    if algorithm == "pan_tompkins":
        return mean(d * d, 0.150)
    if algorithm == "hamilton":
        short = mean(np.abs(d), 0.080)
        return np.maximum(short - 0.5 * mean(short, 1.0, 2 * samples_of(0.080, rate, 3)), 0)
    if algorithm == "wfdb":
        scale = (robust_level(d) or (0.0, 1.0))[1]
        return mean(np.sqrt(1 + (d / max(scale, 1e-6)) ** 2) - 1, 0.130) + np.sqrt(np.maximum(mean(d * d, 0.050), 0))
    if algorithm == "wavelet":
        steps = [y, *(mean(y, seconds, least) for seconds, least in ((0.025, 1), (0.050, 3), (0.100, 5), (0.200, 9)))]
        energy = sum(share * (fine - coarse) ** 2 for share, fine, coarse in zip((1.0, 0.85, 0.60, 0.35), steps, steps[1:], strict=False))
        return mean(np.sqrt(energy), 0.080)
    short = mean(np.abs(d) + 0.45 * np.abs(derivative(d)), 0.040)
    return np.maximum(short - 0.35 * mean(short, 0.280, 7), 0)


def lead_scores(x: np.ndarray, rate: float, algorithm: str, polarity: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Robust z of a lead's envelope (0 and more), and the waveform that beats are placed on."""
    y = without_baseline(x, rate)
    if algorithm != "simple":
        y = moving_average(y - moving_average(y, samples_of(HIGH_PASS, rate, 3)), samples_of(SMOOTHING, rate))
    e = y if algorithm == "simple" else envelope(y, rate, algorithm)
    level = robust_level(e)
    if level is None:
        return None
    z = (e - level[0]) / level[1]
    return (np.maximum(z, 0) if algorithm != "simple" else turned(z, polarity)), y


def turned(x: np.ndarray, polarity: str) -> np.ndarray:
    return {"positive": np.maximum(x, 0), "negative": np.maximum(-x, 0)}.get(polarity, np.abs(x))


def clustered(z: np.ndarray, spacing: int) -> np.ndarray:
    """Local maxima, of each cluster the highest; a cluster spans the spacing from its first."""
    at = np.flatnonzero((z[1:-1] >= z[:-2]) & (z[1:-1] > z[2:])) + 1
    kept: list[int] = []
    first = None
    for p in at.tolist():
        if first is None or p - first > spacing:
            kept.append(p)
            first = p
        elif z[p] > z[kept[-1]]:
            kept[-1] = p
    return np.array(kept, int)


def adaptive_picks(z: np.ndarray, peaks: np.ndarray, level: float, floor: float) -> list[int]:
    """Peaks above a quarter of the way from the noise to the signal level, which both follow the peaks by an eighth."""
    if not len(peaks):
        return []
    signal, noise = max(level, float(np.percentile(z[peaks], 85))), max(0.0, float(np.percentile(z[peaks], 20)))
    limit = max(floor, min(level, noise + 0.25 * (signal - noise)))
    picks: list[int] = []
    for p in peaks.tolist():
        v = float(z[p])
        if v >= limit:
            picks.append(p)
            signal = 0.125 * v + 0.875 * signal
        else:
            noise = 0.125 * v + 0.875 * noise
        limit = max(floor, noise + 0.25 * (signal - noise))
    return picks


def r_waves(channels: np.ndarray, rate: float, algorithm: str = "pan_tompkins", threshold: float = 2.0, min_rr: float = 0.3, polarity: str = "either") -> list[tuple[int, float]]:
    """(sample, score) of each beat; channels x samples, the largest score of the channels counts.

    'simple' takes local maxima above the threshold, the others adaptive levels that
    start from it. Beats move to the largest excursion near them; of beats closer than
    ``min_rr`` seconds the better stays.
    """
    if channels.size == 0 or rate <= 0 or channels.shape[1] < 3:
        return []
    leads = [x for x in (lead_scores(c, rate, algorithm, polarity) for c in channels) if x is not None]
    if not leads:
        return []
    z = np.maximum(np.max([s for s, _ in leads], 0), 0)
    if algorithm == "simple":
        picks = (np.flatnonzero((z[1:-1] >= threshold) & (z[1:-1] >= z[:-2]) & (z[1:-1] > z[2:])) + 1).tolist()
    else:
        share, least, low_share, low_least = LEVELS[algorithm]
        picks = adaptive_picks(z, clustered(z, samples_of(SPACING, rate)), max(threshold * share, least), max(threshold * low_share, low_least))
    half, lead = samples_of(REFINEMENT, rate), np.max([turned(y, polarity) for _, y in leads], 0)
    placed = [(max(0, p - half) + int(np.argmax(lead[max(0, p - half) : p + half + 1])), float(z[p])) for p in picks]
    out: list[tuple[int, float]] = []
    for p, score in sorted(placed, key=lambda x: -x[1]):
        if all(abs(p - q) >= min_rr * rate for q, _ in out):
            out.append((p, score))
    return sorted(out)


def suppressed_peaks(x: np.ndarray, sigmas: float, spacing: int) -> list[int]:
    """Local maxima above mean + sigmas deviations of the values' middle half, tallest first."""
    if len(x) < 3:
        return []
    low, high = np.percentile(x, [25, 75])
    middle = x[(x >= low) & (x <= high)]
    at = np.flatnonzero((x[1:-1] >= x[:-2]) & (x[1:-1] > x[2:])) + 1
    at = at[x[at] > middle.mean() + sigmas * middle.std()]
    kept: list[int] = []
    for p in at[np.argsort(-x[at], kind="stable")].tolist():
        if all(abs(p - q) >= spacing for q in kept):
            kept.append(p)
    return sorted(kept)


def bcg_periodic(channels: np.ndarray, rate: float, low_bpm: float = 40, high_bpm: float = 180) -> list[int]:
    """Peaks of the field power in the band of the heart rate."""
    y = band_pass(channels.T, rate, low_bpm / 60, min(high_bpm / 60, 0.45 * rate), slope=12).T
    return suppressed_peaks(np.sqrt((y * y).mean(0)), 2.5, int(0.6 * rate / (high_bpm / 60)))


def bcg_spatial(channels: np.ndarray, rate: float, exemplar: tuple[int, int] | None = None, components: int = 3, whiten: bool = False) -> list[int]:
    """Root of the summed squared spatial components of an exemplar (or the first 30 s), smoothed, normalised, z-scored, picked."""
    x = channels - channels.mean(1, keepdims=True)
    part = x[:, slice(*exemplar)] if exemplar else x[:, : int(30 * rate)]
    values, vectors = symmetric_eigen(part @ part.T / part.shape[1])
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    scores = vectors.T @ x
    if whiten:
        scores = scores / np.sqrt(np.maximum(values, 1e-12))[:, None]
    drive = moving_average(np.sqrt((scores**2).sum(0)), max(2, int(0.1 * rate)))
    drive = drive / np.sqrt(np.maximum(moving_average(drive**2, int(6 * rate)), 1e-20))
    mean = moving_average(drive, int(30 * rate))
    sd = np.sqrt(np.maximum(moving_average(drive**2, int(30 * rate)) - mean**2, 1e-20))
    return suppressed_peaks((drive - mean) / sd, 1.5, int(0.5 * rate))


def bcg_refined(channels: np.ndarray, rate: float, events: list[int], half_s: float = 0.35, keep: float = 0.8) -> tuple[list[int], np.ndarray]:
    """Average of the epochs whose first component peaks best (the worst fifth dropped), and picks of its correlation."""
    h = int(half_s * rate)
    inside = [p for p in events if h <= p < channels.shape[1] - h]
    if len(inside) < 4:
        return events, np.zeros((len(channels), 2 * h))
    epochs = np.stack([channels[:, p - h : p + h] for p in inside])
    epochs = epochs - epochs.mean(2, keepdims=True)
    flat = epochs.reshape(len(inside), -1)
    first = np.linalg.svd(flat, full_matrices=False)[2][0]
    score = np.abs(flat @ first)
    best = np.argsort(-score, kind="stable")[: max(4, int(np.ceil(keep * len(inside))))]
    template = epochs[best].mean(0)
    unit = template / max(1e-12, np.linalg.norm(template))
    drive = sum(np.convolve(c - c.mean(), u[::-1], "same") for c, u in zip(channels, unit, strict=True))
    return suppressed_peaks(drive, 1.5, int(0.5 * rate)), template


def virtual_ecg(channels: np.ndarray) -> np.ndarray:
    """First spatial component, turned so that its largest excursion is positive."""
    x = channels - channels.mean(1, keepdims=True)
    _, v = symmetric_eigen(x @ x.T)
    y = v[:, -1] @ x
    return y if abs(y.max(initial=0)) >= abs(y.min(initial=0)) else -y


def cardiac_power(channels: np.ndarray, rate: float) -> np.ndarray:
    """Sum of channels in the cardiac band, weighted by their rms."""
    y = band_pass(channels.T, rate, 0.7, min(10.0, 0.45 * rate), slope=12).T
    w = np.sqrt((y * y).mean(1))
    return (w / max(1e-12, w.sum())) @ np.abs(y)
