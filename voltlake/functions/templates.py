"""Template search on channel matrices: waveforms, trajectories of maps, wavelet features."""

from __future__ import annotations

import numpy as np

from voltlake.functions.wavelets import a_trous


#: Windows that are compared at a time.
WINDOWS = 16_384


def unit(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


def merge(starts: list[int], scores: list[float], gap: int) -> list[tuple[int, float]]:
    """Starts no further than the gap from the last kept one: the better stays and moves the anchor."""
    kept: list[tuple[int, float]] = []
    for s, v in sorted(zip(starts, scores, strict=True), key=lambda x: (x[0], -x[1])):
        if kept and s - kept[-1][0] <= gap:
            if v > kept[-1][1]:
                kept[-1] = (s, v)
        else:
            kept.append((s, v))
    return kept


def spaced(order: np.ndarray, spacing: int) -> list[int]:
    """Of places in the order given those at least ``spacing`` from all kept before; each marks what it keeps others from."""
    taken = np.zeros(int(order.max(initial=0)) + spacing + 1, bool)
    kept: list[int] = []
    for a in order.tolist():
        if not taken[a]:
            kept.append(a)
            taken[max(0, a - spacing + 1) : a + spacing] = True
    return kept


def candidate_starts(x: np.ndarray, width: int, template: np.ndarray) -> np.ndarray:
    """Local maxima of the projection on the template's strongest channel, at mean + 1.25 deviations or more and a third of a window apart; with fewer than 12, every quarter window."""
    n = x.shape[1] - width + 1
    if n < 1:
        return np.zeros(0, int)
    c = int(np.argmax((template**2).sum(1)))
    p = np.abs(np.correlate(x[c] - x[c].mean(), unit(template[c]), "valid"))
    at = np.flatnonzero((p[1:-1] >= p[:-2]) & (p[1:-1] > p[2:])) + 1
    at = at[p[at] >= p.mean() + 1.25 * p.std()]
    kept = spaced(at[np.argsort(-p[at], kind="stable")], width // 3)
    return np.array(sorted(kept), int) if len(kept) >= 12 else np.arange(0, n, max(1, width // 4))


def waveform_scores(x: np.ndarray, template: np.ndarray, starts: np.ndarray, polarity: str = "same") -> np.ndarray:
    """Correlation per channel, weighted by the template's rms."""
    width = template.shape[1]
    weight = np.sqrt((template**2).mean(1))
    weight = weight / max(1e-12, weight.sum())
    r = np.zeros(len(starts))
    for c, (trace, t) in enumerate(zip(x, unit(template), strict=True)):  # a channel and some windows at a time: all windows are many times the recording
        windows = np.lib.stride_tricks.sliding_window_view(trace, width)
        for low in range(0, len(starts), WINDOWS):
            r[low : low + WINDOWS] += weight[c] * (unit(windows[starts[low : low + WINDOWS]]) @ t)
    return np.abs(r) if polarity == "both" else -r if polarity == "opposite" else r


def waveform_matches(x: np.ndarray, template: np.ndarray, threshold: float, polarity: str = "same", merge_share: float = 0.5) -> list[tuple[int, float]]:
    """(centre, score) of matches."""
    width = template.shape[1]
    starts = candidate_starts(x, width, template)
    if not len(starts):
        return []
    fine = np.unique(np.clip((starts[:, None] + np.arange(-(width // 8), width // 8 + 1)).ravel(), 0, x.shape[1] - width))
    scores = waveform_scores(x, template, fine, polarity)
    hit = scores >= threshold
    return [(s + width // 2, v) for s, v in merge(fine[hit].tolist(), scores[hit].tolist(), int(width * merge_share))]


def scope_counts(x: np.ndarray, template: np.ndarray, threshold: float, most: int = 8) -> list[tuple[int, int]]:
    """Matches of single-channel searches, for the channels of the highest average peak."""
    order = np.lexsort((np.arange(len(template)), -np.abs(template).max(1)))[:most]
    return [(int(c), len(waveform_matches(x[c : c + 1], template[c : c + 1], threshold))) for c in order]


def topography(x: np.ndarray, start: int, width: int, mode: str = "middle") -> np.ndarray:
    w = x[:, start : start + width]
    if mode == "peak":
        return w[:, int(np.argmax(w.std(0)))]
    return w.mean(1) if mode == "average" else w[:, width // 2]


def trajectory_scores(x: np.ndarray, template: np.ndarray, scales: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2)) -> list[tuple[int, float]]:
    """(start, best score) at every eighth of a window: the mean spatial correlation weighted by field power, over time scales and small shifts."""
    width = template.shape[1]
    step, slack = max(1, width // 8), max(1, width // 4)
    maps, power = unit(template.T), template.std(0)
    power = power / max(1e-12, power.sum())
    field = unit(x.T)
    out = []
    for s in range(0, x.shape[1] - width + 1, step):
        best = -1.0
        for scale in scales:
            for shift in range(-slack, slack + 1, max(1, slack // 2)):
                at = np.round(s + shift + (np.arange(width) - width / 2) * scale + width / 2).astype(int)
                if at[0] < 0 or at[-1] >= x.shape[1]:
                    continue
                best = max(best, float(power @ (field[at] * maps).sum(1)))
        out.append((s, best))
    return out


def trajectory_matches(x: np.ndarray, template: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    width = template.shape[1]
    hits = [(s, v) for s, v in trajectory_scores(x, template) if v >= threshold]
    return [(s + width // 2, v) for s, v in merge([s for s, _ in hits], [v for _, v in hits], width // 2)]


def wavelet_features(w: np.ndarray, levels: int = 5) -> np.ndarray:
    """Energy of each channel and level."""
    return np.array([[float(d @ d) for d in a_trous(c, levels)[1]] for c in w])


def wavelet_summary(w: np.ndarray, rate: float, levels: int = 5) -> list[tuple[int, int, float, float]]:
    """(channel, level, centre in Hz, share of the energy)."""
    e = wavelet_features(w, levels)
    return [(c, k, rate / 2 ** (k + 1 + 1), float(e[c, k] / max(1e-300, e.sum()))) for c in range(len(e)) for k in range(levels)]


def wavelet_scores(x: np.ndarray, template: np.ndarray, starts: np.ndarray, levels: int = 5) -> np.ndarray:
    """Correlation of the windows' wavelet details with the template's, weighted by the template's energy."""
    width = template.shape[1]
    mine = np.stack([np.stack(a_trous(c, levels)[1]) for c in template])
    weight = (mine**2).sum(2)
    weight = weight / max(1e-300, weight.sum())
    r = np.zeros(len(starts))
    for trace, shares, own in zip(x, weight, mine, strict=True):
        for share, detail, t in zip(shares, a_trous(trace, levels)[1], unit(own), strict=True):
            windows = np.lib.stride_tricks.sliding_window_view(detail, width)
            for low in range(0, len(starts), WINDOWS):
                r[low : low + WINDOWS] += share * (unit(windows[starts[low : low + WINDOWS]]) @ t)
    return r


def wavelet_matches(x: np.ndarray, template: np.ndarray, threshold: float, levels: int = 5) -> list[tuple[int, float]]:
    """(centre, score) of windows by ``wavelet_scores``."""
    width = template.shape[1]
    starts = candidate_starts(x, width, template)
    if not len(starts):
        return []
    r = wavelet_scores(x, template, starts, levels)
    hit = r >= threshold
    return [(s + width // 2, v) for s, v in merge(starts[hit].tolist(), r[hit].tolist(), width // 2)]


def wavelet_explore(x: np.ndarray, rate: float, sensitivity: float = 0.5, least_s: float = 0.02, gap_s: float = 0.1, top: int = 50, levels: int = 5) -> list[tuple[int, int, float]]:
    """(start, end, peak) of ranges where the channels' detail energy, scaled by each channel's p95, is unusual."""
    drive = np.zeros(x.shape[1])
    for c in x:
        e = np.sqrt(sum(d * d for d in a_trous(c, levels)[1]))
        drive = np.maximum(drive, e / max(1e-12, np.percentile(e, 95)))
    limit = 1 + (1 - sensitivity) * 4
    over = np.flatnonzero(np.diff(np.concatenate([[0], (drive >= limit).astype(int), [0]])))
    runs = [(a, b - 1, float(drive[a:b].max())) for a, b in over.reshape(-1, 2).tolist() if b - a >= least_s * rate]
    merged: list[tuple[int, int, float]] = []
    for a, b, p in runs:
        if merged and a - merged[-1][1] <= gap_s * rate:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), max(p, merged[-1][2]))
        else:
            merged.append((a, b, p))
    return sorted(sorted(merged, key=lambda r: (-r[2], r[0]))[:top])


def reduction_candidates(artifact: np.ndarray, half: int, top: int) -> list[tuple[int, int, float]]:
    """(channel, sample, window rms): one candidate a channel where the artifact is largest, the strongest ``top``."""
    out = []
    for c, a in enumerate(artifact):
        p = int(np.argmax(np.abs(a)))
        w = a[max(0, p - half) : p + half + 1]
        out.append((c, p, float(np.sqrt((w * w).mean()))))
    return sorted(out, key=lambda r: (-r[2], r[0]))[:top]


def cleaning_preview(before: np.ndarray, after: np.ndarray) -> dict[str, float]:
    removed = before - after
    peak = np.abs(before).max(initial=0)
    r = np.corrcoef(before.ravel(), after.ravel())[0, 1] if before.size > 1 and before.std() > 1e-12 and after.std() > 1e-12 else 1.0
    return {"variance_retained": float(after.var() / max(1e-300, before.var())), "r": float(r), "removed_rms": float(np.sqrt((removed**2).mean())), "peak_reduction": float(1 - np.abs(after).max(initial=0) / peak) if peak > 1e-12 else 0.0}


def channel_goodness(x: np.ndarray, levels: int = 5) -> np.ndarray:
    """0.46 energy (2, 8) + 0.30 burst (2, 8) + 0.24 peak (2.5, 9): upper scores of ratios to the medians across channels."""
    rows = []
    for c in x:
        d = np.stack(a_trous(c, levels)[1])
        e = np.sqrt((d**2).sum(0))
        rows.append((float((e**2).mean()), float(np.percentile(e, 99)), float(np.abs(c).max(initial=0))))
    v = np.array(rows)
    ratio = v / np.maximum(np.median(v, 0), 1e-9)
    green, red = np.array([2, 2, 2.5]), np.array([8, 8, 9])
    return np.clip(1 - (ratio - green) / (red - green), 0, 1) @ np.array([0.46, 0.30, 0.24])
