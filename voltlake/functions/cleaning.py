"""Artifact removal on channel matrices (channels x samples): templates, OBS, SSP, MR-gradient correction."""

from __future__ import annotations

import numpy as np

from voltlake.functions.dsp import band_pass, convolve_same, decimate, interpolate, lms, pca, raised_cosine_edges, symmetric_eigen, windowed_sinc


def event_starts(times: np.ndarray, rate: float, width: int, n: int) -> np.ndarray:
    """First samples of half-open windows around the times; those that leave the recording go."""
    s = np.floor(np.asarray(times, float) * rate + 0.5).astype(int) - width // 2
    return s[(s >= 0) & (s + width <= n)]


def evenly(items: np.ndarray, cap: int) -> np.ndarray:
    return items if len(items) <= cap else items[(np.arange(cap) * len(items)) // cap]


def boundary_line(x: np.ndarray) -> np.ndarray:
    """The line through a window's first and last value."""
    return np.linspace(x[..., 0], x[..., -1], x.shape[-1], axis=-1)


def template_removed(x: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Per channel: each event less its projection on the unit mean template, after removing the boundary line."""
    out = x.copy()
    if not len(starts):
        return out
    for c in range(len(x)):
        w = np.stack([x[c, s : s + width] for s in starts])
        w = w - boundary_line(w)
        t = w.mean(0)
        e = t @ t
        if e <= 1e-18:
            continue
        for s, row in zip(starts, w, strict=True):
            out[c, s : s + width] -= (row @ t) / e * t
    return out


def obs_removed(x: np.ndarray, starts: np.ndarray, width: int, components: int = 3, cap: int = 80, ridge: float = 1e-6) -> np.ndarray:
    """Optimal basis set: mean and leading components of at most ``cap`` evenly spaced windows, ridge-fitted, tapered, overlap-added."""
    out, total, weight = x.copy(), np.zeros_like(x), np.zeros(x.shape[1])
    if not len(starts):
        return out
    taper = raised_cosine_edges(width, max(1, width // 10))
    for s in starts:
        weight[s : s + width] += taper
    for c in range(len(x)):
        used = np.stack([x[c, s : s + width] for s in evenly(starts, cap)])
        used = used - boundary_line(used)
        basis = [used.mean(0)] + list(pca(used)[0][:components])
        b = np.stack([v / max(1e-12, np.linalg.norm(v)) for v in basis], 1)
        gram = b.T @ b + ridge * np.eye(b.shape[1])
        for s in starts:
            w = x[c, s : s + width]
            w = w - boundary_line(w)
            total[c, s : s + width] += taper * (b @ np.linalg.solve(gram, b.T @ w))
    return out - total / np.maximum(weight, 1.0)


def ssp_removed(x: np.ndarray, starts: np.ndarray, width: int, components: int = 2, per_window: int = 16) -> np.ndarray:
    """Spatial projection: the leading components of re-centred maps at events are projected out of every sample."""
    if not len(starts):
        return x.copy()
    at = np.unique(np.concatenate([s + evenly(np.arange(width), per_window) for s in starts]))
    maps = x[:, at] - x[:, at].mean(0)
    _, v = symmetric_eigen(maps @ maps.T / len(at))
    u = v[:, ::-1][:, :components]
    return x - u @ (u.T @ x)


def obs_variance(x: np.ndarray, starts: np.ndarray, width: int, most: int = 10) -> list[tuple[int, float, float, float]]:
    """(component, explained, cumulative, remaining) in percent, pooled over channels."""
    total = np.zeros(0)
    for c in x:
        w = np.stack([c[s : s + width] for s in starts]) if len(starts) else np.zeros((0, width))
        if len(w) > 1:
            w = w - w.mean(0)
            values = np.sort(np.maximum(np.linalg.eigvalsh(w @ w.T), 0))[::-1][:most]
            total = np.pad(total, (0, max(0, len(values) - len(total))))
            total[: len(values)] += values
    share = 100 * total / max(1e-300, total.sum())
    return [(k + 1, float(s), float(c), float(100 - c)) for k, (s, c) in enumerate(zip(share, np.cumsum(share), strict=True))]


def auto_components(variance: np.ndarray) -> int:
    """Mean of three rules: 80 % cumulative, at least 5 % each, and where the slope flattens."""
    if not len(variance):
        return 0
    by_sum = int(np.searchsorted(np.cumsum(variance), 80.0)) + 1
    by_share = int((variance >= 5).sum())
    drops = -np.diff(variance)
    by_slope = int(np.argmax(drops < 0.1 * max(drops.max(initial=0), 1e-12))) if len(drops) else 1
    return int(min(len(variance), max(1, round((by_sum + by_share + by_slope) / 3))))


def moosmann_neighbours(motion_distance: np.ndarray, k: int) -> list[np.ndarray]:
    """For each volume, the k others with the least accumulated motion between."""
    path = np.concatenate([[0.0], np.cumsum(motion_distance[1:])])
    n = len(path)
    return [np.array(sorted((j for j in range(n) if j != i), key=lambda j: (abs(path[j] - path[i]), abs(j - i), j))[:k]) for i in range(n)]


def fastr(x: np.ndarray, rate: float, starts: np.ndarray, spacing: int, factor: int = 10, window: int = 20, scheme: str = "neighbour", excluded: frozenset[int] = frozenset(), obs: int | None = None, anc: bool = False, low_pass: float | None = 70.0, motion: np.ndarray | None = None, search: int = 100) -> np.ndarray:
    """MR-gradient correction by upsampled, aligned average templates; alignment is found on channel 0 and used for all.

    Schemes: neighbour (volumes within half a window), farm (most correlated ones
    with |r| >= 0.9), moosmann (least motion between). Excluded volumes give no
    template but are corrected; missing donors are topped up from the nearest
    ones. OBS on the residual, low-pass and adaptive noise cancelling are optional.
    """
    out = np.array(x, float)
    n = len(starts)
    if n < 3 or spacing < 4:
        return out
    up_len, half = spacing * factor, window // 2

    def cut(u: np.ndarray, s: int) -> np.ndarray:
        s = min(max(s, 0), len(u) - up_len)
        return u[s : s + up_len]

    first = interpolate(out[0], factor)
    reference = cut(first, starts[n // 2] * factor)
    shifts = []
    for s in starts:
        scores = [(float(np.dot(cut(first, s * factor + k) - cut(first, s * factor + k).mean(), reference - reference.mean())), -abs(k), k) for k in range(-factor, factor + 1)]
        shifts.append(max(scores)[2])
    donors: list[np.ndarray] = []
    good = [i for i in range(n) if i not in excluded]
    epochs0 = np.stack([cut(first, s * factor + k) for s, k in zip(starts, shifts, strict=True)])
    z = epochs0 - epochs0.mean(1, keepdims=True)
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    near = moosmann_neighbours(motion if motion is not None else np.zeros(n), window) if scheme == "moosmann" else None
    for i in range(n):
        if scheme == "farm":
            r = z @ z[i]
            chosen = [j for j in sorted(good, key=lambda j: -abs(r[j])) if j != i and abs(j - i) <= search and abs(r[j]) >= 0.9][:window]
        elif near is not None:
            chosen = [j for j in near[i].tolist() if j in good]
        else:
            chosen = [j for j in good if j != i and abs(j - i) <= half]
        if len(chosen) < min(3, len(good)):
            chosen = sorted((j for j in good if j != i), key=lambda j: (abs(j - i), j))[: max(3, half)]
        donors.append(np.array(chosen, int))
    for c in range(len(out)):
        u = interpolate(out[c], factor)
        epochs = np.stack([cut(u, s * factor + k) for s, k in zip(starts, shifts, strict=True)])
        centred = epochs - epochs.mean(1, keepdims=True)
        noise = np.zeros(len(u))
        for i, (s, k) in enumerate(zip(starts, shifts, strict=True)):
            if not len(donors[i]):
                continue
            t = centred[donors[i]].mean(0)
            fit = (centred[i] @ t) / max(1e-18, t @ t) * t
            at = min(max(s * factor + k, 0), len(u) - up_len)
            noise[at : at + up_len] = fit
        residual = u - noise
        if obs:
            left = np.stack([cut(residual, s * factor + k) for s, k in zip(starts, shifts, strict=True)])
            basis, variance = pca(left[:: 2 if n < 60 else 3])
            count = auto_components(variance) if obs < 0 else obs
            b = np.stack([v / max(1e-12, np.linalg.norm(v)) for v in basis[:count]])
            for s, k, e in zip(starts, shifts, left, strict=True):
                at = min(max(s * factor + k, 0), len(u) - up_len)
                residual[at : at + up_len] -= b.T @ (b @ (e - e.mean()))
        y = decimate(residual, factor)[: out.shape[1]]
        if low_pass and low_pass < rate / 2:
            y = convolve_same(windowed_sinc(2 * int(rate / low_pass * 2) + 1, low_pass / (rate / 2)), y)
        if anc:
            ref = decimate(noise, factor)[: len(y)]
            high = band_pass(y, rate, 2.0, slope=12)
            alpha = (high @ ref) / max(1e-18, ref @ ref)
            ref = alpha * ref
            mu = 0.05 / max(1e-18, spacing * np.var(ref))
            cancelled = y - lms(ref, high, min(spacing, 60), mu)
            y = cancelled if np.isfinite(cancelled).all() else y
        out[c] = y
    return out
