"""Independent components: rules by moments, fit, clean, features of a classifier."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np

from voltlake.functions.dsp import hamming, symmetric_eigen

#: The classes of components.
LABELS = ("Brain", "Muscle", "Eye", "Heart", "Line Noise", "Channel Noise", "Other")


def _orthogonal(w: np.ndarray) -> np.ndarray:
    v, e = np.linalg.eigh(w @ w.T)
    return (e / np.sqrt(np.maximum(v, 1e-12))) @ e.T @ w


def _start(k: int) -> np.ndarray:
    return _orthogonal(np.random.default_rng(7).standard_normal((k, k)))


@dataclass
class Moments:
    """Means over samples of what the rules need, for whitened samples z and components y = w z."""

    tanh_z: np.ndarray  # tanh(y) z', k x k
    slope: np.ndarray  # 1 - tanh(y)^2, k
    tanh_y: np.ndarray  # tanh(y) y, k
    fourth: np.ndarray  # y^4, k
    second: np.ndarray  # y^2, k
    log_cosh: np.ndarray  # log cosh(y), k

    def flat(self) -> np.ndarray:
        return np.concatenate([self.tanh_z.ravel(), self.slope, self.tanh_y, self.fourth, self.second, self.log_cosh])

    @staticmethod
    def of(flat: np.ndarray, k: int) -> Moments:
        rest = flat[k * k :].reshape(5, k)
        return Moments(flat[: k * k].reshape(k, k), *rest)


def moment_sums(w: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sums of the moments over the samples of z (k x n); sums of parts add up."""
    y = w @ z
    size = np.abs(y)
    e = np.exp(-2 * size)
    t, square = np.copysign((1 - e) / (1 + e), y), y * y
    return Moments(t @ z.T, (1 - t * t).sum(1), (t * y).sum(1), (square * square).sum(1), square.sum(1), (size + np.log(1 + e)).sum(1) - np.log(2) * y.shape[1]).flat()


def fast_step(w: np.ndarray, m: Moments, step: int) -> tuple[np.ndarray, float]:
    """Symmetric fixed-point step; the change is how far components turn."""
    new = _orthogonal(m.tanh_z - m.slope[:, None] * w)
    return new, float(np.abs(np.abs((new * w).sum(1)) - 1).max())


def infomax_step(w: np.ndarray, m: Moments, step: int) -> tuple[np.ndarray, float]:
    """Extended natural-gradient rule with the sign of each component's kurtosis."""
    sign = np.sign(m.fourth / np.maximum(m.second, 1e-12) ** 2 - 3)
    g = np.eye(len(w)) - sign[:, None] * (m.tanh_z @ w.T) - w @ w.T
    return w + 0.1 / (1 + step / 100) * g @ w, float(np.abs(g).max())


#: A fit asks for the moments of one matrix after the other and returns the last.
Fit = Generator[np.ndarray, Moments, np.ndarray]


def stepwise(rule: Callable[[np.ndarray, Moments, int], tuple[np.ndarray, float]]) -> Callable[[np.ndarray, int | None, float], Fit]:
    """The fit of a rule that goes one step a round, up to ``most`` rounds."""

    def fit_(w: np.ndarray, most: int | None, enough: float) -> Fit:
        for step in itertools.count() if most is None else range(most):
            w, change = rule(w, (yield w), step)
            if change < enough:
                break
        return w

    return fit_


#: Mean log cosh of a normal variable.
NORMAL = 0.374567207491438


def _turned(angles: np.ndarray) -> np.ndarray:
    """The rotation exp(angles) of an antisymmetric matrix."""
    values, vectors = np.linalg.eigh(1j * angles)
    return np.real((vectors * np.exp(-1j * values)) @ vectors.conj().T)


def picard(w: np.ndarray, most: int | None, enough: float, memory: int = 10) -> Fit:
    """Rotations that take the components' mean log cosh as far from a normal variable's as they can, each by its own side.

    Quasi-Newton steps of limited memory over a block-diagonal Hessian, along which the sum of distances must grow by a share of what
    the gradient says (a quarter of the step if not). So the fit ends: where the gradient's largest element is under ``enough``, or where no step
    is left that double precision can tell from none.
    """
    steps: list[tuple[np.ndarray, np.ndarray]] = []

    def seen(w: np.ndarray, m: Moments) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Sides, what is left to lose, its gradient by rotations and the Hessian's diagonal."""
        side = np.where(m.log_cosh > NORMAL, -1.0, 1.0)
        near = side * (m.slope - m.tanh_y)
        return side, float((side * (m.log_cosh - NORMAL)).sum()), _anti(side, w, m), np.maximum(np.abs(near[:, None] + near) / 2, 0.03)

    m = yield w
    asked = 1
    side, loss, g, curve = seen(w, m)
    while np.abs(g).max(initial=0) >= enough:
        p, shares = g, []
        for s, y in reversed(steps):
            shares.append((s * p).sum() / (s * y).sum())
            p = p - shares[-1] * y
        p = p / curve
        for (s, y), share in zip(steps, reversed(shares), strict=True):
            p = p + (share - (y * p).sum() / (s * y).sum()) * s
        if (g * p).sum() <= 0:
            steps, p = [], g / curve
        slope, length = -(g * p).sum(), min(1.0, 0.5 / np.abs(p).max())
        for _ in range(12):
            if most is not None and asked >= most:
                return w
            new = _orthogonal(_turned(-length * p) @ w)
            m = yield new
            asked += 1
            found = seen(new, m)
            # losses that double precision can't tell apart: the gradient must fall instead
            if found[1] <= loss + 1e-4 * length * slope or (abs(found[1] - loss) <= 1e-13 * len(w) and np.abs(found[2]).max() < 0.9 * np.abs(g).max()):
                break
            length /= 4
        else:
            if not steps:
                return w
            steps = []
            continue
        s, y = -length * p, _anti(side, new, m) - g
        steps = [*steps, (s, y)][-memory:] if (s * y).sum() > 1e-12 * (s * s).sum() else steps
        if (found[0] != side).any():
            steps = []
        w, (side, loss, g, curve) = new, found
    return w


def _anti(side: np.ndarray, w: np.ndarray, m: Moments) -> np.ndarray:
    g = side[:, None] * (m.tanh_z @ w.T)
    return (g - g.T) / 2


#: Fit, most rounds (None: until it converges) and the change at which it ends.
RULES = {"picard": (picard, None, 1e-7), "fastica": (stepwise(fast_step), 200, 1e-7), "infomax": (stepwise(infomax_step), 300, 1e-6)}


def whitening(covariance: np.ndarray, variance: float) -> np.ndarray:
    """Rows that give uncorrelated components of unit variance, as many as ``variance`` asks for."""
    values, vectors = symmetric_eigen(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values > 1e-6 * max(values[0], 1e-300)
    k = min(int(keep.sum()), int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), variance)) + 1)
    return (vectors[:, :k] / np.sqrt(values[:k])).T


def ordered(w: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> dict:
    """A model with components by falling contribution, their largest weight positive."""
    mixing = np.linalg.pinv(w)
    power = (mixing**2).sum(0) * np.einsum("ki,ij,kj->k", w, covariance, w)
    order = np.argsort(-power, kind="stable")
    w, mixing, power = w[order], mixing[:, order], power[order]
    sign = np.sign(mixing[np.abs(mixing).argmax(0), np.arange(mixing.shape[1])])
    return {"unmixing": w * sign[:, None], "mixing": mixing * sign, "mean": mean, "contribution": power / max(power.sum(), 1e-300)}


def solved(method: str, z: np.ndarray, most: int | None = None, enough: float | None = None, piece: int = 4_096) -> np.ndarray:
    """The matrix that a method comes to on whitened samples (k x n) held in memory."""
    rule = RULES[method]
    going = rule[0](_start(len(z)), rule[1] if most is None else most, rule[2] if enough is None else enough)
    try:
        w = next(going)
        while True:
            total = sum(moment_sums(w, z[:, at : at + piece]) for at in range(0, max(z.shape[1], 1), piece))
            w = going.send(Moments.of(total / max(1, z.shape[1]), len(z)))
    except StopIteration as end:
        return end.value


def fit(x: np.ndarray, method: str = "picard", variance: float = 0.999, every: int = 1, average_reference: bool = False, most: int | None = None, enough: float | None = None) -> dict:
    """Unmixing and mixing matrices of channels x samples held in memory; ``operators.components.fit_components`` fits tables. Deterministic: fixed start. ``most`` rounds and ``enough`` are the method's own unless given."""
    data = np.asarray(x, float)[:, ::every]
    if average_reference:
        data = data - data.mean(0)
    mean = data.mean(1, keepdims=True)
    data = data - mean
    covariance = data @ data.T / max(1, data.shape[1] - 1)
    whiten = whitening(covariance, variance)
    z = whiten @ data
    w = solved(method, z, most, enough) if len(z) else np.zeros((0, 0))
    return ordered(w @ whiten, mean[:, 0], covariance)


def clean(x: np.ndarray, model: dict, components: list[int], block: int = 32_768, clip: bool = True) -> np.ndarray:
    """Less the chosen components, by blocks; the removed part is clamped to 20 times its p99, within 500 and 5000."""
    if not components:
        return np.array(x, float)
    w, m = model["unmixing"][components], model["mixing"][:, components]
    out = np.array(x, float)
    artifact = m @ (w @ (out[:, :block] - model["mean"][:, None]))
    limit = float(np.clip(20 * np.percentile(np.abs(artifact), 99), 500, 5_000)) if artifact.size else 5_000.0
    for s in range(0, out.shape[1], block):
        part = m @ (w @ (out[:, s : s + block] - model["mean"][:, None]))
        out[:, s : s + block] -= np.clip(part, -limit, limit) if clip else part
    return out


def features(source: np.ndarray, weights: np.ndarray, positions: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Inputs of a component classifier: a 32 x 32 inverse-distance map, 100 spectral bins in dB, 100 lags of autocorrelation."""
    axis = np.linspace(-1, 1, 32)
    gx, gy = np.meshgrid(axis, axis)
    d = np.hypot(gx[..., None] - positions[:, 0], gy[..., None] - positions[:, 1]).clip(1e-6) ** -3
    image = np.where(np.hypot(gx, gy) <= 1, (d @ weights) / d.sum(-1), 0)
    image = image / max(1e-12, np.abs(image).max())
    n = min(len(source), int(rate)) // 2 * 2
    window = hamming(n)
    pieces = [np.abs(np.fft.rfft(source[s : s + n] * window)) ** 2 for s in range(0, len(source) - n + 1, max(1, n // 2))]
    psd = np.median(pieces, 0) if pieces else np.zeros(n // 2 + 1)
    bins = np.interp(np.arange(1, 101), np.arange(len(psd)) * rate / max(n, 1), psd)
    db = 10 * np.log10(np.maximum(bins, 1e-12))
    s = source - source.mean()
    full = np.fft.irfft(np.abs(np.fft.rfft(s, 2 * len(s))) ** 2)[: len(s)]
    full = full / max(full[0], 1e-300)
    lags = np.interp(np.linspace(0, 1, 101)[1:], np.arange(len(full)) / rate, full)
    return {"map": image, "psd": db / max(1e-12, np.abs(db).max()), "autocorrelation": lags}


def classify(batch: list[dict[str, np.ndarray]], network) -> np.ndarray:
    """Class probabilities by a pluggable network (map, psd, autocorrelation -> 7), averaged over flips and negations of the map."""
    out = []
    for f in batch:
        views = [f["map"], -f["map"], f["map"][:, ::-1], -f["map"][:, ::-1]]
        out.append(np.mean([network(v, f["psd"], f["autocorrelation"]) for v in views], 0))
    return np.array(out)
