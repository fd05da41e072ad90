"""Wavelet transforms and threshold reduction on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Scaling filters of public wavelet families.
SCALING = {
    "db4": (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278),
    "coif4": (
        -1.7849850030882614e-06, -3.2596802368833675e-06, 3.1229875865345646e-05, 6.233903446100713e-05, -0.00025997455248771324, -0.0005890207562443383,
        0.0012665619292980445, 0.003751436157278457, -0.00565828668661072, -0.015211731527946259, 0.025082261844864097, 0.03933442712333749,
        -0.09622044203398833, -0.06662747426342504, 0.4343860564914685, 0.7822389309206135, 0.41530840703043026, -0.05607731331675481,
        -0.08126669968087875, 0.026682300156053072, 0.016068943964776348, -0.0073461663276420935, -0.0016294920126017326, 0.0008923136685823146,
    ),
    "sym4": (0.032223100604042702, -0.012603967262037833, -0.099219543576847216, 0.29785779560527736, 0.80373875180591614, 0.49761866763201545, -0.02963552764599851, -0.075765714789273325),
}


def filters(name: str) -> tuple[np.ndarray, np.ndarray]:
    h = np.array(SCALING[name])
    h = h / np.linalg.norm(h)
    return h, h[::-1] * (-1.0) ** np.arange(len(h))


def _padded(x: np.ndarray, levels: int) -> np.ndarray:
    block = 1 << levels
    extra = -len(x) % block
    return np.concatenate([x, x[::-1][:extra]]) if extra else x


def dwt(x: np.ndarray, name: str, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Periodic transform: approximation and details, finest first. The input is reflected to a multiple of 2^levels."""
    h, g = filters(name)
    a, details = _padded(np.asarray(x, float), levels), []
    for _ in range(levels):
        at = (2 * np.arange(len(a) // 2)[:, None] + np.arange(len(h))) % len(a)
        a, d = a[at] @ h, a[at] @ g
        details.append(d)
    return a, details


def idwt(a: np.ndarray, details: list[np.ndarray], name: str, n: int) -> np.ndarray:
    h, g = filters(name)
    for d in reversed(details):
        out = np.zeros(2 * len(d))
        at = (2 * np.arange(len(d))[:, None] + np.arange(len(h))) % len(out)
        np.add.at(out, at, a[:, None] * h + d[:, None] * g)
        a = out
    return a[:n]


def swt(x: np.ndarray, name: str, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Stationary transform with dilated filters, periodic."""
    h, g = filters(name)
    a, details = np.asarray(x, float), []
    for level in range(levels):
        at = (np.arange(len(a))[:, None] + np.arange(len(h)) * 2**level) % len(a)
        a, d = a[at] @ h, a[at] @ g
        details.append(d)
    return a, details


def iswt(a: np.ndarray, details: list[np.ndarray], name: str) -> np.ndarray:
    h, g = filters(name)
    for level in reversed(range(len(details))):
        out = np.zeros(len(a))
        at = (np.arange(len(a))[:, None] + np.arange(len(h)) * 2**level) % len(a)
        np.add.at(out, at, 0.5 * (a[:, None] * h + details[level][:, None] * g))
        a = out
    return a


def threshold(d: np.ndarray, rule: str, sigma: float) -> float:
    if rule == "universal":
        return sigma * np.sqrt(2 * np.log(max(2, len(d))))
    signal = np.sqrt(max(float(d @ d) / max(1, len(d)) - sigma**2, 0))
    return sigma**2 / signal if signal > 1e-12 else float(np.abs(d).max(initial=0))


def large_part(d: np.ndarray, limit: float, hard: bool) -> np.ndarray:
    return np.where(np.abs(d) > limit, d if hard else np.sign(d) * (np.abs(d) - limit), 0.0)


def reduce(x: np.ndarray, name: str = "db4", levels: int = 5, rule: str = "universal", hard: bool = False, stationary: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(cleaned, artifact): the artifact is the approximation band and the large details, so the slow band goes as well."""
    a, details = (swt if stationary else dwt)(np.pad(x, (0, 0)), name, levels)
    sigma = float(np.median(np.abs(details[0])) / 0.6745) if len(details[0]) else 0.0
    big = [large_part(d, threshold(d, rule, sigma), hard) for d in details]
    artifact = iswt(a, big, name) if stationary else idwt(a, big, name, len(x))
    return x - artifact, artifact


def a_trous(x: np.ndarray, levels: int, kernel: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Detector's transform: smoothing with a dilated kernel of sum 1 and clamped edges; details are the differences."""
    kernel = np.array([1, 4, 6, 4, 1]) / 16 if kernel is None else kernel / kernel.sum()
    a, details, half = np.asarray(x, float), [], len(kernel) // 2
    for level in range(levels):
        at = np.clip(np.arange(len(a))[:, None] + (np.arange(len(kernel)) - half) * 2**level, 0, len(a) - 1)
        smooth = a[at] @ kernel
        details.append(a - smooth)
        a = smooth
    return a, details
