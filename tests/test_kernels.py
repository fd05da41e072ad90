"""Kernels on generated signals: exact inverses, known answers, recovered plants."""

import numpy as np
import pytest

from voltlake.functions import cardiac, cleaning, dsp, ica, templates, wavelets


def noise(n, seed=1, scale=1.0):
    return np.random.default_rng(seed).standard_normal(n) * scale


def bump(width, peak=80.0):
    return peak * np.exp(-0.5 * ((np.arange(width) - width / 2) / (width / 6)) ** 2)


def sine(f, fs, n, a=20.0):
    return a * np.sin(2 * np.pi * f * np.arange(n) / fs)


def test_band_pass_keeps_the_band_and_removes_the_rest():
    x = sine(10, 250, 2500) + sine(60, 250, 2500) + 30
    y = dsp.band_pass(x, 250, high=1.0, low=40.0, slope=48)
    mid = slice(500, 2000)
    assert np.abs(y[mid] - sine(10, 250, 2500)[mid]).max() < 1.0
    z = dsp.band_pass(x, 250, notch=60.0)
    assert np.abs((z - sine(10, 250, 2500) - 30)[mid]).max() < 1.5


def test_blockwise_recursion_equals_the_plain_one():
    b, a = dsp.biquad("high", 1.0, 250, 0.7)
    x, y, s1, s2 = noise((700, 3)), np.zeros((700, 3)), 0.0, 0.0
    for n, v in enumerate(x):
        y[n] = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * y[n] + s2, b[2] * v - a[2] * y[n]
    assert np.abs(dsp._recursive(b, a, x) - y).max() < 1e-9


def test_band_pass_validates():
    for options in ({"low": 200.0}, {"high": 50.0, "low": 10.0}):
        with pytest.raises(ValueError):
            dsp.band_pass(np.zeros(100), 250, **options)
    with pytest.raises(ValueError):
        dsp.band_pass(np.zeros(100), 0, high=1.0)
    assert (dsp.band_pass(np.arange(6.0), 250, high=1.0) == np.arange(6.0)).all()


def test_line_noise_goes_and_signal_stays():
    x = sine(10, 250, 5000) + sine(60, 250, 5000, 15)
    y = dsp.line_noise_reduced(x, 250)
    assert ((y - sine(10, 250, 5000)) ** 2).mean() < 0.05 * (15**2 / 2)


def test_fir_tools():
    b = dsp.firls(31, [0, 0.2, 0.3, 1], [1, 1, 0, 0])
    h = np.abs(np.fft.rfft(b, 512))
    assert np.allclose(b, b[::-1]) and abs(h[0] - 1) < 0.02 and h[-1] < 0.02
    assert abs(dsp.windowed_sinc(41, 0.2).sum() - 1) < 1e-12
    x = sine(3, 250, 600)
    assert np.abs(dsp.filtfilt_fir(dsp.windowed_sinc(41, 0.4), x) - x)[50:-50].max() < 0.3
    assert np.abs(dsp.decimate(dsp.interpolate(x, 4), 4) - x)[50:-50].max() < 0.5
    assert np.allclose(dsp.fractional_shift(np.eye(1, 64, 10)[0], 3), np.eye(1, 64, 13)[0], atol=1e-9)


def test_linear_algebra():
    a = np.array([[2.0, 1], [1, 3]])
    assert np.allclose(dsp.solve(a, np.array([3.0, 5])), [0.8, 1.4])
    assert dsp.solve(np.ones((2, 2)), np.ones(2)) is None
    assert (dsp.least_squares(np.ones((4, 2)), np.ones(4)) == 0).all()
    _, share = dsp.pca(np.stack([bump(40), 2 * bump(40), noise(40, 3, 0.01)]))
    assert share[0] > 99
    assert dsp.lms(np.ones(3), np.arange(3.0), 5, 0.1).tolist() == [0, 1, 2]
    ref = noise(4000)
    assert ((3 * ref - dsp.lms(ref, 3 * ref, 4, 0.01))[2000:] ** 2).mean() < 0.01


def test_spline_weights():
    good = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1.0]])
    w = dsp.spline_weights(good, np.array([0.5, 0.5, 0.7]))
    assert abs(w.sum() - 1) < 1e-9
    assert dsp.spline_weights(good[:2], good[3]) is None


@pytest.mark.parametrize("name", sorted(wavelets.SCALING))
@pytest.mark.parametrize("n", [512, 600])
def test_wavelets_reconstruct(name, n):
    x = sine(5, 250, n) + noise(n)
    a, d = wavelets.dwt(x, name, 5)
    assert np.abs(wavelets.idwt(a, d, name, n) - x).max() < 1e-6
    a, d = wavelets.swt(x, name, 4)
    assert np.abs(wavelets.iswt(a, d, name) - x).max() < 1e-6
    cleaned, artifact = wavelets.reduce(x, name)
    assert np.allclose(cleaned + artifact, x)
    a, d = wavelets.a_trous(x, 4)
    assert np.allclose(a + sum(d), x)


def test_wavelet_reduction_removes_spikes():
    x = noise(600)
    spiky = x.copy()
    spiky[::97] += 60
    cleaned, _ = wavelets.reduce(spiky)
    assert np.abs(cleaned).max() < 0.5 * np.abs(spiky).max()
    assert templates.reduction_candidates(np.stack([np.eye(1, 50, 7)[0] * 9, np.eye(1, 50, 20)[0]]), 3, 1) == [(0, 7, pytest.approx(np.sqrt(81 / 7)))]


@pytest.mark.parametrize("algorithm", cardiac.ALGORITHMS)
def test_r_waves(algorithm):
    x = noise(5000, 2, 1.0)
    beats = np.arange(250, 4800, 250)
    for b in beats:
        x[b - 8 : b + 8] += bump(16)
    found = [p for p, _ in cardiac.r_waves(x[None], 250, algorithm)]
    near = [min(abs(p - b) for p in found) for b in beats]
    assert sum(n <= 25 for n in near) >= len(beats) - 2 and len(found) <= len(beats) + 2


@pytest.mark.parametrize("method", ["periodic", "spatial"])
def test_bcg(method):
    x = np.stack([noise(6000, k) for k in range(6)])
    pulses = np.arange(250, 5700, 250)
    for p in pulses:
        x[:, p - 20 : p + 20] += bump(40, 30.0) * np.linspace(0.5, 1, 6)[:, None]
    found = cardiac.bcg_periodic(x, 250) if method == "periodic" else cardiac.bcg_spatial(x, 250)
    assert sum(min(abs(f - p) for f in found) <= 30 for p in pulses) >= 0.8 * len(pulses)
    refined, template = cardiac.bcg_refined(x, 250, found)
    assert sum(min(abs(f - p) for f in refined) <= 30 for p in pulses) >= 0.8 * len(pulses) and template.shape == (6, 174)
    assert cardiac.virtual_ecg(x).max() > 0 and len(cardiac.cardiac_power(x, 250)) == 6000


def test_suppressed_peaks():
    x = np.zeros(120)
    x[[40, 45, 80]] = 10, 12, 9
    assert cardiac.suppressed_peaks(x, 1.0, 20) == [45, 80]


def test_templates_find_planted_bumps():
    x = np.stack([noise(4000, k, 2.0) for k in range(4)])
    places = [300, 900, 1700, 2600, 3500]
    for p in places:
        x[:, p - 20 : p + 20] += bump(40) * np.array([1, 0.8, 0.6, 0.4])[:, None]
    exemplar = x[:, 280:320]
    for match in (templates.waveform_matches, templates.trajectory_matches, templates.wavelet_matches):
        found = [c for c, _ in match(x, exemplar, 0.6)]
        assert sum(any(abs(c - p) <= 12 for c in found) for p in places) >= 4, match.__name__
    assert templates.wavelet_explore(x, 250, 0.9)
    share = sum(s for *_, s in templates.wavelet_summary(exemplar, 250))
    assert abs(share - 1) < 1e-9
    assert templates.scope_counts(x, exemplar, 0.5)[0][1] >= 4
    assert templates.merge([1, 3, 20], [0.5, 0.9, 0.4], 5) == [(3, 0.9), (20, 0.4)]


@pytest.mark.parametrize("method", ["template_removed", "obs_removed", "ssp_removed"])
def test_cleaning_reduces_events(method):
    x = np.stack([noise(3000, k) for k in range(6)])
    clean = x.copy()
    starts = np.arange(100, 2900, 150)
    for s in starts:
        x[:, s : s + 40] += bump(40) * np.linspace(1, -1, 6)[:, None]  # no common mode: maps are re-centred
    y = getattr(cleaning, method)(x, starts, 40)
    assert ((y - clean) ** 2).mean() < 0.3 * ((x - clean) ** 2).mean()
    assert cleaning.event_starts(np.array([0.0, 1.0]), 100, 50, 120).tolist() == []
    assert sum(e for _, e, _, _ in cleaning.obs_variance(x, starts, 40)) == pytest.approx(100)


@pytest.mark.parametrize("scheme", ["neighbour", "farm", "moosmann"])
def test_gradient_correction(scheme):
    n, spacing = 40, 120
    template = 200 * np.sign(np.sin(2 * np.pi * 7 * np.arange(spacing) / spacing)) * np.hanning(spacing)
    brain = sine(10, 1000, n * spacing, 5)
    x = np.stack([brain + np.tile(template, n)])
    y = cleaning.fastr(x, 1000, np.arange(n) * spacing, spacing, 4, scheme=scheme, low_pass=None)
    mid = slice(10 * spacing, 30 * spacing)
    assert ((y - brain)[0, mid] ** 2).mean() < 0.2 * ((x - brain)[0, mid] ** 2).mean()


@pytest.mark.parametrize("method", ["picard", "fastica", "infomax"])
def test_ica(method):
    t = np.arange(2000) / 200
    s = np.stack([np.sin(2 * np.pi * 3 * t), 2 * (t * 1.3 % 1) - 1, np.sign(np.sin(2 * np.pi * 0.7 * t))])
    x = np.random.default_rng(5).standard_normal((4, 3)) @ s + noise((4, 2000), 9, 1e-3)
    m = ica.fit(x, method, 0.99999)
    sources = m["unmixing"] @ (x - m["mean"][:, None])
    best = np.abs(np.corrcoef(np.vstack([s, sources]))[:3, 3:]).max(1)
    assert best.min() > 0.9
    assert np.abs(m["mixing"] @ sources + m["mean"][:, None] - x).max() < 0.05
    assert np.allclose(ica.clean(x, m, []), x)
    assert ((ica.clean(x, m, [0])) ** 2).sum() < (x**2).sum()
    f = ica.features(sources[0], m["mixing"][:, 0], np.array([[0, 1], [1, 0], [0, -1], [-1, 0.0]]), 200)
    assert f["map"].shape == (32, 32) and f["psd"].shape == (100,) and f["autocorrelation"].shape == (100,)
    p = ica.classify([f], lambda image, psd, auto: np.full(7, 1 / 7))
    assert p.shape == (1, 7)


def test_spectra():
    f, p, n = dsp.welch(sine(10, 128, 512), 128, 128)
    assert n == 7 and f[p.argmax()] == 10
    assert dsp.welch(np.full(256, np.nan), 128, 128)[2] == 0
    k = np.arange(1, 200) / 2
    assert dsp.aperiodic_slope(k, k**-1.5) == pytest.approx(-1.5, abs=1e-6)
    assert dsp.aperiodic_slope(k[:2], k[:2]) is None


def test_r_wave_levels():
    from voltlake.functions import cardiac

    z = np.zeros(1000)
    at = np.arange(50, 1000, 100)
    z[at] = 4.0
    z[at + 40] = 0.6
    peaks = cardiac.clustered(z, 20)
    assert sorted(peaks.tolist()) == sorted([*at.tolist(), *(p for p in (at + 40).tolist() if p < 999)])
    assert cardiac.adaptive_picks(z, peaks, 0.9, 0.55) == at.tolist() or set(at) <= set(cardiac.adaptive_picks(z, peaks, 0.9, 0.55))
    x = np.zeros((1, 5000))
    for p in range(100, 5000, 250):
        x[0, p - 8 : p + 8] += 80 * np.hanning(16)
    for algorithm in cardiac.ALGORITHMS:
        found = [p for p, _ in cardiac.r_waves(x + 0.5 * np.random.default_rng(1).standard_normal(x.shape), 250.0, algorithm, threshold=6.0 if algorithm == "simple" else 2.0)]
        assert len(found) >= 18 and all(min(abs(p - q) for q in range(100, 5000, 250)) <= 25 for p in found), algorithm
    assert cardiac.r_waves(np.zeros((1, 5)), 250.0) == []
