"""Components of recordings in blocks: the fit against the one in memory, labels, removal, odd recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_blocks import long, traces_of
from voltlake.functions import ica
from voltlake.operators import components as comp


def mixed(n=3_000, seed=5):
    t = np.arange(n) / 200
    s = np.stack([np.sin(2 * np.pi * 3 * t), 2 * (t * 1.3 % 1) - 1, np.sign(np.sin(2 * np.pi * 0.7 * t))])
    rng = np.random.default_rng(seed)
    return rng.standard_normal((4, 3)) @ s + 1e-3 * rng.standard_normal((4, n)) + np.arange(4)[:, None]


@pytest.mark.parametrize("method", ["picard", "fastica", "infomax"])
def test_fit_over_blocks_equals_fit_in_memory(spark, method):
    x, y = mixed(), mixed(2_000, 8) * 3
    df = long(spark, dict(enumerate(x))).unionByName(long(spark, dict(enumerate(y)), "b"))
    rows = comp.fit_components(df, method, 0.99999, size=512, rounds=ica.RULES[method][1], tolerance=ica.RULES[method][2]).orderBy("recording_id", "component").collect()
    for name, data in (("a", x), ("b", y)):
        want, got = ica.fit(data, method, 0.99999), [r for r in rows if r.recording_id == name]
        assert len(got) == 3
        assert np.allclose([r.unmixing for r in got], want["unmixing"], atol=1e-4 * np.abs(want["unmixing"]).max())
        assert np.allclose(np.array([r.mixing for r in got]).T, want["mixing"], atol=1e-3) and np.allclose(got[0].means, want["mean"])


def test_sources_and_removal(spark):
    x = mixed()
    df = long(spark, dict(enumerate(x))).unionByName(long(spark, {0: x[0]}, "flat").withColumn("value", F.lit(1.0)))
    models = comp.fit_components(df, "fastica", 0.99999, size=700)
    assert {r.recording_id for r in models.collect()} == {"a"}  # constant channels have no components
    sources = comp.component_sources(df, models, 700)
    found = np.array([[r.value for r in sources.where(F.col("component") == k).orderBy("sample_index").collect()] for k in range(3)])
    m = ica.fit(x, "fastica", 0.99999)
    assert np.allclose(found, m["unmixing"] @ (x - m["mean"][:, None]), atol=1e-3)
    for clip in (True, False):
        left = comp.without_components(df, models, models.where("component = 0"), 32_768, clip)
        got = np.stack(list(traces_of(left).values()))
        assert np.allclose(got, ica.clean(x, m, [0], clip=clip), atol=1e-2) and left.count() == df.count()
    assert set(traces_of(left, "flat")[0]) == {1.0}


def test_odd_recordings(spark):
    x = mixed(600)
    gap = long(spark, dict(enumerate(x))).where("NOT (channel_index = 2 AND sample_index >= 512)")
    models = comp.fit_components(gap, "fastica", 0.99999, size=256)
    want = ica.fit(x[:, :512], "fastica", 0.99999)
    assert np.allclose([r.unmixing for r in models.orderBy("component").collect()], want["unmixing"], atol=1e-3)  # the block that lacks a channel is left out
    assert comp.component_sources(gap, models, 256).agg(F.max("sample_index")).first()[0] == 511
    assert comp.without_components(gap, models, models.where("component = 0"), 256).count() == gap.count()
    assert comp.fit_components(gap.where("false")).count() == 0
    alone = gap.drop("recording_id")
    assert comp.fit_components(alone, "fastica", 0.99999, size=256).where("recording_id IS NULL").count() == models.count()


def test_labels(spark):
    rng = np.random.default_rng(11)
    k = np.arange(64)
    layout = np.stack([np.cos(2 * np.pi * k * 0.618) * np.sqrt(k / 64), np.sin(2 * np.pi * k * 0.618) * np.sqrt(k / 64)], 1)
    t = np.arange(5_000) / 250
    maps = {"dipole": layout[:, 0] + 0.3 * layout[:, 1], "frontal": np.maximum(layout[:, 1] - 0.3, 0), "focal": np.where(k < 2, 1.0, 0.02), "rim": np.where(np.hypot(*layout.T) > 0.8, (-1.0) ** k, 0.05), "broad": np.exp(-2 * (layout**2).sum(1))}
    slow = np.convolve(rng.standard_normal(5_000), np.ones(250) / 250, "same")
    pink = np.cumsum(rng.standard_normal(5_000))
    pink = pink - np.convolve(pink, np.ones(500) / 500, "same") + 12 * np.sin(2 * np.pi * 10 * t)
    heart = np.convolve((np.arange(5_000) % 225 == 0).astype(float), np.hanning(25), "same") + 0.02 * rng.standard_normal(5_000)
    cases = {"Brain": (pink, "dipole"), "Eye": (slow, "frontal"), "Channel Noise": (rng.standard_normal(5_000), "focal"), "Line Noise": (np.sin(2 * np.pi * 60 * t) + 0.05 * rng.standard_normal(5_000), "broad"), "Heart": (heart, "dipole"), "Muscle": (rng.standard_normal(5_000), "rim"), "Other": (rng.standard_normal(5_000), "broad")}
    x, a = np.stack([c / c.std() for c, _ in cases.values()]), np.stack([maps[m] for _, m in cases.values()], 1)
    df = long(spark, dict(enumerate(x)))  # a component a channel, so that labels are tested alone
    rows = [("a", c, 1.0, a[:, c].tolist(), [float(c == i) for i in range(len(x))], [0.0] * len(x), list(range(len(x)))) for c in range(len(x))]
    models = spark.createDataFrame(rows, comp.MODEL)
    places = spark.createDataFrame([(int(c), float(p), float(q)) for c, (p, q) in enumerate(layout)], "channel_index int, x double, y double")
    wide = models.withColumn("channels", F.sequence(F.lit(0), F.lit(63)))
    traits = comp.source_traits(comp.source_sums(df, models, 250.0, 512)).toPandas().set_index("component")
    assert traits["line"][3] > 0.95 and traits["pulses"][4] > 0.4 and traits["slow"][1] > 0.75 and traits["fast"][2] > 0.8
    spots = {r.component: r for r in comp.map_traits(wide, places).collect()}
    assert spots[0].dipole > 0.95 and spots[2].focal > 0.6 and spots[1].front > 0.5 and spots[5].rim > 0.9
    joined = comp.classed(models.join(comp.source_traits(comp.source_sums(df, models, 250.0, 512)), ["recording_id", "component"]).join(comp.map_traits(wide, places), ["recording_id", "component"]))
    got = {r.component: r for r in joined.collect()}
    assert [got[c].label for c in range(len(cases))] == list(cases)
    assert all(0 < r.score <= 1 for r in got.values()) and set(comp.WEIGHTS) == set(ica.LABELS)
    bare = comp.label_components(df, models, places.where("false"), 250.0).collect()
    assert len(bare) == len(cases) and all(r.dipole == 0 and r.label in ica.LABELS for r in bare)
