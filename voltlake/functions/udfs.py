"""Kernels on one trace as SQL functions: ``register(spark)``, then ``SELECT band_pass(values, 250.0, 1.0, 40.0) FROM traces``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def _each(kernel, values: pd.Series, *rest: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.asarray(kernel(np.asarray(v, float), *map(float, r))).tolist() for v, *r in zip(values, *rest, strict=True)], dtype=object)


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for SQL; their names. Null traces give null."""
    from voltlake.functions import cardiac, dsp, wavelets

    @pandas_udf("array<double>")
    def band_pass(values: pd.Series, rate: pd.Series, low_cut: pd.Series, high_cut: pd.Series) -> pd.Series:
        return _each(lambda x, r, a, b: dsp.band_pass(x, r, high=a, low=b), values, rate, low_cut, high_cut)

    @pandas_udf("array<double>")
    def line_noise_reduced(values: pd.Series, rate: pd.Series) -> pd.Series:
        return _each(dsp.line_noise_reduced, values, rate)

    @pandas_udf("array<double>")
    def wavelet_reduced(values: pd.Series) -> pd.Series:
        return _each(lambda x: wavelets.reduce(x)[0], values)

    @pandas_udf("array<bigint>")
    def r_wave_samples(values: pd.Series, rate: pd.Series) -> pd.Series:
        return _each(lambda x, r: np.array([p for p, _ in cardiac.r_waves(x[None], r)], np.int64), values, rate)

    found = {"band_pass": band_pass, "line_noise_reduced": line_noise_reduced, "wavelet_reduced": wavelet_reduced, "r_wave_samples": r_wave_samples}
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
