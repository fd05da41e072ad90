"""Resting analysis: segments, health, decisions, spectra and connectivity of what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.operators import health, select, spectra
from voltlake.operators.keys import ids
from voltlake.operators.layout import to_traces
from voltlake.operators.tables import written


def resting_analysis(samples: DataFrame, rate: float, n_samples: int, n_channels: int, seconds: float = 4.0, intervals: DataFrame | None = None, kept_grades: tuple[str, ...] = ("good", "watch"), max_overlap: float = 0.1) -> dict[str, DataFrame]:
    """Tables: decisions, summary, powers, bands, pairs and the long result rows.

    Decisions are written once; the kept segments are joined to their recording's traces. Health is of all samples, whatever their number; a last segment that the recording's end cuts has the windows of a whole one as far as its samples go.
    """
    length = max(1, round(seconds * rate))
    scored = health.segment_health(samples, length, n_samples, n_channels, rate, intervals, stride=1)
    scored = scored.withColumn("overlap_fraction", F.least(F.lit(1.0), F.col("overlap_samples") / (F.col("end_sample") - F.col("start_sample") + 1)))
    decisions = written(select.segment_decisions(scored, kept_grades, max_overlap))
    kept = decisions.where("kept").select(*ids(samples), "start_sample", "end_sample")
    traces = to_traces(samples)
    powers = spectra.band_powers(spectra.pooled_spectra(traces, kept, rate, length))
    pairs = spectra.connectivity(traces, kept, rate, whole=length) if kept.head(1) else None
    return {"decisions": decisions, "summary": health.segment_summary(decisions), "powers": powers, "bands": spectra.band_summary(powers), "rows": spectra.result_rows(powers, pairs)} | ({"pairs": pairs} if pairs is not None else {})
