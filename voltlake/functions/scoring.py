"""Score, grade and text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    """Not null, NaN or infinite."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def cleaned(x: Column) -> Column:
    return F.when(finite(x), x.cast("double")).otherwise(F.lit(0.0))


def score_upper_ratio(r: Column, green, red) -> Column:
    """1 up to green, 0 from red on, linear between; 0 for what isn't finite."""
    green, red = num(green), num(red)
    return F.when(~finite(r), 0.0).when(r <= green, 1.0).when(r >= red, 0.0).otherwise(1.0 - (r - green) / (red - green))


def score_two_sided_ratio(r: Column, green, red) -> Column:
    """Upper score of the ratio or its inverse, whichever is larger."""
    return F.when(~finite(r) | (r <= 0), 0.0).otherwise(score_upper_ratio(F.greatest(r, F.lit(1.0) / F.when(r > 0, r)), green, red))


def score_lower_bound(r: Column, green, red) -> Column:
    """1 from green on, 0 up to red, linear between."""
    green, red = num(green), num(red)
    return F.when(~finite(r), 0.0).when(r >= green, 1.0).when(r <= red, 0.0).otherwise((r - red) / (green - red))


def grade(score: Column) -> Column:
    return F.when(score >= 0.78, "good").when(score >= 0.50, "watch").otherwise("poor")


def impedance_score(k: Column) -> Column:
    return F.when(k < 40, 1.0).when(k < 60, 1.0 - (k - 40) / 20 * 0.22).when(k < 70, 0.78 - (k - 60) / 10 * 0.28).otherwise(F.greatest(F.lit(0.0), 0.49 - (k - 70) / 50 * 0.49))


def impedance_band(k: Column) -> Column:
    return F.when(k < 40, "great").when(k < 60, "good").when(k < 70, "fair").otherwise("poor")


def format_percent(fraction: Column) -> Column:
    return F.format_string("%.1f%%", F.greatest(F.lit(0.0), F.least(F.lit(100.0), fraction * 100)))


def format_ratio(r: Column) -> Column:
    return F.when(finite(r), F.format_string("%.1fx", r)).otherwise("nanx")


def format_microvolts(v: Column) -> Column:
    size = F.abs(v)
    return F.when(size >= 100, F.format_string("%.0f µV", v)).when(size >= 10, F.format_string("%.1f µV", v)).otherwise(F.format_string("%.2f µV", v))


def unit_scale(unit: Column) -> Column:
    """Factor to microvolts; the micro sign and Greek mu both count."""
    u = F.lower(F.trim(unit))
    return F.when(u == "v", 1e6).when(u == "mv", 1e3).when(u.isin("µv", "μv", "uv", ""), 1.0).when(u == "nv", 1e-3).otherwise(1.0)


def downsample_factor(source, target) -> Column:
    return F.greatest(F.round(num(source) / F.greatest(num(target), F.lit(1.0))), F.lit(1.0)).cast("int")


def effective_rate(source, target) -> Column:
    return num(source) / downsample_factor(source, target)


def normalised_category(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def normalised_channel(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), " ", ""), "(?i)-REF", ""))


def non_empty(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def version_at_least(version: Column, *parts: int) -> Column:
    """Components compared in turn; missing ones are 0, trailing text in a component is ignored."""
    have = F.transform(F.split(F.coalesce(version, F.lit("")), r"\."), lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(p, r"^\s*(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)))
    padded = F.slice(F.concat(have, F.array_repeat(F.lit(0), len(parts))), 1, len(parts))
    return padded >= F.array(*(F.lit(p) for p in parts))


def unit_vector(values: Column) -> Column:
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(values, lambda v: F.when(norm > 1e-12, v / norm).otherwise(0.0))


def mean_centred(values: Column) -> Column:
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return F.transform(values, lambda v: v - mean)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def normalised_topography(values: Column) -> Column:
    """Centred, then divided by the largest magnitude."""
    centred = mean_centred(values)
    top = F.array_max(F.transform(centred, lambda v: F.abs(v)))
    return F.transform(centred, lambda v: F.when(top > 1e-12, v / top).otherwise(0.0))


def spherical_to_cartesian(r: Column, theta: Column, phi: Column) -> list[Column]:
    t, p = F.radians(theta), F.radians(phi)
    return [(r * F.sin(t) * F.cos(p)).alias("x"), (r * F.sin(t) * F.sin(p)).alias("y"), (r * F.cos(t)).alias("z")]
