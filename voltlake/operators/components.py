"""Independent components of recordings that no task or driver holds: fit, sources, labels, removal.

A recording comes as blocks (all channels of a stretch of samples). A recording of one block is
fitted in its task. For longer ones an iteration ships the unmixing matrices to the tasks; each task adds up the moments of its blocks, Spark
adds up the tasks', and the driver gets channels x channels numbers a recording to
turn the matrix by. Samples never leave the tasks. Long recordings are fitted in
groups by ``GROUP``, so what is shipped has a bound whatever the table's size.

The labeller is this engine's own: traits of a component's time course (sums over
its blocks) and of its map (sums over channels) are columns, and classes are weighted
sums of traits by one table, through a softmax.

Edge cases: samples at which a channel lacks are left out of the fit; a recording of
constant channels has no components; null recording ids are one recording; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions import ica
from voltlake.operators.blocks import matrix_blocks
from voltlake.operators.keys import ids
from voltlake.operators.tables import written

SIZE, PIECE = 32_768, 4_096
#: Squares of channels of the recordings whose matrices the driver turns at a time: 256 recordings of 64 channels, 16 of 256.
GROUP = 256 * 64**2
#: Numbers of all tasks that the driver adds up in a round (64 MB).
HELD = 8 * 2**20
MODEL = "recording_id string, component int, contribution double, mixing array<double>, unmixing array<double>, means array<double>, channels array<int>"


def recording_blocks(samples: DataFrame, size: int = SIZE, before: int = 0) -> DataFrame:
    """recording_id, block, first, channels, rows."""
    blocks = matrix_blocks(samples, size, before)
    return blocks if ids(samples) else blocks.select(F.lit(None).cast("string").alias("recording_id"), *blocks.columns)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[int], np.ndarray, int, int]]:
    """Recording, channels, samples (channels x n), first sample and block; only samples that all channels have."""
    for name, channels, rows, first, block in zip(batch.column("recording_id").to_pylist(), batch.column("channels").to_pylist(), batch.column("rows"), batch.column("first").to_pylist(), batch.column("block").to_pylist(), strict=True):
        each = [np.asarray(r.values.to_numpy(zero_copy_only=False), float) for r in rows]
        n = min(map(len, each))
        yield name, channels, np.stack([x[:n] for x in each]), first, block


def fit_pieces(blocks: DataFrame, size: int = PIECE) -> DataFrame:
    """recording_id, channels, first, data: the finite samples of blocks as matrices of doubles, ``size`` samples at most, dealt evenly over tasks.

    Every round of a fit reads them: bytes reach a task as they are, where arrays of arrays would be taken apart
    and rebuilt value by value. A block without finite samples is one empty piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, channels, x, first, _ in _matrices(batch):
                x = _finite(x)
                for at in range(0, max(x.shape[1], 1), size):
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([channels], pa.list_(pa.int32())), pa.array([first + at], pa.int64()), pa.array([x[:, at : at + size].tobytes()])], names=["recording_id", "channels", "first", "data"])

    cut = blocks.select("recording_id", "block", "first", F.col("channels").cast("array<int>").alias("channels"), "rows").mapInArrow(run, "recording_id string, channels array<int>, first long, data binary")
    return cut.repartition(blocks.sparkSession.sparkContext.defaultParallelism)


def summed(pieces: DataFrame, sums: Callable[[str | None, list[int], np.ndarray], np.ndarray | None], few: bool = False) -> dict[str | None, np.ndarray]:
    """Vectors of the pieces of a recording, added up: in tasks first, then by Spark in the order of tasks, and the totals come to the driver. With ``few`` tasks and recordings the driver adds up the tasks', which saves an exchange a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for name, channels, data in zip(batch.column("recording_id").to_pylist(), batch.column("channels").to_pylist(), batch.column("data"), strict=True):
                held = data.as_buffer()
                found = sums(name, channels, np.frombuffer(held).reshape(len(channels), -1)) if held.size else None
                if found is not None:
                    totals[name] = totals[name] + found if name in totals else found
        task, n = TaskContext.get().partitionId(), len(totals)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([task] * n, pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], names=["recording_id", "task", "v"])

    found = pieces.mapInArrow(run, "recording_id string, task int, v array<double>")
    if few:
        added: dict[str | None, np.ndarray] = {}
        for r in sorted(found.collect(), key=lambda r: r.task):
            added[r.recording_id] = added[r.recording_id] + np.array(r.v) if r.recording_id in added else np.array(r.v)
        return added
    parts = F.array_sort(F.collect_list(F.struct("task", "v")))
    total = F.aggregate(parts, F.array_repeat(F.lit(0.0), F.size(parts[0]["v"])), lambda total, x: F.zip_with(total, x["v"], lambda a, b: a + b))
    return {r.recording_id: np.array(r.v) for r in found.groupBy("recording_id").agg(total.alias("v")).collect()}


def _finite(x: np.ndarray) -> np.ndarray:
    return x[:, np.isfinite(x).all(0)]


def _whole(name: str | None, channels: list[int], models: dict) -> bool:
    return name in models and channels == models[name]["channels"]


def fit_group(pieces: DataFrame, channels: dict[str | None, list[int]], method: str, variance: float, rounds: int | None, tolerance: float | None) -> dict[str | None, dict]:
    """Models by recording, for the recordings of ``channels``."""
    rule = ica.RULES[method]
    models: dict[str | None, dict] = {name: {"channels": c} for name, c in channels.items()}
    few = pieces.rdd.getNumPartitions() * sum(len(c) ** 2 + 5 * len(c) for c in channels.values()) <= HELD

    def gram(name: str | None, own: list[int], x: np.ndarray) -> np.ndarray | None:
        return np.concatenate([[x.shape[1]], x.sum(1), (x @ x.T).ravel()]) if _whole(name, own, models) else None

    going: dict[str | None, ica.Fit] = {}
    for name, total in summed(pieces, gram, few).items():
        k, n = len(models[name]["channels"]), max(total[0], 1)
        means = total[1 : k + 1] / n
        covariance = (total[k + 1 :].reshape(k, k) - n * np.outer(means, means)) / max(n - 1, 1)
        models[name] |= {"n": n, "means": means, "covariance": covariance, "whiten": ica.whitening(covariance, variance)}
        if len(models[name]["whiten"]):
            going[name] = rule[0](ica._start(len(models[name]["whiten"])), rule[1] if rounds is None else rounds, rule[2] if tolerance is None else tolerance)

    def ask(name: str | None, moments: ica.Moments | None) -> None:
        """The next matrix whose moments a fit needs; the last one where it ends."""
        try:
            models[name]["w"] = going[name].send(moments)
        except StopIteration as end:
            models[name]["w"] = end.value
            del going[name]

    for name in list(going):
        ask(name, None)
    while going:
        shipped = {name: {k: models[name][k] for k in ("channels", "means", "whiten", "w")} for name in going}

        def moments(name: str | None, own: list[int], x: np.ndarray, shipped: dict = shipped) -> np.ndarray | None:
            if not _whole(name, own, shipped):
                return None
            m = shipped[name]
            return ica.moment_sums(m["w"], m["whiten"] @ (x - m["means"][:, None]))

        for name, total in summed(pieces, moments, few).items():
            ask(name, ica.Moments.of(total / models[name]["n"], len(models[name]["w"])))
    return {name: m | ica.ordered(m["w"] @ m["whiten"], m["means"], m["covariance"]) for name, m in models.items() if "w" in m}


def _rows(name: str | None, m: dict) -> list[tuple]:
    return [(name, k, float(m["contribution"][k]), m["mixing"][:, k].tolist(), m["unmixing"][k].tolist(), m["mean"].tolist(), m["channels"]) for k in range(len(m["unmixing"]))]


def fit_short(pieces: DataFrame, method: str, variance: float, rounds: int | None, tolerance: float | None) -> DataFrame:
    """Models of recordings that a task holds, each fitted in one task."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.sort_by("first")
        channels = max(parts.column("channels").to_pylist(), key=len)
        own = [np.frombuffer(d).reshape(len(c), -1) for c, d in zip(parts.column("channels").to_pylist(), parts.column("data").to_pylist(), strict=True) if c == channels]
        x = np.concatenate(own, 1)
        found = _rows(parts.column("recording_id")[0].as_py(), ica.fit(x, method, variance, most=rounds, enough=tolerance) | {"channels": channels}) if x.shape[1] else []
        names = [part.split()[0] for part in MODEL.split(", ")]
        types = [pa.string(), pa.int32(), pa.float64(), *[pa.list_(pa.float64())] * 3, pa.list_(pa.int32())]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else [[]] * len(names), types, strict=True)], names=names)

    tasks = 4 * pieces.sparkSession.sparkContext.defaultParallelism  # as stated, so that recordings aren't put into one task for being small
    return pieces.repartition(tasks, "recording_id").groupBy("recording_id").applyInArrow(run, MODEL)


def fit_components(samples: DataFrame, method: str = "picard", variance: float = 0.999, size: int = SIZE, rounds: int | None = None, tolerance: float | None = None) -> DataFrame:
    """A row a recording and component: contribution, mixing and unmixing weights and means by channel.

    A recording of at most ``size`` samples is fitted in a task; for longer ones each round is one pass over their samples. ``rounds`` and
    ``tolerance`` are the method's own unless given (``ica.RULES``): picard has no most rounds, it goes on until it converges.
    """
    pieces = written(fit_pieces(recording_blocks(samples, size)))
    sizes = pieces.groupBy(F.col("recording_id").alias("__name")).agg(F.max_by("channels", F.size("channels")).alias("__channels"), F.sum(F.length("data") / (8 * F.size("channels"))).alias("__n"))
    of = lambda part: pieces.join(sizes.where(part), F.col("recording_id").eqNullSafe(F.col("__name")))
    fitted = written(fit_short(of(F.col("__n") <= size).select(*pieces.columns), method, variance, rounds, tolerance))
    channels = {r["__name"]: r["__channels"] for r in sizes.where(F.col("__n") > size).collect()}  # a list a long recording
    if not channels:
        return fitted
    long = written(of(F.col("__n") > size).select(*pieces.columns)) if fitted.head(1) else pieces
    names = sorted(channels, key=lambda n: (n is not None, n or ""))
    rows, group = [], {}
    for at, name in enumerate(names):
        group[name] = channels[name]
        if at + 1 == len(names) or sum(len(c) ** 2 for c in group.values()) + len(channels[names[at + 1]]) ** 2 > GROUP:
            for found, m in fit_group(long, group, method, variance, rounds, tolerance).items():
                rows += _rows(found, m)
            group = {}
    return fitted.unionByName(samples.sparkSession.createDataFrame(rows, MODEL))


def models_by_recording(models: DataFrame) -> DataFrame:
    """A row a recording: its components in order, as arrays."""
    each = F.sort_array(F.collect_list(F.struct("component", "mixing", "unmixing", "means", "channels")))
    return models.groupBy(F.col("recording_id").alias("__name")).agg(each.alias("__model"))


def _with_models(samples: DataFrame, models: DataFrame, size: int, before: int = 0) -> DataFrame:
    blocks = recording_blocks(samples, size, before)
    return blocks.join(models_by_recording(models), F.col("recording_id").eqNullSafe(F.col("__name"))).drop("__name")


def _models(batch: pa.RecordBatch) -> Iterator[dict]:
    for m in batch.column("__model").to_pylist():
        yield {"components": [c["component"] for c in m], "w": np.array([c["unmixing"] for c in m]), "a": np.array([c["mixing"] for c in m]).T, "means": np.array(m[0]["means"]), "channels": m[0]["channels"]}


def component_sources(samples: DataFrame, models: DataFrame, size: int = SIZE) -> DataFrame:
    """LONG samples of the components: recording_id, component, sample_index, value. Blocks that lack a channel have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (name, channels, x, first, _), m in zip(_matrices(batch), _models(batch), strict=True):
                if channels != m["channels"]:
                    continue
                y, n = m["w"] @ (x - m["means"][:, None]), x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * y.size, pa.string()), pa.array(np.repeat(np.array(m["components"], np.int32), n)), pa.array(np.tile(np.arange(first, first + n), len(y))), pa.array(y.ravel())], names=["recording_id", "component", "sample_index", "value"])

    return _with_models(samples, models, size).mapInArrow(run, "recording_id string, component int, sample_index long, value double")


#: Seconds at which a component is compared with its own past.
LAGS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2)
LINES = (50.0, 60.0)
SUMS = ("n", "s1", "s2", "s4", "d2", *(f"lag{k}" for k in range(len(LAGS))), *(f"{part}{int(f)}" for f in LINES for part in ("re", "im")))


def source_sums(samples: DataFrame, models: DataFrame, rate: float, size: int = SIZE) -> DataFrame:
    """recording_id, component and the sums over its samples that traits are made of, added up over blocks (each with a halo of the longest lag)."""
    lags = [max(1, int(rate * s + 0.5)) for s in LAGS]

    def of_block(y: np.ndarray, first: int, begin: int) -> np.ndarray:
        """Components x sums, for the samples from ``begin`` on."""
        own = y[:, begin - first :]
        t = np.arange(begin, begin + own.shape[1])

        def past(k: int) -> np.ndarray:
            skip = max(0, k - (begin - first))  # samples whose past lies before the recording
            there = begin - first + skip - k
            return (own[:, skip:] * y[:, there : y.shape[1] - k]).sum(1) if skip < own.shape[1] else np.zeros(len(y))

        steps = np.diff(y[:, max(0, begin - first - 1) :], axis=1)
        waves = [own @ wave(2 * np.pi * f / rate * t) for f in LINES for wave in (np.cos, np.sin)]
        return np.stack([np.full(len(y), float(own.shape[1])), own.sum(1), (own**2).sum(1), (own**4).sum(1), (steps**2).sum(1), *(past(k) for k in lags), *waves], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (name, channels, x, first, block), m in zip(_matrices(batch), _models(batch), strict=True):
                begin = block * size
                if channels != m["channels"] or first + x.shape[1] <= begin:
                    continue
                sums = of_block(m["w"] @ (x - m["means"][:, None]), first, begin)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums), pa.string()), pa.array(m["components"], pa.int32()), *(pa.array(c) for c in sums.T)], names=["recording_id", "component", *SUMS])

    parts = _with_models(samples, models, size, max(lags)).mapInArrow(run, "recording_id string, component int, " + ", ".join(f"{c} double" for c in SUMS))
    return parts.groupBy("recording_id", "component").agg(*(F.sum(c).alias(c) for c in SUMS))


def source_traits(sums: DataFrame) -> DataFrame:
    """Traits of the time course, each from 0 to 1: slow, fast (mean squared steps), spiky (kurtosis), line (share of a mains frequency), pulses (spikes that come back after 0.5 to 1.2 s)."""
    power = F.greatest(F.col("s2"), F.lit(1e-300))
    rough = F.col("d2") / (4 * power)
    kurtosis = F.greatest(F.col("n") * F.col("s4") / (power * power) - 3, F.lit(0.0))
    spiky = kurtosis / (kurtosis + 6)
    line = F.greatest(*(2 * (F.col(f"re{int(f)}") ** 2 + F.col(f"im{int(f)}") ** 2) / (F.greatest("n", F.lit(1.0)) * power) for f in LINES))
    back = F.greatest(F.lit(0.0), *(F.col(f"lag{k}") / power for k in range(len(LAGS))))
    return sums.select("recording_id", "component", F.exp(-60 * rough).alias("slow"), F.least(2 * rough, F.lit(1.0)).alias("fast"), spiky.alias("spiky"), F.least(line, F.lit(1.0)).alias("line"), (F.least(back, F.lit(1.0)) * spiky).alias("pulses"))


def map_traits(models: DataFrame, layout: DataFrame) -> DataFrame:
    """Traits of the map over the sensors of ``layout`` (channel_index, x, y), each from 0 to 1: focal (participation), front, rim (shares of power), dipole (explained by a plane over the sensors)."""
    weights = models.select("recording_id", "component", F.explode(F.arrays_zip("channels", "mixing")).alias("m")).select("recording_id", "component", F.col("m.channels").alias("channel_index"), F.col("m.mixing").alias("w"))
    edge = layout.agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).alias("edge"))
    placed = weights.join(layout.select("channel_index", "x", "y"), "channel_index").crossJoin(F.broadcast(edge)).withColumn("p", F.col("w") ** 2)  # one row
    share = lambda where: F.sum(F.when(where, F.col("p")).otherwise(0.0)) / F.greatest(F.sum("p"), F.lit(1e-300))
    flat = lambda c: F.coalesce(F.when(F.isnan(c), 0.0).otherwise(c), F.lit(0.0))
    return placed.groupBy("recording_id", "component").agg(
        F.sqrt(F.sum(F.col("p") ** 2) / F.greatest(F.sum("p") ** 2, F.lit(1e-300))).alias("focal"),
        share(F.col("y") > 0.5 * F.col("edge")).alias("front"),
        share(F.col("x") ** 2 + F.col("y") ** 2 > (0.8 * F.col("edge")) ** 2).alias("rim"),
        F.least(flat(F.corr("w", "x")) ** 2 + flat(F.corr("w", "y")) ** 2, F.lit(1.0)).alias("dipole"),
    )


TRAITS = ("slow", "fast", "spiky", "line", "pulses", "focal", "front", "rim", "dipole")
#: This engine's own weights of the traits, and a constant, by class.
WEIGHTS = {
    "Brain": {"": 0.0, "dipole": 3.0, "slow": 1.0, "fast": -3.0, "focal": -2.0, "pulses": -3.0},
    "Muscle": {"": -3.75, "fast": 4.0, "rim": 2.5, "line": -4.0, "focal": -3.0},
    "Eye": {"": -3.5, "front": 4.0, "slow": 3.0, "fast": -2.0},
    "Heart": {"": -1.5, "pulses": 9.0, "fast": -1.0},
    "Line Noise": {"": -2.0, "line": 6.0},
    "Channel Noise": {"": -4.0, "focal": 12.0},
    "Other": {"": 0.5},
}
SHARPNESS = 2.0


def label_components(samples: DataFrame, models: DataFrame, layout: DataFrame, rate: float, size: int = SIZE) -> DataFrame:
    """``models`` with label (the class of largest weighted sum; ties to the first in name), score (its share in the softmax) and the traits. Sensors without a place don't count; a component without placed sensors has map traits 0."""
    joined = models
    for traits in (source_traits(source_sums(samples, models, rate, size)), map_traits(models, layout)):
        own = traits.withColumnsRenamed({"recording_id": "__r", "component": "__c"})
        joined = joined.join(own, F.col("recording_id").eqNullSafe(F.col("__r")) & (F.col("component") == F.col("__c")), "left").drop("__r", "__c")
    for t in TRAITS:
        joined = joined.withColumn(t, F.coalesce(t, F.lit(0.0)))
    return classed(joined)


def classed(traits: DataFrame) -> DataFrame:
    """``traits`` with label and score."""
    logits = {name: sum((F.lit(v) * F.col(t) for t, v in row.items() if t), F.lit(row[""])) * SHARPNESS for name, row in sorted(WEIGHTS.items())}
    best = F.greatest(*(F.struct(logit.alias("v"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, logit) in enumerate(logits.items())))
    total = sum((F.exp(logit - F.col("__best.v")) for logit in logits.values()), F.lit(0.0))
    return traits.withColumn("__best", best).withColumn("label", F.col("__best.name")).withColumn("score", 1 / total).drop("__best")


def without_components(samples: DataFrame, models: DataFrame, chosen: DataFrame, size: int = SIZE, clip: bool = True) -> DataFrame:
    """``samples`` less the ``chosen`` (recording_id, component); the removed part is clamped as ``ica.clean`` does, by the recording's first block. Recordings without a chosen component, and blocks that lack a channel, stay as they are."""
    picked = chosen.select(F.col("recording_id").alias("__r"), F.col("component").alias("__c")).distinct()
    part = models.join(picked, F.col("recording_id").eqNullSafe(F.col("__r")) & (F.col("component") == F.col("__c"))).select(*models.columns)
    blocks = recording_blocks(samples, size).join(models_by_recording(part), F.col("recording_id").eqNullSafe(F.col("__name")), "left").drop("__name")

    def limit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (name, channels, x, _, _), m in zip(_matrices(batch), _models(batch), strict=True):
                if channels == m["channels"]:
                    removed = np.abs(m["a"] @ (m["w"] @ (x - m["means"][:, None])))
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([float(np.clip(20 * np.percentile(removed, 99), 500, 5_000)) if removed.size else 5_000.0])], names=["recording_id", "most"])

    first = blocks.where("block = 0 AND __model IS NOT NULL").mapInArrow(limit, "recording_id string, most double").select(F.col("recording_id").alias("__r"), "most")
    bounded = blocks.join(first, F.col("recording_id").eqNullSafe(F.col("__r")), "left").drop("__r")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models_ = batch.column("__model").to_pylist()
            for k, (name, channels, x, at, _) in enumerate(_matrices(batch)):
                if models_[k]:
                    m, most = next(_models(batch.slice(k, 1))), batch.column("most")[k].as_py()
                    if channels == m["channels"]:
                        removed = m["a"] @ (m["w"] @ (x - m["means"][:, None]))
                        x = x - (np.clip(removed, -most, most) if clip and most is not None else removed)
                n = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * x.size, pa.string()), pa.array(np.repeat(np.array(channels, np.int32), n)), pa.array(np.tile(np.arange(at, at + n), len(x))), pa.array(x.ravel())], names=["recording_id", "channel_index", "sample_index", "value"])

    out = bounded.mapInArrow(clean, "recording_id string, channel_index int, sample_index long, value double")
    return out if ids(samples) else out.drop("recording_id")
