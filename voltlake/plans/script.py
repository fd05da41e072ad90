"""Processing scripts: named steps over traces, recorded and replayed in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from voltlake.functions import formats
from voltlake.operators import kernels

OPS: dict[str, Callable[[DataFrame, float, dict[str, str]], DataFrame]] = {}


def op(name: str):
    def register(f):
        OPS[name] = f
        return f

    return register


def number(p: dict[str, str], key: str) -> float | None:
    return float(p[key]) if p.get(key, "").strip() else None


#: The vocabulary of scripts. Those without a transform here can be recorded, but not replayed.
VOCABULARY = frozenset(("filter", "reference", "mriGradientCorrection", "waveletReduce", "artifactClean", "icaClean", "bcgDetection", "ecgDetection", "interpolateChannels", "markBad", "segment", "baseline", "average", "combine", "split"))


@op("filter")
def _filter(traces, rate, p):
    """Band-pass and notch, then line noise, then average reference, as far as parameters ask for them."""
    out = kernels.filtered(traces, rate, high=number(p, "highPassHz"), low=number(p, "lowPassHz"), notch=number(p, "notchHz"), slope=int(number(p, "slope") or 24))
    if number(p, "lineNoiseHz"):
        out = kernels.line_reduced(out, rate, line=number(p, "lineNoiseHz"), strength=number(p, "lineNoiseStrength") or 1.0)
    return _reference(out, rate, p) if p.get("averageReference") == "true" else out


@op("reference")
def _reference(traces, rate, p):
    bad = [int(c) for c in p.get("bad", "").split(",") if c.strip()]

    def run(x):
        good = [k for k in range(len(x)) if k not in bad]
        return x - x[good].mean(0) if len(x) > 1 and good else x

    return kernels.matrix_kernel(traces, run)


@op("baseline")
def _baseline(traces, rate, p):
    n = int(number(p, "samples") or 0)
    return kernels.map_traces(traces, lambda x: x - x[:n].mean() if n and len(x) else x)


@op("waveletReduce")
def _wavelet(traces, rate, p):
    return kernels.wavelet_reduced(traces, name=p.get("wavelet", "db4"), levels=int(number(p, "levels") or 5), rule=p.get("rule", "universal"), hard=p.get("hard") == "true", stationary=p.get("kind") == "swt")


@op("mriGradientCorrection")
def _gradient(traces, rate, p):
    starts = [int(v) for v in p["starts"].split(",")]
    return kernels.gradient_corrected(traces, rate, starts, int(p["spacing"]), factor=int(number(p, "factor") or 10), scheme=p.get("scheme", "neighbour"))


@op("icaClean")
def _ica(traces, rate, p):
    import numpy as np

    positions = np.array([[float(v) for v in s.split(":")] for s in p["positions"].split(",")])
    return kernels.ica_cleaned(traces, rate, positions, tuple(p.get("reject", "Eye,Heart").split(",")), p.get("method", "picard"))


@op("artifactClean")
def _artifact(traces, rate, p):
    return kernels.artifact_cleaned(traces, [{"method": p["method"], "times": [float(t) for t in p["times"].split(",")], "width": int(p["width"]), "components": int(number(p, "components") or 2)}], rate)


@dataclass
class Pipeline:
    """Steps as (op, parameters, replayable). Steps marked as not replayable are kept in the script and skipped; a replayable one without a transform here is an error."""

    steps: list[dict] = field(default_factory=list)

    def add(self, name: str, replayable: bool = True, **parameters) -> Pipeline:
        self.steps.append({"seq": len(self.steps), "op": name, "parameters": {k: str(v) for k, v in parameters.items()}, "replayable": replayable, "note": None, "rejections": []})
        return self

    def run(self, traces: DataFrame, rate: float) -> DataFrame:
        for s in self.steps:
            if not s["replayable"]:
                continue
            if s["op"] not in OPS:
                raise ValueError(f"step {s['seq'] + 1}: {s['op']} can't be replayed on traces")
            traces = OPS[s["op"]](traces, rate, s["parameters"])
        return traces

    def to_xml(self) -> bytes:
        return formats.write_script(self.steps)

    @classmethod
    def from_xml(cls, raw: bytes) -> Pipeline:
        return cls(formats.read_script(raw, VOCABULARY))
