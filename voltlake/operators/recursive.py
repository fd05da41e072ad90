"""Recursive filters over blocks of a trace: affine maps of filter states, composed by scans.

What a block does to the state of a second-order section is an affine map of the state that enters:
a 2 x 2 matrix of the block's length and a vector of its samples. With all passes of
a filter (each section forward and backward) the block is still linear in the states
that enter all passes. So three steps are exact:

1. each block runs all passes from zero states (a map over blocks) and keeps what it would leave;
2. by trace, pass after pass, a scan over these few numbers a block gives the states that enter;
3. each block runs again, from those states (a map over blocks).

The samples are dealt once, by (recording, channel, block), for both maps. Blocks
grow with the longest trace, so that a scan has at most ``MOST`` blocks. Even reflection
lies inside the first and the last block, which are never shorter than it.

Edge cases: traces up to six samples stay as they are (as with ``dsp.zero_phase``); a null
or missing value makes the pass after it NaN; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions import dsp
from voltlake.operators.blocks import channel_blocks
from voltlake.operators.keys import ids

#: Blocks of a trace at most, and samples of a block at least.
MOST, LEAST = 65_536, 4_096
#: Samples of the blocks that run side by side at a time.
SIDE_BY_SIDE = 1 << 19
Section = tuple[np.ndarray, np.ndarray]


def run_section(section: Section, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output of samples x columns and the state left; the part of the entering state is the all-pole response to its two values."""
    b, a = section
    enter = np.zeros_like(x)
    enter[: len(state)] = state[: len(x)]
    y = dsp._recursive(b, a, x) + dsp._recursive(np.array([1.0, 0.0, 0.0]), a, enter)
    before = b[2] * x[-2] - a[2] * y[-2] if len(x) > 1 else state[1]
    return y, np.stack([b[1] * x[-1] - a[1] * y[-1] + before, b[2] * x[-1] - a[2] * y[-1]])


def run_block(sections: list[Section], x: np.ndarray, states: np.ndarray, pad: int, first: bool, last: bool, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """All passes over a block (samples x columns) from ``states`` (passes x 2 x columns): output, and the states left."""
    left = []
    for section in sections:
        head = pad if both and first else 0
        tail = pad if both and last else 0
        y = np.concatenate([x[head:0:-1], x, x[-2 : -tail - 2 : -1]]) if head or tail else x
        y, state = run_section(section, y, states[len(left)])
        left.append(state)
        if both:
            y, state = run_section(section, y[::-1], states[len(left)])
            left.append(state)
            y = y[::-1]
        x = y[head : len(y) - tail]
    return x, np.stack(left)


def coupling(sections: list[Section], n: int, pad: int, first: bool, last: bool, both: bool) -> np.ndarray:
    """What each entering state value adds to each state value left: a square matrix over passes x 2."""
    size = 2 * len(sections) * (2 if both else 1)
    _, left = run_block(sections, np.zeros((n, size)), np.eye(size).reshape(size // 2, 2, size), pad, first, last, both)
    return left.reshape(size, size)


def entering_states(left: np.ndarray, maps: list[np.ndarray], both: bool) -> np.ndarray:
    """States that enter each block (blocks x passes * 2) from what blocks leave when started from zero.

    Passes in order; even ones run forward over the blocks, odd ones (of ``both``) backward.
    """
    blocks, size = left.shape
    enter = np.zeros((blocks, size))
    for p in range(size // 2):
        own, known = slice(2 * p, 2 * p + 2), slice(0, 2 * p)
        push = left[:, own] + np.stack([m[own, known] @ e for m, e in zip(maps, enter[:, known], strict=True)])
        order = range(blocks - 1, -1, -1) if both and p % 2 else range(blocks)
        state = np.zeros(2)
        for k in order:
            enter[k, own] = state
            state = push[k] + maps[k][own, own] @ state
    return enter


def filtered_blocks(samples: DataFrame, sections: list[Section], pad: int, size: int | None = None, both: bool = True) -> DataFrame:
    """``samples`` (LONG) through the sections, each forward and backward if ``both``, else forward from rest."""
    keys = [*ids(samples), "channel_index"]
    longest = (samples.agg(F.max("sample_index")).first()[0] or 0) + 1
    size = max(size or LEAST, pad + 1 if both else 1, math.ceil(longest / MOST))
    n_states = 2 * len(sections) * (2 if both else 1)
    if not sections:
        return samples.select(*keys, "sample_index", "value")
    blocks = channel_blocks(samples, size)
    names = [*keys, "block", "n_blocks"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*names).schema.fields)

    def passed(batch: pa.RecordBatch, states: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Output and states left of each row; blocks of one kind and length run side by side, as columns."""
        at, n = batch.column("block").to_pylist(), batch.column("n_blocks").to_pylist()
        rows = [np.asarray(values.values.to_numpy(zero_copy_only=False), float) for values in batch.column("values")]
        kinds: dict[tuple[int, bool, bool], list[int]] = {}
        for k, x in enumerate(rows):
            kinds.setdefault((len(x), at[k] == 0, at[k] == n[k] - 1), []).append(k)
        out: list = [None] * len(rows)
        for (length, first, last), members in kinds.items():
            beside = max(1, SIDE_BY_SIDE // max(length, 1))
            for low in range(0, len(members), beside):
                part = members[low : low + beside]
                if both and first and last and length <= 6:
                    for k in part:
                        out[k] = (rows[k], np.zeros(n_states))
                    continue
                enter = np.stack([np.zeros(n_states) if states[k] is None else states[k] for k in part], 1)
                y, left = run_block(sections, np.stack([rows[k] for k in part], 1), enter.reshape(-1, 2, len(part)), min(pad, length - 1), first, last, both)
                for j, k in enumerate(part):
                    out[k] = (y[:, j], left[..., j].ravel())
        return out

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [row.tolist() for _, row in passed(batch, [None] * batch.num_rows)]
            n = pa.array(np.diff(batch.column("values").offsets.to_numpy()).astype("int64"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), n, pa.array(left, pa.list_(pa.float64()))], names=[*names, "n", "left"])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        known: dict[tuple, np.ndarray] = {}
        maps = []
        for b, n in zip(pdf["block"], pdf["n"], strict=True):
            kind = (int(n), b == 0, b == len(pdf) - 1)
            if kind not in known:
                known[kind] = coupling(sections, kind[0], min(pad, kind[0] - 1), *kind[1:], both)
            maps.append(known[kind])
        pdf["states"] = list(entering_states(np.stack(pdf["left"].to_numpy()), maps, both))
        return pdf[[*names, "states"]]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [np.asarray(s.values.to_numpy(zero_copy_only=False), float) for s in batch.column("states")]
            out = [y for y, _ in passed(batch, states)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "values"])

    left = blocks.select(*names, "values").mapInArrow(leave, f"{ddl}, n long, left array<double>")
    states = left.groupBy(*keys).applyInPandas(scan, f"{ddl}, states array<double>").drop("n_blocks")
    out = blocks.join(states, [*keys, "block"]).select(*names, "values", "states").mapInArrow(final, f"{ddl}, values array<double>")
    flat = out.select(*keys, "block", F.posexplode("values").alias("at", "value"))
    return flat.select(*keys, (F.col("block") * size + F.col("at")).alias("sample_index"), "value")


def band_pass_blocks(samples: DataFrame, rate: float, high: float | None = None, low: float | None = None, notch: float | None = None, slope: int = 24, size: int | None = None, both: bool = True) -> DataFrame:
    """``dsp.band_pass`` of every trace, with no trace in one task."""
    sections = dsp.band_sections(rate, high, low, notch, slope)
    lead = high or low or notch
    return filtered_blocks(samples, sections, max(math.ceil(3 * rate / lead), 24) if lead else 0, size, both)
