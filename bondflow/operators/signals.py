"""Presence signals and their de-noising by a two-state hidden Markov model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P, A, B = (0.5, 0.5), ((0.999, 0.001), (0.001, 0.999)), ((0.6, 0.4), (0.4, 0.6))
SCALE, NEVER = 10**9, -(10**15)
CELLS = 1 << 25


def weight(p: float) -> int:
    """A log probability as an integer, so that equal paths tie exactly on every machine."""
    return round(math.log(p) * SCALE) if p > 0 else NEVER


def signal(frames: Column, steps: int) -> Column:
    """An array of 0 and 1, whether each of the frames 0 to steps - 1 is among frames."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.array_contains(frames, i).cast("int"))


def viterbi(seen: np.ndarray, p=P, a=A, b=B) -> np.ndarray:
    """The likeliest states of each row of 0/1 observations; of equal paths the one with state 0."""
    rows, steps = seen.shape
    la = [[weight(x) for x in r] for r in a]
    lb = [[weight(x) for x in r] for r in b]
    gain = [lb[1][o] - lb[0][o] for o in (0, 1)]
    gap = weight(p[1]) - weight(p[0]) + np.where(seen[:, 0] == 1, gain[1], gain[0])
    from_one = np.zeros((2, steps, rows), bool)
    for t in range(1, steps):
        from_one[0, t] = gap + la[1][0] > la[0][0]
        from_one[1, t] = gap + la[1][1] > la[0][1]
        gap = np.maximum(la[0][1], gap + la[1][1]) - np.maximum(la[0][0], gap + la[1][0]) + np.where(seen[:, t] == 1, gain[1], gain[0])
    out = np.zeros((rows, steps), np.int8)
    state = gap > 0
    for t in range(steps - 1, -1, -1):
        out[:, t] = state
        state = np.where(state, from_one[1, t], from_one[0, t])
    return out


def decoded(molecules: DataFrame, steps: int, p=P, a=A, b=B) -> DataFrame:
    """(mol_id, frames): the frames on in the decoded signal of each of (mol_id, frames); all-off molecules have none.

    Signals are dense inside a task only, for as many molecules at a time as fit CELLS cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, CELLS // steps)
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                lists = part.column(1)
                at = np.diff(np.asarray(lists.offsets))
                seen = np.zeros((part.num_rows, steps), np.int8)
                seen[np.repeat(np.arange(part.num_rows), at), lists.flatten().to_numpy()] = 1
                row, frame = np.nonzero(viterbi(seen, p, a, b))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(frame.astype(np.int32)))], names=["mol_id", "frames"])

    return molecules.select("mol_id", "frames").mapInArrow(run, "mol_id bigint, frames array<int>")


def survivors(decoded_: DataFrame) -> DataFrame:
    """Molecules whose decoded signal is on somewhere."""
    return decoded_.where(F.size("frames") > 0)
