"""Rolling statistics (W1-W5) of ordered series, worked out in Arrow batches.

Spark's sliding frames run every aggregate again over the whole frame for every
row. Here Spark partitions, orders and numbers the rows of each series by one
window, and a task goes once through its rows in that order: a batch's frames
are worked out for all its rows together, one lag at a time, with the last rows
of the batch before it at hand. Sums and moments are updated from the oldest row
of a frame to the newest as Spark's aggregates do, so results are theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.series import Series

KINDS = ("mean", "std", "min", "max", "range")
POSITION = "_position"


def rolled(df: DataFrame, channels, windows, s: Series) -> DataFrame:
    """``df`` with the rolling columns of its double channels (``series.rolling``), window outer, channel inner."""
    channels, windows = list(channels), list(windows)
    x = df.select("*", F.row_number().over(s.window()).alias(POSITION))
    new = [f"{c}_rolling_{k}_{w}" for w in windows for c in channels for k in KINDS]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new]])
    kept, names = df.columns, [*df.columns, *new]

    def run(batches):
        held = max(windows) - 1
        tail = {c: (np.zeros(held), np.zeros(held, dtype=bool)) for c in channels}  # rows before the batch
        for batch in batches:
            position, cols = batch.column(POSITION).to_numpy(), {}
            for c in channels:
                v = batch.column(c)
                ok = np.concatenate([tail[c][1], v.is_valid().to_numpy(zero_copy_only=False)])
                v = np.concatenate([tail[c][0], v.fill_null(0.0).to_numpy()])
                for w, frame in _frames(v, ok, position, windows).items():
                    cols.update({f"{c}_rolling_{k}_{w}": part for k, part in zip(KINDS, frame)})
                tail[c] = v[len(v) - held:], ok[len(ok) - held:]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[cols[c] for c in new]], names)

    return x.mapInArrow(run, schema)


def _frames(v: np.ndarray, ok: np.ndarray, position: np.ndarray, windows) -> dict[int, list[pa.Array]]:
    """{w: mean, std, min, max, range} over each row and the w - 1 before it in its series.

    ``v`` and ``ok`` (not missing) begin with rows before those that ``position``, counted from 1, has.
    """
    n, before, most = len(position), len(v) - len(position), max(windows)
    lagged = [v[before - j:before - j + n] for j in range(most)]
    live = [ok[before - j:before - j + n] & (position > j) for j in range(most)]
    out = {}
    with np.errstate(all="ignore"):
        low, high = np.full(n, np.nan), np.full(n, -np.inf)
        for j in range(most):
            low = np.fmin(low, np.where(live[j], lagged[j], np.nan))  # NaN is the largest value
            high = np.maximum(high, np.where(live[j], lagged[j], -np.inf))
            if j + 1 in windows:
                out[j + 1] = [low, high]
        for w in windows:
            count, total, mean, m2 = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
            for j in range(w - 1, -1, -1):
                count += live[j]
                total += np.where(live[j], lagged[j], 0.0)
                delta = np.where(live[j], lagged[j] - mean, 0.0)
                step = delta / np.maximum(count, 1)
                mean += step
                m2 += delta * (delta - step)
            low, high = out[w]
            none = count == 0
            out[w] = [pa.array(total / count, mask=none), pa.array(np.sqrt(m2 / (count - 1)), mask=count < 2),
                      *[pa.array(x, mask=none) for x in (low, high, high - low)]]
    return out
