"""Whitening of embeddings by a weighted covariance of distinct vectors (op13).

Components become x = floor(scale * c) + shift. Equal x vectors are grouped with
their count; the covariance is a weighted matrix product over the distinct
vectors, centred before multiplying, with counts or ones as weights. Every
distinct vector is projected once on the leading eigenvectors, and the result is
joined back to the rows that have it.

Sums are whole numbers, and rows are centred about the whole number next to the
mean, so partial products are exact below 2**53 and don't depend on the order of
tasks; what the centre is off the mean is subtracted from the finished matrix.

Defined cases: vectors that are null or hold null or non-finite entries take no
part; of the rest those of the most frequent length (the longer, in a tie) are
whitened, others take no part; a null vec_id is a row like any other; rows
repeated whole are rows of their own; a component without variance (constant
dimensions, a single vector) gives whitened and explained 0; a deviation beyond
64 bits is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import store
from vigil.llm.topk import _matrix

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Eigenvalues below this share of their sum are rounding.
LEAST_SHARE = 1e-12


def whole_vectors(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x of every row whose vector is whole and finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.filter("e is not null and forall(e, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    return v.select("vec_id", F.transform("e", lambda c: F.floor(c * scale).cast("long") + shift).alias("x"))


def multiplicities(rows: DataFrame) -> DataFrame:
    """x and times: the distinct vectors of the most frequent length and how many rows have each."""
    distinct = store(rows.groupBy("x").agg(F.count("*").alias("times")), "distinct")
    sizes = distinct.groupBy(F.size("x").alias("size")).agg(F.sum("times").alias("times")).orderBy(F.desc("times"), F.desc("size")).first()
    return distinct.filter(F.size("x") == (sizes[0] if sizes else 0))


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and sum of every dimension, by weight; as many values as dimensions reach the driver."""
    n = distinct.agg(F.sum("weight")).first()[0] or 0
    parts = distinct.select("weight", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)") * F.col("weight")).alias("s"))
    return n, [int(r[1]) for r in parts.orderBy("i").collect()]


def _products(distinct: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sum of weight * (x - centre) (x - centre)'; each task sends one row per dimension, summed by Spark."""
    dim = len(centre)

    def multiply(batches):
        import pyarrow as pa

        total = np.zeros((dim, dim))
        for b in batches:
            c = _matrix(b.column("x"), dim) - centre
            total += (c * b.column("weight").to_numpy().astype(float)[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = distinct.select("x", "weight").mapInArrow(multiply, "i int, row array<double>")
    out = np.zeros((dim, dim))
    for i, j, v in rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[i, j] = v
    return out


class Whitening:
    """Fitted means, leading eigenvectors and their values."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        e, vec = np.linalg.eigh(covariance) if len(sums) else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-e, kind="stable")[:components]
        self.trace = float(np.trace(covariance))
        self.real = e[order] > LEAST_SHARE * self.trace
        self.explained = np.where(self.real, e[order] / (self.trace or 1.0), 0.0)
        self.project = np.where(self.real, vec[:, order] / np.sqrt(np.where(self.real, e[order], 1.0)), 0.0)

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x, whole numbers. x - S/n is taken as ((x - centre) * n - (S - centre * n)) / n."""
        centre = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s - int(c) * self.n for s, c in zip(self.sums, centre)], float) / self.n
        return ((x - centre) - rest) @ self.project

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; None beyond 64 bits."""
        low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
        most = max((max(abs(self.n * low - s), abs(self.n * high - s)) for s in self.sums), default=0)
        if most * most * max(1, len(self.sums)) < 1 << 63 and self.n * max(abs(low), abs(high)) < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """``distinct``: x and weight. None where there is nothing to fit."""
    n, sums = _sums(distinct)
    if not n:
        return None
    centre = np.array([round(s / n) if abs(s) < 1 << 53 else s // n for s in sums], np.int64)
    off = np.array([s - int(c) * n for s, c in zip(sums, centre)], float) / n
    covariance = _products(distinct, centre) / n - np.outer(off, off)
    return Whitening(n, sums, covariance, components)


def _projected(distinct: DataFrame, model: Whitening, names: list[str]) -> DataFrame:
    dim = len(model.sums)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            z = model.transform(sizes)
            columns = [b.column(c) for c in names] + [pa.array(model.deviations(sizes), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "deviation", "z"])

    fields = {f.name: f.dataType.simpleString() for f in distinct.schema}
    return distinct.mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in names) + ", deviation long, z array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of z (by weight) minus the identity, over components with variance."""
    k = len(model.real)
    means = whitened.select(*[(F.sum(F.col("weight") * F.col("z")[i]) / model.n).alias(f"m{i}") for i in range(k)]).first() if k else []
    pairs = [(i, j) for i in range(k) for j in range(i, k) if model.real[i] and model.real[j]]
    if not pairs:
        return 0.0
    z = [F.col("z")[i] - F.lit(means[i]) for i in range(k)]
    c = whitened.select(*[(F.sum(F.col("weight") * z[i] * z[j]) / model.n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(c, pairs))


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "count", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component.

    ``weights``: "count" fits on all rows, "one" on each distinct vector once.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights are 'count' or 'one'")
    spark = vectors.sparkSession
    rows = store(whole_vectors(vectors, scale, shift), "whole-vectors")
    distinct = multiplicities(rows).select("x", (F.col("times") if weights == "count" else F.lit(1).cast("long")).alias("weight"))
    model = fit(distinct, components)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = store(_projected(distinct, model, ["x", "weight"]), "whitened")
    error = identity_error(white, model)
    # both sides of the join have an exchange, so that rows of one hot vector can be split
    back = rows.join(white.select("x", "deviation", "z"), "x")
    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    out = back.select("vec_id", "deviation", F.posexplode("z").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      explained[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
