"""M3/M4: isolation forest (Liu, Ting, Zhou, ICDM 2008) on Spark.

Fit: each tree sees min(psi, n) rows. Every (row, tree) pair draws by a stable
hash with probability 4 psi / n, then ``row_number() <= psi`` per tree (planned
as a partial WindowGroupLimit, so no task receives more than psi rows per map
partition); ``groupBy(tree_id).applyInPandas`` grows one tree per group. The
tree table has at most n_trees * (2 psi - 1) rows: a proven bound, so it is
broadcast for scoring. Scoring is a scalar pandas UDF over the array of
features: only that array goes to Python and one number per row comes back, in
the partitions the rows are in.

decision = -2^(-E[h(x)] / c(psi)) - offset, with offset the ``contamination``
quantile of the training scores; anomalous when decision < threshold (0).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.stats import exact_quantiles
from vigil.models.split import stable_unit
from vigil.session import stored

TREE_SCHEMA = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
    ]
)
EULER = 0.5772156649015329


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


@dataclass
class IsolationForestModel:
    trees: pd.DataFrame  # TREE_SCHEMA rows (bounded: n_trees * (2 psi - 1))
    features: list
    psi: int
    offset: float
    n_trees: int

    def arrays(self):
        out = []
        for _, t in self.trees.sort_values(["tree_id", "node_id"]).groupby("tree_id"):
            out.append((t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(),
                        t["right"].to_numpy(), t["size"].to_numpy()))
        return out


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Iterative isolation tree over the sample x; returns node rows."""
    nodes = []  # (feature, threshold, left, right, size)
    stack = [(np.arange(len(x)), 0, None)]
    order = []
    while stack:
        idx, depth, parent = stack.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx)])
        if parent is not None:
            p, side = parent
            nodes[p][2 if side == 0 else 3] = me
        order.append(me)
        if depth >= limit or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            continue
        q = int(rng.choice(cand))
        thr = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < thr
        nodes[me][0], nodes[me][1] = q, thr
        stack.append((idx[~go_left], depth + 1, (me, 1)))
        stack.append((idx[go_left], depth + 1, (me, 0)))
    return nodes


def _builder(features, psi: int, seed: int):
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree_id"].iloc[0])
        x = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tid])
        nodes = _grow(x, rng, limit)
        arr = np.asarray(nodes, dtype=object)
        return pd.DataFrame({
            "tree_id": tid, "node_id": np.arange(len(nodes), dtype="int32"),
            "feature": arr[:, 0].astype("int32"), "threshold": arr[:, 1].astype(float),
            "left": arr[:, 2].astype("int32"), "right": arr[:, 3].astype("int32"), "size": arr[:, 4].astype("int32"),
        })

    return build


def _sample(df: DataFrame, features, n: int, n_trees: int, psi: int, seed: int, id_col: str) -> DataFrame:
    """psi rows per tree: one draw per (row, tree), the same for any n (4 psi / n may pass 1)."""
    from pyspark.sql import Window

    x = df.select(F.col(id_col).alias("_id"), *features)
    keep = int(min(1.0, 4.0 * psi / max(n, 1)) * (1 << 32))
    x = x.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    x = x.filter(F.pmod(F.xxhash64(F.lit(seed), "tree_id", "_id"), F.lit(1 << 32)) < F.lit(keep))
    w = Window.partitionBy("tree_id").orderBy(F.xxhash64(F.lit(seed + 1), "tree_id", "_id"), "_id")
    return x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi).drop("_rn")


def _descent(tree) -> tuple:
    """A tree for walking all rows at once: feature, threshold and both children per node (a leaf is its own child), path length, depth."""
    feat, thr, left, right, size = tree
    inner, me = feat >= 0, np.arange(len(feat))
    depth = np.zeros(len(feat))
    for node in np.flatnonzero(inner):  # a child is numbered after its parent
        depth[left[node]] = depth[right[node]] = depth[node] + 1
    children = np.stack([np.where(inner, right, me), np.where(inner, left, me)], 1).ravel()  # goes left: 1
    return np.where(inner, feat, 0), np.where(inner, thr, -np.inf), children, depth + c_factor(size), int(depth.max())


def _path_lengths(trees_arrays, x: np.ndarray) -> np.ndarray:
    n = len(x)
    total, rows, columns = np.zeros(n), np.arange(n), np.ascontiguousarray(x.T).ravel()
    for tree in trees_arrays:
        feat, thr, children, length, depth = _descent(tree)
        at = feat * n
        node = np.zeros(n, dtype=np.int64)
        for _ in range(depth):
            node = children.take(2 * node + (columns.take(at.take(node) + rows) < thr.take(node)))
        total += length.take(node)
    return total / len(trees_arrays)


def raw_scores(model_arrays, x: np.ndarray) -> np.ndarray:
    """score_samples: -2^(-E[h]/c(psi)), with c averaged over the trees' true sample sizes."""
    eh = _path_lengths(model_arrays, x)
    c = float(np.mean(c_factor([t[4][0] for t in model_arrays])))
    return -np.power(2.0, -eh / c) if c > 0 else np.full(len(x), -0.5)


def _raw_score(df: DataFrame, model: IsolationForestModel):
    """Column expression: the features as one array in, one score out; missing counts as 0."""
    bc = df.sparkSession.sparkContext.broadcast(model.arrays())
    width = len(model.features)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        m = np.concatenate(x.to_numpy()).reshape(-1, width) if len(x) else np.zeros((0, width))
        return pd.Series(raw_scores(bc.value, np.nan_to_num(m)))

    return score(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in model.features]))


def fit_isolation_forest(df: DataFrame, features, n_trees: int = 100, psi: int = 256, contamination: float = 0.1,
                         seed: int = 42, id_col: str = "reading_id") -> IsolationForestModel:
    return fit_and_score(df, features, n_trees, psi, contamination, seed, id_col)[0]


def fit_and_score(df: DataFrame, features, n_trees: int = 100, psi: int = 256, contamination: float = 0.1,
                  seed: int = 42, id_col: str = "reading_id") -> tuple[IsolationForestModel, DataFrame]:
    """The model, and the training rows' ``anomaly_score`` and ``is_anomaly``.

    All rows are scored once: offset, range and metrics come from that one narrow table, which is written.
    """
    n = df.count()
    psi_eff = int(min(psi, max(n, 1)))
    sample = _sample(df, features, n, n_trees, psi_eff, seed, id_col)
    schema_in = list(features)
    trees = sample.select("tree_id", *schema_in).groupBy("tree_id").applyInPandas(
        _builder(schema_in, psi_eff, seed), TREE_SCHEMA
    ).toPandas()  # bounded: n_trees * (2 psi - 1) rows
    model = IsolationForestModel(trees, list(features), psi_eff, 0.0, n_trees)
    raw = stored(df.select(_raw_score(df, model).alias("_s")), "isolation-scores")
    model.offset = float(exact_quantiles(raw, {"_s": [contamination]})[("_s", contamination)])
    scored = raw.select((F.col("_s") - F.lit(model.offset)).alias("anomaly_score")).withColumn("is_anomaly", F.col("anomaly_score") < 0)
    return model, scored


def score_isolation_forest(model: IsolationForestModel, df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """M4: adds ``anomaly_score`` (decision function) and ``is_anomaly``."""
    x = df.withColumn("anomaly_score", _raw_score(df, model) - F.lit(model.offset))
    return x.withColumn("is_anomaly", F.col("anomaly_score") < F.lit(threshold))
