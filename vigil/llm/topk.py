"""Exact top-k inner products, longest vectors first (op10).

Components become floor(scale * x). One pass gives the Gram matrix of all
vectors, whose eigenvectors (the SVD rotation) gather most of a product in the
first coordinates. Vectors lie range-partitioned by descending length. The
longest ones, up to ``HEAD``, are scored first against every query: their k-th
score is a floor that every later product must reach. Each task then walks its
blocks, which hold vectors of like length, and drops

* a block if |q| * longest length in it is below the floor; files of several
  length ranges share a task in any order, so later blocks are looked at anew;
* a vector, if its partial product over the first rotated coordinates plus the
  product of the two residual lengths (Cauchy-Schwarz) is below the floor.

What remains is scored in whole numbers, so scores are exact and ties stand.
Bounds carry a slack for rounding; equal scores are never dropped.

Queries go in blocks of at most ``QUERIES`` rows, one broadcast after another.

Defined cases: vectors that are null, or hold null or non-finite components, or
have a null id take no part; shorter vectors count as padded with zeros; an
empty vector scores 0; a query leaves out every row of its own id; rows repeated
whole are one row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import shuffle_partitions, store

SCALE = 1024
HEAD = 4096
QUERIES = 4096
BLOCK = 1024
RESULT = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole components as doubles, exact below 2**53) and squared length."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.filter("vec_id is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    v = v.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("v")).distinct()
    return v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at:at + n]
        at += n
    return out


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, largest first; partial sums leave the tasks, d x d each."""

    def grams(batches):
        import pyarrow as pa

        g = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v"), dim)
            g += m.T @ m
        flat = [x.tolist() for x in g]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select("v").mapInArrow(grams, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((dim, dim))
    for r in sums:
        g[r[0], r[1]] = r[2]
    _, vec = np.linalg.eigh(g if np.isfinite(g).all() else np.eye(dim))
    return vec[:, ::-1]


def _scorer(queries, dim: int, rotation: np.ndarray, k: int, first: int):
    """mapInArrow function over vectors of one partition, in any order."""

    def run(batches):
        import pyarrow as pa

        ids, q, floor = queries.value
        norm = np.sqrt((q * q).sum(1))
        rq = q @ rotation
        q_rest = np.sqrt((rq[:, first:] ** 2).sum(1))
        # k best so far of each query in this partition: scores and ids
        best = [([], []) for _ in ids]
        floor = floor.copy()
        for b in batches:
            vec, all_rows = b.column("vec_id").to_numpy(), _matrix(b.column("v"), dim)
            for at in range(0, len(vec), BLOCK):
                names, m = vec[at:at + BLOCK], all_rows[at:at + BLOCK]
                length = np.sqrt((m * m).sum(1))
                slack = 1e-6 + 1e-9 * norm * length.max(initial=0.0)
                alive = np.nonzero(norm * length.max(initial=0.0) + slack >= floor)[0]
                if not len(alive):
                    continue
                rm = m @ rotation
                m_rest = np.sqrt((rm[:, first:] ** 2).sum(1))
                bound = rq[alive, :first] @ rm[:, :first].T + np.outer(q_rest[alive], m_rest) + slack[alive, None]
                keep = bound >= floor[alive, None]
                for row in np.nonzero(keep.any(1))[0]:
                    i = alive[row]
                    got = np.nonzero(keep[row] & (names != ids[i]))[0]
                    if not len(got):
                        continue
                    if norm[i] * length.max() < 2.0 ** 52:
                        score = (m[got] @ q[i]).astype(np.int64)  # whole numbers below 2**53: exact in doubles
                    else:
                        whole = [int(x) for x in q[i]]
                        score = np.array([sum(int(x) * y for x, y in zip(c, whole)) for c in m[got]], dtype=object)
                    s, n = np.concatenate([best[i][0], score]) if len(best[i][0]) else score, np.concatenate([best[i][1], names[got]]) if len(best[i][1]) else names[got]
                    order = np.lexsort((n, np.array([-x for x in s], dtype=s.dtype)))[:k]
                    best[i] = s[order], n[order]
                    if len(order) == k:
                        floor[i] = max(floor[i], float(s[order][-1]))
        out = [(ids[i], int(n), int(s)) for i, (ss, ns) in enumerate(best) for s, n in zip(ss, ns)]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = SCALE, longest: int = HEAD) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest whole inner products of each query row."""
    spark = vectors.sparkSession
    rows = store(whole_vectors(vectors, scale), "vectors")
    shape = rows.agg(F.max(F.size("v")), F.count("*")).first()
    dim, n = max(1, shape[0] or 0), shape[1]
    rotation = _rotation(rows, dim)
    first = max(1, dim // 4)
    ordered = store(rows.repartitionByRange(shuffle_partitions(spark), F.col("norm2").desc(), "vec_id").sortWithinPartitions(F.col("norm2").desc(), "vec_id"), "by_length")
    head = store(rows.orderBy(F.col("norm2").desc(), "vec_id").limit(longest), "head") if n > longest else None
    queries = rows.filter(is_query)
    rounds = max(1, -(-queries.count() // (QUERIES * 3 // 4)))
    results = []
    for r in range(rounds):
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).select("vec_id", "v").toArrow()
        ids = block.column("vec_id").to_numpy()
        q = _matrix(block.column("v").combine_chunks(), dim) if len(ids) else np.zeros((0, dim))
        floor = np.full(len(ids), -np.inf)
        if head is not None:
            shared = spark.sparkContext.broadcast((ids, q, floor))
            top = _ranked(head.select("vec_id", "v").mapInArrow(_scorer(shared, dim, rotation, k, first), RESULT), k)
            kth = {x[0]: x[1] for x in top.filter(F.col("rank") == k).select("query_id", "score").collect()}
            floor = np.array([float(kth.get(i, -np.inf)) for i in ids])
        shared = spark.sparkContext.broadcast((ids, q, floor))
        found = ordered.select("vec_id", "v").mapInArrow(_scorer(shared, dim, rotation, k, first), RESULT)
        results.append(_ranked(found, k).select("query_id", "rank", "vec_id", "score"))
    return reduce(DataFrame.unionByName, results)
