"""Line-level conditional random field for document quality (op2).

Every non-blank line is good or bad. A linear-chain CRF scores a line from its
own features and those of the lines before and after it, and couples
neighbouring labels. Labels exist for documents only, so the CRF is trained
with a document's label on each of its lines, every document weighing the same.
A document's quality is the mean of its lines' forward-backward marginals,
weighted by line length, passed through a logistic curve fitted on the training
documents.

The CRF is fitted on at most ``TRAINING_DOCS`` labelled documents (smallest
hashes of their ids among those outside the held-out fold); every document is
scored over its whole text.

Defined cases: null, empty or blank text is one line without features; ids
without a document or without a label are not used; several labels of an id
count as one row each; no label at all gives the score 0.5 to every document;
an empty table gives no rows; further columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import carried, fold

TRAINING_DOCS = 2500
ROUNDS = 120
SLICE = 512
UPPER = bytes(range(65, 91))
LETTERS = bytes(range(97, 123)) + UPPER + bytes(range(128, 256))
DIGITS = b"0123456789"
ENDS = b".,;:?'\""
SPACE = b" \t\r\x0b\x0c"
N_FEATURES = 14
WIDTH = 3 * N_FEATURES + 1


def _line(line: bytes, seen: set) -> tuple:
    """Features of one line; shares lie between 0 and 1."""
    n = len(line)
    words = line.split()
    k = len(words) or 1
    visible = max(1, len(line.translate(None, SPACE)))
    upper = n - len(line.translate(None, UPPER))
    digits = n - len(line.translate(None, DIGITS))
    marks = len(line.translate(None, LETTERS + DIGITS + SPACE + ENDS))
    bars = line.count(b"|")
    shouts = line.count(b"!")
    same = sum(a == b for a, b in zip(words, words[1:]))
    again = line in seen
    seen.add(line)
    return (upper / visible, digits / visible, marks / visible, bars / k, shouts / k, same / k, len(set(words)) / k,
            min(visible / k, 30.0) / 10.0, np.log1p(k) / 5.0, float(again), float(k < 4), line.count(b"http") / k,
            line.count(b",") / k, float(line[-1:] in (b".", b"?", b"!", b'"')))


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line features with neighbours, lines per text, line lengths) of a list of byte texts."""
    rows, counts, lengths = [], [], []
    for text in texts:
        seen: set = set()
        lines = [x for x in (text or b"").split(b"\n") if x.strip()]
        rows.extend(_line(x, seen) for x in lines)
        lengths.extend(len(x) for x in lines)
        if not lines:
            rows.append((0.0,) * N_FEATURES)
            lengths.append(1)
        counts.append(max(1, len(lines)))
    own = np.asarray(rows, dtype=np.float64).reshape(-1, N_FEATURES)
    counts, lengths = np.asarray(counts, dtype=np.int64), np.asarray(lengths, dtype=np.float64)
    start = np.cumsum(counts) - counts
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    if len(counts):
        before[start] = 0
        after[start + counts - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))]), counts, lengths


def marginals(emission: np.ndarray, counts: np.ndarray, trans: np.ndarray):
    """Forward-backward over all texts at once: P(good) per line, expected label pairs per text, log partition.

    ``emission`` is the score of "good" against "bad" per line; lines of a text are neighbours.
    """
    start = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    left = counts[order]
    e = np.stack([np.zeros_like(emission), emission], 1)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    longest = int(left[0]) if len(left) else 0
    active = [order[: np.searchsorted(-left, -t, side="left")] for t in range(longest)]  # texts with more than t lines
    for t, docs in enumerate(active):
        at = start[docs] + t
        if t == 0:
            alpha[at] = e[at]
        else:
            prev = alpha[at - 1]
            alpha[at] = e[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
    for t in range(longest - 2, -1, -1):
        docs = active[t + 1]
        at = start[docs] + t
        nxt = e[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    last = start + counts - 1
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1]) if len(counts) else np.zeros(0)
    z = np.repeat(log_z, counts)
    good = np.exp(alpha[:, 1] + beta[:, 1] - z)
    return good, (alpha, beta, e, z), log_z


def _pairs(inner, counts, trans, weight):
    """Expected transitions, each text weighted."""
    alpha, beta, e, z = inner
    start = np.cumsum(counts) - counts
    has = np.ones(len(z), dtype=bool)
    has[start] = False
    at = np.nonzero(has)[0]
    out = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            p = np.exp(alpha[at - 1, a] + trans[a, b] + e[at, b] + beta[at, b] - z[at])
            out[a, b] = (p * weight[at]).sum()
    return out


def fit(x: np.ndarray, counts: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> dict:
    """CRF weights by Adam on the mean log-likelihood, then the logistic curve over document means."""
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-6] = 1.0
    mean[-1], std[-1] = 0.0, 1.0
    x = (x - mean) / std
    y = np.repeat(labels.astype(float), counts)
    weight = np.repeat(1.0 / counts / max(1, len(counts)), counts)
    same = np.array([[((1 - labels) * (counts - 1) / counts).sum(), 0.0], [0.0, (labels * (counts - 1) / counts).sum()]]) / max(1, len(counts))
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, rounds + 1):
        good, inner, _ = marginals(x @ w, counts, trans)
        grads = [x.T @ (weight * (y - good)) - 1e-3 * w, same - _pairs(inner, counts, trans, weight) - 1e-3 * trans]
        for k, p in enumerate((w, trans)):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.99 * v[k] + 0.01 * grads[k] ** 2
            p += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    model = {"mean": mean, "std": std, "w": w, "trans": trans, "curve": (0.0, 1.0)}
    model["curve"] = _curve(_document_means(model, x * std + mean, counts, lengths), labels)
    return model


def _document_means(model, x, counts, lengths) -> np.ndarray:
    """Length-weighted mean marginal per text, as a logit within +-6."""
    good, _, _ = marginals(((x - model["mean"]) / model["std"]) @ model["w"], counts, model["trans"])
    start = np.cumsum(counts) - counts
    p = np.add.reduceat(good * lengths, start) / np.add.reduceat(lengths, start)
    p = np.clip(p, 0.0025, 0.9975)
    return np.log(p / (1 - p))


def _curve(logit: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one number, by Newton steps with a small penalty."""
    a = np.stack([np.ones_like(logit), logit], 1)
    beta = np.array([0.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(h, a.T @ (labels - p) - 1e-2 * (beta - [0.0, 1.0]))
    return float(beta[0]), float(beta[1])


def predict(model: dict | None, texts) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    if not len(texts):
        return np.zeros(0)
    a, b = model["curve"]
    # texts are independent: slices keep the feature matrix small, whatever the size of a batch
    z = np.concatenate([a + b * _document_means(model, *features(texts[i:i + SLICE])) for i in range(0, len(texts), SLICE)])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_DOCS) -> dict | None:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""
    picked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    picked = picked.filter("_id is not null and _label in (0, 1)").filter(fold("_id", 5) != 0)
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"))
    # rows of one id are one document here: the bound on labels bounds what is fitted on
    rows = rows.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.max("_text").alias("_text"))

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            x, counts, lengths = features(b.column("_text").to_pylist())
            ends = np.cumsum(counts)
            xs = [x[e - n:e, :N_FEATURES].ravel().tolist() for e, n in zip(ends, counts)]
            ls = [lengths[e - n:e].tolist() for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_label"), pa.array(xs, pa.list_(pa.float64())), pa.array(ls, pa.list_(pa.float64()))],
                ["_id", "_label", "x", "lengths"])

    got = rows.mapInArrow(measure, "_id long, _label int, x array<double>, lengths array<double>").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r[0], r[1], len(r[3]), r[2]))
    counts = np.array([len(r[3]) for r in got])
    own = np.concatenate([np.asarray(r[2]) for r in got]).reshape(-1, N_FEATURES)
    start = np.cumsum(counts) - counts
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[start], after[start + counts - 1] = 0, 0
    x = np.hstack([own, before, after, np.ones((len(own), 1))])
    return fit(x, counts, np.concatenate([np.asarray(r[3]) for r in got]), np.array([r[1] for r in got], dtype=float))


def _scorer(docs: DataFrame, model: dict | None):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts):
        import pandas as pd

        return pd.Series(predict(shared.value, texts.tolist()))

    return quality


def score(docs: DataFrame, model: dict | None, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the quality score, 0 to 1; a column of that name is replaced."""
    return docs.withColumn(column, _scorer(docs, model)(F.col(text).cast("binary")))


def accepted(docs: DataFrame, model: dict | None, least: float, text: str = "text") -> DataFrame:
    """The rows whose score is ``least`` or more, with all their columns."""
    rows = carried(docs, quality=_scorer(docs, model)(F.col(text).cast("binary")))
    return rows.filter(F.col("quality") >= least).select("row.*")
