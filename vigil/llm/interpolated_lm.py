"""Deleted-interpolation language model over the whole corpus (op9).

P(w | h) = l0[b] / (V + 1) + l1[b] * c(w) / N + l2[b] * c(h, w) / c(h), where b
is the bucket (powers of two) of the context's count c(h). Counts are exact,
over all training documents. The weights l are learned by expectation
maximisation on held-out counts: the training documents of one fold are scored
with counts of the others, and their tokens gathered into cells of (bucket,
ratio of each estimate to the uniform one), which the iterations run over.

Tokens travel packed. A block is some neighbouring documents of a partition:
their distinct words (64-bit hashes) and each token's place among them. A
block's distinct words and word pairs, as sorted 64-bit keys with their counts,
are cut by key range; all blocks' pieces of a range meet in one task, are
summed, and go back to their blocks. A key stands once per block, whatever its
frequency, so no range is hot; the number of ranges follows the number of keys.
Everything gathered grows with the corpus, nothing of it reaches the driver.

Two words, or pairs, with equal 64-bit hashes would share a count; among 10**9
keys that is expected for none or one, and moves one count.

Defined cases: null or empty text is the end token alone; a null doc_id is in
the fold of empty text; repeated rows count as often as they stand there; with
no training document N and V are 0 and every estimate is the uniform one; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WordHashes, fold, held, store

BLOCK_TOKENS = 1_000_000
RANGE_KEYS = 1_500_000
BUCKETS = 24
#: Cells of the held-out histogram: log-ratio steps of 0.1 natural units, 0 for "not seen".
STEP, CELLS = 0.1, 256
END = 0x9E3779B97F4A7C15
BLOCK = ("block long, held boolean, rows array<struct<doc_id:long,held_out:boolean,n:long>>, vocabulary binary, places binary, "
         "tokens long, n_keys long")


def _zip(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _zip_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences: the high planes are nearly constant."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _zip(d.view(np.uint8).reshape(-1, 8).T)


def _unzip_keys(b: bytes) -> np.ndarray:
    planes = _unzip(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = h * np.uint64(0xC2B2AE3D27D4EB4F) ^ (w + np.uint64(0x165667B19E3779F9)) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
        k *= np.uint64(0xBF58476D1CE4E5B9)
        return k ^ (k >> np.uint64(32))


def blocks(docs: DataFrame, held_parts: int = 10) -> DataFrame:
    """Packed blocks of documents; held-out, EM-fold and other documents go to blocks of their own kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), fold("doc_id", held_parts).cast("int").alias("fold"))

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64())])
        schema = pa.schema([("block", pa.int64()), ("held", pa.bool_()), ("rows", pa.list_(kind)), ("vocabulary", pa.binary()), ("places", pa.binary()),
                            ("tokens", pa.int64()), ("n_keys", pa.int64())])
        part, made = TaskContext.get().partitionId(), 0
        hashes = held("words", "hashes", None, WordHashes)
        open_ = {False: ([], [], 0), True: ([], [], 0)}

        def flush(em):
            nonlocal made
            docs_, arrays, size = open_[em]
            open_[em] = ([], [], 0)
            vocabulary, places = np.unique(np.concatenate(arrays), return_inverse=True)
            places = places.astype("<u4")
            row = {"block": (part << 32) + made, "held": em, "rows": docs_, "vocabulary": vocabulary.astype("<u8").tobytes(),
                   "places": _zip(places.view(np.uint8).reshape(-1, 4).T), "tokens": size, "n_keys": len(vocabulary) + size}
            made += 1
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for doc, text, f in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("fold").to_pylist()):
                words = (text or b"").lower().split()
                h = np.empty(len(words) + 1, dtype=np.uint64)
                h[:-1] = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
                h[-1] = END
                em = f == 1  # the fold whose counts are held out while the weights are learned
                d, a, size = open_[em]
                d.append({"doc_id": doc, "held_out": f == 0, "n": len(h)})
                a.append(h)
                open_[em] = (d, a, size + len(h))
                if size + len(h) >= BLOCK_TOKENS:
                    yield flush(em)
        for em in (False, True):
            if open_[em][0]:
                yield flush(em)

    return store(rows.mapInArrow(gather, BLOCK), "lm-blocks")


class _Block:
    """A block's tokens as sorted distinct keys of words and of pairs, with counts of its training tokens."""

    def __init__(self, row):
        vocabulary = np.frombuffer(row["vocabulary"], "<u8").astype(np.uint64)
        planes = _unzip(row["places"], np.uint8).reshape(4, -1)
        self.places = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        self.words = vocabulary
        self.n = np.array([r["n"] for r in row["rows"]], dtype=np.int64)
        self.start = np.cumsum(self.n) - self.n
        learns = np.repeat(np.array([not r["held_out"] for r in row["rows"]]), self.n)
        self.word_counts = np.bincount(self.places[learns], minlength=len(vocabulary))
        # the context of a text's first word is the end of another text
        token = vocabulary[self.places]
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.start] = np.uint64(END)
        self.pairs, self.pair_places = np.unique(_pair_keys(context, token), return_inverse=True)
        self.pair_counts = np.bincount(self.pair_places[learns], minlength=len(self.pairs))
        end = np.searchsorted(vocabulary, np.uint64(END))
        self.context_places = np.empty_like(self.places)
        self.context_places[1:] = self.places[:-1]
        self.context_places[self.start] = end


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal key ranges begins in the sorted keys, and the end."""
    edges = [(r << 64) // n for r in range(1, n)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]]).astype(np.int64)


def _send(packed: DataFrame, n_ranges: int) -> DataFrame:
    """One row per block and key range: sorted keys with the block's training counts."""

    def pieces(batches):
        import pyarrow as pa

        schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("held", pa.bool_()), ("pairs", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, out = _Block(row), []
                for pairs, keys, counts in ((False, block.words, block.word_counts), (True, block.pairs, block.pair_counts)):
                    at = _ranges(keys, n_ranges)
                    for r in range(n_ranges):
                        lo, hi = at[r], at[r + 1]
                        if lo < hi:
                            out.append({"range": r, "block": row["block"], "held": row["held"], "pairs": pairs,
                                        "keys": _zip_keys(keys[lo:hi]), "counts": _zip(counts[lo:hi].astype("<u4"))})
                yield pa.RecordBatch.from_pylist(out, schema)

    return packed.mapInArrow(pieces, "range int, block long, held boolean, pairs boolean, keys binary, counts binary")


RETURNED = "block long, range int, pairs boolean, counts binary, kept binary, n_words long, n_tokens long, kept_words long, kept_tokens long"


def _sum_range(pdf):
    """Total counts of a key range, back to each block; blocks of the EM fold also get the counts without that fold.

    The row of block -1 carries the range's number of distinct words and of tokens.
    """
    import pandas as pd

    out, totals = [], [0, 0, 0, 0]
    for pairs, part in pdf.groupby("pairs", sort=True):
        keys = [_unzip_keys(k) for k in part["keys"]]
        counts = [_unzip(c, "<u4").astype(np.int64) for c in part["counts"]]
        held = np.repeat(part["held"].to_numpy(dtype=bool), [len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(counts)
        total = np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)
        kept = np.bincount(place[~held], weights=n[~held], minlength=len(distinct)).astype(np.int64)
        if not pairs:
            totals = [int((total > 0).sum()), int(total.sum()), int((kept > 0).sum()), int(kept.sum())]
        at = 0
        for block, h, k in zip(part["block"], part["held"], keys):
            p = place[at:at + len(k)]
            at += len(k)
            out.append((block, int(part["range"].iloc[0]), bool(pairs), _zip(total[p].astype("<u8")), _zip(kept[p].astype("<u8")) if h else None, 0, 0, 0, 0))
    out.append((-1, int(pdf["range"].iloc[0]), False, None, None, *totals))
    return pd.DataFrame(out, columns=["block", "range", "pairs", "counts", "kept", "n_words", "n_tokens", "kept_words", "kept_tokens"])


def exchange(packed: DataFrame) -> tuple[DataFrame, dict]:
    """Counts of all keys of every block, and the corpus totals."""
    keys = packed.agg(F.sum("n_keys")).first()[0] or 0
    n_ranges = max(1, -(-int(keys) // RANGE_KEYS))
    sums = store(_send(packed, n_ranges).groupBy("range").applyInPandas(_sum_range, RETURNED), "lm-counts")
    t = sums.filter("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "kept_words", "kept_tokens")]).first().asDict()
    return sums.filter("block >= 0"), t


def _joined(rows, counts, column):
    """A block with the counts of its keys put together from its ranges."""
    block = _Block(rows)
    got = {}
    for pairs in (False, True):
        mine = sorted((c for c in counts if c["pairs"] == pairs), key=lambda c: c["range"])
        got[pairs] = np.concatenate([_unzip(c[column], "<u8").astype(np.float64) for c in mine])
    return block, got[False], got[True]


def _estimates(block, words, pairs, n: float, v: float):
    """c(h) and the three estimates per token: uniform, word, pair."""
    c_h = words[block.context_places]
    p0 = 1.0 / (v + 1.0)
    p1 = words[block.places] / max(n, 1.0)
    p2 = np.where(c_h > 0, pairs[block.pair_places] / np.maximum(c_h, 1.0), 0.0)
    return c_h, p0, p1, p2


def _bucket(c_h: np.ndarray) -> np.ndarray:
    return np.where(c_h > 0, np.minimum(np.log2(np.maximum(c_h, 1.0)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _cell(p: np.ndarray, p0: float) -> np.ndarray:
    """Log ratio to the uniform estimate in steps; 0 where the estimate is 0."""
    ratio = np.log(np.maximum(p, 1e-300) / p0) / STEP + CELLS // 4
    return np.where(p > 0, np.clip(ratio, 1, CELLS - 1), 0).astype(np.int64)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, np.exp((cell + 0.5 - CELLS // 4) * STEP), 0.0)


def learn_weights(packed: DataFrame, sums: DataFrame, totals: dict, rounds: int = 60) -> np.ndarray:
    """Mixture weights per bucket by EM over the held-out fold's cells."""
    n, v = float(totals["kept_tokens"]), float(totals["kept_words"])

    def cells(_, left, right):
        import pandas as pd

        if not len(left):
            return pd.DataFrame({"cell": [], "n": []})
        block, words, pairs = _joined(left.iloc[0], right.to_dict("records"), "kept")
        c_h, p0, p1, p2 = _estimates(block, words, pairs, n, v)
        cell = (_bucket(c_h) * CELLS + _cell(p1, p0)) * CELLS + _cell(p2, p0)
        at, k = np.unique(cell, return_counts=True)
        return pd.DataFrame({"cell": at, "n": k})

    held = packed.filter("held").groupBy("block").cogroup(sums.filter("kept is not null").groupBy("block"))
    rows = held.applyInPandas(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS * CELLS ** 2
    weights = np.tile([0.1, 0.3, 0.6], (BUCKETS, 1))
    weights[0] = [0.1, 0.9, 0.0]
    if not rows:
        return weights
    cell, k = np.array(sorted((r[0], r[1]) for r in rows)).T
    b = cell // CELLS**2
    p = np.stack([np.ones(len(cell)), _value(cell // CELLS % CELLS), _value(cell % CELLS)], 1)
    for _ in range(rounds):
        share = weights[b] * p
        share /= share.sum(1, keepdims=True)
        sums_ = np.stack([np.bincount(b, weights=share[:, j] * k, minlength=BUCKETS) for j in range(3)], 1)
        sums_ += 1e-3 * np.array([1.0, 1.0, 0.0])  # no bucket forbids what it has not seen
        total = sums_.sum(1, keepdims=True)
        weights = np.where(total > 1, sums_ / total, weights)
    return weights


def lm_scores(docs: DataFrame, held_parts: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    packed = blocks(docs, held_parts)
    sums, totals = exchange(packed)
    weights = learn_weights(packed, sums, totals)
    n, v = float(totals["n_tokens"]), float(totals["n_words"])
    seen = int(totals["n_tokens"])

    def score(_, left, right):
        import pandas as pd

        row = left.iloc[0]
        block, words, pairs = _joined(row, right.to_dict("records"), "counts")
        c_h, p0, p1, p2 = _estimates(block, words, pairs, n, v)
        w = weights[_bucket(c_h)]
        c = words[block.places]
        model = np.log10(w[:, 0] * p0 + w[:, 1] * p1 + w[:, 2] * p2)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        return pd.DataFrame({
            "doc_id": pd.array([r["doc_id"] for r in row["rows"]], dtype="Int64"), "held_out": [r["held_out"] for r in row["rows"]], "n_tokens": block.n,
            "n_known": np.add.reduceat((c > 0).astype(np.int64), block.start), "train_tokens": np.full(len(block.n), seen),
            "base_score": np.add.reduceat(base, block.start), "score": np.add.reduceat(model, block.start)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(sums.drop("kept").groupBy("block")).applyInPandas(score, schema)
