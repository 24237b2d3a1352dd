"""One-row statistics tables (quantiles, moments) joined back by broadcast.

A statistics table always has exactly one row, so ``crossJoin(broadcast(..))``
is a BroadcastNestedLoopJoin against one row: it keeps the partitioning and
ordering of the big side and never shuffles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# percentile_approx accuracy used for brackets of the exact quantile search
_ACCURACY = 10_000
# values a bracket may hold when it is ranked at last; every search ends with such a bracket
_LAST_VALUES = 1_000


def quantile_exprs(c: str, ps, exact: bool = True, accuracy: int = _ACCURACY) -> list[Column]:
    """Linear-interpolation quantiles (pandas/DuckDB quantile_cont) or approximate."""
    if exact:
        return [F.percentile(F.col(c), F.lit(p)) for p in ps]
    return [F.percentile_approx(F.col(c), F.lit(p), accuracy) for p in ps]


def exact_quantiles(df: DataFrame, targets: dict[str, list[float]], accuracy: int = _ACCURACY) -> dict:
    """Exact linear-interpolation quantiles without holding every distinct value.

    ``percentile`` keeps a count per distinct value and merges them in one final
    task, which does not scale to billions of distinct doubles. Here every pass
    is a scan with map-side partial aggregation, batched over all targets, see
    ``order_statistics``. Returns {(col, p): value}.
    """
    cols = list(targets)
    x = df.select(*cols)
    counts = x.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    keys = set()
    for c in cols:
        n = counts[c]
        for p in targets[c]:
            if n:
                h = (n - 1) * p
                keys |= {(c, int(h // 1)), (c, int(-(-h // 1)))}
    out_k = order_statistics(x, keys, {c: counts[c] for c in cols}, accuracy)
    res = {}
    for c in cols:
        n = counts[c]
        for p in targets[c]:
            if not n:
                res[(c, p)] = None
                continue
            h = (n - 1) * p
            lo_k, hi_k = int(h // 1), int(-(-h // 1))
            a, b = out_k[(c, lo_k)], out_k[(c, hi_k)]
            res[(c, p)] = a + (h - lo_k) * (b - a)
    return res


def order_statistics(x: DataFrame, keys, counts: dict, accuracy: int = _ACCURACY) -> dict:
    """{(col, k): k-th smallest non-null value (0-based)}.

    Each round sketches two values around the rank (``percentile_approx``) and
    counts exactly the rows below, at, between and above them. The rank is at
    one of the two values, which is then the answer however often it occurs, or
    strictly on one side or between, which becomes the next bracket: both values
    leave it, so every round shrinks it, usually by about accuracy / 4. Brackets
    of at most ``_LAST_VALUES`` rows are ranked together in one last aggregate.
    """
    need = {t: {"lo": None, "hi": None, "below": 0, "size": counts[t[0]]} for t in keys}
    out: dict = {}
    while True:
        active = [t for t, st in need.items() if t not in out and st["size"] > _LAST_VALUES]
        if not active:
            break
        d = 2.0 / accuracy
        sketches = []
        for i, t in enumerate(active):
            st = need[t]
            rank = (t[1] - st["below"] + 0.5) / st["size"]
            sketches.append(F.percentile_approx(_inside(t[0], st), [max(0.0, rank - d), min(1.0, rank + d)], accuracy).alias(f"b{i}"))
        marks = x.agg(*sketches).first()
        exprs = []
        for i, t in enumerate(active):
            v, (lo, hi) = _inside(t[0], need[t]), marks[f"b{i}"]
            exprs += [F.count_if(v < lo).alias(f"b{i}"), F.count_if(v == lo).alias(f"l{i}"),
                      F.count_if((v > lo) & (v < hi)).alias(f"m{i}"), F.count_if((v == hi) & (v > lo)).alias(f"h{i}")]
        n = x.agg(*exprs).first()
        for i, t in enumerate(active):
            st, (lo, hi) = need[t], marks[f"b{i}"]
            k = t[1] - st["below"]
            at = [n[f"{c}{i}"] for c in "blmh"]
            if k < at[0]:
                st.update(hi=lo, size=at[0])
            elif k < sum(at[:2]):
                out[t] = lo
            elif k < sum(at[:3]):
                st.update(lo=lo, hi=hi, below=st["below"] + sum(at[:2]), size=at[2])
            elif k < sum(at):
                out[t] = hi
            else:
                st.update(lo=hi, below=st["below"] + sum(at), size=st["size"] - sum(at))
    left = [t for t in need if t not in out]
    if left:
        brackets = list(dict.fromkeys((t[0], need[t]["lo"], need[t]["hi"]) for t in left))
        got = x.agg(*[F.sort_array(F.collect_list(_inside(c, {"lo": lo, "hi": hi}))).alias(f"v{i}") for i, (c, lo, hi) in enumerate(brackets)]).first()
        values = {b: got[f"v{i}"] for i, b in enumerate(brackets)}  # at most _LAST_VALUES each
        for t in left:
            st = need[t]
            out[t] = values[t[0], st["lo"], st["hi"]][t[1] - st["below"]]
    return out


def _inside(c: str, st: dict) -> Column:
    """The column strictly inside the current bracket (NULL outside)."""
    v = F.col(c)
    if st["lo"] is None and st["hi"] is None:
        return v
    inside = F.lit(True)
    if st["lo"] is not None:
        inside = inside & (v > F.lit(st["lo"]))
    if st["hi"] is not None:
        inside = inside & (v < F.lit(st["hi"]))
    return F.when(inside, v)


def kth_smallest(df: DataFrame, c: str, k: int, n: int, accuracy: int = _ACCURACY):
    """k-th smallest (0-based) of the n non-null values of column c."""
    return order_statistics(df.select(c), {(c, k)}, {c: n}, accuracy)[(c, k)]


def moments(df: DataFrame, channels, prefix: str = "") -> DataFrame:
    """Mean and population std per channel: one row (scaler statistics, C8)."""
    aggs = []
    for c in channels:
        aggs += [F.avg(c).alias(f"{prefix}mean_{c}"), F.stddev_pop(c).alias(f"{prefix}std_{c}")]
    return df.agg(*aggs)
