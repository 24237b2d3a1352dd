"""Exact quantiles per group by mergeable sketches.

One KLL sketch per group brackets every wanted order statistic; a counting pass
then says, exactly, on which side of the two marks it lies. It is one of the
marks, which ends its search however often that value occurs, or strictly
between or beside them, which is the next bracket, sketched again. Brackets of
at most ``LAST_VALUES`` values are sorted as one array. All passes are partial
aggregates: no group, however large, is gathered, and nothing but a flag per
round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import stored

#: Size of the sketches (a rank error of about 0.1 %), and the even ranks that are read from one: marks stand one beyond the wanted rank's.
SKETCH_K, STEPS = 4096, 512
LAST_VALUES = 1_000


def _mark(grid: str, rank: Column, beyond: int) -> Column:
    """The value ``beyond`` steps from the rank in a sketch's values at even ranks."""
    at = F.floor(rank * STEPS) + (beyond if beyond < 0 else beyond + 1)
    return F.get(F.col(grid), F.least(F.lit(STEPS), F.greatest(F.lit(0), at)).cast("int"))


def _within(lo: Column, hi: Column, v: Column) -> Column:
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def grouped_quantiles(df: DataFrame, group: str, value: str, probs: dict[str, float], k: int = SKETCH_K, last_values: int = LAST_VALUES) -> DataFrame:
    """``group``, ``n`` and one column per name in ``probs``: linearly interpolated quantiles of each group's values.

    NULL and NaN values count nowhere; a group without any has no row. A NULL
    group is a group.
    """
    x = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ranks = {}  # target -> rank (0-based) as a column of n
    for i, p in enumerate(probs.values()):
        ranks[f"{i}a"], ranks[f"{i}b"] = F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)
    sketched = x.groupBy("g").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("whole"))
    none = F.lit(None).cast("double")
    state = sketched.select("g", "n", *[c.alias(f"k{t}") for t, c in ranks.items()], *[none.alias(f"{s}{t}") for t in ranks for s in ("lo", "hi", "answer")],
                            *[F.lit(0).cast("long").alias(f"below{t}") for t in ranks], *[F.col("n").alias(f"size{t}") for t in ranks],
                            *[F.col("whole").alias(f"sketch{t}") for t in ranks])
    state = stored(state, "quantile-state")
    even = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    while True:
        grids = state.select("*", *[
            F.when(F.col(f"answer{t}").isNull(), F.kll_sketch_get_quantile_double(F.col(f"sketch{t}"), even)).alias(f"grid{t}") for t in ranks])
        marks = grids.select("g", *[c for c in state.columns if not c.startswith("sketch") and c != "g"], *[
            _mark(f"grid{t}", (F.col(f"k{t}") - F.col(f"below{t}") + 0.5) / F.col(f"size{t}"), beyond).alias(f"{m}{t}")
            for t in ranks for m, beyond in (("m", -1), ("w", 1))])
        marks = stored(marks, "quantile-marks").withColumnRenamed("g", "_g")
        both = x.join(marks, x["g"].eqNullSafe(F.col("_g")))
        v, counts = F.col("v"), []
        for t in ranks:
            lo, hi, m, w, open_ = (F.col(f"{c}{t}") for c in ("lo", "hi", "m", "w", "answer"))
            inside = open_.isNull() & _within(lo, hi, v)
            counts += [F.count_if(inside & (v < m)).alias(f"c0{t}"), F.count_if(inside & (v == m)).alias(f"c1{t}"),
                       F.count_if(inside & (v > m) & (v < w)).alias(f"c2{t}"), F.count_if(inside & (v == w) & (w > m)).alias(f"c3{t}")]
        counted = stored(both.groupBy("_g").agg(*counts), "quantile-counts").withColumnRenamed("_g", "_c")
        rows = marks.join(counted, F.col("_g").eqNullSafe(F.col("_c"))).drop("_c")
        out = [F.col("_g").alias("g"), "n", *[F.col(f"k{t}") for t in ranks]]
        for t in ranks:
            lo, hi, m, w, answer, below, size = (F.col(f"{c}{t}") for c in ("lo", "hi", "m", "w", "answer", "below", "size"))
            at = F.col(f"k{t}") - below
            c0, c1, c2, c3 = (F.col(f"c{i}{t}") for i in range(4))
            before, on, between, last = at < c0, at < c0 + c1, at < c0 + c1 + c2, at < c0 + c1 + c2 + c3
            out += [F.when(before | answer.isNotNull(), lo).when(on, lo).when(between, m).when(last, lo).otherwise(w).alias(f"lo{t}"),
                    F.when(answer.isNotNull(), hi).when(before, m).when(on, hi).when(between, w).otherwise(hi).alias(f"hi{t}"),
                    F.when(answer.isNotNull(), answer).when(before, none).when(on, m).when(between, none).when(last, w).alias(f"answer{t}"),
                    F.when(before | answer.isNotNull(), below).when(on, below).when(between, below + c0 + c1).when(last, below).otherwise(below + c0 + c1 + c2 + c3).alias(f"below{t}"),
                    F.when(answer.isNotNull(), size).when(before, c0).when(on, size).when(between, c2).when(last, size).otherwise(size - c0 - c1 - c2 - c3).alias(f"size{t}")]
        state = stored(rows.select(*out), "quantile-state").withColumnRenamed("g", "_g")
        wide = [f"(answer{t} is null and size{t} > {int(last_values)})" for t in ranks]
        more = not state.filter(" or ".join(wide)).isEmpty()
        both = x.join(state, x["g"].eqNullSafe(F.col("_g")))
        inside = {t: F.when(F.col(f"answer{t}").isNull() & _within(F.col(f"lo{t}"), F.col(f"hi{t}"), v), v) for t in ranks}
        small = {t: F.when(F.col(f"size{t}") <= last_values, inside[t]) for t in ranks}
        if not more:
            lists = both.groupBy("_g").agg(*[F.sort_array(F.collect_list(small[t])).alias(f"v{t}") for t in ranks]).withColumnRenamed("_g", "_c")
            rows = state.join(lists, F.col("_g").eqNullSafe(F.col("_c"))).drop("_c")
            value_of = {t: F.coalesce(F.col(f"answer{t}"), F.get(F.col(f"v{t}"), (F.col(f"k{t}") - F.col(f"below{t}")).cast("int"))) for t in ranks}
            names = []
            for i, (name, p) in enumerate(probs.items()):
                a, b = value_of[f"{i}a"], value_of[f"{i}b"]
                h = (F.col("n") - 1) * p
                names.append((a + (h - F.floor(h)) * (b - a)).alias(name))
            return rows.select(F.col("_g").alias(group), "n", *names)
        again = both.groupBy("_g").agg(*[F.kll_sketch_agg_double(inside[t], F.lit(k)).alias(f"sketch{t}") for t in ranks]).withColumnRenamed("_g", "_c")
        state = stored(state.join(again, F.col("_g").eqNullSafe(F.col("_c"))).drop("_c").withColumnRenamed("_g", "g"), "quantile-state")
