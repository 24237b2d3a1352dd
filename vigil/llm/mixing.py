"""Mixing sources to target weights (op4): Efraimidis-Spirakis order inside token budgets.

Every document gets the exponential key -ln(u) / w, with u a hash of its id and
w its quality weight; smaller keys come first inside a source. A source whose
target is T and whose size is S gives floor(T / S) whole epochs, then the
documents whose running size stays nearest to the rest of T.

The running size is a two-level prefix sum: keys are cut into ranges of about
``rows_per_range`` rows, the ranges' sums are accumulated per source, and only
inside a range are rows sorted. No source, however large, is one task.

Defined cases: null text has size 0 and takes 0; a null source is a source and
sorts last; all sizes 0 gives targets 0; an empty table gives no rows; rows
repeated whole count as often as they stand there; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import WORD_GAP, carried, store

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
ROWS_PER_RANGE = 1024


def words_of(text: str):
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP), "")


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 42) -> DataFrame:
    """doc_id, text_hash, source, size and the sampling key of every row.

    Quality weight: 0.5 + the share of distinct words, so repetitive texts come later.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                       F.col(source).cast("string").alias("source"), words_of(text).alias("words"))
    rows = rows.select("doc_id", "text_hash", "source", F.size("words").cast("long").alias("size"),
                       (0.5 + F.size(F.array_distinct("words")) / F.greatest(F.size("words"), F.lit(1))).alias("weight"))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.withColumn("key", -F.log(unit) / F.col("weight"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per source: its size and target. ``weights`` repeat over sources in code-point order, null last.

    Targets are min(level * weight, most * size) with one level for all, found
    in closed form: sources in order of most * size / weight are capped as long
    as the level left for the rest is above that quotient.
    """
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    src = src.withColumn("level", left / free).withColumn("capped", F.col("level") > F.col("full_at"))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(total)
    return src.select("source", "source_size", F.ceil(F.col("n") / rows_per_range).alias("ranges"),
                      F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken for every row."""
    rows = store(measured(docs, text, doc_id, source, seed), "sizes")
    src = store(targets(rows, weights, share, most), "targets").withColumnRenamed("source", "_source")
    rows = rows.join(src, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    # exp(-key * weight) would be uniform; 1 - exp(-key) keeps the order and spreads rows over the ranges
    rows = rows.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")))
    rows = store(rows.drop("ranges"), "ranged")
    # a null source is a group like any other
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = store(sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"),
                             F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead")), "ranges")
    rows = rows.join(sums, rows["source"].eqNullSafe(F.col("_source")) & (rows["range"] == F.col("_range")))
    inside = W.partitionBy("_source", "_range").orderBy("key", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("start", start).withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("start") + F.col("size") / 2 <= rest) & (F.col("size") > 0) & (F.col("epochs") < most)
    taken = F.col("size") * (F.col("epochs") + F.when(chosen, 1).otherwise(0))
    return rows.select("doc_id", "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **args) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return plan(docs, **args).drop("text_hash")


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **args) -> DataFrame:
    """The rows the mix takes, with all their columns, as often as it takes them."""
    copies = plan(docs, text=text, doc_id=doc_id, **args).filter("taken > 0")
    # rows repeated whole share their copies
    copies = copies.groupBy("doc_id", "text_hash").agg(F.sum(F.expr("taken div size")).cast("int").alias("_copies"))
    copies = store(copies, "copies").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "_copies")
    rows = carried(docs, doc_id=F.col(doc_id), text_hash=F.xxhash64(F.col(text)))
    rows = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    rows = rows.dropDuplicates(["doc_id", "text_hash"])
    return rows.select("row", F.explode(F.sequence(F.lit(1), "_copies"))).select("row.*")
