"""Merkle manifest of a dataset by nested-struct rollup (op12).

Leaves get their rank inside their source. The rank's base-16 digit columns are
grouped away one after the other inside blocks of ``WIDTH ** DIGITS`` leaves:
each step collects a run's nodes as an array of structs, hashes it, and becomes
a node that holds its children nested. One shuffle on (source, block) serves all
steps. Blocks of a source with several are the nodes of a next, 256 times
smaller layer, and so on; the sources' subroots are a forest of their own kind.

Going down, a transform over each nested block writes every child's path (what
stands left and right of it, level by level) and an explode turns the children
into rows. A block's own path comes down by grouping it with its block, so that
no proof needs a join. No row holds more than one block, whatever the data.

Defined cases: a null source is a source and comes first; null values are
hashed as ``-``; null doc_ids come first inside their source; equal doc_ids are
ordered by their leaf's hash, so rows repeated whole are interchangeable; a
lone leaf is its subroot and has the hash of nothing as proof; a null doc_id
counts as empty text for the tampering; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import fold, shuffle_partitions, store

WIDTH = 16
DIGITS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def measured(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column | None = None, fields=FIELDS) -> Column:
    """H of a row; ``text`` in place of its column text."""
    return F.sha2(F.concat(*[measured(text if text is not None and f == "text" else F.col(f)) for f in fields]), 256)


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with ``rank`` (from 0) inside their group and ``n``, the group's size.

    Range partitions are counted per group and the counts summed up, so a group
    of any size is ranked by many tasks.
    """
    keys = [group, *order, "salt"]
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # rows repeated whole need not share a range
    rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *[F.col(k).asc_nulls_first() for k in keys])
    rows = store(rows.withColumn("part", F.spark_partition_id()), f"{name}-ranged")
    by_group = W.partitionBy(group)
    counts = rows.groupBy(group, "part").agg(F.count("*").alias("rows"))
    ahead = F.sum("rows").over(by_group.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = store(counts.select(group, "part", F.coalesce(ahead, F.lit(0)).alias("ahead"), F.sum("rows").over(by_group).alias("n")), f"{name}-counts")
    inside = W.partitionBy(group, "part").orderBy(*[F.col(k).asc_nulls_first() for k in keys[1:]])
    rows = rows.join(counts, [group, "part"]).withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1)
    return rows.drop("part", "ahead", "salt")


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _rolled_up(nodes: DataFrame, name: str) -> DataFrame:
    """One row per block of a group: grp, block, n, hash, tree (children with children nested).

    ``nodes``: grp, rank, n, hash, item.
    """
    per = WIDTH ** DIGITS
    digits = [F.expr(f"cast(rank div {WIDTH ** k} % {WIDTH} as int)").alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select("grp", "n", F.expr(f"rank div {per}").alias("block"), *digits, "hash", F.col("item").alias("below"))
    rows = rows.repartition("grp", "block")  # all steps below find their rows together
    for k in range(DIGITS):
        keep = ["grp", "block", "n", *[f"d{j}" for j in range(k + 1, DIGITS)]]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "hash", "below")))
        rows = rows.groupBy(*keep).agg(kids.alias("below"))
        hashes = F.transform("below", lambda x: x["hash"])
        # a lone node of the whole group is what remains; a lone node of a last run is hashed all the same
        rows = rows.withColumn("hash", F.when(F.col("n") > WIDTH ** k, F.sha2(_joined(hashes), 256)).otherwise(hashes[0]))
    return store(rows.withColumnRenamed("below", "tree"), f"{name}-blocks")


def _layers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of the nodes, blocks of those blocks, ... until every group is one block."""
    per, out = WIDTH ** DIGITS, []
    while True:
        blocks = _rolled_up(nodes, f"{name}{len(out)}")
        out.append(blocks)
        several = blocks.filter(F.col("n") > per)
        if several.isEmpty():
            return out
        nodes = several.select("grp", F.col("block").alias("rank"), F.expr(f"(n + {per - 1}) div {per}").alias("n"), "hash", F.lit(None).cast("int").alias("item"))


def _tops(layers: list[DataFrame]) -> DataFrame:
    """grp, layer and the hash that remains of each group."""
    return reduce(DataFrame.unionByName, [b.filter(F.col("n") <= WIDTH ** DIGITS).select("grp", F.lit(k).alias("layer"), "hash") for k, b in enumerate(layers)])


def _children(kids: Column, n: Column, level: int, above: Column) -> Column:
    """(digits, item, path) of all leaves of a nested node; ``above`` is the node's own path."""

    def path(i):
        hashes = F.transform(kids, lambda x: x["hash"])
        step = F.struct(_joined(F.slice(hashes, F.lit(1), i)).alias("left"), _joined(F.slice(hashes, i + 2, F.lit(WIDTH))).alias("right"))
        return F.concat(F.when(n > WIDTH ** level, F.array(step)).otherwise(F.array().cast(_STEPS)), above)

    if level == 0:
        return F.transform(kids, lambda kid, i: F.struct(kid["digit"].cast("long").alias("place"), kid["below"].alias("item"), path(i).alias("path")))
    return F.flatten(F.transform(kids, lambda kid, i: F.transform(
        _children(kid["below"], n, level - 1, path(i)),
        lambda c: F.struct((kid["digit"] * WIDTH ** level + c["place"]).alias("place"), c["item"].alias("item"), c["path"].alias("path")))))


def _exploded(layers: list[DataFrame], paths: DataFrame, extra: list[str], name: str) -> DataFrame:
    """grp, rank, item, path and ``extra`` of every node; ``paths``: grp, layer, path, extra of every group."""
    per, entering = WIDTH ** DIGITS, None
    for k in reversed(range(len(layers))):
        own = paths.filter(F.col("layer") == k).select("grp", F.lit(0).cast("long").alias("block"), "path", *extra)
        entering = own if entering is None else own.unionByName(entering)
        kind = layers[k].schema
        both = layers[k].select("grp", "block", "n", "tree", F.lit(None).cast(_STEPS).alias("path"), *[F.lit(None).cast(paths.schema[c].dataType).alias(c) for c in extra])
        both = both.unionByName(entering.select("grp", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(kind["tree"].dataType).alias("tree"), "path", *extra))
        blocks = both.repartition("grp", "block").groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "path", *extra)])
        kids = blocks.select("grp", "block", *extra, F.explode(_children(F.col("tree"), F.col("n"), DIGITS - 1, F.col("path"))).alias("kid"))
        rows = kids.select("grp", (F.col("block") * per + F.col("kid.place")).alias("rank"), "kid.item", "kid.path", *extra)
        if k:
            entering = store(rows.select("grp", F.col("rank").alias("block"), "path", *extra), f"{name}{k}-paths")
    return rows


def manifest(docs: DataFrame, changed_text: Column | None = None, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, leaf, changed, subroot, root, path of every row.

    ``path`` has for each level, from the leaf up, the hashes left and right of
    the node on the way; ``changed`` is the leaf's hash with ``changed_text``
    in place of its text (null without one).
    """
    # "-" sorts before "=", so a null source comes first, and names bytewise
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    changed = F.lit(None).cast("string") if changed_text is None else leaf_hash(changed_text)
    leaves = docs.select(key.alias("grp"), F.col(doc_id).alias("doc_id"), leaf_hash().alias("hash"), changed.alias("changed"))
    leaves = ranked(leaves, "grp", ["doc_id", "hash"], "leaves")
    layers = _layers(leaves.select("grp", "rank", "n", "hash", F.struct("doc_id", F.col("hash").alias("leaf"), "changed").alias("item")), "leaves")
    tops = store(_tops(layers), "subroots")
    sources = tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "layer", "hash")
    sources = ranked(sources, "grp", ["name"], "sources")
    source_layers = _layers(sources.select("grp", "rank", "n", "hash", F.struct("name", "layer", "hash").alias("item")), "sources")
    root = _tops(source_layers).select("grp", "layer", F.array().cast(_STEPS).alias("path"), F.col("hash").alias("root"))
    of_sources = _exploded(source_layers, root, ["root"], "sources")
    paths = of_sources.select(F.col("item.name").alias("grp"), F.col("item.layer").alias("layer"), "path", F.col("item.hash").alias("subroot"), "root")
    rows = _exploded(layers, store(paths, "source-paths"), ["subroot", "root"], "leaves")
    return rows.select("item.doc_id", "item.leaf", "item.changed", "subroot", "root", "path")


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf's hash and its path lead to."""
    return F.aggregate(path, start, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof_hash(path: str = "path") -> Column:
    return F.sha2(_joined(F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


def audited(docs: DataFrame, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Manifest digests, and proofs folded from leaves of which a fifth (by id) has its text lower-cased."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(docs, F.when(fold(doc_id, 5) == 0, lower).otherwise(F.col("text")), source, doc_id)
    found = rows.select("doc_id", "leaf", "subroot", "root", proof_hash().alias("proof_sha256"), folded(F.col("changed")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
