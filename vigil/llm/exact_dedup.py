"""Exact deduplication by deterministic block naming (op6).

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and numbered; then neighbouring numbers are paired, the distinct pairs
sorted and numbered, and so on, until every text is one (level, number). Two
texts have the same identity if and only if they are the same bytes: numbers
are given to values, never to hashes.

A digest only carries a block's number back to the rows that hold the block,
and only after a check over all distinct blocks that no two share a digest;
else a longer digest, and at last the block itself, takes its place.

Defined cases: null text counts as empty; empty texts are one group; a null
doc_id sorts below every id; rows repeated whole are copies of each other and
one of them stays; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import carried, store

BLOCK_BYTES = 16384
DIGESTS = ("xxhash64({0})", "sha2({0}, 256)", "hex({0})")


def _blocks(text: str, size: int) -> str:
    n = f"greatest(1, cast(ceil(octet_length({text}) / {size}) as int))"
    return f"transform(sequence(0, {n} - 1), i -> substring(cast({text} as binary), i * {size} + 1, {size}))"


def _numbered(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values, sorted inside each shuffle partition, with a unique number each."""
    return values.distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, text_sha256, rid (row number of this run), level, name."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = rows.select(F.explode(F.expr(_blocks("text", block_bytes))).alias("block"))
    named = _numbered(blocks, ["block"])
    # one pass over the texts sorts and numbers the blocks; 64-bit digests first, longer ones if two blocks share one
    for digest in DIGESTS:
        names = store(named.select(F.expr(digest.format("block")).alias("digest"), "name"), "names0")
        if names.groupBy("digest").count().filter("count > 1").isEmpty():
            break
    base = store(
        rows.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("text", 256).alias("text_sha256"),
            F.expr(f"transform({_blocks('text', block_bytes)}, b -> {digest.format('b')})").alias("digests")),
        "rows")
    cur = base.select("rid", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    cur = store(cur.join(names, "digest").select("rid", "n", "pos", "name"), "level0")
    longest = base.agg(F.max(F.size("digests"))).first()[0] or 1
    done, level = [cur.filter("n = 1")], 0
    while longest > 1:  # log2 of the longest text's blocks
        level, longest = level + 1, (longest + 1) // 2
        pairs = cur.filter("n > 1").groupBy("rid", F.expr("(n + 1) div 2").cast("int").alias("n"), F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
            F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        pairs = store(pairs, f"pairs{level}")
        names = store(_numbered(pairs.select("a", "b"), ["a", "b"]), f"names{level}")
        cur = store(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), f"level{level}")
        done.append(cur.filter("n = 1"))
    found = None
    for k, df in enumerate(done):
        part = df.select("rid", F.lit(k).alias("level"), "name")
        found = part if found is None else found.unionByName(part)
    return base.select("rid", "doc_id", "text_sha256").join(found, "rid")


def exact_groups(docs: DataFrame, **args) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: of equal texts the row with the largest doc_id stays."""
    rows = store(identities(docs, **args), "identities")
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size"))
    groups = store(groups, "groups")  # both join sides then have an exchange, and a hot group can be split
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = exact_groups(docs, text=text, doc_id=doc_id).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    kept = store(kept.distinct(), "kept")
    rows = carried(docs, doc_id=F.col(doc_id), text_sha256=F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha")), "left_semi")
    # rows repeated whole (same id, same text) are one row from here on
    return rows.dropDuplicates(["doc_id", "text_sha256"]).select("row.*")
