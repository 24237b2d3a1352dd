"""Near duplicates by word n-gram Jaccard with adaptive multi-match prefixes (op1).

A document is the set of its distinct n-word shingles as 64-bit hashes. All sets
are sorted by one order of tokens, the estimated document frequency first. If two
sets overlap enough, their prefixes of length |x| - overlap + l share at least l
tokens, for every l. Each document picks its own l, from 1 to ``MOST_SHARED``, by
the estimated cost of its candidates: a longer prefix meets more documents, but
asks each of them for more shared tokens before verification. Two documents are
held to the smaller l of both, and only tokens inside the prefixes that their two
lengths call for are counted.

Equal sets are one vertex. To keep large groups of near copies from turning into
all their pairs, each token first offers only the pairs with its most central
document; what these link is a component, and only pairs across components
follow. Pairs that pass are verified on the whole sets, read again from the
texts. So no link is lost, and copies are not expanded into pairs.

Frequencies come from a count sketch over all documents: ``2 ** SKETCH_BITS``
counters, whatever the corpus; they only order tokens, so an estimate can cost
time and never a link.

Defined cases: null or empty text, or white space alone, is an empty set, linked
with nothing, its component is its doc_id; rows repeated whole are linked as
copies; a null doc_id belongs to the component of its text, whose id is the
smallest that is not null; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WordHashes, carried, held, store
from vigil.llm.graph import components

WORDS = 5
PERCENT = 80
MOST_SHARED = 8
SKETCH_BITS = 20
SKETCH_PARTS = 64
#: Tasks whose counters meet in one group.
SKETCH_TASKS = 64
#: Partners that one copy of a set is compared with.
HUB_PARTNERS = 256
#: Vertices whose ids are broadcast to read their texts again; beyond it the texts are shuffled.
BROADCAST_IDS = 2_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than a shingle are one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) < words:
        import xxhash

        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=words)], dtype=np.uint64)
    hashes = held("words", "hashes", None, WordHashes)
    h = np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w))
    n = len(h) - words + 1
    s = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):  # each place has its own multiplier
            s += (h[i:i + n] + np.uint64(i)) * _MIX[i % 5] ^ (h[i:i + n] >> np.uint64(31 - i % 7))
        s ^= s >> np.uint64(29)
        s *= _MIX[4]
        s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Document frequencies by hash slot over all documents; tasks send their counters in parts."""
    size = (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH_BITS, dtype="<i8")
        for b in batches:
            held, n = [], 0
            for text in b.column("text").to_pylist():
                held.append(_slots(shingle_set(text, words)))
                n += len(held[-1])
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
        task = TaskContext.get().partitionId()
        parts = [total[p * size:(p + 1) * size].tobytes() for p in range(SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([task] * SKETCH_PARTS, pa.int32()), pa.array(parts, pa.binary())],
                                         ["part", "task", "counts"])

    def add(pdf):
        import pandas as pd

        total = np.zeros(size, dtype="<i8")
        for c in pdf["counts"]:
            total += np.frombuffer(c, "<i8")
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "task": pdf["task"].iloc[:1] // SKETCH_TASKS, "counts": [total.tobytes()]})

    kind = "part int, task int, counts binary"
    rows = docs.select("text").mapInArrow(count, kind)
    while True:  # SKETCH_TASKS counters are added up at a time, however many tasks there are
        rows = store(rows.groupBy("part", F.expr(f"task div {SKETCH_TASKS}")).applyInPandas(add, kind), "sketch")
        if not rows.agg(F.max("task")).first()[0]:
            break
    out = np.zeros((SKETCH_PARTS, size), dtype=np.int64)
    for r in rows.collect():  # SKETCH_PARTS rows, 8 MB in all
        out[r[0]] = np.frombuffer(r[2], "<i8")
    return out.ravel()


def prefix(s: np.ndarray, sketch: np.ndarray, noise: float, percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """(tokens that must be shared, prefix tokens in the common order) of a set."""
    n = len(s)
    df = np.maximum(sketch[_slots(s)] - int(noise), 1)
    order = np.argsort(df, kind="stable")  # the set is sorted by hash, which breaks ties
    same_length = n + (-2 * percent * n // (100 + percent))  # n - ceil(2tn / (1 + t)): partners of any length from n up
    any_length = n + (-percent * n // 100)
    most = max(1, min(MOST_SHARED, n - same_length))
    met = np.cumsum(df[order[:same_length + most]] - 0.9)  # documents met by prefixes of each length
    shared = np.arange(1, most + 1)
    cost = met[same_length + shared - 1] * (1 + 4.0 / shared)  # reading them, and verifying those that share enough
    level = int(shared[np.argmin(cost)])
    return level, s[order[:min(n, any_length + level)]]


def records(docs: DataFrame, sketch: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, sig1, sig2, level and prefix of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((sketch, float(sketch.sum()) / len(sketch)))

    def measure(batches):
        import pyarrow as pa

        counts, noise = shared.value
        for b in batches:
            n, one, two, levels, sizes, tokens = [], [], [], [], [0], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, words)
                a, c = signature(s)
                level, p = prefix(s, counts, noise, percent) if len(s) else (0, s)
                n.append(len(s))
                one.append(a)
                two.append(c)
                levels.append(level)
                sizes.append(sizes[-1] + len(p))
                tokens.append(p)
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(levels, pa.int32()), lists],
                ["doc_id", "n", "sig1", "sig2", "level", "prefix"])

    return store(docs.mapInArrow(measure, "doc_id long, n long, sig1 long, sig2 long, level int, prefix array<long>"), "shingles")


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(a, b), a the longer set, that share enough tokens inside the prefixes their lengths call for."""
    a, b = left.alias("a"), right.alias("b")
    overlap = f"(({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent})"
    level = "least(a.level, b.level)"
    both = a.join(b, F.expr(
        f"a.token = b.token and a.v <> b.v and a.component <> b.component"
        f" and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"
        f" and a.pos <= a.n - {overlap} + {level} and b.pos <= b.n - {overlap} + {level}"
        + (" and (a.n > b.n or (a.n = b.n and a.v < b.v))" if left is right else "")))
    longer = "(a.n > b.n or (a.n = b.n and a.v < b.v))"
    both = both.select(F.expr(f"if({longer}, a.v, b.v)").alias("a"), F.expr(f"if({longer}, b.v, a.v)").alias("b"), F.expr(level).alias("level"))
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("level").alias("level")).filter("shared >= level").select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity; sets are read again from the texts."""
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    ends = store(ends.join(nodes.select("v", "doc_id", "sig1", "sig2"), "v"), "ends")
    ids = ends.select("doc_id").distinct()
    ids = F.broadcast(ids) if ends.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select("text")

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            found = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            sig = [signature(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sig], pa.int64()), pa.array([x[1] for x in sig], pa.int64()),
                                              pa.array([s.tobytes() for s in found], pa.binary())], ["sig1", "sig2", "tokens"])

    tokens = texts.mapInArrow(sets, "sig1 long, sig2 long, tokens binary").dropDuplicates(["sig1", "sig2"])
    tokens = store(tokens.join(ends.select("v", "sig1", "sig2"), ["sig1", "sig2"]).select("v", "tokens"), "sets")
    # the end with more pairs is the hub: its set goes once to every HUB_PARTNERS of its partners, theirs once to each hub
    met = store(pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("met")), "met")
    sized = pairs.join(met.select(F.col("v").alias("a"), F.col("met").alias("met_a")), "a").join(met.select(F.col("v").alias("b"), F.col("met").alias("met_b")), "b")
    first = F.col("met_a") >= F.col("met_b")
    sized = sized.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"),
                         F.greatest("met_a", "met_b").alias("met"), "a", "b")
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("v"), F.ceil(F.col("met") / HUB_PARTNERS)))
    partners = sized.join(tokens, "v").select("hub", "chunk", "v", "a", "b", "tokens")
    hubs = sized.select("hub", "chunk").distinct().join(tokens.withColumnRenamed("v", "hub"), "hub")
    none = F.lit(None).cast("long")
    both = partners.unionByName(hubs.select("hub", "chunk", none.alias("v"), none.alias("a"), none.alias("b"), "tokens"))
    both = both.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("v").asc_nulls_first())

    def check(batches):
        import pyarrow as pa

        hub = None
        for batch in batches:
            a, b, linked = [], [], []
            for x, y, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tokens")):
                t = np.frombuffer(t.as_buffer(), np.uint64)
                if x is None:  # the hub's own row comes before its partners'
                    hub = t.copy()
                    continue
                n = len(np.intersect1d(hub, t, assume_unique=True))
                a.append(x)
                b.append(y)
                linked.append(100 * n >= percent * (len(hub) + len(t) - n))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return store(both.select("a", "b", "tokens").mapInArrow(check, "a long, b long, linked boolean"), "verified")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = records(docs, frequency_sketch(docs, words), words, percent)
    # equal sets are one vertex, with the prefix of its first document
    nodes = rows.filter("n > 0").groupBy("sig1", "sig2", "n").agg(F.min(F.struct("doc_id", "level", "prefix")).alias("first"), F.min("doc_id").alias("least_id"))
    nodes = store(nodes.select(F.monotonically_increasing_id().alias("v"), "sig1", "sig2", "n", "first.doc_id", "first.level", "first.prefix", "least_id"), "nodes")
    postings = nodes.select("v", "n", "level", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    frequent = store(postings.groupBy("token").count().filter("count > 1"), "tokens")
    shared = store(postings.join(frequent, "token"), "shared")
    # the most central document of each token: the one whose prefix meets most others
    central = store(shared.groupBy("v").agg(F.sum(F.col("count") - 1).alias("met")), "central")
    shared = store(shared.join(central, "v").withColumn("component", F.col("v")), "postings")
    leaders = shared.groupBy("token").agg(F.max(F.struct("met", "v", "n", "level", "pos", "component")).alias("x")).select("token", "x.*")
    first = store(_pairs(shared, store(leaders, "leaders"), percent), "pairs")
    checked = _verified(first, nodes, docs, words, percent)
    links = checked.filter("linked").select("a", "b")
    grown = store(components(links), "grown").withColumnRenamed("component", "_component")
    shared = shared.drop("component").join(grown, "v", "left").withColumn("component", F.coalesce("_component", "v")).drop("_component", "met", "count")
    shared = store(shared, "labelled")
    mixed = store(shared.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token"), "mixed")
    across = store(shared.join(mixed, "token"), "across")
    second = store(_pairs(across, across, percent).join(checked.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = _verified(second, nodes, docs, words, percent).filter("linked").select("a", "b")
    final = store(components(links.unionByName(more)), "components")
    names = nodes.select("v", "sig1", "sig2", "least_id").join(final, "v", "left").withColumn("component", F.coalesce("component", "v"))
    names = store(names, "names")
    ids = store(names.groupBy("component").agg(F.min("least_id").alias("component_id")), "ids")
    names = store(names.join(ids, "component").select("sig1", "sig2", "component_id"), "named")
    out = rows.select("doc_id", "n", "sig1", "sig2")
    linked = out.filter("n > 0").join(names, ["sig1", "sig2"])
    empty = out.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows whose doc_id names their group, with all their columns; documents without words all stay."""
    kept = near_duplicates(docs, text, doc_id).filter("doc_id <=> component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = carried(docs, doc_id=F.col(doc_id).cast("long"))
    return rows.join(store(kept, "kept"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("row.*")
