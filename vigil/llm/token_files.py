"""Token-id files with a shared zstandard dictionary (op3).

Format: a Parquet folder whose rows are chunks of neighbouring documents in
ascending doc_id order. A chunk holds ``payload`` (one zstandard frame per
document, back to back), ``doc_ids``, ``offsets`` (first byte of each frame and
the end), ``n_tokens``, the ``part`` it lies in, ``before`` (ids of this part
ahead of the chunk) and ``dictionary`` (SHA-256 of the dictionary). Ids are
little-endian, 2 bytes each if the vocabulary fits, else 4. The folder
``dictionary`` beside it holds the dictionary itself. One short document costs
its chunk's index and one frame.

The dictionary is trained on the id arrays of at most ``SAMPLE`` documents
(smallest hashes of their ids): on whole arrays cut into ``SLICE_BYTES``, or, of
longer ones, on ``SLICES`` slices spread evenly from begin to end. All documents
are written with it.

Defined cases: null or empty text is the end id alone; a null doc_id comes
first; equal ids stand in the order of a hash of their texts; an empty table
gives no chunks and an empty dictionary; further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import shuffle_partitions
from vigil.llm.tokens import worker_ids

SAMPLE = 1000
#: Of a sampled document, so many evenly spread slices of so many bytes at most; a shorter one is taken whole.
SLICES, SLICE_BYTES = 16, 1024
DICTIONARY_BYTES = 65536
CHUNK_DOCS = 1024
CHUNK_BYTES = 4 << 20
CHUNK = ("part int, before long, first_id long, last_id long, dictionary string, id_bytes int, tokens long, "
         "doc_ids array<long>, offsets array<long>, n_tokens array<int>, payload binary")


def _packed(ids: bytes, id_bytes: int) -> bytes:
    import numpy as np

    return np.frombuffer(ids, "<u4").astype(f"<u{id_bytes}").tobytes()


def _evenly(size: int) -> list[int]:
    """Where the slices of an array of ``size`` bytes begin: all of it, or SLICES spread from its begin to its end."""
    n = -(-size // SLICE_BYTES)
    if n <= SLICES:
        return [k * SLICE_BYTES for k in range(n)]
    return [(size - SLICE_BYTES) * k // (SLICES - 1) // 4 * 4 for k in range(SLICES)]


def train(docs: DataFrame, vocabulary, end_id: int, id_bytes: int) -> bytes:
    """zstandard dictionary from a bounded sample; empty if there is nothing to learn from."""
    import zstandard

    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    picked = docs.join(F.broadcast(ids), "doc_id", "left_semi")

    def arrays(batches):
        import pyarrow as pa

        words = worker_ids(vocabulary.value)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            arrays = [_packed(words.text(t) + end, id_bytes) for t in b.column("text").to_pylist()]
            out = [a[at:at + SLICE_BYTES] for a in arrays for at in _evenly(len(a))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    # texts that share an id are one document here, so that SAMPLE bounds what comes to the driver
    texts = picked.groupBy("doc_id").agg(F.max("text").alias("text")).select("text")
    samples = sorted(bytes(r[0]) for r in texts.mapInArrow(arrays, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return b"".join(sorted(samples))[:DICTIONARY_BYTES]


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def write_tokens(docs: DataFrame, folder: str, vocabulary_json: str, end_id: int, vocabulary_size: int) -> None:
    """Encode every text, append ``end_id`` and write the files under ``folder``."""
    spark = docs.sparkSession
    id_bytes = 2 if max(vocabulary_size, end_id + 1) <= 1 << 16 else 4
    vocabulary = spark.sparkContext.broadcast(vocabulary_json)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    content = train(docs, vocabulary, end_id, id_bytes)
    name = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(name, id_bytes, content)], "dictionary string, id_bytes int, content binary").write.parquet(f"{folder}/dictionary")

    def chunks(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
                            ("dictionary", pa.string()), ("id_bytes", pa.int32()), ("tokens", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
                            ("n_tokens", pa.list_(pa.int32())), ("payload", pa.binary())])
        words, end = worker_ids(vocabulary.value), end_id.to_bytes(4, "little")
        shared = _dictionary(content)
        coder = zstandard.ZstdCompressor(level=3, dict_data=shared) if shared else zstandard.ZstdCompressor(level=3)
        part, before = TaskContext.get().partitionId(), 0
        ids, frames, counts, size = [], [], [], 0

        def flush():
            nonlocal before, ids, frames, counts, size
            offsets, at = [0], 0
            for f in frames:
                at += len(f)
                offsets.append(at)
            total = sum(counts)
            row = {"part": part, "before": before, "first_id": ids[0], "last_id": ids[-1], "dictionary": name, "id_bytes": id_bytes,
                   "tokens": total, "doc_ids": ids, "offsets": offsets, "n_tokens": counts, "payload": b"".join(frames)}
            before += total
            ids, frames, counts, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = words.text(text) + end
                frame = coder.compress(_packed(raw, id_bytes))
                ids.append(doc)
                frames.append(frame)
                counts.append(len(raw) // 4)
                size += len(frame)
                if len(ids) >= CHUNK_DOCS or size >= CHUNK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    ranged = docs.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged.mapInArrow(chunks, CHUNK).write.option("compression", "none").parquet(f"{folder}/tokens")


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked, the ids."""
    chunks = spark.read.schema(CHUNK).parquet(f"{folder}/tokens")
    name, id_bytes, content = spark.read.parquet(f"{folder}/dictionary").first()
    content = bytes(content)

    def documents(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import zstandard

        shared = _dictionary(content)
        coder = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"chunk of doc_id {row['first_id']} was written with another dictionary: {row['dictionary']}")
                start, cols = row["before"], ([], [], [], [], [])
                at = row["offsets"]
                view = memoryview(row["payload"])
                for k, doc in enumerate(row["doc_ids"]):
                    got = np.frombuffer(coder.decompress(view[at[k]:at[k + 1]]), f"<u{id_bytes}").astype("<u4")
                    for c, v in zip(cols, (doc, start, len(got), zlib.crc32(got.tobytes()), got.tolist() if ids else None)):
                        c.append(v)
                    start += len(got)
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array([row["part"]] * len(cols[0]), pa.int32())]
                names = ["doc_id", "rel", "n_tokens", "ids_crc32", "part"]
                if ids:
                    arrays, names = [*arrays, pa.array(cols[4], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    docs = chunks.mapInArrow(documents, "doc_id long, rel long, n_tokens long, ids_crc32 long, part int" + (", ids array<long>" if ids else ""))
    # one row per range partition that was written: bounded by the number of partitions, not by documents
    parts = chunks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    ahead = F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", ahead.alias("ahead"))
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("ahead") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def lookup(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """Ids of one document: the chunk statistics find its chunk, the index its frame."""
    name, id_bytes, content = spark.read.parquet(f"{folder}/dictionary").first()
    content = bytes(content)
    chunks = spark.read.schema(CHUNK).parquet(f"{folder}/tokens").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.expr(f"array_position(doc_ids, {int(doc_id)}L)").cast("int")
    frame = chunks.filter(at > 0).select(F.expr(
        f"substring(payload, cast(element_at(offsets, cast(array_position(doc_ids, {int(doc_id)}L) as int)) as int) + 1, "
        f"cast(element_at(offsets, cast(array_position(doc_ids, {int(doc_id)}L) as int) + 1) - element_at(offsets, cast(array_position(doc_ids, {int(doc_id)}L) as int)) as int))").alias("frame"))

    def decode(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        shared = _dictionary(content)
        coder = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        for b in batches:
            out = [np.frombuffer(coder.decompress(f), f"<u{id_bytes}").astype("int64").tolist() for f in b.column("frame").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["ids"])

    return frame.mapInArrow(decode, "ids array<long>")
