"""Byte-level BPE by a minimal acyclic transducer of frequent words (op11).

The frequent words of the corpus, with their token ids as outputs, are compiled
into one automaton: words share their beginnings, ids are emitted as early as
all continuations agree on them, and states with equal futures are one state, so
endings are shared too. Its arrays lie in one file that every executor gets and
its Python workers map into memory. A batch's distinct words walk it all at
once, a byte a step. Words it does not hold are cut by the vocabulary's pattern
and merged by the vocabulary's ranks, so ids are exact whatever the lexicon has.

A text may be cut before every blank that a visible sign follows: no token of
the pattern reaches over such a place, so words can be encoded one by one.

Defined cases: null text counts as empty and has no ids; the vocabulary's
special marks inside a text become their ids, as the vocabulary's library does;
words longer than the lexicon's are merged; a null doc_id and rows repeated whole are
rows like any other; an empty table gives an empty lexicon and no rows; further
columns are ignored, and ids outside the vocabulary fail on decoding.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Remembered, held, store
from vigil.llm.tokens import byte_signs

#: Words in the lexicon at most, the most frequent ones, and the longest of them in bytes.
LEXICON_WORDS = 65_536
LEXICON_BYTES = 64
#: A worker looks at so many characters at a time, and remembers the ids of so many bytes of unseen words.
SLICE_CHARS = 1_000_000
REMEMBERED_BYTES = 24_000_000

#: Fixed value: the published pattern of byte-level vocabularies, with white space named by its Unicode property.
_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Below this sign the installed regex module and the vocabulary's library know the same letters (tests try them all).
_SAME_LETTERS = "՘"
_CUT = re.compile(r" (?=\S)")
_ODD_BLANK = re.compile(r" (?:\s|$)")


class Vocabulary:
    """Ids, merges and special marks of a byte-level BPE vocabulary (its JSON text)."""

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        self._signs = byte_signs()
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special marks that take in their surroundings")
        self.mark = re.compile("(" + "|".join(sorted(map(re.escape, self.marks), key=len, reverse=True)) + ")") if self.marks else None
        self._json, self._words = tokenizer_json, regex.compile(_PATTERN).findall
        library = Tokenizer.from_str(tokenizer_json)
        self._library, self._merges = library.pre_tokenizer, library.model

    @cached_property
    def bytes_of(self) -> list[bytes]:
        return token_bytes(self._json)

    def words(self, piece: str) -> list[str]:
        if max(piece, default="") < _SAME_LETTERS:
            return self._words(piece)
        return [piece[a:b] for _, (a, b) in self._library.pre_tokenize_str(piece)]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word by the vocabulary's merges, lowest rank first."""
        return [t.id for t in self._merges.tokenize(word.decode("latin-1").translate(self._signs))]

    def ids(self, piece: str) -> list[int]:
        """Ids of a text without special marks."""
        return [i for w in self.words(piece) for i in self.merged(w.encode())]


def token_bytes(tokenizer_json: str) -> list[bytes]:
    """The bytes of every id, special marks spelt out: all that decoding needs."""
    spec = json.loads(tokenizer_json)
    vocab, back = spec["model"]["vocab"], {s: b for b, s in byte_signs().items()}
    marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (1 + max([*vocab.values(), *marks.values()]))
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    for token, i in marks.items():
        out[i] = token.encode()
    return out


# ------------------------------------------------------------------ automaton
def compiled(entries: list[tuple[bytes, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of (word, ids), words distinct.

    States are numbered children first; the last one is the start. A state's
    arcs lie together in byte order: 256 bits say which bytes have one.
    """
    entries = sorted(entries)
    outputs: dict[tuple[int, ...], int] = {(): 0}
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def out(ids):
        return outputs.setdefault(ids, len(outputs))

    def shared(lo: int, hi: int, skip: int) -> tuple[int, ...]:
        first = entries[lo][1][skip:]
        n = len(first)
        for k in range(lo + 1, hi):
            other = entries[k][1]
            m = 0
            while m < n and skip + m < len(other) and other[skip + m] == first[m]:
                m += 1
            n = m
            if not n:
                break
        return first[:n]

    def state(lo: int, hi: int, depth: int, skip: int) -> int:
        """State of the words lo..hi, which share ``depth`` bytes and whose first ``skip`` ids are out."""
        final = -1
        if lo < hi and len(entries[lo][0]) == depth:
            final = out(entries[lo][1][skip:])
            lo += 1
        arcs = []
        while lo < hi:
            byte, end = entries[lo][0][depth], lo + 1
            while end < hi and entries[end][0][depth] == byte:
                end += 1
            ids = shared(lo, end, skip)
            arcs.append((byte, out(ids), state(lo, end, depth + 1, skip + len(ids))))
            lo = end
        key = (final, *arcs)
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    start = state(0, len(entries), 0, 0)
    bits = np.zeros((len(states), 4), np.uint64)
    first_arc = np.zeros(len(states), np.int32)
    arc_to, arc_out = [], []
    for s, (_, *arcs) in enumerate(states):
        first_arc[s] = len(arc_to)
        for byte, o, to in arcs:
            bits[s, byte >> 6] |= np.uint64(1) << np.uint64(byte & 63)
            arc_to.append(to)
            arc_out.append(o)
    pool = list(outputs)
    return {
        "start": np.array([start], np.int32), "bits": bits, "first_arc": first_arc, "final": np.array([s[0] for s in states], np.int32),
        "arc_to": np.array(arc_to, np.int32), "arc_out": np.array(arc_out, np.int32),
        "out_start": np.cumsum([0, *map(len, pool)]).astype(np.int32), "out_ids": np.array([i for p in pool for i in p], np.uint32)}


_HEADER = 4096


def saved(arrays: dict[str, np.ndarray], path: str) -> None:
    at, parts = _HEADER, {}
    with open(path, "wb") as f:
        for name, a in arrays.items():
            f.seek(at)
            f.write(a.tobytes())
            parts[name] = (a.dtype.str, a.shape, at)
            at = -(-(at + a.nbytes) // 64) * 64
        f.truncate(at + 64)
        head = json.dumps(parts).encode()
        assert len(head) < _HEADER
        f.seek(0)
        f.write(head.ljust(_HEADER))


class Lexicon:
    """The automaton, mapped from its file."""

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain view; the file stays mapped
        parts = json.loads(bytes(data[:_HEADER]))
        for name, (dtype, shape, at) in parts.items():
            n = int(np.prod(shape)) * np.dtype(dtype).itemsize
            setattr(self, name, data[at:at + n].view(dtype).reshape(shape))
        self.below = np.zeros(self.bits.shape, np.int32)  # arcs in the words of bits before
        self.below[:, 1:] = np.cumsum(np.bitwise_count(self.bits[:, :3]), axis=1)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found (bool), length and ids, one word's ids after the other's, of each word."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        longest = int(min(size.max(initial=0), LEXICON_BYTES))
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        start = np.cumsum(size) - size
        state = np.full(n, self.start[0], np.int32)
        alive = np.nonzero(size <= LEXICON_BYTES)[0]
        state[size > LEXICON_BYTES] = -1
        outs = np.zeros((n, longest + 1), np.int32)
        for depth in range(longest):
            alive = alive[size[alive] > depth]
            if not len(alive):
                break
            byte = text[start[alive] + depth]
            s, part, bit = state[alive], byte >> 6, (byte & 63).astype(np.uint64)
            bits = self.bits[s, part]
            there = (bits >> bit) & np.uint64(1) > 0
            state[alive[~there]] = -1
            alive, s, part, bit, bits = alive[there], s[there], part[there], bit[there], bits[there]
            arc = self.first_arc[s] + self.below[s, part] + np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
            state[alive] = self.arc_to[arc]
            outs[alive, depth] = self.arc_out[arc]
        final = np.where(state >= 0, self.final[state], -1)
        found = final >= 0
        outs[~found] = 0
        outs[found, longest] = final[found]
        lengths = self.out_start[outs + 1] - self.out_start[outs]
        flat, many = self.out_start[outs].ravel(), lengths.ravel()
        return found, lengths.sum(1), self.out_ids[_ranges(flat, many)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then those of the next."""
    some = size > 0
    start, size = start[some].astype(np.int64), size[some]
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


# ------------------------------------------------------------------ encoding
class _Codes(dict):
    """Number of each distinct word of a slice: str in the midst of a text, (str,) at a beginning, int for a special id."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon_path: str):
        self.vocabulary = vocabulary
        self.lexicon = Lexicon(lexicon_path)
        self._seen = Remembered(REMEMBERED_BYTES)

    def _pieces(self, text: str) -> list:
        mark = self.vocabulary.mark
        if mark and mark.search(text):
            out = []
            for part in mark.split(text):
                if part in self.vocabulary.marks:
                    out.append(self.vocabulary.marks[part])
                elif part:
                    out += self._pieces(part)
            return out
        pieces = _CUT.split(text) if _ODD_BLANK.search(text) else text.split(" ")
        pieces[0] = (pieces[0],)
        return pieces

    def _unseen(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids, one word's after the other's, and their number, of words the lexicon does not hold as a whole.

        Their parts may be in it; what is left is merged.
        """
        seen, ids_of = self._seen, {}
        parts = [[p.encode() for p in self.vocabulary.words(w)] for w in words]
        new = [p for p in {p for ps in parts for p in ps} if p not in seen]
        found, size, ids = self.lexicon.look_up(new)
        ids, end = ids.tolist(), 0
        for p, ok, n in zip(new, found.tolist(), size.tolist()):
            if ok:
                ids_of[p] = ids[end:end + n]
                end += n
                continue
            ids_of[p] = merged = self.vocabulary.merged(p)
            if len(p) <= LEXICON_BYTES:
                seen.put(p, merged, len(p) + 8 * len(merged))
        out, sizes = [], []
        for ps in parts:
            before = len(out)
            for p in ps:
                out += ids_of[p] if p in ids_of else seen[p]
            sizes.append(len(out) - before)
        return out, sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids."""
        codes = _Codes()
        at, counts = [], []
        for text in texts:
            pieces = self._pieces(text) if text else []
            counts.append(len(pieces))
            at += map(codes.__getitem__, pieces)
        at, counts = np.array(at, np.int64), np.array(counts, np.int64)
        words = [w if type(w) is int else w[0] if type(w) is tuple else " " + w for w in codes]
        text_at = [i for i, w in enumerate(words) if type(w) is str]
        found, size, ids = self.lexicon.look_up([words[i].encode() for i in text_at])
        sizes = np.ones(len(words), np.int64)
        starts = np.zeros(len(words), np.int64)
        text_at = np.array(text_at, np.int64)
        sizes[text_at], starts[text_at] = size, np.cumsum(size) - size
        missing = text_at[~found]
        extra, extra_size = self._unseen([words[i] for i in missing.tolist()])
        sizes[missing] = extra_size
        starts[missing] = len(ids) + np.cumsum(sizes[missing]) - sizes[missing]
        special = np.array([i for i, w in enumerate(words) if type(w) is int], np.int64)
        starts[special] = len(ids) + len(extra) + np.arange(len(special))
        pool = np.concatenate([ids, np.array([*extra, *(words[i] for i in special.tolist())], np.uint32)])
        ids = pool[_ranges(starts[at], sizes[at])]
        total = np.concatenate([[0], np.cumsum(sizes[at])])
        ends = np.cumsum(counts)
        return ids.astype("<u4"), total[ends] - total[ends - counts]


def slices(texts, most: int = SLICE_CHARS):
    """Runs of consecutive texts of about ``most`` characters, as (first, end)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 8
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _worker_vocabulary(tokenizer_json: str) -> Vocabulary:
    return held("lexicon", "vocabulary", hash(tokenizer_json), lambda: Vocabulary(tokenizer_json))


def _worker_encoder(tokenizer_json: str, name: str) -> Encoder:
    from pyspark import SparkFiles

    vocabulary = _worker_vocabulary(tokenizer_json)
    return held("lexicon", "encoder", (hash(tokenizer_json), name), lambda: Encoder(vocabulary, SparkFiles.get(name)))


# ------------------------------------------------------------------ Spark
def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS, longest: int = LEXICON_BYTES) -> DataFrame:
    """word, n: words of the whole corpus, with the blank before them, down to the count that at most ``most`` words reach.

    Counts are taken in steps of a sixteenth of an octave; words that occur
    once are never frequent.
    """
    words = docs.select(F.explode(F.split(F.col(text), " (?=\\S)")).alias("word")).filter(F.octet_length("word") < longest)
    counts = store(words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"), "word-counts")
    step = F.floor(16 * F.log2(F.col("n")))
    least, total = None, 0
    for s, n in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):  # a thousand steps at most
        total += n
        if total > most:
            break
        least = s
    return counts.filter(F.lit(False) if least is None else step >= least).select(F.concat(F.lit(" "), "word").alias("word"), "n")


_ADDED: set = set()


def lexicon(docs: DataFrame, tokenizer_json: str, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compile the corpus's frequent words; the name of the file that every executor gets."""
    import hashlib

    spark = docs.sparkSession

    def merge(batches):
        import pyarrow as pa

        vocabulary = _worker_vocabulary(tokenizer_json)
        for b in batches:
            words = b.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary()), pa.array([vocabulary.ids(w) for w in words], pa.list_(pa.int32()))], ["word", "ids"])

    rows = frequent_words(docs, text, most).repartition(8).mapInArrow(merge, "word binary, ids array<int>").toArrow()
    entries = sorted(zip(rows.column("word").to_pylist(), map(tuple, rows.column("ids").to_pylist())))
    name = f"vigil-lexicon-{hashlib.sha256(repr(entries).encode()).hexdigest()[:24]}"
    if (spark.sparkContext.applicationId, name) not in _ADDED:  # a name stands for its content
        path = os.path.join(tempfile.mkdtemp(prefix="vigil-lexicon-"), name)
        saved(compiled(entries), path)
        spark.sparkContext.addFile(path)  # the driver hands it to executors, those that join later too
        _ADDED.add((spark.sparkContext.applicationId, name))
    return name


def encoded(docs: DataFrame, tokenizer_json: str, name: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids: every text's ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        import pyarrow as pa

        encoder = _worker_encoder(tokenizer_json, name)
        for b in batches:
            texts = b.column("text").to_pylist()
            for first, end in slices(texts):
                ids, size = encoder.encode(texts[first:end])
                offsets = np.concatenate([[0], np.cumsum(size) * 4]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, end - first), column], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, tokenizer_json: str) -> DataFrame:
    """The rows with a column ``decoded``: the text of their column ``ids``, special marks spelt out."""
    columns = rows.columns

    def run(batches):
        import pyarrow as pa

        of = held("lexicon", "bytes", hash(tokenizer_json), lambda: token_bytes(tokenizer_json)).__getitem__
        for b in batches:
            column = b.column("ids")
            for first in range(0, b.num_rows, 512):
                part = column.slice(first, 512)
                texts = [b"".join(map(of, np.frombuffer(x.as_buffer(), "<u4").tolist())).decode("utf-8", "replace") for x in part]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(first, 512) for c in columns], pa.array(texts, pa.string())], [*columns, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string"
    return rows.mapInArrow(run, schema)
