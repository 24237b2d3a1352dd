"""Best-fit packing by bin completion (op8).

Every document is its token ids and an end id; documents longer than a sequence
are cut into full pieces and a rest. Full pieces are sequences by themselves.
The others are dealt by hash into groups of about ``GROUP`` pieces and each
group is packed on its own: best-fit decreasing gives the first incumbent; if
it needs more sequences than the bound of sizes allows, a depth-first search
takes the largest piece left, enumerates undominated fillings of the room
around it, the fullest first, and prunes by the waste that an improvement may
still have. Of equally full ones, that whose smallest piece is largest comes
first, so that small pieces stay for the last bins. Every bin level of the
search has its own part of the ``STEPS`` of a group; where one is used up, the
levels above go on with theirs, and the best packing found stays.

A group's last sequences may be part-filled, so the result exceeds the bound by
at most about one sequence per ``GROUP`` pieces.

Defined cases: null or empty text is the end id alone; a null doc_id is packed
like any; repeated rows are packed as often as they stand there; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import store
from vigil.llm.tokens import worker_ids

CAPACITY = 4096
GROUP = 4096
STEPS = 200_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of positions in ``sizes``."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


def bound(sizes: list[int], capacity: int) -> int:
    """Least number of bins: the sum, and pieces above a half with what can't join them, over all thresholds.

    With pieces below a threshold t left out, pieces above capacity - t stand
    alone, and the others above a half offer what room they leave to the rest.
    """
    ordered = sorted(sizes)
    sums = [0, *accumulate(ordered)]
    half = bisect_right(ordered, capacity // 2)  # pieces from here on are above a half
    best = -(-sums[-1] // capacity)
    for at in range(half):
        t = ordered[at]
        if at and t == ordered[at - 1]:
            continue
        alone = bisect_right(ordered, capacity - t, half)
        room = (alone - half) * capacity - (sums[alone] - sums[half])
        best = max(best, len(ordered) - half + max(0, -(-(sums[half] - sums[at] - room) // capacity)))
    return max(best, len(ordered) - half)


class _Search:
    """Bin completion over the multiset of sizes."""

    def __init__(self, sizes, capacity, incumbent, least, steps):
        self.capacity, self.least = capacity, least
        self.best, self.total = incumbent, sum(sizes)
        self.values = sorted(set(sizes), reverse=True)
        self.left = {v: 0 for v in self.values}
        for s in sizes:
            self.left[s] += 1
        self.share = -(-steps // incumbent)
        self.spent = [0] * incumbent  # steps by bin level
        self.waste = 0
        self.ended = False  # a level's steps ran out
        self.answer = None

    def _over(self, level: int) -> bool:
        self.spent[level] += 1
        if self.spent[level] <= self.share:
            return False
        self.ended = True
        return True

    def _allowed(self) -> int:
        """Waste that the bins still to fill may have in an improvement."""
        return (self.best - 1) * self.capacity - self.total - self.waste

    def _sums(self, values, room: int) -> list[int]:
        """By index, the sums up to ``room`` of the sizes from there on, as bits."""
        bits, mask = 1, (2 << room) - 1
        out = [bits]
        for v in reversed(values):
            n, k = min(self.left[v], room // v), 1
            while n > 0:
                take = min(k, n)
                bits |= bits << take * v & mask
                n -= take
                k *= 2
            out.append(bits)
        out.reverse()
        return out

    def fillings(self, room: int, level: int):
        """Undominated sets of sizes for ``room``, as (size, number) pairs: the fullest first, one at a time, while the waste is allowed."""
        values = [v for v in reversed(self.values) if self.left[v] and v <= room]
        sums = self._sums(values, room)

        def choices(k: int, rest: int):
            """Smallest size in use and its number, the largest size first; each leads to a filling."""
            for j in range(bisect_right(values, rest) - 1, k - 1, -1):
                v = values[j]
                for n in range(1, min(self.left[v], rest // v) + 1):
                    if sums[j + 1] >> rest - n * v & 1:
                        yield j, n

        def put(chosen, sign: int):
            for v, n in chosen:
                self.left[v] -= sign * n

        target = sums[0].bit_length() - 1
        while room - target <= self._allowed():
            chosen, rest = [], target
            if not target and not self._dominated(chosen, room):
                yield ()
            open_ = [choices(0, target)] if target else []
            while open_:
                if self._over(level):
                    put(chosen, -1)
                    return
                step = next(open_[-1], None)
                if step is None:
                    open_.pop()
                else:
                    j, n = step
                    self.left[values[j]] -= n
                    chosen.append((values[j], n))
                    rest -= n * values[j]
                    if rest:
                        open_.append(choices(j + 1, rest))
                        continue
                    if not self._dominated(chosen, room - target):
                        put(chosen, -1)
                        sums.clear()  # many levels wait at a time
                        yield tuple(chosen)
                        sums += self._sums(values, room)
                        put(chosen, 1)
                        if room - target > self._allowed():
                            put(chosen, -1)
                            return
                if chosen:
                    v, n = chosen.pop()
                    self.left[v] += n
                    rest += n * v
            if not target:
                return
            target = (sums[0] & (1 << target) - 1).bit_length() - 1

    def _dominated(self, chosen, room: int) -> bool:
        """A size that is left would go into ``room``, or one chosen size could give way to a larger one that is left."""
        for v in (0, *(v for v, _ in chosen)):
            for j in range(bisect_left(self.values, -v - room, key=lambda x: -x), len(self.values)):
                w = self.values[j]
                if w <= v:
                    break
                if self.left[w]:
                    return True
        return False

    def run(self):
        """Depth first without recursion: a deep stack of bins, each with its untried fillings."""
        stack = []

        def open_bin():
            top = next((v for v in self.values if self.left[v]), None)
            if top is None:
                return None
            self.left[top] -= 1
            return [top, self.fillings(self.capacity - top, len(stack)), None, 0]

        frame = open_bin()
        while frame is not None or stack:
            if frame is None:  # all sizes placed: an improvement, as the prune let it through
                self.best = len(stack)
                self.answer = [(top, *(v for v, n in fill for _ in range(n))) for top, _, fill, _ in stack]
                if self.best <= self.least:
                    return
                frame = stack.pop()
                self._undo(frame)
            fill = next(frame[1], None)
            if fill is None:
                self.left[frame[0]] += 1
                if not stack:
                    return
                frame = stack.pop()
                self._undo(frame)
                continue
            for v, n in fill:
                self.left[v] -= n
            frame[2], frame[3] = fill, self.capacity - frame[0] - sum(v * n for v, n in fill)
            self.waste += frame[3]
            stack.append(frame)
            frame = open_bin()

    def _undo(self, frame) -> None:
        self.waste -= frame[3]
        for v, n in frame[2]:
            self.left[v] += n


def pack(sizes: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Bins of positions in ``sizes``, each within ``capacity``."""
    bins = best_fit(sizes, capacity)
    least = bound(sizes, capacity)
    if len(bins) <= least:
        return bins
    search = _Search(sizes, capacity, len(bins), least, steps)
    search.run()
    if search.answer is None:
        return bins
    places: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        places.setdefault(s, []).append(i)
    return [[places[s].pop() for s in filling] for filling in search.answer]


def pieces(docs: DataFrame, vocabulary_json: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's pieces."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_json)

    def cut(batches):
        import zlib

        import pyarrow as pa

        words, end, step = worker_ids(vocabulary.value), end_id.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            cols = ([], [], [], [], [])
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = memoryview(words.text(text) + end)
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at:at + step]
                    for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_packing(docs: DataFrame, vocabulary_json: str, end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = store(pieces(docs, vocabulary_json, end_id, capacity).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    full = rows.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("long"))
    rest = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def place(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rid", ignore_index=True)
        lengths = pdf["length"].tolist()
        ids, offsets = [0] * len(lengths), [0] * len(lengths)
        first = int(pdf["group"].iloc[0]) << 24
        for k, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                ids[i], offsets[i] = first + k, at
                at += lengths[i]
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"],
                             "ids_crc32": pdf["ids_crc32"], "sequence_id": ids, "offset": offsets})

    rest = rest.withColumn("group", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    packed = rest.groupBy("group").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(full.drop("rid"))
