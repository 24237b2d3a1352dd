"""Toxicity after noisy-channel deobfuscation (op7).

Channel: letters may be written as digits or signs (leetspeak), set apart by
spaces or marks, and repeated. A suspicious stretch - a token with such a sign
or with marks between letters, a run of two or more single characters or of two
or more tokens of at most three over any white space, a letter three times in a
row, or two longer tokens that together begin like a weighted word - becomes a
lattice of readings per character, each with a channel cost
(white space counts as one blank); Viterbi finds the
reading that is most likely under a character trigram model counted over all
documents. The restored words join the text's own words.

Score: words, and their beginnings of 4 to 8 letters, weigh by the log-odds of
toxic against other labelled documents, where these are surely above chance; a
logistic curve over a document's
strongest words and their number gives the score.

The word weights and the curve are fitted on at most ``TRAINING_DOCS`` labelled
documents (smallest hashes of their ids among those outside the held-out fold);
the character model counts every document, and every text is scored whole.

Defined cases: null or empty text has no words and scores as such; ids without
a document or a label are not used; no label at all, or labels of one kind,
give 0.5, or near that kind, to every document; an empty table gives no rows;
further columns pass through untouched, but for
one named like the score, which is replaced.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WORKER_BYTES, Remembered, fold, held, store

TRAINING_DOCS = 20000
#: A word weighs if so many toxic documents have it, and its log-odds are above 1 by so many standard errors.
LEAST_DOCS, SURE = 3, 2.5
#: Of words cut in two, the weighted part that goes over the cut has so many letters at least.
CUT_LETTERS = 5
#: What a sign may stand for, and its channel cost.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y"}
GAPS = " \t\n\r\x0b\x0c.-_*~'`^,:/"
COST_LEET, COST_GAP, COST_BREAK, COST_REPEAT, COST_KEPT = 1.0, 0.3, 2.5, 0.3, 6.0
#: Character classes: 0 no letter, 1 other letter, 2-27 a to z, 28 on the letters of U+00DF to U+00FF.
N_CLASSES = 61
#: A sign that may stand for a letter, marks between letters, or a letter three times in a row.
_SUSPICIOUS = re.compile("[" + re.escape("".join(LEET)) + r"]|[^\W\d_][._\-*~'`^,:/]+[^\W\d_]|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S))+")
_SPLIT = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3}(?!\S))+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _class_table() -> np.ndarray:
    table = np.zeros(0x180, dtype=np.int64)
    for c in range(0x180):
        low = chr(c).lower()
        if not chr(c).isalpha() or len(low) != 1:
            continue
        o = ord(low)
        table[c] = o - 97 + 2 if 97 <= o <= 122 else 28 + o - 0xDF if 0xDF <= o <= 0xFF else 1
    return table


CLASSES = _class_table()


def classes(text: str) -> np.ndarray:
    """Class per character; letters beyond the table are "other"."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return np.where(code < 0x180, CLASSES[np.minimum(code, 0x17F)], 1)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Class trigram counts over all texts; partial sums leave the tasks, N_CLASSES ** 3 at most."""
    n = N_CLASSES

    def count(batches):
        import pyarrow as pa

        total, held, size = np.zeros(n**3, dtype=np.int64), [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                if text:
                    k = classes("  " + text + " ")
                    # a stretch without letters is one break
                    k = k[np.concatenate([[True], (k[1:] != 0) | (k[:-1] != 0)])]
                    k = np.concatenate([[0], k])
                    held.append(k[:-2] * n * n + k[1:-1] * n + k[2:])
                    size += len(k)
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(held), minlength=n**3)
                        held, size = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *held]), minlength=n**3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    rows = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n**3)
    for r in rows:
        out[r[0]] = r[1]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b): trigram mixed with bigram and unigram."""
    n = N_CLASSES
    tri = counts.reshape(n, n, n)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + n)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return -np.log(p3)


def _class_of(c: str) -> int:
    return int(CLASSES[ord(c)]) if ord(c) < 0x180 else 1


def restore(text: str, lm: np.ndarray) -> str:
    """Most likely reading of a suspicious stretch, in lower case; words are split by blanks."""
    text = text.lower()
    states = {(0, 0): (0.0, None)}  # last two classes -> cost, (previous node, written)
    last = ""
    for i, c in enumerate(text):
        options = []  # (written, cost)
        if c.isalpha():
            options.append((c, 0.0))
            if c == last:  # repeated: said once
                options.append(("", COST_REPEAT))
        else:
            options += [(x, COST_LEET) for x in LEET.get(c, "")]
            if c in LEET and last and c == last:
                options.append(("", COST_REPEAT))
            if c in GAPS or c in "!|+(<":
                options.append(("", COST_GAP))
                options.append((" ", COST_BREAK))
            elif c not in LEET:
                options += [(" ", COST_BREAK), ("", COST_KEPT)]
            else:
                options.append((" ", COST_KEPT))
        last = c
        new: dict = {}
        for (a, b), node in states.items():
            for out, cost in options:
                if not out:
                    key, total = (a, b), node[0] + cost
                else:
                    k = _class_of(out)
                    if k == 0 and b == 0:
                        key, total = (a, b), node[0] + cost
                        out = ""
                    else:
                        key, total = (b, k), node[0] + cost + lm[a, b, k]
                if key not in new or total < new[key][0]:
                    new[key] = (total, (node, out))
        states = new
    best = min(((s[0] + lm[a, b, 0] * (b != 0), s) for (a, b), s in states.items()), key=lambda x: x[0])[1]
    out = []
    while best[1] is not None:
        node, written = best[1]
        out.append(written)
        best = node
    return "".join(reversed(out)).strip()


def _suspicious(word: str) -> bool:
    return _SUSPICIOUS.search(word) is not None


def _restored(stretch: str, lm: np.ndarray) -> list[str]:
    return [w for w in restore(stretch, lm).split() if len(w) > 2]


def _token_words(token: str, lm: np.ndarray, worth=lambda stretch: True) -> set[str]:
    words = [token] if token.isalpha() else _LETTERS.findall(token)
    if _suspicious(token) and worth(token):
        words += _restored(token, lm)
    return {w for w in words if len(w) > 1}


def _runs(text: str) -> set[str]:
    """Runs of short tokens, set apart by blanks."""
    return {" ".join(m.group().split()) for p in (_SPACED, _SPLIT) for m in p.finditer(text)}


class Reader:
    """All words of texts, with the restored readings of what is suspicious; remembers what tokens gave."""

    def __init__(self, lm: np.ndarray):
        self.lm = lm
        self.known = Remembered()

    def token(self, token: str) -> set[str]:
        got = self.known.get(token)
        if got is None:
            got = _token_words(token, self.lm)
            self.known.put(token, got, 300 + 60 * len(token))
        return got

    def words(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        out: set[str] = set()
        for t in set(text.split()):
            out |= self.token(t)
        for r in _runs(text):
            out.update(_restored(r, self.lm))
        return out


def parts(word: str) -> list[str]:
    """A word and its beginnings, the most particular first."""
    return ["=" + word] + [word[:k] for k in (8, 7, 6, 5, 4) if len(word) >= k]


_DROPPED = re.compile(r"[!|+(<]")
_TWICE = re.compile(r"(.)\1+")
_PLAIN = str.maketrans({**{sign: letters[0].replace("l", "i") for sign, letters in LEET.items()}, "l": "i"})


def skeleton(stretch: str) -> str:
    """Letters a stretch may be read as, one for all readings of a sign, each said once however often it stands there."""
    return _TWICE.sub(r"\1", "".join(filter(str.isalpha, stretch.translate(_PLAIN))))


class Scorer:
    """Weighted words of texts, read as ``Reader`` reads them, but for stretches that can't hold a weighted word.

    A letter is only left out where it stands beside itself, and a sign that
    stands for a letter is read as one of them or ends a word. So what a stretch
    reads as holds a weighted part only if its skeleton holds the part's, and
    other stretches need no decoding. Signs that may also be gaps always do.

    Two neighbouring tokens, one of them longer than a run's, are read together
    where a weighted part begins in the first and goes on in the second.
    """

    def __init__(self, lm: np.ndarray, weights: dict[str, float]):
        import ahocorasick

        self.lm, self.weights = lm, weights
        self.clean: set[str] = set()  # tokens without a weighted word
        self.left = WORKER_BYTES * 3 // 4
        self.hits = Remembered(WORKER_BYTES // 4)
        self.heads = {p.removeprefix("=")[:4] for p in weights}
        self.long_heads = {p[:k] for p in (w.removeprefix("=") for w in weights) for k in range(CUT_LETTERS, len(p) + 1)}
        self.parts = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in weights:
            self.parts.add_word(skeleton(p))
        self.parts.make_automaton()

    def worth(self, stretch: str) -> bool:
        """False if no reading of the stretch has a weighted word."""
        if not self.weights:
            return False
        return bool(_DROPPED.search(stretch)) or next(self.parts.iter(skeleton(stretch)), None) is not None

    def weight(self, word: str) -> float:
        if word[:4] not in self.heads:
            return 0.0
        return next((self.weights[p] for p in parts(word) if p in self.weights), 0.0)

    def _weighted(self, words) -> dict[str, float]:
        return {w: x for w, x in ((w, self.weight(w)) for w in words) if x > 0}

    def token(self, token: str) -> dict[str, float]:
        got = self.hits.get(token)
        if got is None:
            got = self._weighted(_token_words(token, self.lm, self.worth))
            if got:
                self.hits.put(token, got, 200 + 80 * len(got) + len(token))
            elif self.left > 0:
                self.clean.add(token)
                self.left -= 110 + len(token)
        return got

    def _cut_words(self, tokens: list[str]) -> set[str]:
        """Neighbouring tokens whose letters together begin like a weighted part, of ``CUT_LETTERS`` or more, that the first has not alone."""
        out, heads = set(), self.long_heads
        for a, b in [(a, b) for a, b in zip(tokens, tokens[1:]) if (a + b)[:max(CUT_LETTERS, len(a) + 1)] in heads]:
            if a.isalpha() and (len(a) > 3 or len(b) > 3):
                rest = _LETTERS.match(b)
                if rest and any(p in self.weights for p in parts(a + rest.group()) if len(p.removeprefix("=")) > max(len(a), CUT_LETTERS - 1)):
                    out.add(f"{a} {rest.group()}")
        return out

    def words(self, text: str | None) -> dict[str, float]:
        text = (text or "").lower()
        tokens = text.split()
        out: dict[str, float] = {}
        for t in set(tokens) - self.clean:
            out.update(self.token(t))
        for r in _runs(text):
            if self.worth(r):
                out.update(self._weighted(_restored(r, self.lm)))
        for r in self._cut_words(tokens):
            out.update(self._weighted(_restored(r, self.lm)))
        return out

    def summary(self, text: str | None) -> list[float]:
        """Strongest word, mean of the three strongest, log of the number of strong ones."""
        top = sorted(self.words(text).values(), reverse=True)
        return [top[0] if top else 0.0, sum(top[:3]) / 3, math.log1p(sum(1 for w in top if w > 2))]


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + 0.5 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, a.T @ (y - p) - 0.5 * beta)
    return beta


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_DOCS) -> dict:
    """Character model over all documents; word weights and curve on a bounded labelled sample."""
    docs = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    lm = language_model(count_trigrams(docs))
    picked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    picked = picked.filter("_id is not null and _label in (0, 1)").filter(fold("_id", 5) != 0)
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)
    # rows of one id are one document here: the bound on labels bounds what is fitted on
    rows = docs.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.max("text").alias("text"))
    rows = store(rows, "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(lm)

    def words(batches):
        import pyarrow as pa

        reader = Reader(shared.value)
        for b in batches:
            out = [sorted({p for w in reader.words(t) for p in parts(w)}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_label"), pa.array(out, pa.list_(pa.string()))], ["y", "parts"])

    n = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos + neg:
        return {"lm": lm, "weights": {}, "curve": np.zeros(4)}
    seen = rows.mapInArrow(words, "y int, parts array<string>")
    counts = seen.select("y", F.explode("parts").alias("part")).groupBy("part").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    odds = F.log((F.col("a") + 0.5) / (pos + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / (neg + 1.0))
    # what the labelled documents have, at most: their number is bounded
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    strong = counts.filter(F.col("a") >= LEAST_DOCS).withColumn("w", odds).filter(F.col("w") - SURE * error > 1)
    weights = {r[0]: r[1] for r in strong.select("part", "w").collect()}
    model = {"lm": lm, "weights": weights, "curve": None}
    shared2 = docs.sparkSession.sparkContext.broadcast(model)

    def summaries(batches):
        import pyarrow as pa

        scorer = Scorer(shared2.value["lm"], shared2.value["weights"])
        for b in batches:
            x = [scorer.summary(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array(x, pa.list_(pa.float64()))], ["_id", "y", "x"])

    got = rows.mapInArrow(summaries, "_id long, y int, x array<double>").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    model["curve"] = _curve(np.array([r[2] for r in got]), np.array([float(r[1]) for r in got]))
    return model


def score(docs: DataFrame, model: dict, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the toxicity score, 0 to 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def toxicity(texts):
        import pandas as pd

        scorer = held("toxicity", "scorer", name, lambda: Scorer(shared.value["lm"], shared.value["weights"]))
        x = np.array([scorer.summary(t) for t in texts]).reshape(-1, 3)
        z = shared.value["curve"][0] + x @ shared.value["curve"][1:]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(column, toxicity(F.col(text)))
