import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from oracle import compare
from vigil.llm import merkle
from vigil.llm.merkle import audited, manifest
from vigil.llm.queries import ORACLE, QUERIES
from conftest import SF0001


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False):
    text = r.text
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def forest(hashes):
    """The hash that remains, and per start the (left, right) of every level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = level[i // 16 * 16:i // 16 * 16 + 16]
            p.append((run[:i % 16], run[i % 16 + 1:]))
        at = [i // 16 for i in at]
        level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in names:
        own = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        found[s] = (own, *forest([leaf(r) for r in own]))
    root, upper = forest([found[s][1] for s in names])
    out = Counter()
    for s, above in zip(names, upper):
        own, subroot, paths = found[s]
        for r, p in zip(own, paths):
            tampered = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0
            cur = leaf(r, tampered)
            for left, right in p + above:
                cur = h(*left, cur, *right)
            proof = h(*[x for left, right in p + above for x in left + right])
            out[r.doc_id, leaf(r), subroot, root, proof, cur, cur == root] += 1
    return out


def found(docs):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, audited(docs).select(*names).collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, path string, leaf string, hash string, tree int, part int, salt int, rank int"


def made(spark, sizes, seed=1):
    rng, rows, i = random.Random(seed), [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += rng.randint(1, 5)
            rows.append((i, rng.choice(["Some Text", "ÄB é", "", None, "lower"]) , rng.choice([None, "en"]), source, rng.choice([None, 5]), "g", "p", "l", "h", 1, 2, 3, 4))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_rows(spark, odd_docs, no_docs):
    assert found(odd_docs) == brute(odd_docs.collect())
    assert audited(no_docs).count() == 0
    assert "path" in manifest(odd_docs).columns


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 16, "": 17}, {"a": 256, "b": 257, None: 1, "é": 300}, {f"s{i}": 1 + i % 3 for i in range(270)}])
def test_forests_equal_brute_force(spark, sizes):
    df = made(spark, sizes)
    assert found(df) == brute(df.collect())


def test_three_layers_with_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    df = made(spark, {"hot": 4200, "b": 300})
    assert found(df) == brute(df.collect())


def test_changed_leaves_fail(spark):
    rows = audited(made(spark, {"a": 60})).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows) and {r.verified for r in rows} == {True, False}


def test_sql(spark):
    assert not compare(spark, QUERIES["op12_merkle"], ORACLE["op12_merkle"], SF0001)
