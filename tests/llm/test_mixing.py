import re
from collections import defaultdict

import pytest

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from vigil.llm.mixing import mix, mixed, plan, targets


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("odd", [True, False])
def test_mix_meets_targets(spark, odd_docs, odd):
    docs = odd_docs if odd else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, plans = docs.collect(), plan(docs).collect()
    assert len(rows) == len(plans)
    size, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    want = brute_targets(size)
    text = {(r.doc_id, words(r.text)): r.source for r in rows}
    taken = defaultdict(int)
    for p in plans:
        assert 0 <= p.taken <= 2 * p.size and (p.size == 0 or p.taken % p.size == 0)
    by_target = defaultdict(lambda: [0, 0.0, 0])
    for p in plans:
        t = by_target[p.source_size, round(p.target, 6)]
        t[0] += p.taken
    for s, t in want.items():
        got = by_target[size[s], round(t, 6)][0]
        assert abs(got - t) <= longest[s], (s, got, t)
    assert text and taken is not None
    again = plan(docs).collect()
    assert sorted(map(str, plans)) == sorted(map(str, again))


def test_targets_are_water_filling(spark):
    sizes = {None: 7, "": 100, "a": 3, "b": 1000, "zz": 40, "é": 0, "Z": 500}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_better_documents_come_first(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50)) if i % 2 else "same " * 50, "s") for i in range(2000)] + [(5000, "tiny " * 2000, "t")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    good = sum(r.taken for r in got if r.doc_id < 5000 and r.doc_id % 2)
    bad = sum(r.taken for r in got if r.doc_id < 5000 and not r.doc_id % 2)
    assert good > bad > 0


def test_mixed_repeats_rows(spark, odd_docs, no_docs):
    out = mixed(odd_docs)
    assert out.columns == odd_docs.columns
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in mix(odd_docs).collect())
    assert mix(no_docs).count() == 0 and mixed(no_docs).count() == 0
