import random
from collections import Counter, defaultdict

import pytest

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from vigil.llm.graph import components
from vigil.llm.ngram_join import near_duplicates, one_per_group


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        out[d, len(sets[i]), d if not sets[i] else min(least[find(i)], default=None)] += 1
    return out


def edited(rng, words, rate):
    return [w if rng.random() > rate else f"e{rng.randint(0, 10**6)}" for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(12):  # groups around the threshold, chains, shared passages, copies
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 5, 8, 40, 150]))]
        if rng.random() < 0.5:
            base = base[:10] + passage
        rate, words = rng.choice([0.005, 0.02, 0.03]), base
        for _ in range(rng.randint(1, 14)):
            words = edited(rng, words if rng.random() < 0.4 else base, rate)
            rows.append(" ".join(words))
            if rng.random() < 0.3:
                rows.append(" ".join(words).upper())
    ids = rng.sample(range(10_000), len(rows))
    rows = list(zip(ids, rows))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = near_duplicates(odd_docs).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == brute(rows)
    kept = one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 2, 4, 5, 6, 7, 9}
    assert 1 not in {r.doc_id for r in kept.collect()}
    assert near_duplicates(no_docs).count() == 0 and one_per_group(no_docs).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in path + star] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}


def test_one_shingle_in_many_otherwise_different_documents(spark):
    """A shingle that all documents share makes no pairs of them, and near copies among them are found."""
    rng = random.Random(9)
    common = "this stands in all texts"

    def text():
        return " ".join([*(f"w{rng.randint(0, 10**7)}" for _ in range(9)), common])

    rows = [(i, text()) for i in range(20_000)]
    rows += [(20_000 + k, rows[k][1] + " more") for k in range(40)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    small = rows[:60] + rows[20_000:]
    want = brute(small)
    assert {k: n for k, n in got.items() if k[0] < 60 or k[0] >= 20_000} == want
    assert sum(n for (d, _, c), n in got.items() if d != c) == 40


def test_a_hub_meets_all_its_partners(spark, monkeypatch):
    from vigil.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HUB_PARTNERS", 3)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for _ in range(rng.randint(1, 12)):
            words[rng.randrange(200)] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
