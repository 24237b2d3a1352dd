import hashlib
import random
from collections import Counter, defaultdict

import pytest

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from vigil.llm import exact_dedup
from vigil.llm.exact_dedup import deduplicate, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for d in ids:
            kept = left > 0 and d == keep
            left -= kept
            out[d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [4, 1000, 16384])
def test_groups_equal_brute_force(spark, odd_docs, block):
    got = Counter(map(tuple, exact_groups(odd_docs, block_bytes=block).collect()))
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_shared_digests_fall_back(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for i in range(300)]
    monkeypatch.setattr(exact_dedup, "DIGESTS", ("cast(octet_length({0}) as string)", "hex({0})"))
    got = Counter(map(tuple, exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2).collect()))
    assert got == brute(rows)


def test_deduplicate_keeps_whole_rows(spark, odd_docs, no_docs):
    out = deduplicate(odd_docs)
    rows = out.collect()
    assert out.columns == odd_docs.columns
    assert Counter(r.text or "" for r in rows) == Counter({(r.text or "") for r in odd_docs.collect()})
    assert deduplicate(no_docs).count() == 0 and exact_groups(no_docs).count() == 0
