import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from vigil.llm.packing import best_fit, best_fit_packing, bound, pack
from vigil.llm.token_files import lookup, read_tokens, write_tokens
from vigil.llm.tokens import WordIds, read_vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
JSON = read_vocabulary(PATH)
WHOLE = Tokenizer.from_file(PATH)


def ids(text, end):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_word_by_word_equals_whole_text(spark, odd_docs):
    table = WordIds(JSON)
    texts = [r.text for r in odd_docs.collect()] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["Σας ΟΔΟΣ ΟΔΟΣ.", "İstanbul ﬁ ǅ µ ª", "don't 's 'S it'LL", "a<|startoftext|>B", "words,, twice,,"]
    for t in texts:
        assert np.frombuffer(table.text((t or "").encode()), "<u4").tolist() == ids(t, 0)[:-1]


def test_token_files_round_trip(spark, odd_docs, no_docs, tmp_path):
    write_tokens(odd_docs, str(tmp_path / "f"), JSON, 2, 49408)
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(read_tokens(spark, str(tmp_path / "f"), ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, tuple(ids(r.text, 2))) for r in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens
    assert lookup(spark, str(tmp_path / "f"), 9).collect()[0].ids == ids("One two three", 2)
    write_tokens(no_docs, str(tmp_path / "none"), JSON, 2, 49408)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_another_dictionary_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "a"), JSON, 2, 49408)
    spark.createDataFrame([("0" * 64, 2, b"")], "dictionary string, id_bytes int, content binary").write.mode("overwrite").parquet(str(tmp_path / "a/dictionary"))
    with pytest.raises(Exception, match="another dictionary"):
        read_tokens(spark, str(tmp_path / "a")).collect()


def least_bins(sizes, capacity):
    """Fewest bins by trying every assignment."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_finds_least(spark):
    rng = np.random.default_rng(3)
    worse = 0
    for _ in range(150):
        sizes = [int(x) for x in rng.integers(5, 60, rng.integers(1, 9))]
        bins, least = pack(sizes, 100), least_bins(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert bound(sizes, 100) <= least == len(bins)
        worse += len(best_fit(sizes, 100)) > least
    # best fit needs five bins here, bin completion four
    hard = [6, 5, 4, 4, 3, 3, 3, 2] + [10, 10]
    assert len(pack(hard, 10)) == least_bins(hard, 10)


def test_packing_places_every_piece(spark, odd_docs, no_docs):
    got = best_fit_packing(odd_docs, JSON, capacity=256, group=8).collect()
    want = Counter()
    for r in odd_docs.collect():
        x = ids(r.text, 1)
        want.update((r.doc_id, k, a, len(x[a:a + 256]), crc(x[a:a + 256])) for k, a in enumerate(range(0, len(x), 256)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 256
    assert best_fit_packing(no_docs, JSON).count() == 0


def test_large_groups_reach_the_bound():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        sizes = [int(x) for x in rng.integers(500, 1800, 600)]
        bins = pack(sizes)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 4096 for b in bins)
        assert len(bins) == bound(sizes, 4096) < len(best_fit(sizes, 4096))


def test_sequences_of_a_thousand_pieces():
    sizes = [1500] * 2000 + [1] * 2096
    assert bound(sizes, 4096) < len(best_fit(sizes, 4096))  # so that the search starts
    bins = pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 4096 for b in bins) and len(bins) == 1000


def test_bound_takes_all_thresholds():
    rng = random.Random(3)
    sizes = [rng.randint(2600, 3000) for _ in range(500)] + [rng.randint(1300, 1600) for _ in range(500)]
    by_hand = 0
    for t in {0, *sizes}:  # the same bound, threshold by threshold
        if 2 * t > 4096:
            continue
        big = [s for s in sizes if 2 * s > 4096]
        alone = sum(s > 4096 - t for s in big)
        room = sum(4096 - s for s in big if s <= 4096 - t)
        rest = sum(s for s in sizes if t <= s and 2 * s <= 4096)
        by_hand = max(by_hand, len(big) + max(0, -(-(rest - room) // 4096)), -(-sum(sizes) // 4096))
        assert alone <= len(big)
    assert bound(sizes, 4096) == by_hand > -(-sum(sizes) // 4096) + 20
    assert bound([], 10) == 0 and bound([10, 10], 10) == 2 and bound([1] * 11, 10) == 2


def test_dictionary_samples_cover_whole_arrays():
    from vigil.llm.token_files import SLICE_BYTES, SLICES, _evenly

    for size in (0, 1, SLICE_BYTES, SLICES * SLICE_BYTES):
        at = _evenly(size)
        assert at == list(range(0, size, SLICE_BYTES))
    at = _evenly(10**6)
    assert len(at) == SLICES and at[0] == 0 and 10**6 - SLICE_BYTES - 4 < at[-1] <= 10**6 - SLICE_BYTES and all(a % 4 == 0 for a in at)
