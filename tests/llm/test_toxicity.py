import random

import numpy as np

from llm_fixtures import no_docs, no_labels, odd_docs, odd_labels  # noqa: F401
from vigil.llm.q_toxicity import op7_toxicity
from vigil.llm.toxicity import (CLASSES, COST_BREAK, COST_GAP, COST_KEPT, COST_LEET, COST_REPEAT, GAPS, LEET, N_CLASSES, Scorer,
                                count_trigrams, language_model, restore, score, train)


def test_deobfuscation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = count_trigrams(docs)
    lm = language_model(counts)
    assert np.allclose(np.exp(-lm).sum(2), 1.0) and lm.shape == (N_CLASSES,) * 3
    for written, read in {"1d10t": "idiot", "i d i o t": "idiot", "st.u.p.i.d": "stupid", "$tup1d": "stupid", "iiidddiiioooottt": "idiot",
                          "w o r t h l e s s": "worthless", "cl0wn": "clown", "7r4sh": "trash", "plain": "plain"}.items():
        assert restore(written, lm) == read


def test_held_out_accuracy(spark):
    got = op7_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500 and np.mean([r.predicted == r.toxic for r in rows]) > 0.96
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.85


def test_obfuscated_words_score_like_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    tail = " the and of this with reading ending there."
    rows = [(0, "you idiot loser" + tail), (1, "you 1d10t l0ser" + tail), (2, "you i d i o t l o s e r" + tail), (3, "you iiidiooot looosssser" + tail), (4, "you" + tail)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert min(got[i] for i in range(4)) > 0.5 > got[4]


def test_signs_at_the_end_and_words_over_white_space(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    head, tail = "reading about ", " gather ending there."
    texts = ["idi07 mor0n 1053r", "i  d  i  o  t  reading l  o  s  e  r", "i\nd\ni\no\nt reading l\no\ns\ne\nr", "id iot reading los er"]
    rows = [(i, head + t + tail) for i, t in enumerate(texts)] + [(9, head + tail)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert min(got[i] for i in range(4)) > 0.5 > got[9], got


def test_odd_documents(spark, odd_docs, no_docs, odd_labels, no_labels):
    model = train(odd_docs, odd_labels)
    got = score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score(odd_docs, train(odd_docs, no_labels)).collect()} == {0.5}
    assert {r.score for r in score(odd_docs, train(no_docs, odd_labels)).collect()} == {0.5}
    assert score(no_docs, model).count() == 0


def test_words_cut_into_longer_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    texts = ["reading about stup id. The wort hless and idio t people", "reading about the tea and its people"]
    got = [r.score for r in score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got[0] > 0.5 > got[1], got


def every_reading(text):
    """All readings of a stretch with their channel costs, by brute force."""
    found = [("", 0.0)]
    last = ""
    for c in text:
        options = []
        if c.isalpha():
            options = [(c, 0.0)] + ([("", COST_REPEAT)] if c == last else [])
        else:
            options = [(x, COST_LEET) for x in LEET.get(c, "")] + ([("", COST_REPEAT)] if c in LEET and c == last else [])
            if c in GAPS or c in "!|+(<":
                options += [("", COST_GAP), (" ", COST_BREAK)]
            elif c not in LEET:
                options += [(" ", COST_BREAK), ("", COST_KEPT)]
            else:
                options += [(" ", COST_KEPT)]
        last = c
        found = [(w + o, cost + more) for w, cost in found for o, more in options]
    return found


def cost_of(written, lm):
    """Of a reading: breaks beside breaks, and at the begin and end, are one."""
    total, a, b = 0.0, 0, 0
    for c in written:
        k = CLASSES[ord(c)]
        if k or b:
            total, a, b = total + lm[a, b, k], b, k
    return total + lm[a, b, 0] * (b != 0)


def test_restore_equals_an_exhaustive_decode():
    rng = random.Random(4)
    counts = np.random.default_rng(4).gamma(0.3, 20, N_CLASSES**3)
    lm = language_model(counts)
    for _ in range(250):
        text = "".join(rng.choice("ab1!$ .&e") for _ in range(rng.randint(1, 7)))
        best = min(cost + cost_of(w, lm) for w, cost in every_reading(text))
        mine = restore(text, lm)
        squeezed = {" ".join(w.split()): cost + cost_of(w, lm) for w, cost in sorted(every_reading(text), key=lambda x: -(x[1] + cost_of(x[0], lm)))}
        assert abs(squeezed[" ".join(mine.split())] - best) < 1e-9, (text, mine)


def test_stretches_passed_over_hold_no_weighted_word():
    rng = random.Random(5)
    lm = language_model(np.random.default_rng(5).gamma(0.3, 20, N_CLASSES**3))
    weights = {"=" + w: 3.0 for w in ("abba", "lie", "seal")} | {"sabe": 2.0, "ally": 2.0}
    scorer = Scorer(lm, weights)
    passed = 0
    for _ in range(4000):
        text = "".join(rng.choice("abesly14$ .&-") for _ in range(rng.randint(2, 14)))
        if not scorer.worth(text):
            passed += 1
            assert not scorer._weighted(w for w in restore(text, lm).split() if len(w) > 2), text
    assert passed > 500
