import hashlib
import random
import struct

import numpy as np
import pytest

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from vigil.llm import lexicon_bpe as lb
from vigil.llm.lexicon_bpe import Encoder, Lexicon, Vocabulary, compiled, decoded, encoded, frequent_words, lexicon, saved
from vigil.llm.queries import QUERIES
from vigil.session import ship_package
from conftest import SF0001

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def text():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(text):
    return tokenizers.Tokenizer.from_str(text)


def test_automaton_gives_back_its_words_and_no_others(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(0, 7))) for _ in range(900)}
    entries = [(w, tuple(rng.randint(0, 3) for _ in range(rng.randint(0, 4)))) for w in words]
    saved(compiled(entries), str(tmp_path / "a"))
    lex = Lexicon(str(tmp_path / "a"))
    found, size, ids = lex.look_up([w for w, _ in entries])
    assert found.all() and size.tolist() == [len(i) for _, i in entries] and ids.tolist() == [x for _, i in entries for x in i]
    others = [bytes(rng.choice(b"abcd\xff") for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [b"a" * 500]
    found, size, _ = lex.look_up(others)
    assert found.tolist() == [o in words for o in others] and not size[~found].any()


def test_automaton_is_minimal(tmp_path):
    """As many states as there are different futures: what can still follow, with the ids still to come."""
    rng = random.Random(3)
    entries = [(w, tuple(w[:1]) + tuple(w[-2:])) for w in {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(60)}]
    prefixes = {w[:i] for w, _ in entries for i in range(len(w) + 1)}

    def common(prefix):
        outs = [i for w, i in entries if w.startswith(prefix)]
        n = 0
        while all(len(o) > n and o[n] == outs[0][n] for o in outs):
            n += 1
        return n if prefix else 0

    futures = {frozenset((w[len(p):], i[common(p):]) for w, i in entries if w.startswith(p)) for p in prefixes}
    assert len(compiled(entries)["final"]) == len(futures)


def test_empty_lexicon(tmp_path, text, library):
    saved(compiled([]), str(tmp_path / "e"))
    ids, size = Encoder(Vocabulary(text), str(tmp_path / "e")).encode(["Hello there,  you", None, ""])
    assert ids.tolist() == library.encode("Hello there,  you", add_special_tokens=False).ids and size.tolist() == [len(ids), 0, 0]


def test_all_signs_are_cut_as_the_library_cuts_them(text, library):
    vocabulary = Vocabulary(text)
    for c in [*range(0xD800), *range(0xE000, 0x30000, 7)]:
        s = f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}! {chr(c)} {chr(c)}  {chr(c)}"
        assert vocabulary.words(s) == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)], hex(c)


def test_odd_texts_equal_the_library(tmp_path, text, library):
    vocabulary, rng = Vocabulary(text), random.Random(5)
    words = [" the", " a", " b", " don", " '", " \U0001f600", " x"]
    saved(compiled([(w.encode(), tuple(vocabulary.ids(w))) for w in words]), str(tmp_path / "l"))
    encoder = Encoder(vocabulary, str(tmp_path / "l"))
    odd = ["", None, " ", "  ", "a  b", "a \n b", "x \t\n y ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "don't I'll 'S 12 ...é ß",
           "a\x1c b \x1c\x1d c", "  a  b  c", "z" * 5000, "ab" * 3000 + " " * 3000 + "x", "日本語 \U0001f600\U0001f600 ա՘ա ౜"]
    odd += ["".join(rng.choice("ab'st ré \n\t1,.\x1c\x85 日Σ😀") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, size = encoder.encode(odd)
    at = 0
    for o, n in zip(odd, size):
        want = library.encode(o or "", add_special_tokens=False).ids
        assert ids[at:at + n].tolist() == want, o
        assert b"".join(vocabulary.bytes_of[i] for i in want).decode() == library.decode(want, skip_special_tokens=False)
        at += n


@pytest.mark.parametrize("most", [3, 65536])
def test_frames(spark, odd_docs, no_docs, text, library, monkeypatch, most):
    ship_package(spark)
    name = lexicon(odd_docs, text, most=most)
    rows = decoded(encoded(odd_docs, text, name), text)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.decoded, bytes(r.ids)) for r in rows.collect())
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is None, r.doc_id or 0, r.text or "", struct.pack(f"<{len(ids)}I", *ids)))
    assert got == sorted(want)
    assert decoded(encoded(no_docs, text, lexicon(no_docs, text)), text).count() == 0
    assert frequent_words(odd_docs, most=most).count() <= most


def test_slices():
    assert list(lb.slices(["ab", None, "c" * 30, "d"], 20)) == [(0, 3), (3, 4)] and list(lb.slices([])) == []


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    for r in QUERIES["op11_lexicon_bpe"](spark, SF0001).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decoding_keeps_the_bytes_of_ids_only(text, monkeypatch):
    monkeypatch.setattr(lb, "Vocabulary", None)  # the library's tables are not wanted
    assert len(lb.token_bytes(text)) > 50_000 and lb.SLICE_CHARS <= 1_000_000
