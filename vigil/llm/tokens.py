"""Token ids of whole texts, word by word.

The vocabulary drops white space, so a text's ids are those of its words one
after the other. Words repeat, so every Python worker keeps the ids of words it
has met in a table of bounded size, as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import struct

from vigil.llm.common import Remembered, held

#: Bytes of words that a worker remembers with their ids: most of a corpus's words are met again.
WORD_BYTES = 128 << 20
_TAIL = b".,;:!?*$%&#"
_SAMPLES = ("the", "Überraschung", "señora", "çà", "xqzvw", "a", "thandeingly", "ærøÿß")


def byte_signs() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_SIGNS = byte_signs()


class WordIds(Remembered):
    """word (bytes) -> ids as bytes; fills itself."""

    def __init__(self, tokenizer_json: str):
        super().__init__(WORD_BYTES)
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._model = self._tokenizer.model
        # words of plain letters need neither normalizing nor cutting: their bytes go straight to the
        # vocabulary's merges, if a vocabulary shows on samples that it works that way
        self._direct = False
        self._direct = all(self._letters(w) == self._ids(w) for w in _SAMPLES)

    def _ids(self, word: str) -> list[int]:
        return self._tokenizer.encode(word, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        return [t.id for t in self._model.tokenize(word.lower().encode().decode("latin-1").translate(_BYTE_SIGNS))]

    def _encode(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = self._direct and text.isalpha() and max(text) < "\u0130"
        ids = self._letters(text) if plain else self._ids(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_TAIL)
        # letters and marks never share a token, so a tail of marks behind a letter can stand apart
        if len(core) < len(word) and core and 97 <= core[-1] <= 122:
            ids = self[core] + self[word[len(core):]]
        else:
            ids = self._encode(word)
        self.put(word, ids, len(word) + len(ids))
        return ids

    def text(self, text: bytes | None) -> bytes:
        # ASCII letters are lower-cased by the vocabulary itself, except inside its two special marks
        text = text or b""
        words = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.__getitem__, words))


def worker_ids(tokenizer_json: str) -> WordIds:
    """The worker's table for this vocabulary."""
    return held("tokens", "words", hash(tokenizer_json), lambda: WordIds(tokenizer_json))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
