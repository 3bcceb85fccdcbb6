"""Exact, fast encoding with the word BPE: no token of it crosses white space, so words are encoded once and looked up."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

END_ID = 2
#: Under this normaliser the short way for plain words holds.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine has a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words that the tokenizer's normaliser only lower-cases: printable ASCII and Latin-1 letters, all precomposed.
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The tokenizer's splitting pattern on lower-cased plain words.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder(dict):
    """Token ids of words, and by encode() of texts, as little-endian unsigned 16-bit bytes (32-bit if the vocabulary needs them).

    The tokenizer's normaliser and its splitting pattern treat every space and line feed as a border, so
    the ids of a text are those of its words between them. Plain words go straight to the tokenizer's model,
    others to the whole tokenizer. Words seen are kept in two generations of up to ``limit``: when the newer
    one is full, the older one is forgotten, but for words met meanwhile.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.limit = limit
        self.older: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.plain = json.loads(self.tokenizer.to_str())["normalizer"] == NORMALIZER

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if self.plain and PLAIN.fullmatch(word) and "<|" not in word:
                pieces = PIECE.findall(word.lower())
                found = self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
            else:
                found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        found = self.get(piece) or self.older.get(piece)
        if found is None:
            letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            found = self[piece] = array(self.dtype.char, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            out.append(b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" "))))
            if len(self) > self.limit:
                self.older = dict(self)
                self.clear()
                self[""] = b""
        return out


@lru_cache(maxsize=2)
def encoder(name: str) -> WordEncoder:
    """One for each Python worker, of a public vocabulary by its name, which each machine resolves, or of a file by its path."""
    return WordEncoder(name if os.sep in name else vocabulary_path(name))
