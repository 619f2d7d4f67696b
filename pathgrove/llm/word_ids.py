"""Token ids by the tokenizers library, with a bounded cache of words per Python worker.

The vocabularies handled here drop white space and never merge across it, so a text's ids are the ids of its words (split at
ASCII white space, and before a comma or full stop that ends a word) one after another. Each word is encoded once by the
library while it stays in the cache; ids are kept as packed little-endian integers (2 bytes below 65,536 ids, else 4).
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import held

CACHE = 900_000
_ENDS = re.compile(rb"(?<=[a-z])([,.])(?=\s|\Z)")


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)  # tokens that end a word
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache: dict[bytes, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of every text (null: none)."""
        docs = [_ENDS.sub(rb" \1", (t or "").encode().lower()).split() for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = set().union(*docs).difference(self.cache)
        if new:
            self.learn(list(new))
        return [b"".join(map(self.cache.__getitem__, d)) for d in docs]

    def learn(self, new: list[bytes]) -> None:
        """Cache the ids of words. Words of letters are encoded in one go: each has one token that ends a word, its last."""
        words = [w.decode() for w in new]
        letters = [w for w in words if w.isalpha()]
        for at in range(0, len(letters), 10_000):
            part = letters[at : at + 10_000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(stops) != len(part):
                self.one_by_one(part)
                continue
            packed, start = ids.tobytes(), 0
            for w, stop in zip(part, stops.tolist(), strict=True):
                self.cache[w.encode()] = packed[start:stop]
                start = stop
        self.one_by_one([w for w in words if not w.isalpha()])

    def one_by_one(self, words: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            for w, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[w.encode()] = np.array(e.ids, self.dtype).tobytes()


def word_ids(path: str) -> WordIds:
    return held(("word ids", path), lambda: WordIds(path))


def crc_bytes(ids: np.ndarray) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()
