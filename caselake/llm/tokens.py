"""Encoders of public vocabularies with a bounded cache of words or pieces.

A piece (what the vocabulary's own pattern cuts out of a text) always has the same tokens, and so has a word
whose pieces never cross white space; each distinct one is encoded once while the cache holds it.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a generation of the cache.
CACHE = 400_000
#: Signs that are neither letters nor digits nor blanks.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Words that are encoded as one line.
LINE = 2_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Generations(dict):
    """A cache of two generations: what is looked up again outlives the others."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def lacking(self, wanted: set) -> list:
        """Those of ``wanted`` that neither generation has; the others are in the young one afterwards."""
        if len(self) + len(wanted) > self.limit:
            self.old = dict(self)
            self.clear()
        out = []
        for w in wanted:
            if w in self.old:
                self[w] = self.old[w]
            elif w not in self:
                out.append(w)
        return out


class WordBpe:
    """A tokenizers file whose pieces never cross white space; texts become packed little-endian 32-bit ids.

    Texts of SAFE characters are cut at white space, and words are looked up; for them lower
    case is all that the normaliser does. Other texts take the library's own path as a whole.
    """

    SAFE = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027]*")

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that end a piece.
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = Generations(cache)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words in long lines. A word's ids end with the token that closes its last piece."""
        for i in range(0, len(words), LINE):
            line = words[i : i + LINE]
            n = np.ones(len(line), np.int64)
            for k, w in enumerate(line):
                if not w.isalpha():  # letters are one piece of the pattern, and so are the signs after them
                    core = w.rstrip(SIGNS)
                    n[k] = 2 if core.isalpha() else len(self.pattern.findall(w))
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, "<u4")
            closed = np.flatnonzero(self.closes[ids]) + 1
            if len(closed) == n.sum():
                data, ends = ids.tobytes(), (closed[np.cumsum(n) - 1] * 4).tolist()
                self.words.update(zip(line, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
            else:  # not the case in known vocabularies
                self.words.update((w, self._packed(e.ids)) for w, e in zip(line, self.tokenizer.encode_batch_fast(line, add_special_tokens=False), strict=True))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the words that no cache holds are encoded together."""
        safe = [self.SAFE.fullmatch(t) is not None for t in texts]
        lists = [t.lower().split() if ok else () for t, ok in zip(texts, safe, strict=True)]
        known = self.words
        wanted = set(chain.from_iterable(lists))
        missing = [w for w in wanted if w not in known]
        if len(known) + len(missing) > known.limit:
            missing = wanted
        if new := known.lacking(missing):
            self._learn(new)
        look = dict(zip(wanted, map(known.__getitem__, wanted), strict=True)).__getitem__  # small enough for the processor's caches
        return [b"".join(map(look, x)) if ok else self._packed(self.tokenizer.encode(t, add_special_tokens=False).ids) for t, x, ok in zip(texts, lists, safe, strict=True)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each file in a worker process, so that its caches outlive a task."""
    return WordBpe(path)


class ByteBpe:
    """A tiktoken rank file; texts become the byte lengths of their tokens, which add up to the text."""

    #: Other characters take the library's own path, as Unicode versions may differ there.
    SAFE = re.compile(r"[\x00-\u024f\u2010-\u2027]*")

    def __init__(self, path: str, pattern: str, cache: int = 300_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.size = np.zeros(max(ranks.values()) + 1, np.uint16)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def _lengths(self, piece: str) -> bytes:
        return self.size[self.encoding.encode_ordinary(piece)].tobytes()

    def lengths(self, text: str) -> np.ndarray:
        """Bytes of each token of the text, in order."""
        if not self.SAFE.fullmatch(text):
            return np.frombuffer(self._lengths(text), np.uint16)
        pieces = self.pattern.findall(text)
        known = self.known
        new = {p for p in pieces if p not in known}
        if new:
            if len(known) + len(new) > self.cache:
                known.clear()
                new = set(pieces)
            for p in new:
                known[p] = self._lengths(p)
        return np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.uint16)
