"""Exact pre-token encoder with bounded two-generation caches.

The vocabulary file's tokenizer lower-cases, drops white space and never lets
a token cross white space, so the encoding of a text is the concatenation of
the encodings of its white-space words.  Words are looked up in a cache; a
word that is not there is cut into pre-tokens, which are looked up in the given
table and then in a second cache, and only what both lack goes through the
library.  Entries of over ``LONGEST`` characters are not kept, so the caches are
bounded in bytes, not in entries only.  Texts outside a plain Latin alphabet, or holding the
start of a special string, are encoded whole by the library, so the results
always equal the library's own.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array

import numpy as np

from .common import slices

# Characters on which lower-casing, NFC and the character classes of Python
# and of the library agree: ASCII with ordinary white space, and Latin letters
# with diacritics except the dotted capital I.
_OTHER = re.compile(r"[^\t\n\v\f\r\x20-\x7eÀ-įı-ſ]")
_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_WORKER: dict = {}
LONGEST = 64
CHUNK = 1_000
SLICE = 1 << 19


def plain(text: str) -> bool:
    """Whether the cached path gives the library's result for ``text``."""
    return "<|" not in text and not _OTHER.search(text)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a plain text, which the vocabulary encodes one by one."""
    return [p for w in text.lower().split() for p in ((w,) if w.isalpha() else _PRETOKENS.findall(w))]


class Encoder:
    """Token ids (``counts=False``: little-endian uint32 bytes) or token counts.

    ``known`` is the first tier: values of pre-tokens, which stay.  The second tier is this
    worker's own: at ``cap`` entries a new generation begins, and entries of
    the last one move over when they are used again, so memory stays bounded.
    """

    def __init__(self, path: str, counts: bool = False, known: dict | None = None, cap: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.counts, self.known, self.cap = counts, known or {}, cap
        self.words, self.pieces = {}, dict(self.known)
        self.old_words, self.old_pieces = {}, {}

    @classmethod
    def of_worker(cls, key: tuple, path: str, **kw) -> Encoder:
        """One encoder for each worker process and ``key``; it outlives the task."""
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = cls(path, **kw)
        return _WORKER[key]

    def _value(self, ids: list[int]):
        if self.counts:
            return len(ids)
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _library(self, new: list[str]) -> list:
        """Values of pre-tokens, a thousand of which are encoded as one text: white space keeps them apart."""
        out = []
        for at in range(0, len(new), CHUNK):
            part = new[at : at + CHUNK]
            e = self.library.encode(" ".join(part), add_special_tokens=False)
            word = np.array(e.word_ids, np.int64)
            ends = np.flatnonzero(np.append(word[1:] != word[:-1], True)) + 1
            if len(word) and len(ends) == len(part):
                starts = np.append(0, ends[:-1])
                if self.counts:
                    out += (ends - starts).tolist()
                else:
                    packed = np.array(e.ids, "<u4").tobytes()
                    out += [packed[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
            else:
                out += [self._value(e.ids) for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _learn(self, missing: set[str]) -> dict:
        """Values of ``missing`` words; those worth keeping are cached."""
        pieces, old = self.pieces, self.old_pieces
        split = [(w, (w,) if w.isalpha() else _PRETOKENS.findall(w)) for w in missing]
        need = {p for _, ps in split for p in ps}
        if old:
            pieces.update((p, old[p]) for p in need if p not in pieces and p in old)
        new = [p for p in need if p not in pieces]
        values = dict(zip(new, self._library(new)))
        long = {p: v for p, v in values.items() if len(p) > LONGEST}
        pieces.update((p, v) for p, v in values.items() if p not in long) if long else pieces.update(values)
        at = (lambda p: long[p] if p in long else pieces[p]) if long else pieces.__getitem__
        join = sum if self.counts else b"".join
        found = {w: at(ps[0]) if len(ps) == 1 else join(map(at, ps)) for w, ps in split}
        self.words.update((w, v) for w, v in found.items() if len(w) <= LONGEST)
        return found

    def encode(self, texts: list[str | None]) -> list:
        """One value for each text; ``None`` counts as the empty text.

        Texts of about ``SLICE`` characters at a time are quickest: the words
        just split are still at hand when they are looked up.
        """
        out: list = []
        collecting = gc.isenabled()
        gc.disable()  # strings only: nothing here can form a cycle
        try:
            for i, j in slices(texts, SLICE):
                out += self._encode(texts[i:j])
        finally:
            if collecting:
                gc.enable()
        return out

    def _encode(self, texts: list[str | None]) -> list:
        if len(self.words) >= self.cap:
            self.old_words, self.words = self.words, {}
        if len(self.pieces) >= self.cap + len(self.known):
            self.old_pieces, self.pieces = self.pieces, dict(self.known)
        split = [(t or "").lower().split() if not t or plain(t) else None for t in texts]
        words = self.words
        missing, found = set().union(*(s for s in split if s)).difference(words), {}
        if missing:
            if self.old_words:
                found = {w: self.old_words[w] for w in missing if w in self.old_words}
                words.update(found)
            found = self._learn(missing.difference(found))
        long = {w: v for w, v in found.items() if len(w) > LONGEST}
        get, join = words.__getitem__, sum if self.counts else b"".join
        if long:
            get = lambda w: words[w] if w in words else long[w]
        return [self._value(self.library.encode(t, add_special_tokens=False).ids) if s is None else join(map(get, s)) for t, s in zip(texts, split)]
