"""Whole-text encoding with files of public tokenizers, fast on one core.

A text is cut where no token can span the cut. Pieces that are plain Latin
words with trailing marks go straight to the tokenizer's BPE model; every
other piece goes through the whole tokenizer. A bounded cache keeps each
piece's ids as little-endian 32-bit bytes, so frequent pieces are encoded once
a worker. Ids equal those of encoding the whole text at once; a text that holds
the string of a special token is encoded so.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

#: Precomposed Latin letters (but for the dotted capital I, which lower-cases to two characters), then ASCII marks but for the apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch
SPACES = re.compile(r" \s").search


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable, else the next free code from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in kept else free))
        free += b not in kept
    return out


class Encoder:
    """ids(text) gives a text's token ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str, cached: int = 300_000, longest: int = 48):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.tokenize = self.model.tokenize
        # Byte-level pieces keep the one space before a word; else white space is dropped and case folded.
        self.keeps_space = "byte" in name
        self.cut = re.compile(r" (?=\S)").split
        self.cached, self.longest, self.cache, self.runs = cached, longest, {}, {}
        self.newline = self._whole("\n")

    def _whole(self, piece: str) -> bytes:
        return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of one run of letters or marks that the tokenizer would not cut, from the second cache."""
        got = self.runs.get(run)
        if got is None:
            word = run if run.isascii() and run[:1] != " " else "".join(map(self.letters.__getitem__, run.encode()))
            got = array("I", [t.id for t in self.tokenize(word)]).tobytes()
            if len(run) <= self.longest:
                if len(self.runs) >= 2 * self.cached:
                    self.runs.clear()
                self.runs[run] = got
        return got

    def _piece(self, piece: str, space: str) -> bytes:
        """Ids of a piece without spaces, after the given space."""
        m = PLAIN(piece)
        if m is None:
            return self._whole(space + piece)
        word, marks = m.groups()
        if not word:
            return self._run(space + marks) if marks else b""
        word = self._run(space + (word if self.keeps_space else word.lower()))
        return word + self._run(marks) if marks else word

    def _add(self, pieces: list[str], out: list[bytes], space: str) -> None:
        cache = self.cache
        for p in pieces:
            got = cache.get(p)
            if got is None:
                got = self._piece(p, space)
                if len(p) <= self.longest:
                    if len(cache) >= self.cached:
                        cache.clear()
                    cache[p] = got
            out.append(got)

    def ids(self, text: str) -> bytes:
        out: list[bytes] = []
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        if not self.keeps_space:
            if "\t" in text or "\r" in text:
                text = text.replace("\t", " ").replace("\r", " ")
            self._add(text.replace("\n", " ").split(" "), out, "")
        elif SPACES(text) or text[-1] == " ":
            first, *rest = self.cut(text)
            out.append(self._whole(first))
            out += [self._whole(" " + p) for p in rest]
        else:
            lines = text.split("\n")
            plain = all(x and not x[0].isspace() and not x[-1].isspace() for x in lines)
            for k, line in enumerate(lines if plain else [text]):
                if k:
                    out.append(self.newline)
                pieces = line.split(" ")
                out.append(self._piece(pieces[0], ""))
                self._add(pieces[1:], out, " ")
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder a worker: its cache serves all tasks that the worker runs."""
    return Encoder(name)
