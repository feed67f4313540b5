"""Text to token ids with the `tokenizers` library, memoised by space-delimited chunk.

A space or line end that follows or precedes a visible character is always a pre-token boundary, so a
text's ids are the concatenation of its chunks' ids. Chunks that are empty or begin with white space
could join the white space before them; a text that has one, or that holds a special token's string, is
encoded whole. A chunk that is one word
of Latin-1 letters goes straight to the library's BPE model, a word with punctuation behind it is the
word's ids and the punctuation's, and every other chunk is encoded by the whole tokenizer. A memo has a new
and an old half: at half its limit the new one becomes the old one, and what is met again moves back, so
memory is bounded whatever the corpus; results never depend on it.
"""

from __future__ import annotations

import os
import re
from array import array

JOINING = "᠎​﻿"
#: a word and punctuation behind it (no apostrophe, which can begin a pre-token of its own; no letter whose lower case ends in a mark)
PUNCTUATED = re.compile(r"([^\W\d_İ]+)([!-&(-/:-@\[-`{-~]+)")


def _byte_letters() -> dict[int, int]:
    """The library's stand-in character for each byte that is not printable Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


LETTERS = _byte_letters()


class Memo(dict):
    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, chunk: str):
        value = self[chunk] = self.old[chunk] if chunk in self.old else self.compute(chunk)
        return value

    def bound(self, limit: int) -> None:
        if len(self) > limit // 2:
            self.old = dict(self)
            self.clear()


class ChunkEncoder:
    def __init__(self, path: str, space_sticks: bool, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.folds = self.tokenizer.normalizer is not None  # the normalizer lower-cases
        self.sticks, self.limit = space_sticks, limit
        self.memo, self.heads, self.marks = Memo(self._chunk), Memo(self._head), Memo(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, space: bool) -> bytes:
        if self.folds:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(LETTERS)
        return array("I", [t.id for t in self.model.tokenize("Ġ" + word if space else word)]).tobytes()

    def _of(self, chunk: str, space: bool, memo: Memo) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < "Ā"):
            return self._word(chunk, space)
        if parts := PUNCTUATED.fullmatch(chunk):
            return memo[parts[1]] + self.marks[parts[2]]
        return self._whole(" " + chunk if space else chunk)

    def _head(self, chunk: str) -> bytes:
        return self._of(chunk, False, self.heads)

    def _chunk(self, chunk: str) -> bytes | None:
        if not self.sticks:
            return self._of(chunk, False, self.memo) if chunk else b""
        line = chunk[:1] == "\n"
        first = chunk[line : line + 1]
        if not first or first.isspace() or first in JOINING:
            return None
        return self.marks["\n"] + self.heads[chunk[1:]] if line else self._of(chunk, True, self.memo)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for memo in (self.memo, self.heads, self.marks):
            memo.bound(self.limit)
        out: list[bytes] = []
        get, line = self.memo.__getitem__, " \n" if self.sticks else " "
        for text in texts:
            if any(special in text for special in self.specials):
                out.append(self._whole(text))
                continue
            chunks = text.replace("\n", line).split(" ")
            try:
                out.append(self.heads[chunks.pop(0)] + b"".join(map(get, chunks)) if self.sticks else b"".join(map(get, chunks)))
            except TypeError:
                out.append(self._whole(text))
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, space_sticks: bool, limit: int = 600_000) -> ChunkEncoder:
    """One encoder per worker process, so the memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path, space_sticks, limit)
    return _encoders[path]
