"""Tokenizer calls with a bounded memo of pieces: strings between places where a tokenizer always starts a new pre-token."""

from __future__ import annotations

import os
import re

import numpy as np

from quantloom.llm.common import KEPT
from quantloom.llm.ranks import Ranks

MEMO = 450_000  # pieces a Python worker remembers; cleared when full
RANKS_MEMO = 150_000  # the same where new pieces are encoded by ranks, which costs little
LONG = 64  # pieces above so many characters are not remembered
SEEN = 1 << 23  # flags of the filter that tells pieces met before from new ones; only those are remembered
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_CODERS: dict[tuple, object] = {}
KEPT.append(_CODERS)


def load(path: str):
    """The tokenizer of a file, single-threaded, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class PieceCoder:
    """Ids of whole texts as packed integers.

    ``spaced``: byte-level tokenizers keep a space with the word after it, so a piece starts at every space between two other characters.
    Otherwise (white space dropped) a piece ends at every space. Either way the ids of a text are the ids of its pieces, one after another.
    """

    def __init__(self, path: str, spaced: bool, memo: int | None = None, ranks: bool = False, plain: bool = False):
        """``ranks``: encode simple pieces with the file's own ranks, many at once. ``plain``: the strings of special tokens are ordinary text."""
        self.tokenizer = load(path)
        self.tokenizer.encode_special_tokens = plain
        self.ranks = Ranks.of(path) if ranks else None
        if self.ranks and self.ranks.spaced != spaced:
            self.ranks = None
        if self.ranks and plain:
            self.ranks.special = []
        self.spaced, self.limit = spaced, memo or (RANKS_MEMO if self.ranks else MEMO)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo: dict[str, bytes | None] = {}
        self.met = bytearray(SEEN)
        self.passing: list[str] = []  # in the memo for the present slice only

    def direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not in the memo. A piece that touches other white space is marked None when spaces matter."""
        todo = [p for p in pieces if p not in self.memo]
        met = self.met
        for p in todo:
            at = hash(p) & (SEEN - 1)
            if not met[at] or len(p) > LONG:
                met[at] = 1
                self.passing.append(p)
        if self.spaced:
            bad = [p for p in todo if not p or p[0].isspace() or p[-1].isspace()]
            self.memo.update(dict.fromkeys(bad))
            todo = [p for p in todo if p and not p[0].isspace() and not p[-1].isspace()]
        if self.ranks and todo:
            every = self.ranks.simple(" ".join(todo))
            easy = todo if every else [p for p in todo if self.ranks.simple(p)]
            self.memo.update(zip(easy, self.ranks.encode(easy, self.dtype), strict=True))
            todo = [] if every else [p for p in todo if not self.ranks.simple(p)]
        self.memo.update(zip(todo, self.direct([" " + p for p in todo] if self.spaced else todo), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [t.split(" ") for t in texts]
        memo = self.memo
        want: set[str] = set()
        for c in cut:
            want.update(c[1:] if self.spaced else c)
        self.learn(want.difference(memo))
        heads = self.direct([c[0] for c in cut]) if self.spaced else None
        out = []
        for i, (t, c) in enumerate(zip(texts, cut, strict=True)):
            if self.spaced and (not c[0] or c[0][-1].isspace()):
                out.append(self.careful(t))
                continue
            try:
                out.append(heads[i] + b"".join([memo[p] for p in c[1:]]) if self.spaced else b"".join([memo[p] for p in c]))
            except TypeError:  # a piece beside other white space
                out.append(self.careful(t))
        self.forget()
        return out

    def careful(self, text: str) -> bytes:
        """Cut only at single spaces between other characters, and not through the memo."""
        first, *rest = _INNER_SPACE.split(text)
        return b"".join(self.direct([first, *(" " + p for p in rest)]))

    def forget(self) -> None:
        """Keep only pieces met before, and not too many."""
        for p in self.passing:
            self.memo.pop(p, None)
        self.passing = []
        if len(self.memo) > self.limit:
            self.memo.clear()


    def release(self) -> None:
        """Forget all pieces: the worker may go on with another stage."""
        self.memo.clear()
        self.met = bytearray(SEEN)


def coder(path: str, spaced: bool, ranks: bool = False) -> PieceCoder:
    """One coder a Python worker and file; the memo lasts from task to task."""
    key = (path, spaced, ranks)
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(path, spaced, ranks=ranks)
    return _CODERS[key]
