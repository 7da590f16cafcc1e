"""Byte-level BPE ids of whole texts, by the ``tokenizers`` library, with a memo
of words.

A byte-level BPE merges only inside the pieces of its pre-tokenizer, and that
pre-tokenizer never joins a word to the one before it, so the ids of a text are
the ids of its space-led words in order.  Each distinct word is cut into pieces
and merged by the library's model once per Python worker and bounded memo; a
text is then a dictionary lookup per word.  Texts that hold anything outside
what the memo models (odd white space, scripts beyond Latin, special strings)
go through the library whole.  ``tests/llm`` holds both ways against each other.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex

#: fixed value: the pieces of the byte-level pre-tokenizer
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: a word that the memo takes, after a \n perhaps: visible characters, ASCII and Latin, whose
#: classes are the same in all libraries
PLAIN = re.compile("\n?[!-~\u00a1-\u00ac\u00ae-\u024f]+")
#: words in a worker's memo, at about 200 bytes a word
MEMO_WORDS = 1_000_000
#: a longer word isn't kept
LONGEST_KEPT = 64

_READY: dict = {}


def _byte_letters() -> dict:
    """Byte -> the letter that stands for it in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _NotPlain(Exception):
    """The memo doesn't model this word."""


class _Words(dict):
    """Word -> its ids as bytes.  A key is \\n + word (a word right after a \\n) or a
    word (a space leads it); one that is missing is looked up in the library."""

    def __init__(self, tok, special: list, limit: int):
        super().__init__()
        self.merge, self.special, self.limit = tok.model.tokenize, special, limit
        self.letters = _byte_letters()
        self.newline = [t.id for t in self.merge(self.letters[10])]

    def __missing__(self, key: str) -> bytes:
        if not PLAIN.fullmatch(key) or any(s in key for s in self.special):
            raise _NotPlain
        ids = [*self.newline] if key[0] == "\n" else []
        for piece in PIECES.findall(key[1:] if ids else " " + key):
            if piece.isascii():
                shown = piece.replace(" ", self.letters[32])
            else:
                shown = piece.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.merge(shown)]
        found = array("I", ids).tobytes()
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.clear()
            self[key] = found
        return found


class MemoEncoder:
    """``encode(text)`` -> ids as a little-endian uint32 array.

    ``path`` is a tokenizer file of the ``tokenizers`` library with a byte-level
    BPE; no special tokens are added, and texts that hold a special token's
    string are left to the library.  Any other kind of tokenizer works without
    the memo.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.memoizes = (spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel"
                         and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and not spec.get("normalizer") and not spec.get("post_processor"))
        if self.memoizes:
            special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
            self.words = _Words(self.tok, special, memo_words)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, text: str | None) -> np.ndarray:
        """Null and empty texts have no ids."""
        if not text:
            return np.empty(0, dtype="<u4")
        if not self.memoizes:
            return self.whole(text)
        # "a b\nc" -> "\na", "b", "\nc"; where white space comes in runs, a key isn't plain
        keys = ("\n" + text.replace("\n", " \n")).split(" ")
        try:
            ids = b"".join(map(self.words.__getitem__, keys))
        except _NotPlain:
            return self.whole(text)
        return np.frombuffer(ids, dtype="<u4")[1:]


def encoder(path: str, memo_words: int = MEMO_WORDS) -> MemoEncoder:
    """The worker's encoder for a tokenizer file, made once per process.  A smaller memo
    takes less of the worker's memory and more time."""
    key = path, memo_words
    if key not in _READY:
        _READY[key] = MemoEncoder(path, memo_words)
    return _READY[key]
