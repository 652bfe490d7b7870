"""Counting the tokens of a text, as chunk budgets need it. Any object with ``algorithm``, ``count`` and ``over`` is a counter."""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import cached_property

# The CJK ranges that basic tokenisation splits character by character.
CJK = r"\u4E00-\u9FFF\u3400-\u4DBF\U00020000-\U0002A6DF\U0002A700-\U0002B73F\U0002B740-\U0002B81F\U0002B920-\U0002CEAF\uF900-\uFAFF\U0002F800-\U0002FA1F"
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
SPECIAL = ["[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]"]
#: Code points from which a word is unknown as a whole.
LONG_WORD = 100


class BasicCounter:
    """Counts basic tokens: runs without white space, with CJK characters, punctuation and literal special tokens split off. Needs no vocabulary."""

    algorithm = "basic-tokens-v1"
    vocabulary_sha256 = hashlib.sha256(b"basic-tokens-v1").hexdigest()
    vocabulary_size = 0
    max_input_tokens, special_tokens = 256, 2

    @cached_property
    def _token(self):
        import regex

        special = "|".join(regex.escape(s) for s in SPECIAL)
        skip = r"[\p{Cc}\p{Cf}\p{Co}�&&[^\t\n\r]]"
        return regex.compile(rf"(?V1)(?:{special})|[{CJK}]|[{PUNCTUATION}]|(?:[^\s\p{{Z}}{PUNCTUATION}{CJK}]|{skip})*[^\s\p{{Z}}{PUNCTUATION}{CJK}\p{{Cc}}\p{{Cf}}\p{{Co}}�](?:[^\s\p{{Z}}{PUNCTUATION}{CJK}])*")

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self._token.finditer(text)]

    def count(self, text: str) -> int:
        return len(self.spans(text))

    def over(self, text: str) -> Callable[[int, int], int]:
        """A counter of slices of one text. A slice of a token is a token, so spans found once serve all slices."""
        spans = self.spans(text)
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        return lambda a, b: max(0, bisect_left(starts, b) - bisect_right(ends, a))

    def __reduce__(self):
        return (type(self), ())


class WordPieceCounter:
    """Uncased WordPiece over the lines of a vocabulary file: counts, and ids cut to the model's input with its first and last special token."""

    algorithm = "bert-uncased-wordpiece-v2"
    max_input_tokens, special_tokens = 256, 2

    def __init__(self, path: str):
        self.path = path
        raw = open(path, "rb").read()
        self.vocabulary_sha256 = hashlib.sha256(raw).hexdigest()
        self.ids = {w: i for i, w in enumerate(raw.decode().splitlines())}
        self.vocabulary_size = len(self.ids)

    def __reduce__(self):
        return (type(self), (self.path,))

    @cached_property
    def _split(self):
        import regex

        return regex.compile("(" + "|".join(regex.escape(s) for s in SPECIAL) + ")"), regex.compile(rf"[{CJK}]|[{PUNCTUATION}]|[^\s{PUNCTUATION}{CJK}]+")

    def tokenize(self, text: str) -> list[str]:
        special, word = self._split
        out = []
        for part in special.split(text):
            if part in SPECIAL:
                out.append(part)
                continue
            clean = "".join(" " if c in " \t\n\r" or unicodedata.category(c) in ("Zs", "Zl", "Zp") else "" if c in "\0�" or unicodedata.category(c) in ("Cc", "Cf", "Co") else c for c in part)
            plain = "".join(c for c in unicodedata.normalize("NFD", clean.lower()) if unicodedata.category(c) != "Mn")
            for w in word.findall(plain):
                out += self._pieces(w)
        return out

    def _pieces(self, word: str) -> list[str]:
        if len(word) > LONG_WORD:
            return ["[UNK]"]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.ids:
                    break
            else:
                return ["[UNK]"]
            out.append(piece)
            at = end
        return out

    def count(self, text: str) -> int:
        return len(self.tokenize(text))

    def over(self, text: str) -> Callable[[int, int], int]:
        return lambda a, b: self.count(text[a:b])

    def encode(self, text: str) -> list[int]:
        body = [self.ids[t] for t in self.tokenize(text)][: self.max_input_tokens - self.special_tokens]
        return [self.ids["[CLS]"], *body, self.ids["[SEP]"]]
