"""Pre-tokens of the public BPE vocabularies, split fast where every Unicode version agrees.

Texts whose characters all lie below U+0130 are split by a compiled pattern; any other text, and any
text with a special token's string in it, goes through the ``tokenizers`` library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cached_property

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters that the fast split leaves to the library: controls, U+0085, no-break space, and all from U+0130.
_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f]")


#: The same among ASCII characters.
_ODD = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]")


def _char_class(first_letter: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x130) if unicodedata.category(chr(i))[0] == first_letter)


_L, _N = _char_class("L"), _char_class("N")
#: The two public split patterns, for characters below U+0130.
BYTE_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
WORD_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")

#: The character that stands for each byte in such a vocabulary: printable ones for themselves, the others from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 0x100 + i for i, b in enumerate(sorted(set(range(0x100)) - set(_SHOWN)))}


class Vocabulary:
    """A vocabulary file of the ``tokenizers`` library; made once per Python worker and file."""

    _made: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        self.path = path

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        return cls._made.setdefault(path, cls(path))

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def _kind(self) -> tuple[re.Pattern | None, bool, list[str]]:
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        special = [t["content"] for t in spec["added_tokens"]]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]:
            return BYTE_SPLIT, False, special
        parts = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if parts == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            return WORD_SPLIT, True, special
        return None, False, special

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, each of which encodes alone as it does in place; None: ask the library."""
        pattern, lower, special = self._kind
        if pattern is None or _OTHER.search(text) or any(s in text for s in special):
            return None
        return pattern.findall(text.lower() if lower else text)

    def words(self, text: str) -> list[str] | None:
        """White-space words, where no pre-token has white space in it and each encodes alone; None: ask the library."""
        pattern, lower, special = self._kind
        if pattern is not WORD_SPLIT or not text.isascii() and _OTHER.search(text) or text.isascii() and _ODD.search(text) or any(s in text for s in special):
            return None
        return text.lower().split()

    def parts(self, word: str) -> list[str]:
        """The pre-tokens of one of ``words``."""
        return WORD_SPLIT.findall(word)

    @cached_property
    def _model(self):
        return self.library.model

    def encode_part(self, part: str) -> list[int]:
        """``encode`` for one of ``parts``, by the library's model without its steps before and after."""
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self._model.tokenize(shown)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
