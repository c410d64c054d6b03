"""Shared by packing and BPE: texts as white-space-parted chunks, each encoded once and then looked up.

For vocabularies whose normaliser is NFC, white space to one space, lower case, and whose words never hold white
space, a chunk's ids don't depend on its neighbours.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

#: str.split() also splits at these four, which aren't white space in Unicode.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[" + "".join(map(chr, (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))) + "]+")


def chunks(text: str) -> list[str]:
    """The maximal runs without Unicode white space."""
    if _NOT_SPACE.search(text):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Words:
    """The normaliser and pre-tokenizer of a tokenizers file: NFC, lower case, and its pattern for words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special: dict[str, int] = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in self.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space is gone from chunks; what regex calls so beyond Unicode's White_Space is a symbol here.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^"))
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def of(self, chunk: str) -> list[str]:
        """The words of a text without white space and special tokens."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        # One character at a time where a final sigma would be told apart.
        return self.pattern.findall("".join(map(str.lower, text)) if "\u03a3" in text else text.lower())
