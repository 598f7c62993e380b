"""Pre-tokens: the pieces of a text that byte-level BPE encodes one by one."""

from __future__ import annotations

import re
from functools import cache

import regex

_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _char_class(category: str) -> str:
    """The characters below U+10000 that `regex` puts into a category, as the inside of a character class of `re`."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))  # no run of a category spans the surrogates
    return "".join(rf"\u{ord(m[0][0]):04x}-\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{category}+", plane))


@cache
def splitter(pattern: str):
    """A function from a text to the list of its matches of a byte-level BPE pattern.

    For the well-known pattern the classes of `regex` are spelled out for `re`, which runs about twice as fast; a text
    with characters above U+FFFF, or any other pattern, goes through `regex` itself.
    """
    exact = regex.compile(pattern)
    if r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" not in pattern or not pattern.startswith("'s|'t|'re|'ve|'m|'ll|'d|"):
        return exact.findall
    letter, number, space = (_char_class(x) for x in (r"\p{L}", r"\p{N}", r"\s"))
    # Contractions start with an apostrophe and words with a blank or a letter, so words may be tried first.
    fast = re.compile(rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")

    def split(text: str) -> list[str]:
        return exact.findall(text) if _ASTRAL.search(text) else fast.findall(text)

    return split
