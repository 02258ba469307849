"""Texts cut into units that byte-level and piece tokenizers treat on their own."""

from __future__ import annotations

import re

#: A blank beside white space or at an edge of the text.
_ODD = re.compile(r" (?:(?<!\S )|(?!\S))")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """The text cut at each blank between two signs that are not white space; the blanks themselves are left out.

    No token of a byte-level vocabulary, whose pattern starts a match at such a blank, and none of a piece vocabulary,
    where a blank can only open a piece, spans a cut. So a text's ids are those of its units, each behind its blank.
    """
    return _BETWEEN.split(text) if _ODD.search(text) else text.split(" ")


class Numbers(dict):
    """A number for each different key that is looked up, in the order of first sight."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number
