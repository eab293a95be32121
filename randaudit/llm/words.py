"""The word rule that the operators on words share."""

from __future__ import annotations

import re

#: A word: a run of characters that are not ASCII other than letters and digits, after lower-casing A-Z only.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes(range(65)) + UPPER.lower().encode() + bytes(range(91, 256))


def lower_bytes(text: str) -> bytes:
    """UTF-8 of the text with A-Z lower-cased: the bytes of other characters are all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def ascii_lower(text: str) -> str:
    """The text with A-Z lower-cased; all positions stay."""
    return lower_bytes(text).decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    """Words of a whole text; a null text has none."""
    return WORD.findall(ascii_lower(text)) if text else []
