"""Token ids of whole texts by the tokenizers library, with repeated words encoded once.

Merges of these tokenizers never cross from a character that is no white space to one that is, nor from a letter to
what is none. So a text is cut at those places, each distinct piece is encoded by the library once in a worker, and its ids
are reused. Texts with characters for which this cut isn't proven (anything beyond Latin letters, odd white space,
strings of special tokens) are encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from randaudit.llm.common import KEPT

#: Pieces kept in a worker at most (about 200 bytes each); later pieces are then encoded again where they occur.
MAX_PIECES = 690_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(r"[\t\n\r -~¡-©«-±´¶-¸»¿-įı-ɏ]*\Z")
#: White space, then what is no letter, then letters: a piece ends after letters or before white space.
_PIECE = re.compile(rf"[ \t\n\r]*(?:[^ \t\n\r{_LETTERS}]+[{_LETTERS}]*|[{_LETTERS}]+)|[ \t\n\r]+")
#: The same without white space, for tokenizers that drop it.
_BARE = re.compile(rf"[^ \t\n\r{_LETTERS}]+[{_LETTERS}]*|[{_LETTERS}]+")
#: Pieces that stay apart when they follow each other.
_SPACED = re.compile(rf" ?[{_LETTERS}]+\Z")
_SLICE = 4096


class Encoder:
    """Encodes texts to arrays of uint32 ids, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.mark, self.mark_id = self._separator()
        # A tokenizer that lower-cases and drops white space knows one form of a word; A-Z and Latin letters lower alike everywhere.
        forms = [t.ids for t in self.tokenizer.encode_batch([" ÉcoLe", "\nécole ", "école", "É cole"], add_special_tokens=False)]
        self.folds = forms[0] == forms[1] == forms[2] != forms[3]

    def _separator(self) -> tuple[str, int]:
        """Text that stands between two words as one token of its own, and its id; none if neither candidate does."""
        for mark in ("\n", " ,"):
            parts = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in (" one", mark, " two", f" one{mark} two")]
            if len(parts[1]) == 1 and parts[3] == parts[0] + parts[1] + parts[2]:
                return mark, parts[1][0]
        return "", -1

    def _ids(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces; words after a blank are encoded many at a time, with a token between that no word holds."""
        before = " " if self.folds else ""
        spaced = [p for p in pieces if _SPACED.match(p) and (self.folds or p[0] == " ")] if self.mark else []
        out = {}
        for i in range(0, len(spaced), _SLICE):
            part = spaced[i : i + _SLICE]
            ids = np.array(self.tokenizer.encode_batch_fast([before + (self.mark + before).join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(part) - 1:
                raw = ids.tobytes()
                bounds = [-4, *(4 * cuts).tolist(), len(raw)]
                out.update((p, raw[a + 4 : b]) for p, a, b in zip(part, bounds, bounds[1:], strict=False))
        alone = [p for p in pieces if p not in out]
        for i in range(0, len(alone), _SLICE):
            part = alone[i : i + _SLICE]
            made = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            out.update((p, np.array(x.ids, dtype=np.uint32).tobytes()) for p, x in zip(part, made, strict=True))
        return out

    def _cut(self, text: str) -> list[str]:
        if text and _PLAIN.match(text) and not any(s in text for s in self.special):
            return _BARE.findall(text.lower()) if self.folds else _PIECE.findall(text)
        return [text] if text else []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.known
        cut = [self._cut(t or "") for t in texts]
        missing = list(set().union(*cut).difference(known))
        known.update(self._ids(missing))
        out = [np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype=np.uint32) for pieces in cut]
        over = len(known) - MAX_PIECES
        for p in missing:
            if over > 0 or len(p) > 64:
                del known[p]
                over -= 1
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file in a worker, shared by its tasks."""
    return Encoder(path)


KEPT.append(encoder.cache_clear)
