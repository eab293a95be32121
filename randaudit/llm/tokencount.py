"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries
the best score and the number of tokens of the best segmentation, and nothing else. The tie rules are those of the
unigram model of the tokenizers library: of equal scores the one whose last piece begins first wins; a character that
is no piece itself may be an unknown token, 10 below the worst score; unknown tokens in a row count as one.

Text is cut into words at blanks as that library's metaspace rule does, and each distinct word is counted once in a
worker, as long as it keeps being met: counts are kept in two generations, and words not met for a whole one are forgotten. The vocabulary is that of a public piece file; since the file ranks its pieces but has no unigram
scores, a piece scores minus the logarithm of its rank (a stated rule, not trained). A null or empty text has no tokens; very long texts
are counted whole; rows that repeat are counted each; other columns, whatever their names, are left behind; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from randaudit.llm.common import KEPT, appended, bounded_batches, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words of a generation; a worker keeps two.
MAX_WORDS = 500_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file; the unknown token comes first, with score 0."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [("<unk>", 0.0), *((model.id_to_piece(i), -math.log(k + 2)) for k, i in enumerate(plain))]


class Counter:
    """Counts tokens of texts under a unigram vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        if len(vocabulary) > 1:
            self.automaton.make_automaton()
        self.empty = len(vocabulary) == 1
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word, by forward dynamic programming over its characters."""
        n = len(word)
        best, count, open_ = [-math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        single = bytearray(n + 1)
        unknown = self.unknown

        def settle(p: int) -> None:
            # The last of the candidates for p: its own character, if that is no piece, as an unknown token.
            if not single[p] and best[p - 1] + unknown > best[p]:
                best[p] = best[p - 1] + unknown
                count[p] = count[p - 1] + (not open_[p - 1])
                open_[p] = True

        done = 1
        for last, (length, score) in self.automaton.iter(word) if not self.empty else ():
            end = last + 1
            while done < end:
                settle(done)
                done += 1
            start = end - length
            if best[start] + score > best[end]:
                best[end] = best[start] + score
                count[end] = count[start] + 1
                open_[end] = False
            if length == 1:
                single[end] = 1
        while done <= n:
            settle(done)
            done += 1
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = (text[1:] if text.startswith(SPACE) else text).split(SPACE)
        young, total = self.young, 0
        for w in words:
            n = young.get(w)
            if n is None:
                n = self.old.get(w)
                if n is None:
                    n = self.word(SPACE + w)
                if len(w) < 64:
                    young[w] = n
                    if len(young) >= MAX_WORDS:
                        self.old, self.young = young, {}
                        young = self.young
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each vocabulary file in a worker, shared by its tasks."""
    return Counter(unigram_vocabulary(path))


KEPT.append(counter.cache_clear)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens of every document; other columns are left behind, repeated rows are counted each."""
    bounded_batches(docs.sparkSession)

    def make() -> Callable:
        count = counter(path).text
        return lambda batch: [[count(t) for t in batch.column("text").to_pylist()]]

    return appended(texts(docs), make, "n_tokens long", drop=("text",))
