"""Benchmark decontamination: windows of benchmark words are looked up in whole training texts.

The normalised windows of all benchmark items form a hash set that is broadcast; a narrow pass over the documents scans their
word windows, and a hit by hash is verified word by word. A worker builds the set once, from the items' words: about 20 bytes
for each window and 120 for each distinct word. A benchmark of more than MAX_WORDS words is cut into parts of at most about that many,
each broadcast for a pass of its own; what a pass adds to the rows is stored in the shared folder before the next. So the
same method holds at any size, and a worker's memory has a bound.

Null texts have no words, empty texts neither; very long texts are scanned whole; repeated items and repeated documents are each
judged alone. Other columns of both tables, whatever their names, are left behind. Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from randaudit.llm.common import appended, bounded_batches, forget, stored, texts
from randaudit.llm.words import SPARK_WORD, UPPER, WORD, ascii_lower, words

WINDOW = 13
#: Benchmark words that are broadcast at once, about, and words of an item that stay together at most.
MAX_WORDS, MAX_ITEM_WORDS = 2_000_000, 100_000
#: A document is contaminated from this share of hit words on.
SHARE = 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


def benchmark_items(benchmark: DataFrame, size: int = WINDOW, longest: int = MAX_ITEM_WORDS) -> DataFrame:
    """item (id as text), w (its words): the non-empty items; longer ones in pieces that overlap, so that no window is lost."""
    lower = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())
    own = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(lower, F.lit(SPARK_WORD), F.lit(0)).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.expr(f"sequence(1, greatest(size(w) - {size} + 1, 1), {longest})")
    return own.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, longest + size - 1))).alias("w"))


class _Index:
    """Windows of one size as sorted hashes to probe with, the words' ids to verify with, and the items that hold each."""

    def __init__(self, rows: list[tuple[str, list[str]]], size: int = WINDOW):
        self.vocabulary: dict[str, int] = {}
        add = self.vocabulary.setdefault
        ids = [np.fromiter((add(w, len(self.vocabulary) + 1) for w in own), dtype=np.uint32, count=len(own)) for _, own in rows]
        self.items = sorted({item for item, _ in rows})
        place = {item: k for k, item in enumerate(self.items)}
        by_n: dict[int, list[int]] = {}
        for k, own in enumerate(ids):
            by_n.setdefault(min(size, len(own)), []).append(k)
        self.by_n = {n: self._windows(n, [ids[k] for k in ks], [place[rows[k][0]] for k in ks]) for n, ks in by_n.items()}

    @staticmethod
    def hashes(ids: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
        out = np.full(len(starts), seed, dtype=np.uint64)
        for k in range(n):
            out = (out ^ ids[starts + k]) * _MULT
            out ^= out >> np.uint64(29)
        return out

    def _windows(self, n: int, ids: list[np.ndarray], items: list[int]) -> tuple:
        """(hashes, first place of each window in flat, flat, bounds and items of each window, seed)."""
        flat = np.concatenate(ids)
        ends = np.cumsum([len(x) for x in ids])
        starts = np.concatenate([np.arange(e - len(x), e - n + 1) for x, e in zip(ids, ends, strict=True)])
        owner = np.repeat(items, [len(x) - n + 1 for x in ids])
        for seed in range(64):
            h = self.hashes(flat, starts, n, seed)
            known, first, which = np.unique(h, return_index=True, return_inverse=True)
            # Equal hashes of different windows: take another seed.
            if all((flat[starts + k] == flat[starts[first[which]] + k]).all() for k in range(n)):
                break
        else:
            raise RuntimeError("window hashes collide under every seed")
        pairs = np.unique(which.astype(np.int64) * len(self.items) + owner)
        return known, starts[first], flat, np.searchsorted(pairs, np.arange(len(known) + 1) * len(self.items)), pairs % len(self.items), seed

    def find(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:
        """(start, end) of every occurrence of a window, and the ids of all items that hold one of them."""
        spans, named = [], []
        for n, (known, first, flat, bounds, items, seed) in self.by_n.items():
            if len(ids) < n:
                continue
            # Only where n words in a row are benchmark words at all can a window occur.
            run = np.cumsum(np.concatenate(([0], ids == 0)))
            starts = np.flatnonzero(run[n:] == run[:-n])
            if not len(starts):
                continue
            h = self.hashes(ids, starts, n, seed)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            same = known[at] == h
            starts, at = starts[same], at[same]
            for k in range(n):
                fine = ids[starts + k] == flat[first[at] + k]
                starts, at = starts[fine], at[fine]
            spans += [(s, s + n) for s in starts.tolist()]
            named += [items[bounds[w] : bounds[w + 1]] for w in np.unique(at).tolist()]
        return spans, [self.items[k] for k in np.unique(np.concatenate(named)).tolist()] if named else []


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


#: The index that this worker built last, by the name of its part.
_BUILT: dict[str, _Index] = {}


def _index(name: str, rows: list, size: int) -> _Index:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _Index(rows, size)
    return _BUILT[name]


_HITS = "n_words long, hit_starts array<int>, hit_ends array<int>, items array<string>"


def _scan(rows, size: int, again: bool) -> Callable:
    """What a task runs over its documents: n_words, hit_starts, hit_ends, items, with those of earlier parts where there are any."""
    name = uuid.uuid4().hex

    def make() -> Callable:
        forget()
        index = _index(name, rows.value, size)
        get = index.vocabulary.get

        def columns(batch: pa.RecordBatch) -> list:
            out = []
            old = [batch.column(c).to_pylist() for c in ("old_starts", "old_ends", "old_items")] if again else None
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = words(text)
                ids = np.fromiter((get(w, 0) for w in own), dtype=np.uint64, count=len(own))
                spans, items = index.find(ids)
                if old:
                    spans += list(zip(old[0][k], old[1][k], strict=True))
                    items = sorted({*items, *old[2][k]})
                out.append((len(own), *_merged(spans), items))
            return [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]

        return columns

    return make


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_words: int = MAX_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns of keep, n_words, hit_starts, hit_ends (merged word spans), items (ids as sorted strings) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = stored(benchmark_items(benchmark, size), "decontam-items")
    n = items.agg(F.coalesce(F.sum(F.size("w").cast("long")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-n // max_words))
    found = texts(docs, *keep)
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "w"), F.lit(parts)) == part)
        rows = spark.sparkContext.broadcast([(r.item, list(r.w)) for r in own.toLocalIterator()])  # about max_words words
        if part:
            found = stored(found.withColumnsRenamed({"hit_starts": "old_starts", "hit_ends": "old_ends", "items": "old_items"}).drop("n_words"), "decontam-part")
        found = appended(found, _scan(rows, size, part > 0), _HITS, drop=("old_starts", "old_ends", "old_items"))
    return found


def judged(found: DataFrame) -> DataFrame:
    """The rows of hits() with n_hit (hit words) and contaminated (at least one word in SHARE is hit)."""
    n_hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for the rows of hits()."""
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return judged(found).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def cut(found: DataFrame) -> DataFrame:
    """doc_id, text: the rows of hits() with every hit span removed from the text, from its first to its last word.

    What surrounds the span stays as it is. A document that was all benchmark keeps an empty or blank text.
    """

    def columns(batch: pa.RecordBatch) -> list:
        out = []
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "hit_starts", "hit_ends")), strict=True):
            if starts:
                # Lower-casing A-Z keeps all positions, so places in the lowered text hold for the text.
                at = [m.span() for m in WORD.finditer(ascii_lower(text))]
                last, kept = 0, []
                for s, e in zip(starts, ends, strict=True):
                    kept.append(text[last : at[s][0]])
                    last = at[e - 1][1]
                text = "".join([*kept, text[last:]])
            out.append(text)
        return [out]

    return appended(found.withColumnRenamed("text", "whole"), lambda: lambda b: columns(b.rename_columns([{"whole": "text"}.get(n, n) for n in b.schema.names])), "text string", drop=("whole", "n_words", "hit_starts", "hit_ends", "items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents") -> DataFrame:
    """doc_id, text without the contamination: mode "documents" removes contaminated documents, "spans" cuts hit words."""
    found = hits(docs, benchmark)
    if mode == "spans":
        return cut(found)
    return judged(found).where(~F.col("contaminated")).select("doc_id", "text")
