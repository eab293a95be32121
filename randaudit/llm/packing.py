"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

A document's ids are cut into pieces of at most `size` ids; all but the first piece of a long document are full.
Full pieces are sequences of their own. The others are dealt into subproblems of about GROUP pieces, by a hash of their
place in the stored table, so repeated or null ids don't gather. A subproblem is a row of lengths that ISLANDS islands
evolve, each in tasks of its own: crossover injects whole well-filled bins of one parent into another, bins that
then hold a duplicate are dissolved, and their displaced pieces are put back by best fit. After each epoch an island
sends its elite to the next island. The best of all islands is the packing. Only lengths travel in the evolution.

Each subproblem may leave room in its last bins. So the pieces of the emptiest EMPTIEST bins of all subproblems are dealt and packed
again in the same way, in rounds, until one subproblem is left.

A null or empty text is one piece, the end id; very long texts are encoded whole and cut; rows that repeat a doc_id are packed each; other
columns of the documents, whatever their names, are neither read nor returned. An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from randaudit.llm.common import appended, bounded_batches, local_parts, stored, texts
from randaudit.llm.subwords import encoder

SIZE = 2048
END_ID = 0
GROUP = 3000
ISLANDS = 3
EPOCHS = 2
PARENTS = 4
CHILDREN = 6
EMPTIEST = 2


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document; a null or empty text is the end id alone."""
    bounded_batches(docs.sparkSession)

    def make() -> Callable:
        encode, end = encoder(tokenizer).encode, np.array([end_id], dtype=np.uint32)

        def columns(batch: pa.RecordBatch) -> list:
            out = []
            for ids in encode(batch.column("text").to_pylist()):
                ids = np.concatenate((ids, end)).astype("<u4")
                first = len(ids) % size or size
                at = [0, *range(first, len(ids) + 1, size)]
                out.append([(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))])
            return [[[dict(zip(("piece", "start", "length", "ids_crc32"), p, strict=True)) for p in own] for own in out]]

        return columns

    kind = "p array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
    return appended(texts(docs), make, kind, drop=("text",)).select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")


class Packing:
    """Bins of pieces with what they hold, and the open ones by their free room."""

    def __init__(self, size: int, bins: list[list[int]] | None = None, fill: list[int] | None = None):
        self.size, self.bins, self.fill = size, bins or [], fill or []
        self.free: dict[int, list[int]] = {}
        self.mask = 0  # bit r is set if a bin with room r is open
        for at, held in enumerate(self.fill):
            self._open(at, size - held)

    def _open(self, at: int, room: int) -> None:
        if room:
            self.free.setdefault(room, []).append(at)
            self.mask |= 1 << room

    def put(self, order: list[int], lengths: list[int]) -> Packing:
        """Best fit: each piece goes to the fullest bin that still takes it, or to a new one."""
        bins, fill, free = self.bins, self.fill, self.free
        for i in order:
            n = lengths[i]
            fits = self.mask >> n
            if fits:
                room = n + ((fits & -fits).bit_length() - 1)
                same = free[room]
                at = same.pop()
                if not same:
                    self.mask &= ~(1 << room)
                bins[at].append(i)
                fill[at] += n
            else:
                room, at = self.size, len(bins)
                bins.append([i])
                fill.append(n)
            self._open(at, room - n)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins are better; then fuller ones (Falkenauer's mean square of the fill). Smaller is better."""
        return len(self.bins), -sum(f * f for f in self.fill) / (self.size**2 * max(1, len(self.fill)))


def cross(one: Packing, other: Packing, lengths: list[int], rng: np.random.Generator) -> Packing:
    """Well-filled bins of `other` go whole into `one`; bins of `one` with a duplicate dissolve; displaced pieces are put by best fit."""
    best = sorted(range(len(other.bins)), key=lambda k: -other.fill[k])[: max(1, len(other.bins) // 2)]
    chosen = [k for k, yes in zip(best, rng.random(len(best)) < 0.5, strict=True) if yes] or best[:1]
    inside = {i for k in chosen for i in other.bins[k]}
    kept, displaced = [], []
    for k, b in enumerate(one.bins):
        if inside.isdisjoint(b):
            kept.append(k)
        else:
            displaced += [i for i in b if i not in inside]
    # Mutation: the emptiest bins dissolve as well, so that their room is dealt anew.
    kept.sort(key=lambda k: -one.fill[k])
    loose = max(1, len(kept) // 20)
    displaced += [i for k in kept[-loose:] for i in one.bins[k]]
    kept = kept[:-loose]
    displaced.sort(key=lambda i: -lengths[i])
    bins = [*(list(other.bins[k]) for k in chosen), *(list(one.bins[k]) for k in kept)]
    return Packing(one.size, bins, [*(other.fill[k] for k in chosen), *(one.fill[k] for k in kept)]).put(displaced, lengths)


def lower_bound(lengths: list[int], size: int) -> int:
    """No packing has fewer bins: the total, and the pieces of over half a sequence, which never share one."""
    return max(-(-sum(lengths) // size), sum(2 * n > size for n in lengths))


def _flat(packing: Packing, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(packing.bins):
        out[b] = k
    return out


def _grouped(flat: list[int], lengths: list[int], size: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        bins[k].append(i)
    bins = [b for b in bins if b]
    return Packing(size, bins, [sum(lengths[i] for i in b) for b in bins])


def evolve(lengths: list[int], population: list[list[int]], island: int, epoch: int, size: int = SIZE) -> list[Packing]:
    """One epoch of an island: its PARENTS best packings, best first. Same input, same result.

    A packing with as few bins as the lower bound allows is optimal: the island then rests.
    """
    rng = np.random.default_rng((island, epoch, len(lengths)))
    people = [_grouped(p, lengths, size) for p in population]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bound = lower_bound(lengths, size)
    while len(people) < PARENTS and not (people and min(len(p.bins) for p in people) <= bound):
        noise = rng.normal(0, size / 24, len(lengths)) if people else np.zeros(len(lengths))
        people.append(Packing(size).put(sorted(order, key=lambda i: -(lengths[i] + noise[i])), lengths))
    people.sort(key=Packing.fitness)
    for _ in range(CHILDREN):
        if len(people[0].bins) <= bound:
            break
        a, b = rng.choice(len(people), 2, replace=len(people) < 2)
        people = sorted([*people, cross(people[a], people[b], lengths, rng)], key=Packing.fitness)[:PARENTS]
    return people


def pack(cut: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset (place in the sequence, from 0 without gaps). cut is a stored table."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = cut.where(F.col("length") == size).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    out = full.select(*columns)
    loose = cut.where(F.col("length") < size).withColumn("at", F.monotonically_increasing_id())
    n, last, level = max(1, -(-loose.count() // group)), None, 0
    while True:
        placed = _solved(loose, n, level, size)
        inside = Window.partitionBy("sub", "bin").orderBy(F.desc("length"), "at").rowsBetween(Window.unboundedPreceding, -1)
        last, again = n, stored(placed.where("again").drop("sub", "bin", "again"), "packing-again") if n > 1 else None
        n = max(1, -(-again.count() // group)) if again else last
        done = placed.where("not again") if n < last else placed
        rest = done.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
        # Bins of a subproblem are fewer than its pieces; a level's subproblems are fewer than those of the level before.
        rest = rest.withColumn("sequence_id", F.lit(level << 56) + F.col("sub") * (1 << 24) + F.col("bin"))
        out = out.unionByName(rest.select(*columns))
        if n >= last:
            return out
        loose, level = again, level + 1


def _solved(loose: DataFrame, n: int, level: int, size: int) -> DataFrame:
    """The pieces of loose with sub, bin, and again (whether the bin is one of the emptiest of its subproblem), from n subproblems."""
    dealt = loose.withColumn("sub", F.pmod(F.xxhash64("at", F.lit(level)), F.lit(n)))
    item = F.struct("length", "at", "doc_id", "piece", "start", "ids_crc32")
    problems = stored(dealt.groupBy("sub").agg(F.sort_array(F.collect_list(item)).alias("items")), "packing-problems")
    ids = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    state = problems.select("sub", F.col("items.length").alias("lengths"), ids, F.array().cast("array<array<int>>").alias("people"))
    # An epoch of an island takes some hundredths of a second: a task gets a dozen, not one.
    tasks = max(local_parts(loose.sparkSession), n * ISLANDS // 12)
    for epoch in range(EPOCHS):
        state = _epoch(state.repartition(tasks, "sub", "island"), epoch, size)
        if epoch < EPOCHS - 1:
            ring = Window.partitionBy("sub").orderBy("island")
            sent = F.coalesce(F.lag("elite").over(ring), F.last("elite").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            state = state.withColumn("sent", sent).withColumn("people", F.array_append("people", F.col("sent"))).drop("sent", "elite", "bins", "square", "emptiest")
    best = state.groupBy("sub").agg(F.min_by(F.struct("elite", "emptiest"), F.struct("bins", "square", "island")).alias("best"))
    best = stored(best.select("sub", "best.elite", "best.emptiest"), "packing-best")
    placed = problems.join(best, "sub").select("sub", "emptiest", F.explode(F.arrays_zip("items", "elite")).alias("x"))
    return placed.select("sub", "x.items.*", F.col("x.elite").alias("bin"), F.array_contains("emptiest", F.col("x.elite")).alias("again"))


def _epoch(state: DataFrame, epoch: int, size: int) -> DataFrame:
    """sub, island, lengths, people, elite, bins, square, emptiest after one epoch."""

    def columns(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], [], []]
        for island, lengths, people in zip(*(batch.column(c).to_pylist() for c in ("island", "lengths", "old")), strict=True):
            made = evolve(lengths, people, island, epoch, size)
            flat = [_flat(p, len(lengths)).tolist() for p in made]
            bins, square = made[0].fitness()
            fill = made[0].fill
            emptiest = sorted((k for k in range(bins) if fill[k] < size), key=lambda k: (fill[k], k))[:EMPTIEST]
            for column, value in zip(out, (flat, flat[0], bins, square, emptiest), strict=True):
                column.append(value)
        return out

    renamed = state.withColumnRenamed("people", "old")
    return appended(renamed, lambda: columns, "people array<array<int>>, elite array<int>, bins int, square double, emptiest array<int>", drop=("old",))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(stored(pieces(docs, tokenizer, size, end_id), "packing-pieces"), size)
