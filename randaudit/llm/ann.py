"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Vectors are projected (principal directions of a bounded sample, rotated and shifted anew for each curve) and ordered
along several Hilbert curves; Spark range-partitions and sorts the orderings. A query looks at the window of keys around
its own place on every curve; the windows' candidates are merged, and the best are scored again exactly. To make inner products a
matter of nearness, data vectors get one more coordinate that lifts them all to the largest norm; queries get 0 there.

Neither the number of curves nor the radius of the windows is a constant: a bounded set of probe queries is compared with all
vectors, and one more pass counts how many keys lie between a probe and its true neighbours on every curve. From these counts follows
the radius at which `target` of the neighbours lie in a window, for every number of curves. The fewest curves are taken whose
windows together hold under NARROW of the table; where none do (isotropic noise), as many as there are. So recall holds on
any table, and vectors with structure get few curves and narrow windows.

A window's vectors travel as 16-bit numbers with a scale. A task holds one block of data at a time; the queries that look at it
stream past, and blocks with more than ASKED of them are dealt to several tasks. A query drops candidates below a floor, about the score
of its 4 (k + 1)-th nearest as a bounded sample of the data tells it; the few queries that are left with too few look again without one.

Equal vectors are searched once and stand for all their ids, so a very common vector is one candidate. Vectors that are
null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows with a
null vec_id. Rows that repeat a vec_id are one neighbour, with the best of their scores. Other columns, whatever their names,
are neither read nor returned. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from randaudit.llm.common import appended, bounded_batches, local_parts, stored

#: Numbers of curves that are weighed, and the part of the table that all windows of a query may hold together.
CURVES, NARROW = (4, 8, 16, 32), 1 / 3
#: Coordinates of a curve and bits of each: keys are longs.
DIMS, BITS = 8, 7
#: Rows that directions, scales and floors are fitted on, at most; probe queries, at most; rows of a block, at most; queries of a block that one task takes.
SAMPLE, PROBES, BLOCK, ASKED = 4096, 128, 16384, 20_000
TARGET = 0.94


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n, d) along the Hilbert curve, after Skilling (2004), for d * bits <= 63."""
    x = x.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections, shifts and scales of the curves, fitted on a bounded sample of lifted vectors."""

    def __init__(self, sample: np.ndarray, top: float, curves: int):
        self.top, self.sample = top, sample
        lifted = self.lift(sample)
        self.mean = lifted.mean(axis=0)
        _, _, axes = np.linalg.svd(lifted - self.mean, full_matrices=False)
        rng = np.random.default_rng(11)
        self.maps, self.shifts = [], []
        turned = np.zeros((0, len(axes)))
        for _ in range(curves):
            if len(turned) < min(DIMS, len(axes)):  # one rotation serves as many curves as it has directions
                turned, _ = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))
            own, turned = turned[:DIMS] @ axes, turned[DIMS:]
            spread = (lifted - self.mean) @ own.T
            scale = np.maximum(spread.std(axis=0), 1e-12)
            self.maps.append(own / scale[:, None])
            self.shifts.append(rng.uniform(0, 1, len(own)))

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        norms = np.linalg.norm(x, axis=1)
        if query:
            return np.hstack([x / norms[:, None], np.zeros((len(x), 1))])
        rest = np.sqrt(np.maximum(self.top**2 - norms**2, 0))
        return np.hstack([x, rest[:, None]]) / self.top

    def keys(self, x: np.ndarray, query: bool, curves: int | None = None) -> list[np.ndarray]:
        lifted = self.lift(x, query) - self.mean
        out = []
        for own, shift in list(zip(self.maps, self.shifts, strict=True))[:curves]:
            # Three deviations either way fill half of the grid; the shift moves them inside it.
            place = np.clip((lifted @ own.T + 3) / 6, 0, 1) + shift
            out.append(hilbert(np.minimum((place * (1 << (BITS - 1))).astype(np.int64), (1 << BITS) - 1), BITS))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles): the rows that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    own = own.where(f"vec_id is not null and v is not null and {fine}")
    length = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    found = length.collect()
    return own.where(F.size("v") == (found[0].n if found else 0)).withColumn("v", F.transform("v", lambda x: x + 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[list[int], list[float]]]:
    """For each row of scores the k best ids (ties to smaller ids)."""
    out = []
    floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    for row, least in zip(scores, floor, strict=True):
        at = np.flatnonzero(row >= least)
        at = at[np.lexsort((ids[at], -row[at]))[:k]]
        out.append((ids[at].tolist(), row[at].tolist()))
    return out


def _distinct(own: DataFrame, k: int) -> DataFrame:
    """rep (smallest vec_id), v, ids (its k smallest vec_ids) of each distinct vector; ranks are limited before the shuffle."""
    ranked = own.distinct().withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("k") <= k)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "v", "ids")


def _truth(reps: DataFrame, probes: list, k: int) -> DataFrame:
    """q, rep: the k best vectors of each probe, by comparing it with all."""
    sent = reps.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = [p[0] for p in sent.value], np.array([p[1] for p in sent.value])
        best: list[tuple[list[int], list[float]]] = [([], []) for _ in names]
        for b in batches:
            if b.num_rows:
                ids = b.column("rep").to_numpy()
                for i, (own, scores) in enumerate(_top(q @ _matrix(b.column("v")).T, ids, k)):
                    every = sorted(zip([-s for s in best[i][1] + scores], best[i][0] + own, strict=True))[:k]
                    best[i] = [r for _, r in every], [-s for s, _ in every]
        for name, (own, scores) in zip(names, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), type=pa.int64()), pa.array(own, type=pa.int64()), pa.array(scores, type=pa.float64())], names=["q", "rep", "score"])

    found = reps.select("rep", "v").mapInArrow(run, "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).select("q", "rep")


def _distances(reps: DataFrame, fitted: Curves, probes: dict[int, list], near: list) -> np.ndarray:
    """(curves, rows of near): how many data keys lie between a probe and its true neighbour; near has rows q, rep, v."""
    asked = fitted.keys(np.array(list(probes.values())), True)
    found = fitted.keys(np.array([r.v for r in near]), False)
    place = {q: k for k, q in enumerate(probes)}
    of = np.array([place[r.q] for r in near])
    marks = [np.unique(np.concatenate(both)) for both in zip(asked, found, strict=True)]
    sent = reps.sparkSession.sparkContext.broadcast((fitted, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = sent.value
        sums = [np.zeros(len(m) + 1, dtype=np.int64) for m in at]
        for b in batches:
            if b.num_rows:
                for total, m, keys in zip(sums, at, own.keys(_matrix(b.column("v")), False), strict=True):
                    total += np.bincount(np.searchsorted(m, keys, side="right"), minlength=len(total))
        for c, total in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(total), c), np.arange(len(total)), total)], names=["curve", "mark", "n"])

    counted = reps.select("v").mapInArrow(run, "curve long, mark long, n long").groupBy("curve", "mark").agg(F.sum("n").alias("n"))
    below = [np.zeros(len(m) + 1, dtype=np.int64) for m in marks]
    for r in counted.collect():  # two marks at most for each of PROBES * k pairs and curve
        below[r.curve][r.mark] = r.n
    ranks = [np.cumsum(b) for b in below]
    return np.array(
        [np.abs(n[np.searchsorted(m, q)][of] - n[np.searchsorted(m, f)]) for n, m, q, f in zip(ranks, marks, asked, found, strict=True)]
    )


def _plan(far: np.ndarray, n: int, target: float) -> tuple[int, int]:
    """(curves, radius): the fewest curves whose windows hold `target` of the neighbours and under NARROW of n vectors."""
    for curves in CURVES:
        nearest = np.sort(far[:curves].min(axis=0))
        radius = max(16, int(nearest[min(len(nearest) - 1, math.ceil(target * len(nearest)))]) + 1)
        if 2 * radius * curves < NARROW * n or curves == CURVES[-1]:
            return curves, radius
    raise AssertionError


def _ranked(points: DataFrame, curves: Curves, n: int) -> DataFrame:
    """curve, query, rep, rank: how many data points precede a point in the concatenated orderings of the first n curves."""
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast(curves)

    def make() -> Callable:
        own = sent.value

        def columns(batch: pa.RecordBatch) -> list:
            if not batch.num_rows:
                return [[]]
            x, query = _matrix(batch.column("v")), batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            both = np.empty((n, len(x)), dtype=np.int64)
            for kind in (False, True):
                if (query == kind).any():
                    both[:, query == kind] = own.keys(x[query == kind], kind, n)
            return [both.T.tolist()]

        return columns

    keyed = appended(points, make, "keys array<bigint>", drop=("v",)).select("query", "rep", F.posexplode("keys").alias("curve", "key"))
    order = ["curve", "key", "query", "rep"]
    dealt = keyed.repartitionByRange(local_parts(spark), *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            data = ~b.column("query").to_numpy(zero_copy_only=False).astype(bool)
            upto = before + np.cumsum(data)
            columns = [b.column(c) for c in ("curve", "query", "rep")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(data), type=pa.int32()), pa.array(upto - data, type=pa.int64())], names=["curve", "query", "rep", "part", "at"])
            before += int(data.sum())

    placed = stored(dealt.mapInArrow(number, "curve int, query boolean, rep long, part int, at long"), "ann-order")
    counts = placed.where(~F.col("query")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = placed.select("part").distinct().join(counts, "part", "left")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").select("curve", "query", "rep", (F.col("at") + F.col("offset")).alias("rank"))


def _coded(reps: DataFrame) -> DataFrame:
    """rep, code (16-bit components), scale of every data vector."""

    def columns(batch: pa.RecordBatch) -> list:
        if not batch.num_rows:
            return [[], []]
        x = _matrix(batch.column("v"))
        scale = np.abs(x).max(axis=1) / 32767
        return [[row.tobytes() for row in np.rint(x / scale[:, None]).astype("<i2")], scale.tolist()]

    return appended(reps.select("rep", "v"), lambda: columns, "code binary, scale double", drop=("v",))


def _floored(queries: DataFrame, fitted: Curves, at: int) -> DataFrame:
    """q, code (32-bit components), scale (a floor: the at-th best score in the sample; none for 0) of every query vector."""
    sent = queries.sparkSession.sparkContext.broadcast(fitted)

    def columns(batch: pa.RecordBatch) -> list:
        own = sent.value
        if not batch.num_rows:
            return [[], []]
        x = _matrix(batch.column("v"))
        floor = np.full(len(x), -np.inf)
        if 0 < at <= len(own.sample):
            slack = 1e-4 * own.top * np.linalg.norm(x, axis=1)  # more than the codes lose
            floor = np.partition(x @ own.sample.T, -at, axis=1)[:, -at] - slack
        return [[row.tobytes() for row in x.astype("<f4")], floor.tolist()]

    return appended(queries.select(F.col("rep").alias("q"), "v"), lambda: columns, "code binary, scale double", drop=("v",))


def _scores(both: DataFrame, radius: int, most: int) -> DataFrame:
    """q, rep, score of the candidates in the windows; both holds data (asks false) and queries (asks true) by block and part.

    The rows of a block and part follow each other, data first, all by rank: a block's data are held, its queries stream past.
    """

    def near(ready: tuple, rank: np.ndarray, ids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
        ranks, reps, x = ready
        out: list[list] = [[], [], []]
        i = 0
        while i < len(rank):  # queries that are close on the curve are scored together
            j = min(i + 64, int(np.searchsorted(rank, rank[i] + radius // 4, side="right")))
            lo, hi = np.searchsorted(ranks, [rank[i] - radius, rank[j - 1] + radius + 1])
            s = q[i:j] @ x[lo:hi].T
            fine = s >= floor[i:j, None]
            for row in np.flatnonzero(fine.sum(axis=1) > most).tolist():
                fine[row] &= s[row] >= np.partition(s[row], -most)[-most]
            at, which = np.nonzero(fine)
            for column, values in zip(out, (ids[i:j][at], reps[lo:hi][which], s[at, which].astype(np.float64)), strict=True):
                column.append(values)
            i = j
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["q", "rep", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for b in batches:
            block, part, asks, rank, ids, scale = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "asks", "rank", "id", "scale"))
            changes = (np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if (block[i], part[i]) != key:
                    key, held, ready = (block[i], part[i]), [], None
                raw = np.frombuffer(b"".join(b.column("code").slice(i, j - i).to_pylist()), dtype="<f4" if asks[i] else "<i2").reshape(j - i, -1)
                if not asks[i]:
                    held.append((rank[i:j], ids[i:j], raw * scale[i:j, None].astype(np.float32)))
                elif held:
                    ready = ready or tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    yield near(ready, rank[i:j], ids[i:j], raw, scale[i:j].astype(np.float32))

    return both.mapInArrow(run, "q long, rep long, score double")


def _looked(ranked: DataFrame, reps: DataFrame, asked: DataFrame, radius: int, block: int, most: int) -> DataFrame:
    """q, rep: the best `most` candidates above its floor in the windows of each query of `asked`, as a stored table."""
    spark = ranked.sparkSession
    data = ranked.where(~F.col("query")).join(_coded(reps), "rep")
    data = data.select(F.floor(F.col("rank") / block).alias("block"), F.lit(False).alias("asks"), "rank", F.col("rep").alias("id"), "code", "scale")
    window = F.sequence(F.floor(F.greatest(F.col("rank") - radius, F.lit(0)) / block), F.floor((F.col("rank") + radius) / block))
    places = ranked.where("query").select(F.col("rep").alias("q"), "rank", F.explode(window).alias("block"))
    busy = stored(places.groupBy("block").count().where(F.col("count") > ASKED).select("block", F.ceil(F.col("count") / ASKED).cast("int").alias("parts")), "ann-busy")
    looking = places.join(asked, "q").select("block", F.lit(True).alias("asks"), "rank", F.col("q").alias("id"), "code", "scale")
    if busy.isEmpty():
        both = data.unionByName(looking).withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        data = data.join(busy, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        looking = looking.join(busy, "block", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
        both = data.unionByName(looking)
    dealt = both.repartition(local_parts(spark), "block", "part").sortWithinPartitions("block", "part", "asks", "rank")
    merged = _scores(dealt, radius, most).groupBy("q", "rep").agg(F.max("score").alias("about"))
    rough = Window.partitionBy("q").orderBy(F.desc("about"), "rep")
    return stored(merged.withColumn("k", F.row_number().over(rough)).where(F.col("k") <= most).select("q", "rep"), "ann-found")


def search(vectors: DataFrame, is_query: Column | None = None, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, nearest first, ties to smaller vec_id."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = usable(vectors)
    asked = is_query if is_query is not None else F.col("vec_id") % 20 == 0
    reps = stored(_distinct(own, k + 1), "ann-vectors")
    asking = stored(own.where(asked).distinct().join(reps.select("v", "rep"), "v").select("vec_id", "rep", "v"), "ann-queries")
    queries = asking.groupBy("rep").agg(F.first("v").alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    top, n = reps.agg(F.max(size), F.count(F.lit(1))).first()
    probes = {r.rep: list(r.v) for r in queries.orderBy(F.xxhash64("rep", F.lit(1))).limit(PROBES).collect()}
    if top is None or not probes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()
    fitted = Curves(np.array([r.v for r in sample]), top, CURVES[-1])
    truth = _truth(reps, list(probes.items()), k).join(reps.select("rep", "v"), "rep").collect()  # PROBES * k rows at most
    curves, radius = _plan(_distances(reps, fitted, probes, truth), n, target)

    points = reps.select(F.lit(False).alias("query"), "rep", "v").unionByName(queries.select(F.lit(True).alias("query"), "rep", "v"))
    ranked = _ranked(points, fitted, curves)
    block = max(256, min(2 * radius, BLOCK))
    most = 2 * k + 10
    found = _looked(ranked, reps, _floored(queries, fitted, math.ceil(4 * (k + 1) * len(sample) / n)), radius, block, most)
    short = found.groupBy("q").count().where(F.col("count") > min(k, n - 1)).select(F.col("q").alias("rep"))
    short = stored(queries.join(short, "rep", "left_anti"), "ann-short")
    if not short.isEmpty():
        again = _looked(ranked, reps, _floored(short, fitted, 0), radius, block, most)
        found = found.join(short.select(F.col("rep").alias("q")), "q", "left_anti").unionByName(again)
    exact = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = found.join(reps, "rep").join(queries.select(F.col("rep").alias("q"), F.col("v").alias("w")), "q").select("q", "ids", exact.alias("score"))
    named = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("k", F.row_number().over(first)).where(F.col("k") <= k + 1).drop("k")
    pairs = asking.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")).join(named, "q").where(F.col("vec_id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
