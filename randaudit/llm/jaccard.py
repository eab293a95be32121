"""N-gram Jaccard join by chosen paths (Christiani and Pagh; the CPSJoin of Christiani, Pagh and Sivertsen).

A document is the set of its five-word shingles. In each run a set follows paths: on every level it chooses each of its
shingles with probability 1 / (threshold * size) by a hash of path and shingle, so sets that share shingles choose shared
ones and meet again. A path that few sets reach is a bucket to brute-force; one that many reach is split on the next
level. On the last level a bucket of any size is compared whole: in random parts first, then all sets that these left in
different clusters, in blocks. Runs repeat until a pair at the threshold is missed with a probability of under 1 - RECALL,
even if all its buckets are large and it must meet on every level.

Equal sets are one set from the start. Buckets compare sketches (b-bit minhashes) and only hand on which sets may belong
together; each such cluster is then compared exactly, in blocks of bounded size, which counts links without emitting pairs.
In these blocks a set is told by what it lacks of its cluster's first set and what it has besides; that first set travels once to
each block. So a very large group of near copies costs rows in proportion to its members times its blocks, never to its pairs.

The paths of all runs and levels are made with the shingles, in one pass over the texts; those of further levels are only
looked at below large buckets. Texts of clusters are found again by a 128-bit hash.

Texts without words (nulls and empty ones too) have no shingles and no links; a text of fewer than five words is one shingle of
all its words; very long texts are taken whole. Rows that repeat a doc_id are documents of their own. Other columns, whatever their
names, are neither read nor returned. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from randaudit.llm.common import appended, bounded_batches, forget, local_parts, stored, texts
from randaudit.llm.components import components
from randaudit.llm.words import words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
LEVELS = 2
#: Sets of a bucket that are compared with each other at once; larger ones are split, on the last level into random parts
#: for a first look and then into blocks, all pairs of which are compared.
BUCKET = 256
#: Sets of a block of a large bucket of the last level.
LEAF_SETS = 2048
#: Minhashes of a sketch (a byte each), and how many must agree for sets to be compared exactly (3.9 deviations below
#: what a pair at the threshold has on average).
SKETCH, AGREE = 128, 85
#: Sets and shingles of a block of a cluster, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 4_000_000
#: Texts that are fetched by a broadcast of their hashes at most; more are fetched by a shuffle join.
MAX_BROADCAST_TEXTS = 500_000
#: Large buckets whose keys are broadcast to find the paths below them at most; more are joined by a shuffle.
MAX_BROADCAST_PATHS = 500_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEEDS = np.random.default_rng(5).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float, levels: int = 1) -> int:
    """Runs after which a pair at the threshold shares a path of `levels` levels with probability `recall`.

    Such a pair shares one chosen shingle a path on average at least, so a shared path has none to go on with with
    probability 1/e at most, and lasts for k levels with probability p(k) = 1 - exp(-p(k - 1)) at least.
    """
    lasts = 1.0
    for _ in range(levels):
        lasts = 1 - math.exp(-lasts)
    return math.ceil(math.log(1 - recall) / math.log(1 - lasts))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _seeds(runs: int) -> np.ndarray:
    return _mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    own = words(text)
    if not own:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), dtype=np.uint64, count=len(own))
    n = min(size, len(own))
    out = np.full(len(own) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(31) ^ h[k : k + len(out)])
    return np.unique(out)


def sketch(own: np.ndarray) -> bytes:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), 4096):
        np.minimum(least, (own[i : i + 4096] * _SEEDS[:, None]).min(axis=1), out=least)
    return ((least >> np.uint64(24)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def paths(own: np.ndarray, now: np.ndarray, threshold: float = THRESHOLD, levels: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, parents) of the paths of a set on each of so many levels below the paths `now`."""
    chance = min(1.0, 1 / (threshold * len(own)))
    limit = np.uint64(min(2**64 - 1, int(chance * 2**64)))
    out = []
    for _ in range(levels):
        keys, parents = [], []
        step = max(1, 2_000_000 // len(own))
        for i in range(0, len(now), step):
            part = now[i : i + step]
            at, token = np.nonzero(_mix(part[:, None] ^ own[None, :]) <= limit)
            keys.append(_mix(part[at] * np.uint64(31) + own[token]))
            parents.append(part[at])
        keys, parents = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (keys, parents))
        out.append((keys.view(np.int64), parents.view(np.int64)))
        now = keys
    return out


def _text_hash() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


_SET = "set_key binary, n int, sketch binary, keys array<bigint>, " + ", ".join(
    f"keys{k} array<bigint>, parents{k} array<bigint>" for k in range(2, LEVELS + 1)
)


def _sets_columns(runs: int = 1, threshold: float = THRESHOLD) -> Callable:
    forget()
    seeds = _seeds(runs)

    def columns(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(4 + 2 * (LEVELS - 1))]
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            row = [None, 0, *[None] * (len(out) - 2)]
            if len(s):
                (keys, _), *below = paths(s, seeds, threshold, LEVELS)
                row = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest(), len(s), sketch(s), keys, *(x for level in below for x in level)]
            for c, v in zip(out, row, strict=True):
                c.append(v)
        return out

    return columns


def _sets(docs: DataFrame, runs: int, threshold: float) -> DataFrame:
    """doc_id, text_hash, set_key, n, sketch and paths of every document; no texts.

    keys are the paths of level 1 of all runs, keys2 and parents2 (and so on) those of further levels and those they go on from.
    """
    own = texts(docs).withColumn("text_hash", _text_hash())
    return stored(appended(own, lambda: _sets_columns(runs, threshold), _SET, drop=("text",)), "jaccard-sets")


def _each(sets: DataFrame) -> DataFrame:
    """One row for each distinct set: set_key, n, sketch, hash (of one of its texts), least (doc_id), copies."""
    first = [F.first(c).alias(c) for c in ("n", "sketch")]
    once = sets.where("set_key is not null").groupBy("set_key").agg(*first, F.min("text_hash").alias("hash"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    return stored(once, "jaccard-each")


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (hash, ...) with the text of that hash; without hash."""
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_TEXTS else wanted
    found = texts(docs).select("text", _text_hash().alias("hash")).join(wanted, "hash")
    return found.dropDuplicates(["hash"]).drop("hash")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of equal key that follow each other, across batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _leaders(near: np.ndarray) -> np.ndarray:
    """The first member of each member's component, for a symmetric matrix of neighbours."""
    root = np.arange(len(near))
    seen = np.zeros(len(near), dtype=bool)
    for i in range(len(near)):
        if not seen[i]:
            reach = near[i].copy()
            reach[i] = True
            front = reach
            while front.any():
                new = near[front].any(axis=0) & ~reach
                reach |= new
                front = new
            root[reach] = i
            seen |= reach
    return root


def _agree(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many minhashes of each sketch equal those of one: bytes of 0 or 1, summed by words of eight."""
    words = (sketches == one).view(np.uint64).sum(axis=1)
    return (words * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _buckets(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """key, set_key of the buckets of up to BUCKET sets, and key, set_key, size of the larger ones of the last level.

    The paths of a level are shuffled once, by key: they are told apart, counted, and left out where a set is alone, in the same stage.
    """
    small = None

    def step(rows: DataFrame) -> DataFrame:
        """key, set_key, size of the large buckets of rows (key, set_key); the small ones are done with."""
        nonlocal small
        size = F.count(F.lit(1)).over(Window.partitionBy("key"))
        met = stored(rows.repartition("key").distinct().withColumn("size", size).where("size > 1"), "jaccard-buckets")
        here = met.where(F.col("size") <= BUCKET).select("key", "set_key")
        small = here if small is None else small.unionByName(here)
        return met.where(F.col("size") > BUCKET)

    large = step(sets.select("set_key", F.explode("keys").alias("key")).select("key", "set_key"))
    for level in range(2, LEVELS + 1):
        parents = large.select(F.col("key").alias("parent")).distinct()
        n = parents.count()
        if not n:
            return small, None
        pairs = F.explode(F.arrays_zip(F.col(f"keys{level}").alias("key"), F.col(f"parents{level}").alias("parent")))
        below = sets.where("set_key is not null").select("set_key", pairs.alias("p")).select("set_key", "p.*")
        known = F.broadcast(parents) if n <= MAX_BROADCAST_PATHS else parents
        large = step(below.join(known, "parent", "left_semi").select("key", "set_key"))
    return small, None if large.isEmpty() else large


def _looked(buckets: DataFrame, looks: DataFrame, threshold: float) -> DataFrame:
    """a, b: sets that may belong together, as stars inside buckets (key, set_key) of bounded size."""
    full = buckets.join(looks.hint("merge"), "set_key")  # both sides grow with the corpus: no broadcast
    dealt = full.repartition(local_parts(looks.sparkSession), "key").sortWithinPartitions("key", "set_key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in _grouped(batches, "key"):
            if len(rows) > 1:
                n = np.array([r["n"] for r in rows])
                s = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
                alike = np.array([_agree(s, x) >= AGREE for x in s])
                alike &= np.minimum(n[:, None], n) >= threshold * np.maximum(n[:, None], n) - 1e-9
                for i, r in enumerate(_leaders(alike)):
                    if i != r:
                        a.append(rows[r]["set_key"])
                        b.append(rows[i]["set_key"])
            if len(a) > 10_000:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)

    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def _across(leaves: DataFrame, looks: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """a, b: sets of different clusters that may belong together, as stars inside pairs of blocks of large buckets.

    All sets of a bucket (key, set_key, size) are compared but for those that share a cluster already.
    """
    known = leaves.join(clusters.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    mixed = known.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    blocks = F.ceil(F.col("size") / LEAF_SETS).cast("int")
    known = known.join(mixed, "key", "left_semi").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks").cast("int"))
    full = known.join(looks, "set_key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(":", "key", F.least("block", "other"), F.greatest("block", "other"))
    full = full.select(pair.alias("pair"), (F.col("block") > F.col("other")).alias("right"), (F.col("block") == F.col("other")).alias("own"), "root", "set_key", "n", "sketch")
    dealt = full.repartition(local_parts(looks.sparkSession), "pair").sortWithinPartitions("pair", "right", "root", "set_key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "pair"):
            total, inside = len(rows), rows[0]["own"]
            split = 0 if inside else sum(not r["right"] for r in rows)
            n = np.array([r["n"] for r in rows])
            s = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype=np.uint8).reshape(total, -1)
            number = {root: k for k, root in enumerate(sorted({r["root"] for r in rows}))}
            roots = np.array([number[r["root"]] for r in rows])
            start, end = (split + np.searchsorted(roots[split:], roots, side) for side in ("left", "right"))
            near = np.zeros((total, total), dtype=bool)
            for i in range(total if inside else split):
                for lo, hi in [(end[i], total)] if inside else [(split, start[i]), (end[i], total)]:
                    if lo < hi:
                        fits = np.minimum(n[lo:hi], n[i]) >= threshold * np.maximum(n[lo:hi], n[i]) - 1e-9
                        near[i, lo:hi] = (_agree(s[lo:hi], s[i]) >= AGREE) & fits
            near |= near.T
            some = np.flatnonzero(near.any(axis=1))
            leader = some[_leaders(near[np.ix_(some, some)])]
            yield _pairs(*[[rows[k]["set_key"] for k in x[some != leader].tolist()] for x in (leader, some)])

    return stored(dealt.mapInArrow(compare, "a binary, b binary").distinct(), "jaccard-across")


def _clusters(sets: DataFrame, each: DataFrame, threshold: float) -> DataFrame:
    """node, root: clusters of the sets that may belong together by any bucket."""
    small, leaves = _buckets(sets)
    looks = each.select("set_key", "n", "sketch")
    if leaves is None:
        return components(_looked(small, looks, threshold))
    part = F.pmod(F.xxhash64("key", "set_key"), F.ceil(F.col("size") / BUCKET))
    parts = leaves.select(F.xxhash64("key", part).alias("key"), "set_key")
    clusters = stored(components(_looked(small.unionByName(parts), looks, threshold)), "jaccard-clusters")
    more = _across(leaves, looks, clusters, threshold)
    if more.isEmpty():
        return clusters
    return components(clusters.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets of hashes, all of left with all of right (with left itself if None, its diagonal aside)."""
    every = left if right is None else [*left, *right]
    out = np.zeros((len(left), len(every) - (0 if right is None else len(left))), dtype=np.int64)
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, token, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[token] > 1
    owner, token = owner[shared], token[shared]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    width = max(256, 2_000_000 // len(every))
    total = int(token[-1]) + 1 if len(token) else 0
    for c in range(0, total, width):
        i, j = np.searchsorted(token, [c, c + width])
        m = np.zeros((len(every), min(width, total - c)), dtype=np.float32)
        m[owner[i:j], token[i:j] - c] = 1
        np.add(out, m @ m.T if right is None else m[: len(left)] @ m[len(left) :].T, out=out, casting="unsafe")  # whole numbers under 2^24
    return out


def _without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.setdiff1d(a, b, assume_unique=True)


def intersections(size: int, left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]] | None) -> np.ndarray:
    """Sizes of the intersections of sets that are told as (missing, added) against one reference set of `size`.

    For x = R - A + B: |x & y| = |R| - |A_x| - |A_y| + |A_x & A_y| + |B_x & B_y|.
    """
    other = left if right is None else right
    missing = np.array([len(a) for a, _ in left])[:, None] + np.array([len(a) for a, _ in other])[None, :]
    both = [overlaps([x[k] for x in left], None if right is None else [x[k] for x in right]) for k in (0, 1)]
    return size - missing + both[0] + both[1]


def _told(found: DataFrame) -> DataFrame:
    """wanted, root, blocks, block, copies, n, size, missing, added: each set of found by its difference from its cluster's root.

    The rows of a cluster are dealt by block; the root's text is sent once to each block and comes first there.
    """
    block = F.pmod(F.xxhash64("wanted"), F.col("blocks")).cast("int")
    own = found.select("root", block.alias("block"), F.lit(True).alias("member"), "wanted", "blocks", "copies", "text")
    first = found.where("wanted = root").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("member"), "wanted", "blocks", "copies", "text")
    dealt = own.unionByName(first).repartition(local_parts(found.sparkSession), "root", "block").sortWithinPartitions("root", "block", "member")
    kept = ["wanted", "root", "blocks", "block", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            members, made = batch.column("member").to_numpy(zero_copy_only=False).astype(bool), []
            for text, member in zip(batch.column("text").to_pylist(), members.tolist(), strict=True):
                s = shingles(text)
                if member:
                    made.append((len(s), len(ref), _without(ref, s).tobytes(), _without(s, ref).tobytes()))
                else:
                    ref = s
            rest = batch.select(kept).filter(pa.array(members))
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            new = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*rest.columns, *new], names=[*kept, "n", "size", "missing", "added"])

    return dealt.mapInArrow(run, "wanted binary, root binary, blocks int, block int, copies long, n int, size int, missing binary, added binary")


def _exact(docs: DataFrame, each: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """set_key, links (documents of other sets that it is linked to), a (a set of its component) by exact comparison inside clusters."""
    spark = docs.sparkSession
    members = clusters.withColumnRenamed("node", "set_key").join(each.select("set_key", "hash", "copies", "n"), "set_key")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = sizes.select("root", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = stored(members.join(blocks, "root").select("hash", F.col("set_key").alias("wanted"), "root", "blocks", "copies"), "jaccard-members")
    full = _told(_with_text(docs, wanted)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(":", F.hex("root"), F.least("block", "other"), F.greatest("block", "other"))
    right, own = (F.col("block") > F.col("other")).alias("right"), (F.col("block") == F.col("other")).alias("own")
    full = full.select(pair.alias("pair"), right, own, "wanted", "copies", "n", "size", "missing", "added")
    dealt = full.repartition(local_parts(spark), "pair").sortWithinPartitions("pair", "right", "wanted")

    def delta(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["missing"], dtype=np.uint64), np.frombuffer(row["added"], dtype=np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows in _grouped(batches, "pair"):
            left, right = [r for r in rows if not r["right"]], [r for r in rows if r["right"]]
            inside = rows[0]["own"]
            if len(rows) < 2 or not inside and not (left and right):
                continue
            both = intersections(rows[0]["size"], [delta(r) for r in left], None if inside else [delta(r) for r in right])
            na, nb = np.array([r["n"] for r in left]), np.array([r["n"] for r in (left if inside else right)])
            linked = both * (1 + threshold) >= threshold * (na[:, None] + nb[None, :]) - 1e-9
            if inside:
                np.fill_diagonal(linked, False)
                near, every = linked, left
            else:
                near = np.zeros((len(rows), len(rows)), dtype=bool)
                near[: len(left), len(left) :] = linked
                near |= near.T
                every = [*left, *right]
            copies = np.array([r["copies"] for r in every])
            links = np.concatenate([near[i : i + 128] @ copies for i in range(0, len(near), 128)])  # each slice becomes integers
            leader = _leaders(near)
            keep = np.flatnonzero(links > 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([every[i]["wanted"] for i in keep], pa.binary()),
                    pa.array([int(links[i]) for i in keep], pa.int64()),
                    pa.array([every[leader[i]]["wanted"] for i in keep], pa.binary()),
                ],
                names=["set_key", "links", "a"],
            )

    return stored(dealt.mapInArrow(compare, "set_key binary, links long, a binary"), "jaccard-links")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles of every document.

    n_links counts the documents with a Jaccard similarity of at least threshold (equal sets included), class_id is the
    smallest doc_id of all documents that links connect; a document without shingles has its own doc_id and no link.
    """
    bounded_batches(docs.sparkSession)
    sets = _sets(docs, runs_for(recall, LEVELS), threshold)
    each = _each(sets)
    clusters = _clusters(sets, each, threshold)
    links = _exact(docs, each, clusters, threshold)
    roots = components(links.select("a", F.col("set_key").alias("b"))).select(F.col("node").alias("set_key"), "root")
    summed = links.groupBy("set_key").agg(F.sum("links").alias("links"))
    info = each.select("set_key", "least", "copies").join(summed, "set_key", "left").join(roots, "set_key", "left")
    info = stored(info.select("set_key", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set_key").alias("root")), "jaccard-info")
    classes = info.groupBy("root").agg(F.min("least").alias("class_id"))
    named = info.join(classes, "root").select("set_key", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    out = sets.select("doc_id", "set_key", F.col("n").alias("n_shingles")).join(named, "set_key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n_shingles").cast("long").alias("n_shingles"),
    )
