"""Line deduplication that can be undone: sharded cuckoo filters over exact reference-count tables.

The exact state is a table of references (key, doc_id): which document holds which line key. From it follow the
counts (key, n_docs, last_doc). A line is dropped when its key has at least `min_docs` documents, except in the
last one. Keys that qualify are also kept as fingerprints in cuckoo filters, one for each shard of the key space; there are
as many shards as give each about SHARD_KEYS of them. Filters that are small together are broadcast and asked by the scan over
texts; larger ones are asked shard by shard, by the keys that were sent to them. A scan asks the filters first, so only lines that may qualify are shuffled and checked against the exact
counts; a false positive of a filter therefore never drops a line. Inserting or deleting documents edits the
references, and only the keys that these documents hold are counted anew; their fingerprints are added to or removed
from the filters, so lines come back when the documents that made them frequent go.

A document is a doc_id; its distinct keys count once, and rows that repeat it count as one document, each with its own lines. Null texts are one
empty line; rows with a null doc_id count as one document, smaller than all others. Texts without long lines stay as they are, very long
texts are split whole. dedup_lines() leaves other columns of the documents behind, whatever their names. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from randaudit.llm.common import appended, bounded_batches, forget, stored, texts
from randaudit.llm.words import lower_bytes

MIN_CHARS = 20
MIN_DOCS = 3
#: Qualified keys of a shard, about, and slots of a bucket of its filter.
SHARD_KEYS, SLOTS = 50_000, 4
#: Bytes of all filters together up to which they are broadcast; beyond it keys are sent to the filters of their shards.
MAX_FILTER_BYTES = 64_000_000
#: Qualified keys (24 bytes each) that are broadcast at most; more are joined by shuffle, common keys dealt over SALTS tasks.
MAX_BROADCAST_KEYS, SALTS = 1_000_000, 16
BLANK = " \t\n\v\f\r"


def line_key(line: Column) -> Column:
    """128 bits that stand for the line, stripped and with A-Z lower-cased; null for lines of under MIN_CHARS code points."""
    norm = F.translate(F.btrim(line, F.lit(BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(norm) >= MIN_CHARS, F.unhex(F.md5(norm.cast("binary"))))


def _key(line: str) -> bytes | None:
    norm = line.strip(BLANK)
    return hashlib.md5(lower_bytes(norm), usedforsecurity=False).digest() if len(norm) >= MIN_CHARS else None


def references(docs: DataFrame) -> DataFrame:
    """key, doc_id: one row for each distinct long line of each document."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: k.isNotNull()))
    return texts(docs).select(F.explode(keys).alias("key"), "doc_id")


def counts(refs: DataFrame) -> DataFrame:
    """key, n_docs (distinct doc_ids, null being one), last_doc, with partial counts before the shuffle (a key may be in a third of all documents)."""
    return refs.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


class Cuckoo:
    """A cuckoo filter: 16-bit fingerprints, SLOTS to a bucket, two buckets for a key. Insert, delete, ask."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS) of uint16, 0 is free; buckets is a power of two

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, n) / SLOTS / 0.8)))), SLOTS), dtype=np.uint16))

    @staticmethod
    def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and hash of the first bucket."""
        raw = np.frombuffer(b"".join(keys), dtype=np.uint32).reshape(-1, 4)
        return (raw[:, 2] % np.uint32(65535) + np.uint32(1)).astype(np.uint16), raw[:, 1].astype(np.uint32)

    def buckets(self, prints: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint32(len(self.table) - 1)
        one = first & mask
        return one, (one ^ (prints.astype(np.uint32) * np.uint32(0x5BD1E995))) & mask

    def ask(self, keys: list[bytes]) -> np.ndarray:
        prints, first = self.halves(keys)
        a, b = self.buckets(prints, first)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def _fill(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets, as many as there are; True for those that found none."""
        order = np.argsort(at, kind="stable")
        near = at[order]
        turn = np.arange(len(near)) - np.searchsorted(near, near)  # how many before it want the same bucket
        taken = self.table[near] != 0
        fits = turn < SLOTS - taken.sum(axis=1)
        slots = np.argsort(taken[fits], axis=1, kind="stable")  # free slots first
        self.table[near[fits], slots[np.arange(len(slots)), turn[fits]]] = prints[order[fits]]
        left = np.ones(len(at), dtype=bool)
        left[order[fits]] = False
        return left

    def insert(self, keys: list[bytes]) -> bool:
        """False if the filter is too full; it must then be built anew, larger."""
        prints, first = self.halves(keys)
        a, b = self.buckets(prints, first)
        left = self._fill(prints, a)  # all keys at once; the few that find both buckets full displace others
        prints, b = prints[left], b[left]
        left = self._fill(prints, b)
        prints, b = prints[left], b[left]
        for p, at in zip(prints, b, strict=True):
            for kick in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
                slot = kick % SLOTS
                p, self.table[at, slot] = self.table[at, slot], p
                at = self.buckets(np.array([p]), np.array([at], dtype=np.uint32))[1][0]
            else:
                return False
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Removes one fingerprint of each key; only keys that were inserted may be deleted."""
        prints, first = self.halves(keys)
        for p, a, b in zip(prints, *self.buckets(prints, first), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == p)
                if len(found):
                    self.table[at, found[0]] = 0
                    break

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        n = len(keys)
        while not (made := cls.sized(n)).insert(keys):
            n = 2 * n + 8
        return made


def shards_for(n: int) -> int:
    """How many shards hold n qualified keys."""
    return max(1, -(-n // SHARD_KEYS))


def _shard(key: Column, shards: int) -> Column:
    return (F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long") % shards).cast("int")


def filters(qualified: DataFrame, shards: int) -> DataFrame:
    """shard, table (bytes of the filter): one cuckoo filter for each shard of the qualified keys."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Cuckoo.of(sorted(pdf["key"]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "table": [made.table.tobytes()]})

    return qualified.select(_shard(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, table binary")


def edited(old: DataFrame, gone: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """The filters after the keys of `gone` ceased to qualify and those of `new` began to."""

    def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = int((left if len(left) else right)["shard"].iloc[0])
        own = Cuckoo(np.frombuffer(left["table"].iloc[0], dtype=np.uint16).reshape(-1, SLOTS).copy()) if len(left) else Cuckoo.sized(len(right))
        own.delete(sorted(right["key"][~right["fresh"]])) if (~right["fresh"]).any() else None
        more = sorted(right["key"][right["fresh"]])
        if more and not own.insert(more):
            return pd.DataFrame({"shard": [shard], "table": [b""]})  # too full: it is made anew from the counts
        return pd.DataFrame({"shard": [shard], "table": [own.table.tobytes()]})

    both = gone.select("key", F.lit(False).alias("fresh")).unionByName(new.select("key", F.lit(True).alias("fresh")))
    both = both.withColumn("shard", _shard(F.col("key"), shards))
    return old.groupBy("shard").cogroup(both.groupBy("shard")).applyInPandas(change, "shard int, table binary")


class LineState:
    """References, counts of keys and filters after some documents were inserted and others deleted."""

    def __init__(self, refs: DataFrame, counted: DataFrame, sieve: DataFrame, min_docs: int = MIN_DOCS, shards: int = 1):
        self.refs, self.counted, self.sieve, self.min_docs, self.shards = refs, counted, sieve, min_docs, shards

    @classmethod
    def empty(cls, spark, min_docs: int = MIN_DOCS) -> LineState:
        return cls(
            spark.createDataFrame([], "key binary, doc_id long"),
            spark.createDataFrame([], "key binary, n_docs long, last_doc long"),
            spark.createDataFrame([], "shard int, table binary"),
            min_docs,
        )

    def qualified(self) -> DataFrame:
        return self.counted.where(F.col("n_docs") >= self.min_docs)

    def _moved(self, refs: DataFrame, touched: DataFrame) -> LineState:
        """The state with new references, of which only the touched keys can have other counts than before."""
        again = counts(refs.join(touched, "key", "left_semi"))
        counted = stored(self.counted.join(touched, "key", "left_anti").unionByName(again), "line-counts")
        after = LineState(refs, counted, self.sieve, self.min_docs, self.shards)
        wanted = shards_for(after.qualified().count())
        if wanted > 2 * self.shards:  # the key space outgrew its shards
            after.shards, after.sieve = wanted, stored(filters(after.qualified(), wanted), "line-filters")
            return after
        gone = self.qualified().join(after.qualified(), "key", "left_anti")
        new = after.qualified().join(self.qualified(), "key", "left_anti")
        sieve = stored(edited(self.sieve, gone, new, self.shards), "line-filters")
        full = sieve.where(F.length("table") == 0).select("shard")
        anew = filters(after.qualified().withColumn("shard", _shard(F.col("key"), self.shards)).join(full, "shard", "left_semi").select("key"), self.shards)
        after.sieve = stored(sieve.where(F.length("table") > 0).unionByName(anew), "line-filters")
        return after

    def insert(self, docs: DataFrame) -> LineState:
        fresh = stored(references(docs), "line-refs")
        return self._moved(self.refs.unionByName(fresh), fresh.select("key").distinct())

    def delete(self, ids: DataFrame) -> LineState:
        """Forget the documents whose doc_id is in ids: lines that only they made frequent come back."""
        gone = ids.select(F.col("doc_id").cast("long").alias("gone_id")).distinct()
        held = self.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi")
        kept = self.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
        return self._moved(stored(kept, "line-refs"), held.select("key").distinct())


def _sieved(docs: DataFrame, sieve: DataFrame, shards: int) -> DataFrame:
    """(key, doc_id) of lines that may qualify, by asking the filters."""
    spark = docs.sparkSession
    size = sieve.agg(F.coalesce(F.sum(F.length("table")), F.lit(0)).alias("b")).first().b
    if size > MAX_FILTER_BYTES:
        return _sent(references(docs), sieve, shards)
    tables = spark.sparkContext.broadcast({r.shard: bytes(r.table) for r in sieve.collect()})

    def make() -> Callable:
        forget()
        own = {s: Cuckoo(np.frombuffer(t, dtype=np.uint16).reshape(-1, SLOTS)) for s, t in tables.value.items()}

        def columns(batch: pa.RecordBatch) -> list:
            held: list[list[bytes]] = []
            by_shard: dict[int, list[bytes]] = {}
            for text in batch.column("text").to_pylist():
                keys = {k for line in (text or "").split("\n") if len(line) >= MIN_CHARS and (k := _key(line))}
                held.append(sorted(keys))
                for k in keys:
                    by_shard.setdefault(int.from_bytes(k[:4]) % shards, []).append(k)
            maybe = set()
            for shard, keys in by_shard.items():
                if shard in own:
                    maybe.update(k for k, yes in zip(keys, own[shard].ask(keys), strict=True) if yes)
            return [[[k for k in keys if k in maybe] for keys in held]]

        return columns

    return appended(texts(docs), make, "keys array<binary>", drop=("text",)).select(F.explode("keys").alias("key"), "doc_id")


def _sent(refs: DataFrame, sieve: DataFrame, shards: int) -> DataFrame:
    """(key, doc_id) of refs that the filters pass: each shard's keys stream past its filter, in SALTS tasks, so that no key is hot."""
    salted = sieve.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = refs.select(_shard(F.col("key"), shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), "key", "doc_id")
    both = salted.select("shard", "salt", "table", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    both = both.unionByName(asked.withColumn("table", F.lit(None).cast("binary")))
    dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("key").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            shard, salt, key = (batch.column(c).to_pylist() for c in ("shard", "salt", "key"))
            passed = np.zeros(batch.num_rows, dtype=bool)
            cuts = [i for i in range(batch.num_rows) if not i or (shard[i], salt[i]) != (shard[i - 1], salt[i - 1])] + [batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if (shard[i], salt[i]) != at:
                    at, own = (shard[i], salt[i]), None
                if key[i] is None:  # the filter comes first
                    own, i = Cuckoo(np.frombuffer(batch.column("table")[i].as_py(), dtype=np.uint16).reshape(-1, SLOTS)), i + 1
                if own is not None and i < j:
                    passed[i:j] = own.ask(key[i:j])
            yield batch.select(["key", "doc_id"]).filter(pa.array(passed))

    return dealt.mapInArrow(run, "key binary, doc_id long")


def drops(docs: DataFrame, state: LineState) -> DataFrame:
    """doc_id, gone: the keys of the lines that each document loses (no row for documents that lose none)."""
    exact = state.qualified().select("key", "last_doc")
    maybe = _sieved(docs, state.sieve, state.shards)
    if exact.count() <= MAX_BROADCAST_KEYS:
        lost = maybe.join(F.broadcast(exact), "key")
    else:
        lost = maybe.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(
            exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"]
        )
    return lost.where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("doc_id").agg(F.collect_set("key").alias("gone"))


def cleaned(docs: DataFrame, state: LineState) -> DataFrame:
    """docs with kept (the remaining lines joined by newlines), n_lines and n_dropped; docs has doc_id and text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    gone = drops(docs, state).withColumnRenamed("doc_id", "gone_id")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").drop("gone_id")

    def columns(batch: pa.RecordBatch) -> list:
        kept, n_lines, n_dropped = [], [], []
        for text, out in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            rest = lines
            if out:
                out = set(out)
                rest = [line for line in lines if _key(line) not in out]
            kept.append("\n".join(rest))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(rest))
        return [kept, n_lines, n_dropped]

    return appended(joined, lambda: columns, "kept string, n_lines long, n_dropped long", drop=("gone",))


def first_state(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineState:
    """The state of a first batch. Its references stay a view on the documents until documents come or go."""
    refs = references(docs)
    counted = stored(counts(refs).where(F.col("n_docs") >= min_docs), "line-counts")
    shards = shards_for(counted.count())
    return LineState(refs, counted, stored(filters(counted, shards), "line-filters"), min_docs, shards)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and the kept text) of every document."""
    own = texts(docs)
    return cleaned(own, first_state(own, min_docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "kept"
    )
