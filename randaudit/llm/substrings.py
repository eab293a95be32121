"""Substring dedup: words of passages that also occur in an earlier document are removed, by suffix automata of reference shards.

A window is LENGTH words in a row. A window's anchor is, of its runs of GRAM words, the one with the smallest hash, so equal windows have
equal anchors wherever they occur. Neighbouring windows with one anchor are a passage. The job has four steps:

1. A scan gives each document's anchors; those of at least two documents are shared. No other window can repeat.
2. Passages with shared anchors are cut from the documents, each text once, with the smallest doc_id that holds it.
3. They are dealt by anchor into reference shards of about SHARD passages. A task builds the suffix automaton of its shard, whose states
   carry the smallest doc_id of all their occurrences, and streams the shard's passages through it: the matching statistics at a
   word name the state of the window that ends there, and so the first document that holds the window.
4. Passages take these answers back to their documents, which lose the maximal spans of windows that an earlier document holds.

An anchor of very many documents (a licence line, say, with other words around it in each) would fill a shard by itself. Such anchors
are found on a 64th of the documents, broadcast (HOT_SHARE bounds their number), and count as shared: the scan sends nothing for them, and their
windows are dealt one by one, by their own hash. Nothing else depends on which anchors these are. What is dealt are distinct texts, so no
shard grows with the copies of a text, and the way back is a join, whose hot keys Spark splits. Text is shuffled once.

Words are runs of what isn't ASCII white space, unchanged. Null and empty texts have no words. Rows with a null doc_id are earlier than none
and later than none: they are kept whole and no reference. Rows that repeat a doc_id are each cut by the other documents alone, never by
one another. A repetition inside one document stays. Very long texts are treated whole. Other columns are left behind unless
named in `keep`. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from randaudit.llm.common import appended, bounded_batches, stored, texts

LENGTH, GRAM = 13, 4
#: Passages of a reference shard, about.
SHARD = 4096
#: Documents, one in so many, on which hot anchors are found; an anchor is hot if it is in HOT_LEAST of them and in one in HOT_SHARE.
PROBES, HOT_LEAST, HOT_SHARE = 64, 64, 20_000
#: Bytes that are hashed at once, about.
CHUNK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.uint64(0xFFFFFFFF)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.both = base, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.both[0]) < n:
            made = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            self.both = tuple(made)
        return self.both


_BYTE_POWERS, _WORD_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Running sums of the values times their powers, with 0 before them: the polynomials of all prefixes."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=out[1:])
    return out


class Words:
    """The words of an Arrow batch of texts, by place in its bytes: runs of what isn't ASCII white space. Texts are not copied."""

    def __init__(self, column: pa.Array):
        wide = column.cast(pa.large_binary())
        offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, dtype=np.int64)
        data = wide.buffers()[2] if len(wide) else None
        self.bytes = memoryview(data)[offsets[0] : offsets[-1]] if data else memoryview(b"")
        self.raw, self.offsets = np.frombuffer(self.bytes, dtype=np.uint8), offsets - offsets[0]
        word = ~_SPACE[self.raw]
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(word))]  # a word ends with its text
        before[inner], after[inner - 1] = False, False
        self.start, self.end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        bounds = np.searchsorted(self.start, self.offsets)
        #: For each text the place of its first word, and its number of words.
        self.base, self.counts = bounds[:-1], np.diff(bounds)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, k: int) -> bytes:
        return bytes(self.bytes[self.offsets[k] : self.offsets[k + 1]])

    def hashes(self) -> np.ndarray:
        """A hash of each word, from its bytes alone."""
        out, i = np.zeros(len(self), dtype=np.uint64), 0
        while i < len(self):
            first = self.start[i]
            k = max(int(np.searchsorted(self.end, first + CHUNK)), i + 1)
            powers, inverse = _BYTE_POWERS(max(CHUNK, int(self.end[k - 1] - first)) + 1)
            sums = _sums(self.raw[first : self.end[k - 1]].astype(np.uint64), powers)
            a, b = self.start[i:k] - first, self.end[i:k] - first
            out[i:k] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
            i = k
        return _mixed(out)


class Passages:
    """The passages of the texts of a batch: runs of windows that have one anchor."""

    def __init__(self, words: Words, length: int):
        self.length, self.hash = length, words.hashes()
        n, gram = max(len(words) - length + 1, 0), min(GRAM, length)
        grams = np.zeros(max(len(words) - gram + 1, 0), dtype=np.uint64)
        for k in range(gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : k + len(grams)]
        grams = _mixed(grams)
        # High bits: hash of the run of words; low bits: its place, so that of equal hashes the leftmost is the smallest.
        least, span = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), 1
        while span < length - gram + 1:
            step = min(span, length - gram + 1 - span)
            least, span = np.minimum(least[:-step] if len(least) > step else least[:0], least[step:]), span + step
        at = (least[:n] & _LOW).astype(np.int64)
        owner = np.repeat(np.arange(len(words.counts)), words.counts)
        place = np.flatnonzero(owner[:n] == owner[length - 1 : length - 1 + n])
        own, at = owner[place], at[place]
        first = np.ones(len(place), dtype=bool)
        first[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
        runs = np.flatnonzero(first)
        #: For each passage: its text, the place of its first word, its number of windows, its anchor.
        self.owner, self.place, self.windows = own[runs], place[runs], np.diff(np.append(runs, len(place)))
        self.anchor = (grams[at[runs]] >> np.uint64(16)).view(np.int64)  # 48 bits: two anchors may share a value, which only adds passages

    def chosen(self, which: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, place and windows of the chosen passages; single ones are cut into their windows."""
        times = np.where(single, self.windows[which], 1)
        number = np.repeat(which, times)
        step = np.arange(len(number)) - np.repeat(np.cumsum(times) - times, times)
        return number, self.place[number] + step, np.where(np.repeat(single, times), 1, self.windows[number])

    def digests(self, place: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits that tell the words of passages: polynomials of two hashes of each word."""
        powers, inverse = _WORD_POWERS(len(self.hash) + 1)
        out = []
        for h in (self.hash, _mixed(self.hash ^ np.uint64(0xA0761D6478BD642F))):
            sums = _sums(h, powers)
            out.append(_mixed((sums[place + windows + self.length - 1] - sums[place]) * inverse[place] + windows.astype(np.uint64)))
        return out[0].view(np.int64), (out[1] & _LOW).astype(np.uint32).view(np.int32)


def _flat(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], ddl: str) -> DataFrame:
    """The rows of ddl that the function made once in each task gives, as columns, for an Arrow batch."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(rows(batch), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def document_anchors(docs: DataFrame, length: int = LENGTH, hot: Broadcast | None = None) -> DataFrame:
    """doc_id, anchor: the distinct anchors of each row (doc_id, text), without the hot ones (an ordered array)."""

    def columns(batch: pa.RecordBatch) -> list:
        found = Passages(Words(batch.column("text")), length)
        own, value = found.owner, found.anchor
        if hot is not None:
            fine = ~_among(value, hot.value)
            own, value = own[fine], value[fine]
        order = np.lexsort((value, own))
        own, value = own[order], value[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
        ends = np.concatenate(([0], np.cumsum(np.bincount(own[new], minlength=len(batch)))))
        return [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(value[new]))]

    listed = appended(docs.select("doc_id", "text"), lambda: columns, "anchors array<long>", drop=("text",))
    return listed.select("doc_id", F.explode("anchors").alias("anchor"))


def hot_anchors(docs: DataFrame, length: int = LENGTH) -> tuple[np.ndarray, int]:
    """The anchors of very many documents, in order, and about how many passages all rows (doc_id, text) have."""
    probes = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(PROBES)) == 0)
    counts = stored(document_anchors(probes, length).groupBy("anchor").agg(F.count("*").alias("n")), "substrings-probes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    least = F.lit(max(HOT_LEAST, probes.count() // HOT_SHARE))
    rows = counts.where(F.col("n") >= least).select("anchor").toPandas()["anchor"]
    return np.sort(rows.to_numpy(dtype=np.int64)), total * PROBES


def _shared_of(batch: pa.RecordBatch, found: Passages, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which passages have a shared anchor, whether it is hot, and whether an earlier document may have it too."""
    lists = batch.column("shared")
    anchors, later = (np.ascontiguousarray(lists.flatten().field(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
    owner = np.repeat(np.arange(len(batch)), np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0))
    told = lambda value, own: value.view(np.uint64) ^ _mixed(own.astype(np.uint64) + np.uint64(1))
    keys, mine = told(anchors, owner), told(found.anchor, found.owner)
    order = np.argsort(keys)
    is_hot, listed = _among(found.anchor, hot), _among(mine, keys[order])
    which = np.flatnonzero(is_hot | listed)
    flags = is_hot[which].copy()
    known = listed[which] & ~flags
    flags_later = flags.copy()
    flags_later[known] = later[order][np.searchsorted(keys[order], mine[which[known]])]
    return which, np.stack([flags, flags_later])


#: Passages of which a task remembers that it sent them.
SENT = 1_000_000


def reference_passages(docs: DataFrame, shards: int, length: int = LENGTH, hot: np.ndarray | None = None) -> DataFrame:
    """shard, passage, doc_id of the passages with shared anchors; rows are (doc_id, text, shared).

    shared lists the document's shared anchors as (anchor, later); the hot ones are shared anyway, and dealt window by window.
    A task sends a passage again only for a smaller doc_id, or when it has forgotten it.
    """
    hot = np.zeros(0, dtype=np.int64) if hot is None else hot
    shared_hot = docs.sparkSession.sparkContext.broadcast(hot)

    def make() -> Callable:
        sent: dict[tuple[int, int], int] = {}

        def columns(batch: pa.RecordBatch) -> list:
            words = Words(batch.column("text"))
            found = Passages(words, length)
            which, (single, _) = _shared_of(batch, found, shared_hot.value)
            number, place, windows = found.chosen(which, single)
            one, two = found.digests(place, windows)
            owners = batch.column("doc_id").take(pa.array(found.owner[number]))
            new = []
            for k, (key, doc) in enumerate(zip(zip(one.tolist(), two.tolist(), strict=True), owners.to_pylist(), strict=True)):
                if doc is not None and (key not in sent or doc < sent[key]):
                    sent[key] = doc
                    new.append(k)
            if len(sent) > SENT:
                sent.clear()
            singles = np.repeat(single, np.where(single, found.windows[which], 1))
            shard = np.where(singles, one, found.anchor[number]) % shards
            begin, end = words.start[place[new]].tolist(), words.end[place[new] + windows[new] + length - 2].tolist()
            passages = [b" ".join(bytes(words.bytes[a:b]).split()) for a, b in zip(begin, end, strict=True)]
            return [shard[new], passages, owners.take(pa.array(new, type=pa.int64()))]

        return columns

    return _flat(docs, make, "shard long, passage binary, doc_id long")


def later_passages(docs: DataFrame, length: int = LENGTH, hot: np.ndarray | None = None) -> DataFrame:
    """hash_1, hash_2, doc_id, start, text_key of the passages whose anchor an earlier document may have too; rows as above.

    text_key tells apart the texts of rows that share a doc_id.
    """
    hot = np.zeros(0, dtype=np.int64) if hot is None else hot
    shared_hot = docs.sparkSession.sparkContext.broadcast(hot)

    def columns(batch: pa.RecordBatch) -> list:
        words = Words(batch.column("text"))
        found = Passages(words, length)
        which, (single, later) = _shared_of(batch, found, shared_hot.value)
        number, place, windows = found.chosen(which[later], single[later])
        one, two = found.digests(place, windows)
        own = found.owner[number]
        keys = np.array([_text_key(words.text(k)) for k in range(len(batch))], dtype=np.int32)
        return [one, two, batch.column("doc_id").take(pa.array(own)), (place - words.base[own]).astype(np.int32), keys[own]]

    return _flat(docs, lambda: columns, "hash_1 long, hash_2 int, doc_id long, start int, text_key int")


def _text_key(text: bytes) -> int:
    return zlib.crc32(text) - (1 << 31)


class SuffixAutomaton:
    """Suffix automaton of several passages (lists of words); each state carries the smallest id of the passages that hold its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def _state(self, size: int, moves: dict, link: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _clone(self, p: int, q: int, word: object, number: int) -> int:
        made = self._state(self.size[p] + 1, self.next[q].copy(), self.link[q], min(number, self.first[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = made
            p = self.link[p]
        self.link[q] = made
        return made

    def add(self, passage: list, number: int) -> None:
        moves, size, link, first = self.next, self.size, self.link, self.first
        last = 0
        for word in passage:
            q = moves[last].get(word)
            if q is not None:  # another passage went this way
                last = q if size[q] == size[last] + 1 else self._clone(last, q, word, number)
                if number < first[last]:
                    first[last] = number
                continue
            p, last = last, self._state(size[last] + 1, {}, 0, number)
            while p >= 0:
                own = moves[p]
                if word in own:
                    q = own[word]
                    link[last] = q if size[q] == size[p] + 1 else self._clone(p, q, word, number)
                    break
                own[word] = last
                p = link[p]

    def settle(self) -> None:
        """Hands the ids of all states down to the states of their suffixes: longer strings first."""
        first, link = self.first, self.link
        for s in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            up = link[s]
            if up > 0 and first[s] < first[up]:
                first[up] = first[s]

    def firsts(self, stream: list, length: int) -> list[int | None]:
        """For each place of the stream where `length` words end: the smallest id of a passage that holds these words, if any does."""
        moves, link, size, first = self.next, self.link, self.size, self.first
        out, s, matched = [], 0, 0
        for k, word in enumerate(stream, 1):
            while s and word not in moves[s]:
                s = link[s]
                matched = size[s]
            if word in moves[s]:
                s, matched = moves[s][word], matched + 1
            while link[s] > 0 and size[link[s]] >= length:  # the state of the last `length` words is a suffix's
                s = link[s]
                matched = size[s]
            if k >= length:
                out.append(first[s] if matched >= length else None)
        return out


def first_holders(references: DataFrame, length: int = LENGTH) -> DataFrame:
    """hash_1, hash_2, firsts (by window the smallest doc_id that holds it) of the distinct passages (shard, passage, first)."""

    def run(group: pa.Table) -> pa.Table:
        split_all = [p.split() for p in group["passage"].to_pylist()]
        automaton = SuffixAutomaton()
        for words, number in zip(split_all, group["first"].to_pylist(), strict=True):
            automaton.add(words, number)
        automaton.settle()
        firsts = pa.array([automaton.firsts(words, length) for words in split_all], type=pa.list_(pa.int64()))
        words = Words(group["passage"].combine_chunks())
        one, two = Passages(words, length).digests(words.base, words.counts - length + 1)
        return pa.table({"hash_1": one, "hash_2": two, "firsts": firsts})

    return references.groupBy("shard").applyInArrow(run, "hash_1 long, hash_2 int, firsts array<long>")


def _with_spans(docs: DataFrame, length: int, shard: int, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, text, the columns of keep, found: for each row the starts of the windows that an earlier document holds, with their text_key."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = texts(docs, *keep)
    numbered = own.where(F.col("doc_id").isNotNull())
    hot, total = hot_anchors(numbered, length)
    pairs = document_anchors(numbered, length, spark.sparkContext.broadcast(hot))
    every = Window.partitionBy("anchor")
    shared = pairs.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("first", F.min("doc_id").over(every)).where("n > 1")
    listed = shared.select(F.col("doc_id").alias("key"), F.struct("anchor", (F.col("first") < F.col("doc_id")).alias("later")).alias("own"))
    lists = listed.groupBy("key").agg(F.collect_list("own").alias("shared"))
    keyed = own.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    # Rows without an id come along, so that the texts are dealt once for all three readings.
    rows = keyed.join(lists, "key", "left").select("doc_id", "text", "shared")
    dealt = reference_passages(rows, max(1, -(-total // shard)), length, hot).repartition("shard")
    known = first_holders(dealt.groupBy("shard", "passage").agg(F.min("doc_id").alias("first")), length)
    gone = F.filter(F.transform("firsts", lambda f, k: F.when(f < F.col("doc_id"), F.col("start") + k)), lambda s: s.isNotNull())
    found = later_passages(rows, length, hot).where(F.col("doc_id").isNotNull()).join(known, ["hash_1", "hash_2"]).select("doc_id", "text_key", gone.alias("gone")).where(F.size("gone") > 0)
    spans = found.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("text_key", "gone")).alias("found"))
    return keyed.join(spans, "key", "left").drop("key")


def _row_spans(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes | None, int, np.ndarray]]:
    """For each row its text, its number of words, and a flag for each word that goes."""
    words, present = Words(batch.column("text")), batch.column("text").is_valid().to_pylist()
    lists = batch.column("found")
    keys, gone = lists.values.field("text_key").to_numpy(), lists.values.field("gone")
    outer, inner = lists.offsets.to_numpy(), gone.offsets.to_numpy()
    places, numbered = gone.values.to_numpy(), batch.column("doc_id").is_valid().to_pylist()
    for k, n in enumerate(words.counts.tolist()):
        text = words.text(k) if present[k] else None
        mine = range(outer[k], outer[k + 1]) if numbered[k] else ()
        edge = np.zeros(n + 1, dtype=np.int64)
        if mine:
            key = _text_key(text or b"")
            if (keys[mine.start : mine.stop] == key).all():
                starts = places[inner[mine.start] : inner[mine.stop]]
            else:  # several rows share the doc_id
                starts = np.concatenate([places[:0], *(places[inner[p] : inner[p + 1]] for p in mine if keys[p] == key)])
            starts = np.unique(starts)  # equal rows say the same
            edge[starts] += 1
            edge[starts + length] -= 1
        yield text, n, np.cumsum(edge)[:n] > 0


def repeated(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns of keep, n_words, starts, ends: merged word spans of each row that an earlier document holds too."""

    def columns(batch: pa.RecordBatch) -> list:
        out = []
        for _, n, gone in _row_spans(batch, length):
            turns = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
            out.append((n, turns[::2].tolist(), turns[1::2].tolist()))
        return [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

    return appended(_with_spans(docs, length, shard, keep), lambda: columns, "n_words long, starts array<int>, ends array<int>", drop=("found",))


def deduplicated(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, n_words, n_removed, kept: the words outside of the spans, joined by one space; null for a null text."""

    def columns(batch: pa.RecordBatch) -> list:
        out = []
        for text, n, gone in _row_spans(batch, length):
            left = (text or b"").split()
            if gone.any():
                left = [w for w, g in zip(left, gone.tolist(), strict=True) if not g]
            out.append((n, n - len(left), None if text is None else b" ".join(left).decode("utf-8", "surrogatepass")))
        return [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

    return appended(_with_spans(docs, length, shard, keep), lambda: columns, "n_words long, n_removed long, kept string", drop=("found", "text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
