"""Substring dedup against brute force and on odd inputs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from randaudit.llm import substrings
from randaudit.llm.common import stored

DOCS = "doc_id long, text string, shard int, n_words long, key string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, length):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - length + 1 if i is not None else 0):
            g = tuple(w[k : k + length])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, text in rows:
        w = words(text)
        gone = {p for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for p in range(k, k + length)}
        out.append((i, len(w), len(gone), None if text is None else " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 1, 2, "clash") for i, t in rows], DOCS)
    out = substrings.deduplicated(docs, **how)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=repr)


def rows_with_copies(seed, n=60, vocabulary=40):
    """Few words, so windows repeat by chance too; passages, copies, one common line with other words around it."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["É", "\x85odd\xa0", "\x1c", "漢字", "'quoted\"", "💡"]
    some = lambda low, high: [rng.choice(vocab) for _ in range(rng.randint(low, high))]
    passages = [some(5, 60) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = [some(0, 30)] + [p for _ in range(rng.randint(0, 3)) for p in (rng.choice(passages), some(0, 12))]
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "\n", "\t \r\n"]).join(x for p in parts for x in p)))
    line = "this line stands in very many of the documents with other words around it".split()
    rows += [(k, " ".join(some(8, 20) + line + some(8, 20))) for k in range(2_000_000, 2_000_080)]
    return rows + [(3_000_000 + k, rows[k % 5][1]) for k in range(20)]


def odd_rows():
    base = " ".join(f"v{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (None, base), (None, base), (None, None), (6, f"new {base} end")]
    rows += [(7, f"{base} seven"), (7, f"{base} seven"), (7, f"seven {base} more"), (8, "a b c"), (9, "a b c"), (10, "loop " * 3000), (11, "loop " * 13)]
    return rows + [(12, f"{base} {'x' * 100_000} {base}"), (13, "long " + "w " * 40_000 + base)]


@pytest.mark.parametrize("probes", [(1, 3, 10), (1, 1, 10**9), (2, 2, 10**9)])
def test_any_choice_of_hot_anchors_gives_the_same(spark, monkeypatch, probes):
    for name, value in zip(("PROBES", "HOT_LEAST", "HOT_SHARE"), probes, strict=True):
        monkeypatch.setattr(substrings, name, value)
    rows = rows_with_copies(7)
    assert found(spark, rows, shard=30) == brute(rows, 13)


@pytest.mark.parametrize(("seed", "how"), [(1, {"length": 13}), (2, {"length": 5, "shard": 7}), (3, {"length": 13, "shard": 20}), (4, {"length": 3, "shard": 50})])
def test_equals_brute_force(spark, seed, how):
    rows = rows_with_copies(seed)
    assert found(spark, rows, **how) == brute(rows, how["length"])


def test_odd_rows(spark):
    assert found(spark, odd_rows()) == brute(odd_rows(), 13)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_spans(spark):
    base = " ".join(f"v{k}" for k in range(20))
    rows = [(1, base), (2, f"a {base} b {base}"), (3, f"{base} tail"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_words, r.starts, r.ends) for r in substrings.repeated(docs).collect()}
    assert got == {1: (base, 20, [], []), 2: (rows[1][1], 42, [1, 22], [21, 42]), 3: (rows[2][1], 21, [0], [20]), 4: (None, 0, [], [])}


def test_common_windows_are_dealt_one_by_one(spark):
    rows = rows_with_copies(5)
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string"), "hot")
    anchors = substrings.document_anchors(docs).groupBy("doc_id").agg(F.collect_list(F.struct("anchor", F.lit(True).alias("later"))).alias("shared"))
    own = docs.join(anchors, "doc_id").select("doc_id", "text", "shared")
    hot = np.unique([r.anchor for r in substrings.document_anchors(docs).select("anchor").distinct().collect()])
    assert substrings.document_anchors(docs, 13, spark.sparkContext.broadcast(hot)).count() == 0
    cut = substrings.reference_passages(own, 7, 13, hot).collect()
    assert {len(r.passage.split()) for r in cut} == {13} and {r.shard for r in cut} == set(range(7))
    shards = {}
    for r in cut:
        assert shards.setdefault(r.passage, r.shard) == r.shard
    told = {bytes(r.passage) for r in cut}
    digests = substrings.later_passages(own, 13, hot).select("hash_1", "hash_2").distinct()
    assert digests.count() == len(told)
    every = sum(max(0, len(words(t)) - 12) for _, t in rows)
    assert len(told) <= len(cut) <= every == substrings.later_passages(own, 13, hot).count()


@pytest.mark.parametrize("length", [1, 4, 13])
def test_equal_windows_have_equal_anchors(length):
    rng = random.Random(length)
    texts = [rng.choice(["\n", " ", " \t"]).join(rng.choice(["a", "b", "é", "x" * 30]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, " "]
    batch = substrings.Words(pa.array(texts, type=pa.string()).slice(1))
    assert batch.counts.tolist() == [len(words(t)) for t in texts[1:]]
    found, anchors = substrings.Passages(batch, length), {}
    for own, place, n, anchor in zip(found.owner.tolist(), found.place.tolist(), found.windows.tolist(), found.anchor.tolist(), strict=True):
        for k in range(place, place + n):
            window = tuple(words(texts[own + 1])[k - batch.base[own] : k - batch.base[own] + length])
            assert len(window) == length and anchors.setdefault(window, anchor) == anchor
    assert found.windows.sum() == sum(max(0, len(words(t)) - length + 1) for t in texts[1:])


def test_long_words_and_texts_are_hashed_alike(monkeypatch):
    texts = pa.array(["one two " + "z" * 5000 + " three", "three " + "z" * 5000 + " two one", None])
    whole = substrings.Words(texts).hashes()
    monkeypatch.setattr(substrings, "CHUNK", 8)
    pieces = substrings.Words(texts).hashes()
    assert whole.tolist() == pieces.tolist() and whole[:4].tolist() == whole[4:][::-1].tolist() and len(set(whole.tolist())) == 4


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_all_substrings(seed):
    rng = random.Random(seed)
    passages = [([rng.choice("abc") for _ in range(rng.randint(1, 12))], rng.randint(0, 99)) for _ in range(12)]
    automaton = substrings.SuffixAutomaton()
    for p, number in passages:
        automaton.add(p, number)
    automaton.settle()
    stream = [rng.choice("abcd") for _ in range(60)] + passages[0][0]
    for length in (1, 2, 4, 6):
        holders = {}
        for p, number in passages:
            for k in range(len(p) - length + 1):
                g = tuple(p[k : k + length])
                holders[g] = min(number, holders.get(g, number))
        want = [holders.get(tuple(stream[k : k + length])) for k in range(len(stream) - length + 1)]
        assert automaton.firsts(stream, length) == want
