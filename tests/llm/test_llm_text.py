"""Training-data operators on texts, against brute force and on odd inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute_texts import brute_kept, brute_links, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from randaudit.llm import decontam, idstore, jaccard, langid, linededup, packing, sharding, subwords, tokencount
from randaudit.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_words long, score double"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, "s", -1, None) for i, t, lang in rows], DOCS)


def odd_docs():
    """Nulls, empty and long texts, ties, repeated rows, odd characters."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ÄÖ", "x-y", "don't"]
    base = " ".join(rng.choice(vocab) for _ in range(90))
    line = "This License line is long enough."
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "123 456"), (5, base), (6, base), (7, base + " tail"), (8, "one"), (9, "one"), (10, "a b c d"), (11, "A B, c D!")]
    rows += [(12, "x " * 30_000), (None, base), (None, None), (13, "漢字 😀 <|endoftext|> text"), (13, "漢字 😀 <|endoftext|> text"), (14, "\r\n\x0b\x85 weird\xa0space")]
    rows += [(20 + k, f"{line}\nown {k} {rng.random()}\n\t {line.lower()}  \n") for k in range(5)]
    rows += [(40 + k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 200)))) for k in range(40)]
    return [(i, t, rng.choice(["en", "de", None])) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_docs())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- decontamination ---
def brute_hits(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bound", "longest"), [(10_000, 10_000), (20, 10_000), (20, 4)])
def test_decontamination(spark, docs, bound, longest, monkeypatch):
    rows = odd_docs()
    long = words(rows[4][1])
    items = [(1, "one"), (2, None), (10, " ".join(long[10:30])), (3, " ".join(long[20:33]).upper()), (4, "!!"), (5, "b c d"), (6, "b c d"), (7, "")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    monkeypatch.setattr(decontam.benchmark_items, "__defaults__", (13, longest))
    got = decontam.report(decontam.hits(docs, bench, max_words=bound)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_hits(rows, items)


def test_large_benchmarks_are_indexed_fast_and_found_whole():
    rng = np.random.default_rng(4)
    rows = [(str(k % 900), [f"v{x}" for x in rng.integers(0, 50_000, 100)]) for k in range(3000)]
    index = decontam._Index(rows)
    assert sum(len(known) for known, *_ in index.by_n.values()) > 250_000
    for item, own in rows[:200]:
        text = ["other", *own[20:50], "words"]
        ids = np.array([index.vocabulary.get(w, 0) for w in text], dtype=np.uint64)
        spans, items = index.find(ids)
        assert decontam._merged(spans) == ([1], [31]) and item in items


def test_decontamination_modes(spark):
    item = " ".join(f"k{i}" for i in range(13))
    rows = [(1, f"Before, {item.upper()}! After", "en"), (2, "clean text", "en"), (3, None, "en"), (4, item + " " + " ".join(f"z{i}" for i in range(300)), "en")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r.doc_id for r in decontam.decontaminate(frame(spark, rows), bench).collect()}
    assert kept == {2, 3, 4}
    cut = {r.doc_id: r.text for r in decontam.decontaminate(frame(spark, rows), bench, "spans").collect()}
    assert cut[1] == "Before, ! After" and cut[2] == "clean text" and cut[3] is None and cut[4].startswith(" z0")


def test_decontamination_empty(spark, empty, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(decontam.hits(empty, bench)).count() == 0
    assert {r.n_hit for r in decontam.report(decontam.hits(docs, bench)).collect()} == {0}


# --- sharding ---
def test_sharding(spark, docs, empty):
    rows = odd_docs()
    got = sharding.shard_documents(docs, 5, 64).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(empty, 5, 64).count() == 0


def test_sharding_balances_and_moves_little(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400), None) for i in range(4000)]
    records = sharding.record_slots(frame(spark, rows), 512)
    loads = sharding.slot_loads(records).cache()
    first = sharding.first_map(loads, 8).cache()
    placed = sharding.assign(records, loads, first)
    sums = [r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.01 * sum(sums) / 8
    again = sharding.rebalance(first, loads, 9)
    assert {r.version for r in again.collect()} == {2}
    moved = first.alias("a").join(again.alias("b"), "vslot").where("a.shard <> b.shard").join(loads, "vslot").agg(F.sum("bytes")).first()[0]
    assert moved < 0.15 * sum(sums)
    sums = [r.b for r in sharding.assign(records, loads, again).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 9 and max(sums) - min(sums) < 0.02 * sum(sums) / 9


def test_slot_maps_are_kept_by_version(spark, tmp_path):
    loads = sharding.slot_loads(sharding.record_slots(frame(spark, [(i, "t", None) for i in range(100)]), 16))
    one = sharding.first_map(loads, 2)
    sharding.store_map(one, str(tmp_path / "maps"))
    stored = spark.read.parquet(str(tmp_path / "maps"))
    sharding.store_map(sharding.rebalance(stored, loads, 3), str(tmp_path / "maps"))
    assert {r.version for r in spark.read.parquet(str(tmp_path / "maps")).collect()} == {1, 2}


def brute_sharding(records, n_shards):
    """Shard of each slot: slots by falling bytes (then by number), each to the shard with the fewest bytes so far."""
    loads = Counter()
    for r in records:
        loads[r.vslot] += r.size
    sums, shard = [0] * n_shards, {}
    for v, b in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        shard[v] = sums.index(min(sums))
        sums[shard[v]] += b
    return shard


def test_sharding_equals_brute_force_and_keeps_its_maps(spark, docs, tmp_path):
    rows = odd_docs() + [(None, "same text", None)] * 300
    names = ("size", "shard", "slot", "vslot", "text_crc32", "version", "bytes", "rows", "before", "k")
    frames = frame(spark, rows).withColumns({c: F.lit("x") for c in names if c != "score"})
    path = str(tmp_path / "maps")
    sharding.store_map(sharding.first_map(sharding.slot_loads(sharding.record_slots(frames, 64)), 4), path)
    for version, n_shards in ((2, 4), (3, 5)):
        got = sharding.shard_documents(frames, n_shards, 64, maps=path).collect()
        held = {r.vslot: r.shard for r in sharding.latest_map(spark, path).collect()}
        assert {r.version for r in sharding.latest_map(spark, path).collect()} == {version}
        assert all(held[r.vslot] == r.shard for r in got) and {r.shard for r in got} <= set(range(n_shards))
    # A folder that doesn't exist yet gets version 1, and version 2 where that is for another number of shards.
    for first, versions in ((5, {1}), (4, {1, 2})):
        new = str(tmp_path / f"new-{first}")
        got = sharding.shard_documents(frames, 5, 64, maps=new, first_shards=first).collect()
        held = {r.vslot: r.shard for r in sharding.latest_map(spark, new).collect()}
        assert {r.version for r in sharding.stored_maps(spark, new).collect()} == versions
        assert len(got) == len(rows) and all(held[r.vslot] == r.shard for r in got) and {r.shard for r in got} <= set(range(5))
    got = sharding.shard_documents(frames, 5, 64).collect()
    want = brute_sharding(got, 5)
    assert len({r.vslot for r in got if r.doc_id is None}) > 30  # no slot is crowded by rows without an id
    place = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.vslot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)):
        assert (r.shard, r.slot) == (want[r.vslot], place[want[r.vslot]])
        place[r.shard] += 1


# --- tokens ---
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    rng = random.Random(3)
    letters = [*"ab Zé'ß,.1 \n\t\r's't_-", "'re", "\xa0", "漢", "😀", "<|endoftext|>", "İ", "ª", "×", "  ", "\x0b", "́", "don't", "…", "½"]
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [t or "" for _, t, _ in odd_docs()]
    made = subwords.Encoder(path)
    for batch in (odd[:2000], odd[2000:], odd):
        want = made.tokenizer.encode_batch(batch, add_special_tokens=False)
        assert [x.tolist() for x in made.encode(batch)] == [w.ids for w in want]


def test_block_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 255, 5000):
        for ids in (rng.integers(0, 300, n), rng.integers(0, 70_000, n), np.arange(n)):
            ids = ids.astype(np.uint32)
            assert (idstore.unpack(*idstore.pack(ids), n) == ids).all()
    many = np.arange(70_000, dtype=np.uint32)
    assert (idstore.unpack(*idstore.pack(many), len(many)) == many).all()


def test_token_ids(spark, docs, empty, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = {(i, t): library.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in odd_docs()}
    got = sorted(idstore.digest(docs, path).collect(), key=lambda r: r.start)
    assert len(got) == len(odd_docs())
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    names = [r.doc_id if r.doc_id is not None else -1 for r in got]
    assert names == sorted(names)
    want = Counter((i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for (i, t), x in ids.items())
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == set(want)
    assert idstore.digest(empty, path).count() == 0


def test_long_documents_are_cut_over_blocks_and_joined():
    writer = idstore._Writer(0)
    docs = [(k, np.arange(n, dtype=np.uint32) % 1000) for k, n in ((1, 10), (2, 3 * idstore.BLOCK_IDS + 5), (3, 7), (4, idstore.BLOCK_IDS))]
    blocks = [b for d, x in docs for b in writer.add(d, x)]
    blocks += [writer.flush()] if writer.size else []
    rows = [r for b in blocks for r in b.to_pylist()]
    assert [r["begun"] == r["block"] for r in rows] == [True, True, False, False, False, True, True]
    ids = defaultdict(list)
    for r in rows:
        all_ids, at = idstore.unpack(r["ranked"], r["control"], r["data"], sum(r["lengths"])), 0
        for d, n in zip(r["doc_ids"], r["lengths"], strict=True):
            ids[d].append(all_ids[at : at + n])
            at += n
    assert all((np.concatenate(ids[d]) == x).all() for d, x in docs)


def test_token_counts_equal_the_library(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = tokencount.unigram_vocabulary(path)
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = Counter(map(tuple, tokencount.token_counts(docs, path).collect()))
    assert got == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in odd_docs())
    assert tokencount.token_counts(empty, path).count() == 0


def test_token_count_ties(monkeypatch):
    vocabulary = [("<unk>", 0.0)] + [(w, -float(len(w))) for w in ["a", "b", "ab", "ba", "aa", "bb", "aba", "▁", "▁a", "▁ab"]]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    monkeypatch.setattr(tokencount, "MAX_WORDS", 50)  # words are forgotten and counted again
    count, rng = tokencount.Counter(vocabulary), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab c▁") for _ in range(rng.randint(0, 12)))
        assert count.text(text) == len(library.encode(text).ids), text


# --- line dedup ---
def brute_lines(rows):
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    out = [(i, (text or "").count("\n") + 1, kept) for (i, text, *_), kept in zip(rows, brute_kept(rows), strict=True)]
    return sorted(((i, n, n - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for i, n, k in out), key=repr)


def test_line_dedup(docs, empty, monkeypatch):
    got = linededup.dedup_lines(docs).drop("kept")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(odd_docs())
    assert linededup.dedup_lines(empty).count() == 0
    monkeypatch.setattr(linededup, "MAX_FILTER_BYTES", -1)
    monkeypatch.setattr(linededup, "MAX_BROADCAST_KEYS", -1)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 1)
    assert sorted(map(tuple, linededup.dedup_lines(docs).drop("kept").collect()), key=repr) == brute_lines(odd_docs())


def test_rows_that_repeat_an_id_are_one_document(spark):
    line = "this line has twenty-five"
    rows = [(1, line, None), (1, line, None), (2, f"{line}\nown", None), (None, "a line of rows without an id", None), (None, "a line of rows without an id", None)]
    got = linededup.dedup_lines(frame(spark, rows))
    assert sorted((r.n_dropped for r in got.collect())) == [0] * 5
    rows += [(3, f"x\n  {line.upper()}", None)]
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1), (3, 0)]


def test_line_dedup_can_be_undone(spark):
    line = "a line that is long enough to count"
    rows = [(k, f"{line}\nown {k}", None) for k in range(4)] + [(9, "nothing to see", None)]
    state = linededup.LineState.empty(spark).insert(frame(spark, rows[:2]))
    drops = lambda s, r: {x.doc_id: x.n_dropped for x in linededup.cleaned(frame(spark, r), s).collect()}
    assert drops(state, rows) == dict.fromkeys([0, 1, 2, 3, 9], 0)
    state = state.insert(frame(spark, rows[2:]))
    assert drops(state, rows) == {0: 1, 1: 1, 2: 1, 3: 0, 9: 0}
    state = state.delete(spark.createDataFrame([(3,)], "doc_id long"))
    assert drops(state, rows[:3]) == {0: 1, 1: 1, 2: 0}
    state = state.delete(spark.createDataFrame([(0,)], "doc_id long"))
    assert drops(state, rows[:3]) == {0: 0, 1: 0, 2: 0}
    assert state.qualified().count() == 0


def test_filters_are_dealt_anew_as_keys_grow(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 2)
    line = lambda k: f"line number {k} that is long enough"
    rows = [(k, "\n".join(line(j) for j in range(9)), None) for k in range(3)]
    state = linededup.LineState.empty(spark).insert(frame(spark, rows))
    assert state.shards == 5 and state.sieve.count() > 1
    assert {x.doc_id: x.n_dropped for x in linededup.cleaned(frame(spark, rows), state).collect()} == {0: 9, 1: 9, 2: 0}


def test_cuckoo_filter():
    keys = [hashlib.md5(str(k).encode()).digest() for k in range(6000)]
    made = linededup.Cuckoo.of(keys[:5000])
    assert made.ask(keys[:5000]).all() and made.ask(keys[5000:]).mean() < 0.01
    made.delete(keys[:2500])
    assert made.ask(keys[2500:5000]).all() and made.ask(keys[:2500]).mean() < 0.02
    assert made.insert(keys[:2500]) and made.ask(keys[:5000]).all()
    assert not linededup.Cuckoo.sized(2).insert(keys[:500])


# --- language ID ---
def test_language_id_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_odd_inputs(spark, docs, empty):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= got
    assert {p for _, p in got} <= {"en", "de", "und"}
    assert langid.identify(empty).count() == 0
    one = langid.identify(frame(spark, [(1, "only words", "en"), (3, "more words", "en"), (5, "5 5", "en"), (6, None, "xx")]))
    assert {r.lang_pred for r in one.collect()} == {"en", "und"}
    none = langid.identify(frame(spark, [(1, "words", None)]))
    assert none.first().lang_pred == "und"


@pytest.mark.parametrize("text", ["½ 12", "①", "Ⅻ", "²", "ⅷ 3", "〇", "_", "😀", "\u0301"])
def test_number_characters_are_no_letters(text):
    model = {"langs": ["en"], "weights": {}}
    assert langid.classify(text, model) == ("und", 0.0)
    assert langid.classify(text + "é", model) == ("en", 1.0)
    assert langid.has_letter("ª") and langid.has_letter("1 漢") and not langid.has_letter(None)


def test_features_travel_whole(spark):
    for text in ("a", "some text, ÄÖ", "x " * 5000):
        x = langid.features(text)
        assert np.allclose(langid._unpacked(langid._packed(x)), x, atol=1e-6) and len(langid._packed(x)) <= 6 * langid.DIMS


def test_language_id_with_clashing_columns_and_repeated_rows(spark):
    rows = [(i, f"the words {i}" if i % 2 else f"die Wörter {i}", "en" if i % 2 else "de", "x", "y", True, 1) for i in range(60)] + [(7, "the words 7", "en", "x", "y", True, 1)] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string, held_out boolean, x int")
    got = langid.identify(docs).collect()
    assert len(got) == 960 and {(r.doc_id % 2, r.lang_pred) for r in got} == {(0, "de"), (1, "en")}


def test_language_families_are_decided_first(spark):
    rng = random.Random(2)
    stems = {"es": "aco ado ción", "fr": "eau tion ère", "de": "heit ung ß", "en": "the ing wh", "fi": "kk ää yö", "zz": "qx xq vv"}
    rows = [(i, " ".join(rng.choice(stems[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(list(stems) * 40)]
    got = langid.identify(frame(spark, rows)).collect()
    want = {i: lang for i, _, lang in rows}
    assert sum(want[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.97


def test_machines_and_decisions_equal_brute_force(spark):
    """The machines that Spark's tasks fit, and every prediction, against the same rules on plain lists."""
    rng = random.Random(8)
    stems = {"es": "aco ado ción", "fr": "eau tion ère", "it": "zione gli che", "de": "heit ung ß", "en": "the ing wh"}
    rows = [(i, " ".join(rng.choice(stems[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(list(stems) * 12)]
    model = langid.fit(langid.learnable(frame(spark, rows)))
    known = sorted((lang, i, t) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    weights = {}
    for name, a, b in langid.machines(sorted(stems)):
        own = [(langid._unpacked(langid._packed(langid.features(t))), 1.0 if lang in a else -1.0) for lang, _, t in known if lang in (*a, *b)]
        weights[name] = langid._fit_svm(np.array([x for x, _ in own]), np.array([y for _, y in own]))
    assert set(model["weights"]) == set(weights) and all(np.allclose(model["weights"][n], w) for n, w in weights.items())

    def winner(x, names, level):
        wins, margins = Counter(), Counter()
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                m = float(x @ weights[f"{level}|{a}|{b}"][:-1] + weights[f"{level}|{a}|{b}"][-1])
                wins[a if m >= 0 else b] += 1
                margins[a] += m
                margins[b] -= m
        return sorted(names, key=lambda n: (-wins[n], -margins[n], n))[0]

    families = defaultdict(list)
    for lang in sorted(stems):
        families[langid.family(lang)].append(lang)
    for r in langid.identify(frame(spark, rows)).collect():
        x = langid.features(rows[r.doc_id][1])
        assert r.lang_pred == winner(x, families[winner(x, sorted(families), "family")], langid.family(r.lang_pred))


# --- Jaccard join ---
def near_docs():
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for k in range(60):  # one large group of near copies
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(150)] = f"e{rng.randint(0, 99)}"
        rows.append((100 + k, " ".join(own), None))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(200 + k, passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60)), None) for k in range(60)]
    return rows + [(300, rows[0][1], None), (301, rows[0][1], None)]


@pytest.mark.parametrize("bucket", [256, 8])
def test_jaccard_join(spark, bucket, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rows = odd_docs() + near_docs()
    clash = frame(spark, rows).withColumns({c: F.lit("x") for c in ("set_key", "root", "hash", "keys", "least", "class_id", "key", "sketch")})
    got = jaccard.join(clash).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute_links(rows)


def test_jaccard_pairs_of_a_hot_passage(spark, monkeypatch):
    """Near copies by twos, whose words are mostly a passage that all documents have: its buckets stay large on every level."""
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "LEAF_SETS", 32, raising=False)
    passage, rows = [f"p{i}" for i in range(134)], []
    for k in range(200, 280):
        shared = [f"s{k}x{i}" for i in range(48)]
        rows += [(2 * k + m, " ".join(passage + shared + [f"o{k}x{m}x{i}" for i in range(21)]), None) for m in range(2)]
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(i, i - i % 2, 1) for i, _, _ in rows]


def test_jaccard_join_by_shuffle_and_empty(spark, empty, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_TEXTS", 0)
    rows = near_docs()
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute_links(rows)
    assert jaccard.join(empty).count() == 0


def test_jaccard_paths_are_shuffled_once(spark, monkeypatch):
    """All paths of level 1 go through one exchange: they are counted and sieved where they arrive."""
    plans, store = [], jaccard.stored
    sets = jaccard._sets(frame(spark, near_docs()), 15, 0.8)

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(jaccard, "stored", spy)
    small, large = jaccard._buckets(sets)
    plans.append(small._jdf.queryExecution().executedPlan().toString())
    assert large is None and sum(p.count("Exchange hashpartitioning") for p in plans) == 1
    met = small.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("set_key").alias("d")).where("n < 2 or n <> d")
    assert small.count() > 0 and met.count() == 0


def test_jaccard_large_buckets_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_PATHS", 0)
    rows = near_docs()
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute_links(rows)


def test_workers_forget_what_other_operators_keep(spark):
    """The pieces and words that a worker knows don't stay in an executor's memory while other operators run in it."""
    import public_tokenizers

    path, piece = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

    def kept(batches):
        import pyarrow as pa

        subwords.encoder(path).encode(["some words"])
        tokencount.counter(piece).text("some words")
        for _ in batches:
            before = subwords.encoder.cache_info().currsize, tokencount.counter.cache_info().currsize
            jaccard._sets_columns()
            after = subwords.encoder.cache_info().currsize, tokencount.counter.cache_info().currsize
            yield pa.RecordBatch.from_pydict({"before": [sum(before)], "after": [sum(after)]})

    assert [tuple(r) for r in spark.range(1).coalesce(1).mapInArrow(kept, "before long, after long").collect()] == [(2, 0)]


def test_intersections_from_differences():
    rng = np.random.default_rng(3)
    ref = np.unique(rng.integers(0, 500, 200).astype(np.uint64))
    sets = [np.unique(rng.integers(0, 500, 180).astype(np.uint64)) for _ in range(12)]
    told = [(np.setdiff1d(ref, s), np.setdiff1d(s, ref)) for s in sets]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    inside = ~np.eye(len(sets), dtype=bool)  # a set's overlap with itself is not told
    assert (jaccard.intersections(len(ref), told, None) == want)[inside].all()
    assert (jaccard.intersections(len(ref), told[:5], told[5:]) == want[:5, 5:]).all()


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# --- packing ---
def test_packing(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = Counter()
    for i, t, _ in odd_docs():
        x = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        first = len(x) % 2048 or 2048
        at = [0, *range(first, len(x) + 1, 2048)]
        ids.update((i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:])))
    got = packing.pack_documents(docs, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b])[:-1].tolist() and sum(n for _, n in b) <= 2048
    assert len(bins) <= packing.lower_bound([r.length for r in got], 2048) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_emptiest_bins_of_all_subproblems_are_packed_again(spark):
    rng = np.random.default_rng(6)
    lengths = [2048] * 30 + rng.integers(1, 900, 3000).tolist() + [1] * 100
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    bins, at = {}, defaultdict(list)
    for group in (5000, 100):
        got = packing.pack(cut, group=group).collect()
        assert sorted((r.doc_id, r.length) for r in got) == sorted(enumerate(lengths))
        at.clear()
        for r in got:
            at[r.sequence_id].append((r.offset, r.length))
        for b in at.values():
            b.sort()
            assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b])[:-1].tolist() and sum(n for _, n in b) <= 2048
        bins[group] = len(at)
    assert bins[100] <= packing.lower_bound(lengths, 2048) + 4 and bins[5000] <= packing.lower_bound(lengths, 2048) + 1


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2048, 400).tolist()
    order = list(range(400))
    a = packing.Packing(2048).put(order, lengths)
    b = packing.Packing(2048).put(order[::-1], lengths)
    for _ in range(20):
        a, b = b, packing.cross(a, b, lengths, rng)
        assert sorted(i for x in b.bins for i in x) == order
        assert all(sum(lengths[i] for i in x) == f <= 2048 for x, f in zip(b.bins, b.fill, strict=True))


def test_evolution_beats_one_pass_and_repeats():
    rng = np.random.default_rng(8)
    lengths = rng.integers(300, 1100, 600).tolist()
    one = packing.evolve(lengths, [], 0, 0)
    assert [p.bins for p in one] == [p.bins for p in packing.evolve(lengths, [], 0, 0)]
    greedy = packing.Packing(2048).put(sorted(range(600), key=lambda i: -lengths[i]), lengths)
    later = packing.evolve(lengths, [packing._flat(p, 600).tolist() for p in one], 0, 1)
    assert len(later[0].bins) <= len(one[0].bins) <= len(greedy.bins)
    assert packing.evolve([], [], 0, 0)[0].bins == []
