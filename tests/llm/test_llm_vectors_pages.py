"""Nearest neighbours, HTML extraction and the pipeline, against brute force and on odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute_texts import brute_links, kept_lines
from randaudit.llm import ann, decontam, htmltext, langid, packing, queries

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, -1) for i, v in rows], VECTORS)


def brute(rows, k, asked):
    own = {}
    for i, v in rows:
        if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own.setdefault(i, np.array(v, dtype=np.float32).astype(float))
    out = {}
    for q in own:
        if asked(q):
            scored = sorted((-float(own[q] @ own[i]), i) for i in own if i != q)[:k]
            out[q] = scored
    return out


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    hot = [1.0, 2.0, 0.0, 0.0, 0.0, 0.5]
    rows += [(300 + i, hot) for i in range(150)]
    rows += [(500, None), (501, [0.0] * 6), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (504, [None] + [1.0] * 5), (505, [1.0]), (None, hot), (506, [])]
    return rows + [rows[20], rows[20]]


def test_every_neighbour_is_exact_on_a_small_table(spark):
    rows = odd_vectors()
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5, target=1.0).orderBy("query_id", "rank").collect()
    want = brute(rows, 5, lambda q: q % 10 == 0)
    assert {r.query_id for r in got} == set(want)
    for q, near in want.items():
        mine = [(r.rank, r.vec_id, r.score) for r in got if r.query_id == q]
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert np.allclose([m[2] for m in mine], [-s for s, _ in near])
        if q >= 300:  # ties of equal vectors go to smaller ids
            assert [m[1] for m in mine] == [i for _, i in near]


def test_blocks_with_many_queries_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKED", 7)
    rows = odd_vectors()
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 2 == 0, k=5, target=1.0).collect()
    want = brute(rows, 5, lambda q: q % 2 == 0)
    found = {(r.query_id, r.rank): r.score for r in got}
    assert set(found) == {(q, k + 1) for q, near in want.items() for k in range(len(near))}
    right = [np.isclose(found[q, k + 1], -s) for q, near in want.items() for k, (s, _) in enumerate(near)]
    assert np.mean(right) > 0.98


def test_plan_takes_the_fewest_curves_with_narrow_windows():
    far = np.full((32, 100), 5000)
    far[0] = 3
    assert ann._plan(far, 10_000, 0.9) == (4, 16)
    far[0, :50] = 5000
    far[9, :50] = 100
    assert ann._plan(far, 10_000, 0.9) == (16, 101)
    assert ann._plan(np.full((32, 100), 400), 1000, 0.9) == (32, 401)


def test_few_and_no_vectors(spark):
    few = ann.search(vectors(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]), k=20).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(20, 1), (20, 2)]
    assert ann.search(vectors(spark, [])).count() == 0
    assert ann.search(vectors(spark, [(1, [1.0, 0.0])])).count() == 0


def test_recall_at_the_production_parameters(spark, sf):
    d = sf.replace("0.001", "0.1")
    got = queries.op1_nearest_neighbours(spark, d).collect()
    e = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in e], dtype=np.float32).astype(float), np.array([r.vec_id for r in e])
    hit = 0
    asked = ids[ids % 20 == 0]
    for q in asked:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 20 * len(asked) and hit / len(got) >= 0.9


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        keys = ann.hilbert(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


PAGES = [
    ("<p>a <b>b</b>\n c<br>d<p>e", "a b c\nd\n\ne"),
    ("<ul><li>one<li>two<ul><li>deep</ul><li hidden>no</ul>", "- one\n- two\n  - deep"),
    ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td><td>漢<tr><td>b</table>", "Name       N\nlong name  1\n           漢\nb"),
    ("<table><tr><td rowspan=2>r<td>q<tr><td>z</table>", "r  q\n   z"),
    ("<pre>\n a\n   b</pre>x", " a\n   b\n\nx"),
    ("<div style='display: none'>no</div><div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "yes"),
    ("<head><title>no</title></head><script>var t='</p>'</script><style>p{}</style><!-- no --><noscript>no</noscript>text", "text"),
    ("&copy; &amp; &lt;b&gt;&nbsp;x", "© & <b>\xa0x"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("<input type=hidden value=no><input value=go><select><option>a<option>b</select>", "go\na\nb"),
    ("", ""),
    ("   \n ", ""),
    ("<p hidden>x", ""),
    ("plain < text & more", "plain < text & more"),
    (None, None),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_rendering(page, text):
    assert htmltext.visible_text(page) == text


def test_no_visible_word_is_lost(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    import html
    import re

    for r in pages.collect():
        raw = re.sub(r"(?s)<!--.*?-->|<(head|script|style)\b.*?</\1>|<!DOCTYPE[^>]*>", " ", r.html)
        want = html.unescape(re.sub(r"<[^>]*>", " ", raw)).split()
        have = [w for w in got[r.page_id].split() if w != "-"]
        assert "".join(have) == "".join(w for w in want if w != "-")


def test_pages_odd_inputs(spark):
    deep = "<div>" * 5000 + "in" + "</div>" * 5000
    df = spark.createDataFrame([(1, "u", deep, "x"), (1, "u", deep, "x"), (None, None, None, None), (2, "u", "<p>" + "w " * 200_000, "x")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0), (r.text or "")[:4]) for r in htmltext.extract(df).collect())
    assert got == [(0, ""), (1, "in"), (1, "in"), (2, "w w ")]
    assert htmltext.extract(df.limit(0)).count() == 0


# --- the pipeline ---
def test_stages_follow_their_rules(spark, sf):
    d = sf
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("kept", F.lit("x"))
    extra = spark.createDataFrame([(10_001, None, None, None, None, "y"), (10_002, "12 34", "en", "s", 5, "y")], docs.schema)
    docs = docs.unionByName(extra)
    # Names that the stages use themselves.
    names = ["first_id", "lang_pred", "score", "whole_row", "gone", "gone_id", "rest", "has_letter", "n_words", "n_hit", "set_key", "length", "c0", "class_id", "contaminated"]
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    rows = {r.doc_id: r for r in docs.collect()}
    stages = corpus_pipeline.STAGES
    told = stages[0][1](spark, docs, d).cache()
    assert set(told.columns) == set(docs.columns)
    assert {r.doc_id for r in told.collect()} == set(rows) - {10_001, 10_002}

    clean = stages[1][1](spark, told, d).cache()
    want = kept_lines([(r.doc_id, r.text) for r in told.collect()])
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {i: (t, len(t)) for i, t in want.items()}

    single = stages[2][1](spark, clean, d).cache()
    classes = brute_links([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id for r in single.collect()} == {i for i, c, _ in classes if i == c}

    pure = stages[3][1](spark, single, d).cache()
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    bad = {r.doc_id for r in decontam.report(decontam.hits(single, bench)).where("contaminated").collect()}
    assert {r.doc_id for r in pure.collect()} == {r.doc_id for r in single.collect()} - bad and bad
    assert pure.columns == docs.columns
    carried = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert all(r[c] == rows[r.doc_id][c] for r in pure.collect() for c in carried)

    packed = stages[4][1](spark, pure, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in pure.collect()}
    n = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= -(-n // packing.SIZE) + 2


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(docs.select(key).collect()) == sorted(corpus_pipeline.run(spark, sf).select(key).collect())


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_null_ids_stay_in_the_pipeline(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(None, "some words to keep here", "en", None, None), (1, "some words to keep here", "en", None, None), (2, "some words to keep here", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.ngram_jaccard(spark, docs, sf)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1]
    assert langid.identify(docs).count() == 3


def test_registered_queries():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.queries())


def test_pipeline_keeps_lettered_documents_without_labels(spark, sf):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "漢字", None), (None, "more words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["more words", "some words", "漢字"]
