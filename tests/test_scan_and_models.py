"""Single readings of texts, histograms of scores, whole-vector sums and Newton fits, against plain Python and numpy."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from randaudit.functions import lexicon as lx
from randaudit.operators import ast_flatten as af
from randaudit.operators import evaluate as ev
from randaudit.operators import graph_features as gf
from randaudit.operators import source_scan as scan
from randaudit.operators import taint


def plain(row):
    return {n: row[n] for n in row.__fields__}


def test_places_of_very_many_matches(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["now ", "é\n", "knows ", "(now)\n\n", "😀 "]) for _ in range(3000))
    df = spark.createDataFrame([(text,), ("",), ("nothing",)], "code string")
    rows = df.select(F.expr(scan.matches_sql("code", r"(?U)\bnow\b", lines=True)).alias("m")).collect()
    want = [(m.start(), "now", text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"\bnow\b", text)]
    assert len(want) > 3 * scan.RUN
    assert [tuple(m) for m in rows[0].m] == want and rows[1].m == [] and rows[2].m == []


def test_overlapping_tokens_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        scan.token_alternation([("block.number", "", 0, ""), ("number.block", "", 0, "")])
    assert scan.token_alternation(lx.LEXICON).count("|") == len(lx.LEXICON) - 1


def test_one_reading_gives_all_kinds(spark):
    code = "uint a = now;\nuint a = now + block.number;\nkeccak256(block.number, block.difficulty) " + "x" * 3000 + " block.timestamp"
    df = spark.createDataFrame([(1, code), (2, ""), (3, None)], "contract_id long, code string")
    hits = scan.detect(df).collect()
    kinds = {k: [r for r in hits if r.kind == k] for k in scan.KINDS}
    assert [r.position for r in kinds["token"]] == [m.start() for m in re.finditer(r"\b(now|block\.(number|difficulty|timestamp))\b", code)]
    # Of equal state variables the last stays, for each of its tokens.
    assert sorted(r.node_id for r in kinds["state"]) == ["source_state_a_block_number", "source_state_a_now"]
    assert {r.snippet.strip() for r in kinds["state"]} == {"uint a = now + block.number;"}
    assert {r.matched_text for r in kinds["combined"]} == {"keccak256(block.number, block.difficulty)"}
    parts = [scan.token_hits(df), scan.combined_hits(df), scan.state_variable_hits(df)]
    assert sorted((str(plain(r)) for p in parts for r in p.collect())) == sorted(str(plain(r)) for r in hits)


def test_plan_reads_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "now")], "contract_id long, code string").write.parquet(str(tmp_path / "c"))
    stats = scan.statistics(scan.detect(spark.read.parquet(str(tmp_path / "c"))))
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert [plain(r) for r in stats.collect()] == [{"contract_id": 1, "total_sources": 1, "nested_sources": 0, "by_risk": {"high": 1}, "by_type": {"timestamp": 1}}]


def brute_context(body, position, pattern):
    if len(body) < 2000:
        return body
    end = position + len(pattern)
    low, high = max(0, position - 1000), min(len(body), end + 1000)
    left, right = body[low:position], body[end:high]
    return (left[left.rfind(";") + 1 :] + pattern + right.split(";")[0]).strip()


@pytest.mark.parametrize("size", [300, 1999, 2000, 9000])
def test_function_contexts_equal_plain_cuts(spark, size):
    rng = random.Random(size)
    words = ["now", "block.timestamp", "x;", "y\n", " z ", "é", "winner = a % b", "block.number + block.number"]
    body = ""
    while len(body) < size:
        body += rng.choice(words) + " "
    body = body[:size]
    hits = scan.function_hits(spark.createDataFrame([(1, "f", body)], "contract_id long, function string, body string")).collect()
    singles = [r for r in hits if r.source_type != "combined"]
    rx = re.compile(r"\b(" + "|".join(re.escape(p) for p, *_ in lx.LEXICON) + r")\b")
    want = [(m.start(), m.group(), body.count("\n", 0, m.start()) + 1, brute_context(body, m.start(), m.group())[:200]) for m in rx.finditer(body)]
    assert sorted((r.position, r.pattern, r.line_number, r.snippet) for r in singles) == sorted(want)


def test_work_does_not_grow_with_hits_times_body(spark):
    seconds = {}
    for n in (4_000, 16_000):
        df = spark.createDataFrame([(1, "f", "now; " * n)], "contract_id long, function string, body string")
        scan.function_hits(df.limit(1)).count()
        start = time.perf_counter()
        assert scan.function_hits(df).count() == n
        seconds[n] = time.perf_counter() - start
    assert seconds[16_000] < 12 * seconds[4_000] + 2


def test_sweep_equals_one_matrix_for_each_threshold(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, None]), rng.choice([None, float("nan"), 0.0, 1.0, *ev.GRID, rng.random()])) for _ in range(400)]
    for data in (rows, [], [(1, 0.9)]):
        df = spark.createDataFrame(data, "label int, prob double")
        got = {r.threshold: (r.tn, r.fp, r.fn, r.tp) for r in ev.sweep(df).collect()}
        assert set(got) == set(ev.GRID)
        for t in ev.GRID:
            pairs = [(y, p != p or p > t) for y, p in data if p is not None and y is not None]
            assert got[t] == tuple(sum(1 for q in pairs if q == cell) for cell in ((0, False), (0, True), (1, False), (1, True)))
        plan = ev.sweep(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Expand" not in plan


def test_vectors_are_summed_whole(spark):
    rng = np.random.default_rng(3)
    nodes = [(c, k, rng.normal(size=3).tolist()) for c in range(3) for k in range(4)] + [(9, 0, None), (8, 0, [-1.0, 0.0, -2.0]), (8, 1, [-3.0, -1.0, -5.0])]
    df = spark.createDataFrame(nodes, "contract_id long, node long, features array<double>")
    got = {(r.contract_id, r.dim): (r["mean"], r["max"]) for r in gf.graph_pool(df).collect()}
    for c in (0, 1, 2, 8):
        x = np.array([f for k, _, f in nodes if k == c and f])
        assert all(np.allclose(got[c, d], (x[:, d].mean(), x[:, d].max())) for d in range(3))
    assert not any(c == 9 for c, _ in got)
    paths = df.select("contract_id", F.col("node").alias("length"), (F.col("node") * 800.0).alias("score"), "features")
    pooled = {(r.contract_id, r.dim): r.attention for r in gf.path_pool(paths, df.select("contract_id").distinct(), 3).collect()}
    for c in (0, 1, 2):  # the largest score takes all
        assert np.allclose([pooled[c, d] for d in range(3)], [f for k, n, f in nodes if (k, n) == (c, 3)][0])
    assert [pooled[9, d] for d in range(3)] == [0.0] * 3


def numpy_fit(x, y, penalty):
    """Gradient descent with small steps is slow but shares nothing with Newton's: here the minimum is checked by its gradient."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    reg = np.append(np.full(x.shape[1] - 1, penalty), 0)
    at = np.zeros(x.shape[1])
    rate = 1 / (np.linalg.eigvalsh(x.T @ (x * w[:, None]) / 4 / len(y)).max() + penalty)
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-x @ at))
        at = at - rate * (x.T @ (w * (p - y)) / len(y) + reg * at)
    return at


def test_classifier_weights_equal_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    y = (x @ np.array([2.0, -1.0, 0.5, 0.0]) + rng.normal(size=300) > 1.2).astype(int)
    rows = [(v, int(t)) for v, t in zip(x.tolist(), y.tolist(), strict=True)] + [(None, 1), ([1.0] * 4, None), ([1.0] * 4, 3)]
    df = spark.createDataFrame(rows, "features array<double>, label int")
    model = gf.train_classifier(df.repartition(5))
    want = numpy_fit(x, y, gf.PENALTY)
    assert np.allclose(np.append(model.weights, model.intercept), want, atol=1e-6)
    got = [r.prob for r in gf.score(model, df).collect()]
    assert np.allclose(got[:300], 1 / (1 + np.exp(-(x @ want[:-1] + want[-1]))), atol=1e-6) and got[300] is None
    again = gf.train_classifier(df.repartition(2))
    assert np.allclose(again.weights, model.weights, atol=1e-9)


def test_classes_that_a_line_parts_are_fitted_too(spark):
    df = spark.createDataFrame([([float(k)], int(k > 10)) for k in range(20)], "features array<double>, label int")
    model = gf.train_classifier(df)
    assert model.steps < gf.STEPS and all((r.prob > 0.5) == (r.label == 1) for r in gf.score(model, df).collect())
    with pytest.raises(ValueError, match="both classes"):
        gf.train_classifier(df.where("label = 1"))


NODES = "contract_id long, id string, label string, type string, code_snippet string, is_source boolean, is_sink boolean, sources array<string>, sinks array<string>, used_vars array<string>, defined_vars array<string>"
EDGES = "contract_id long, source string, target string, type string, var string"


def graphs(rng, contracts):
    nodes, edges = [], []
    for c, (n, chance) in contracts.items():
        for k in range(n):
            code, label = rng.choice([None, "winner = 1", "msg.sender == owner", "block.timestamp > 2 days", "hasRole"]), rng.choice([None, "doTransfer", "step"])
            nodes.append((c, f"n{k:02d}", label, rng.choice([None, "send", "sha3"]), code, rng.random() < 0.3, rng.random() < 0.3, None, None, rng.choice([None, ["a", "b", "c"]]), None))
        edges += [(c, f"n{a:02d}", f"n{b:02d}", rng.choice(["data_dependency", "control_flow"]), "v") for a in range(n) for b in range(n) if rng.random() < chance]
    return nodes, edges


@pytest.mark.parametrize(("cutoff", "limits"), [(15, {}), (3, {}), (4, {"ROW_WALKS": 40}), (4, {"ROW_NODES": 5}), (4, {"ROW_EDGES": 0})])
def test_paths_in_a_row_equal_paths_of_the_loop(spark, monkeypatch, cutoff, limits):
    for name, value in limits.items():
        monkeypatch.setattr(taint, name, value)
    nodes, edges = graphs(random.Random(cutoff), {1: (7, 0.3), 2: (5, 0.5), 3: (9, 0.15), 4: (1, 1.0), 5: (6, 0.0), 6: (4, 1.0)})
    df, links = spark.createDataFrame(nodes, NODES), spark.createDataFrame([*edges, (1, "n00", "gone", "x", "v")], EDGES).where("target <> 'gone'")
    fields = ["contract_id", "source", "sink", "path", "edges", "path_length", "contains_loop", "gambling", "financial", "mixing", "access", "time"]
    rows = lambda found: sorted(map(str, found.select(fields).collect()))
    got = rows(taint.simple_paths(df, links, cutoff))
    assert got == rows(taint.looped_paths(df, links, cutoff)) and len(got) == len(set(got)) > 5


@pytest.mark.parametrize(("strict", "limits"), [(False, {}), (True, {}), (False, {"REACH_ROWS": 12}), (True, {"REACH_ROWS": 12, "MANY_LARGE": 0})])
def test_reach_in_a_row_equals_a_walk_over_each_graph(spark, monkeypatch, limits, strict):
    for name, value in limits.items():
        monkeypatch.setattr(taint, name, value)
    rng = random.Random(7)
    nodes, edges = graphs(rng, {1: (7, 0.3), 2: (5, 0.5), 3: (30, 0.05), 4: (1, 1.0), 5: (6, 0.0), 6: (4, 1.0)})
    # More sources than a word of bits holds, on a chain with a cycle at its end; repeated nodes and links; nodes without a contract or an id.
    nodes += [(7, f"n{k:03d}", None, None, None, k < 150, False, None, None, None, ["v"]) for k in range(160)]
    edges += [(7, f"n{k:03d}", f"n{k + step:03d}", "data_dependency", "v") for step in (1, 20) for k in range(160 - step)] + [(7, "n159", "n150", None, None), (7, "n000", "n001", "control_flow", "")]
    nodes += [nodes[0], (None, "n0", None, None, None, True, False, None, None, None, None), (8, None, None, None, None, True, False, None, None, None, None)]
    nodes = [(*x[:10], rng.choice([None, ["v"]]) if x[0] != 7 else x[10]) for x in dict(((x[0], x[1]), x) for x in nodes).values()]
    nodes.append(next(x for x in nodes if x[5]))
    edges += [(None, "n0", "n1", "x", "v"), (1, "n00", None, "x", "v")]
    df, links = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)

    defined = {(x[0], x[1]): x[10] for x in nodes}
    ways = {}
    for c, a, b, kind, var in edges:
        vars_ = defined.get((c, a))
        if c is not None and b is not None and (not strict or kind is not None and (kind != "data_dependency" or vars_ is not None and var in vars_)):
            ways.setdefault((c, a), []).append(b)
    want = set()
    for c, own, *_, is_source, _, _, _, _, _ in nodes:
        if is_source and c is not None and own is not None:
            todo = [own]
            while todo:
                at = todo.pop()
                if (c, own, at) not in want:
                    want.add((c, own, at))
                    todo += ways.get((c, at), [])
    got = [tuple(r) for r in taint.propagate(df, links, strict).select("contract_id", "source", "node").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10_000


def test_paths_of_a_graph_without_nodes(spark):
    assert taint.simple_paths(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).count() == 0


ELEMENTARY = '{"nodeType":"ElementaryTypeName","name":"uint8"}'


def _names(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(2)
    named = df.select("k", af.type_name(F.try_parse_json("text")).alias("name"))
    assert not re.search("Python|Arrow", named._jdf.queryExecution().toString())
    return [r.name for r in named.orderBy("k").collect()]


def test_types_that_nest_deeply_have_a_name(spark):
    levels = {0: "uint8", 1: "uint8[]", 300: "uint8" + "[]" * 300, 900: "uint8" + "[]" * 900, 2000: "unknown", 100_000: "unknown"}
    assert _names(spark, ['{"nodeType":"ArrayTypeName","baseType":' * k + ELEMENTARY + "}" * k for k in levels]) == list(levels.values())


def test_names_of_types(spark):
    inner = f'{{"nodeType":"Mapping","keyType":{ELEMENTARY},"valueType":{{"nodeType":"ArrayTypeName","baseType":{ELEMENTARY}}}}}'
    cases = {
        f'{{"nodeType":"Mapping","keyType":{{"nodeType":"UserDefinedTypeName","pathNode":{{"name":"A.B"}},"name":"C"}},"valueType":{inner}}}': "mapping(A.B => mapping(uint8 => uint8[]))",
        '{"nodeType":"UserDefinedTypeName","name":"C","pathNode":"x"}': "C",
        '{"nodeType":"UserDefinedTypeName","name":"C","pathNode":{}}': "unknown",
        '{"nodeType":"UserDefinedTypeName"}': "unknown",
        '{"nodeType":"FunctionTypeName","typeString":"function ()"}': "function ()",
        '{"nodeType":"ArrayTypeName"}': "unknown[]",
        '{"nodeType":"ArrayTypeName","baseType":{"nodeType":"ElementaryTypeName","name":"\\"Mapping\\""}}': '"Mapping"[]',
        '{"nodeType":"Mapping","keyType":null,"valueType":[]}': "mapping(unknown => unknown)",
        "{}": "unknown", "[]": "unknown", "5": "unknown", "null": "unknown", "not json": "unknown", None: "unknown",
    }
    assert _names(spark, list(cases)) == list(cases.values())


@pytest.mark.parametrize("limits", [{}, {"ROW_WALKS": 40}, {"ROW_NODES": 5}, {"ROW_EDGES": 0, "MANY_LARGE": 0}])
def test_one_search_gives_paths_with_types_and_tainted_sinks(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(taint, name, value)
    nodes, edges = graphs(random.Random(5), {"a": (7, 0.3), "b": (5, 0.5), "c": (9, 0.15), "d": (1, 1.0), "e": (6, 0.0), "f": (4, 1.0)})
    nodes = [(*x[:7], ["blockhash"] if x[5] and x[1] != "n01" else None, ["valueTransfer"] if x[6] and x[1] != "n02" else [], *x[9:]) for x in nodes]
    nodes.append(next(x for x in nodes if x[6]))  # a node told twice
    text = lambda schema: schema.replace("contract_id long", "contract_id string")
    df, links = spark.createDataFrame(nodes, text(NODES)).distinct(), spark.createDataFrame(edges, text(EDGES))
    paths, tainted = taint.searched(df, links, 4)
    plain = taint.looped_paths(df, links, 4)
    names = [*plain.columns, "source_type", "sink_type", "risk_factors", "mitigating_factors", "risk_level"]
    rows = lambda found: sorted(map(str, found.select(names).collect()))
    assert rows(taint.assess(paths, df)) == rows(taint.assess(plain, df)) and paths.count() > 5
    got = {r.contract_id: r.tainted_sinks for r in tainted.where("tainted_sinks > 0").collect()}
    assert got == {r.contract_id: r.tainted_sinks for r in taint.tainted_sinks(df, taint.propagate(df, links)).collect()} and len(got) > 2
    if not limits:
        # Contracts of ordinary size: neither the search nor the assessment of what it found is shuffled or joined again.
        plan = taint.assess(paths, df)._jdf.queryExecution().executedPlan().toString()
        assert not [op for op in ("Join", "Exchange", "PythonUDF", "MapInArrow") if op in plan]


def test_rows_are_searched_in_whole_contracts():
    import pyarrow as pa

    from randaudit.operators import row_graphs as rg

    names = ["contract_id", "id", "target", "type", "bits", "source_type", "sink_type"]
    schema = pa.schema([(n, pa.int32() if n == "bits" else pa.string()) for n in names])
    ring = [("r", str(k), None, None, rg.SOURCE * (k == 0) + rg.SINK * (k == 3) + (k == 1) * (2 << rg.ACCESS[0]), None, None) for k in range(4)]
    ring += [("r", str(k), str((k + 1) % 4), "t", None, None, None) for k in range(4)] + [("r", "0", "gone", "t", None, None, None), ("r", "gone", "3", "t", None, None, None)]
    rows = [("l", "a", "b", "t", None, None, None), *ring, ("s", "0", None, None, rg.SOURCE + rg.SINK, "x", "y"), ("s", "0", "0", "t", None, None, None)]
    batches = lambda step: [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + step]], schema=schema) for k in range(0, len(rows), step)]
    for step, at_once in ((1, 1), (3, 2), (4, 100), (100, 1)):
        whole = [b.column("contract_id").to_pylist() for b in rg.whole_contracts(iter(batches(step)), at_once)]
        assert sum(whole, []) == [r[0] for r in rows] and all(not set(a) & set(b) for a, b in zip(whole, whole[1:], strict=False))
    assert list(rg.whole_contracts(iter([]))) == []
    out = pa.schema([("contract_id", pa.string()), ("path", pa.list_(pa.string())), ("types", pa.list_(pa.string())), ("access", pa.string()), ("walks", pa.float64()), ("tainted_sinks", pa.int64())])
    told = [r for b in rg.searched(iter(batches(2)), 15, 1000, out) for r in b.to_pylist()]
    assert {r["contract_id"]: r["tainted_sinks"] for r in told if r["path"] is None} == {"l": 0, "r": 1, "s": 1}
    assert [(r["contract_id"], r["path"], r["types"], r["access"]) for r in told if r["path"]] == [("r", ["0", "1", "2", "3"], ["t"] * 3, "role")]
    assert not [r for b in rg.searched(iter(batches(2)), 15, 0, out) for r in b.to_pylist() if r["path"]]
