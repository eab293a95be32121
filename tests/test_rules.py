"""Hand-made cases for text rules, scans, taint and evaluation."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from randaudit.functions import lexicon as lx
from randaudit.functions import text_rules as tr
from randaudit.operators import dataset as ds
from randaudit.operators import evaluate as ev
from randaudit.operators import graph_features as gf
from randaudit.operators import source_scan as scan
from randaudit.operators import taint
from randaudit.sources import contracts as src


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("﻿a\r\nb\rc", "a\nb\nc"), ("a\x00\x0bb\x7f\x85c\x1f", "abc"), ("a﻿", "a﻿"), ("", ""), (None, None), ("\t\n", "\t\n")],
)
def test_clean_source(spark, raw, clean):
    assert one(spark, raw, tr.clean_source) == clean


@pytest.mark.parametrize(
    ("pragma", "version"),
    [
        ("pragma solidity ^0.4.24;", "0.4.24"),
        ("pragma solidity ~0.6;", "0.6.0"),
        ("pragma solidity >=0.5.0 <0.7.0;", "0.5.0"),
        ("pragma solidity >0.4.22 <0.6.0;", "0.4.22"),
        ("pragma solidity ^0.5.25;", "0.5.17"),
        ("pragma solidity >=0.5.2;", "0.5.10"),
        ("pragma solidity >=0.9.0;", "0.8.19"),
        ("pragma solidity >=abc;", "0.8.19"),
        ("pragma solidity 1;", None),
        ("contract C {}", None),
    ],
)
def test_required_version(spark, pragma, version):
    versions = ["0.4.22", "0.5.0", "0.5.10", "0.10.0", "0.8.19"] if ">=0.9" not in pragma else ["0.8.19"]
    assert one(spark, pragma, lambda x: tr.required_version(tr.pragma_spec(x), versions)) == version


def test_versions_compare_as_numbers(spark):
    assert one(spark, "0.5.9", lambda x: tr.min_compatible(x, ["0.5.10", "0.6.0", "0.10.0"])) == "0.5.10"


def test_casts_and_levels(spark):
    assert one(spark, "12", tr.safe_int) == 12
    assert one(spark, "x", tr.safe_int) == 0
    assert one(spark, None, tr.safe_str) == ""
    assert one(spark, "1.5", tr.safe_float) == 1.5
    for score, level in ((0.8, "critical"), (0.6, "high"), (0.6000000000000001, "high"), (0.4, "medium"), (0.39, "low")):
        assert one(spark, score, tr.risk_level, "double") == level


def test_decode(spark):
    assert one(spark, "é".encode(), tr.decode_bytes, "binary") == "é"
    assert one(spark, b"\xe9", tr.decode_bytes, "binary") == "é"


FIX = [
    ("x * 16.66", "not implicitly convertible", "0.4.0", "x * 1666 / 100", True),
    ("uint8(keccak256(a))", "Explicit type conversion not allowed", "0.4.0", "uint8(uint256(keccak256(a))", True),
    ("f(string a, string b)", 'Data location must be "memory"', "0.5.0", "f(string memory a, string memory b)", True),
    ("address v; address value; v.transfer(1);", "transfer on address payable", "0.5.0", "address payable v; address value; v.transfer(1);", True),
    ("now known", "", "0.7.0", "block.timestamp known", True),
    ("now", "", "0.6.0", "now", False),
]


@pytest.mark.parametrize(("code", "error", "version", "want", "fixed"), FIX)
def test_autofix_basic(spark, code, error, version, want, fixed):
    df = spark.createDataFrame([(code, error, version)], "c string, e string, v string")
    got = df.select(*[x.alias(n) for x, n in zip(tr.autofix_basic(F.col("c"), F.col("e"), F.col("v")), ("code", "fixed"), strict=True)]).first()
    assert (got.code, got.fixed) == (want, fixed)


def python_hits(code):
    out = []
    for pattern, *_ in lx.LEXICON:
        out += [(pattern, m.start()) for m in re.finditer(rf"\b{re.escape(pattern)}\b", code)]
    return sorted(out)


def test_positions_are_those_of_python(spark):
    rng = random.Random(4)
    words = ["block.timestamp", "now", "known", "now_", "blockhash(", "block.number", "é", "\r\n", " ", ";", "(", "block.difficulty", "blocks.number", "😀"]
    codes = [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, ""), (901, None)]
    got = scan.tokens(spark.createDataFrame(codes, "contract_id long, code string")).select("contract_id", "pattern", "position", "code").collect()
    for i, code in codes:
        mine = sorted((r.pattern, r.position) for r in got if r.contract_id == i)
        assert mine == python_hits(code or "")
    assert all(r.code[r.position : r.position + len(r.pattern)] == r.pattern for r in got)


def python_use(pattern, text):
    low = text.lower()
    scores = {n: sum(bool(re.search(p, low, re.I)) for p in ps) for n, ps in lx.CONTEXTS.items()}
    found = {n: s for n, s in scores.items() if s}
    if not found:
        return "unknown"
    if pattern in ("block.timestamp", "now"):
        if "gambling" in found:
            return "gambling"
        if "timing" in found and "randomness" not in found:
            return "timing"
        if "randomness" in found:
            return "randomness"
    elif pattern in ("block.difficulty", "blockhash", "block.prevrandao"):
        return "randomness"
    return max(found, key=found.get)


def test_usage_context_against_python(spark):
    rng = random.Random(5)
    bits = [
        "% players.length", "x % 10 == 0", "lottery", "keccak256(block.timestamp)", "abi.encode(block.difficulty", "winner = a % b", "uint rand = 1", "shuffle",
        "require(block.timestamp >= x)", "if (block.timestamp < y)", "endTime", "block.timestamp + 15", "vesting", "> = endTime", "< startTime",
        "keccak256(a, block.number", "sha256(block.number)", "abi.encodePacked(block.number)", "uint x = block.number % 2", "seed = block.number", "nonce block.", "random = keccak",
        "require(msg.sender == owner)", "onlyOwner", "modifier m(", "mapping(address => bool)", "nothing", "\n", ";",
    ]
    rows = [(i, rng.choice(lx.LEXICON)[0], " ".join(rng.sample(bits, rng.randint(0, 3)))) for i in range(400)]
    got = {r.i: r.usage_context for r in scan.usage_context(spark.createDataFrame(rows, "i long, pattern string, context string")).collect()}
    for i, pattern, text in rows:
        assert got[i] == python_use(pattern, text), (pattern, text)


def test_combined_rules_and_ids(spark):
    code = "a = keccak256(msg.sender, block.number); abi.encode(block.number, block.timestamp); KECCAK256 (block.number, block.coinbase); block.number + block.timestamp"
    got = scan.combined(spark.createDataFrame([(1, code)], "contract_id long, code string")).orderBy("rule", "position").collect()
    want = [(k, m.start(), m.group()) for k, r in enumerate(lx.COMBINED) for m in re.finditer(r, code, re.I)]
    assert [(r.rule, r.position, r.text) for r in got] == want
    assert {r for r, *_ in want} == {0, 1, 2, 3}


def test_state_variables_last_wins_and_substrings(spark):
    code = "  uint seed = now;\naddress a = b;\nbytes32 known = known;\nuint private seed = block.number + now;\n"
    got = {r.node_id: r for r in scan.state_variable_hits(spark.createDataFrame([(1, code)], "contract_id long, code string")).collect()}
    assert set(got) == {"source_state_seed_now", "source_state_known_now", "source_state_seed_block_number"}
    assert got["source_state_seed_now"].position == re.search(r"uint private", code).start() - 1 + 1
    assert got["source_state_seed_now"].base_risk == 0.7 * 0.8


def test_functions_last_wins(spark):
    code = "function f() public { a; } function g(uint x) returns (uint) { if (x) { b; } c; } function f() { z; } constructor() public { k; }"
    got = {r.function: r.body.strip() for r in scan.functions(spark.createDataFrame([(1, code)], "contract_id long, code string")).collect()}
    assert got == {"f": "z;", "g": "if (x) { b; } c;", "constructor": "k;"}


def test_statistics_leave_state_variables_out(spark):
    code = "uint a = now;\nfunction f() { b = keccak256(now, block.number, block.difficulty); }"
    hits = scan.detect(spark.createDataFrame([(1, code)], "contract_id long, code string"))
    s = scan.statistics(hits).first()
    rows = hits.collect()
    assert s.total_sources == len(rows)
    assert sum(s.by_type.values()) == len(rows)
    assert sum(s.by_risk.values()) == sum(r.kind != "state" for r in rows)


def graph(spark, n, links, sources, sinks):
    nodes = spark.createDataFrame(
        [("c", f"n{i}", "lottery" if i == 1 else "", "assign", "", i in sources, i in sinks, ["blockhash"] if i in sources else [], ["randomGeneration"], [], ["v"]) for i in range(n)],
        "contract_id string, id string, label string, type string, code_snippet string, is_source boolean, is_sink boolean, sources array<string>, sinks array<string>, used_vars array<string>, defined_vars array<string>",
    )
    edges = spark.createDataFrame([("c", f"n{a}", f"n{b}", t, v, k) for k, (a, b, t, v) in enumerate(links)], "contract_id string, source string, target string, type string, var string, ord int")
    return nodes, edges


def brute_paths(links, source, sinks, cutoff=15):
    next_of = {}
    for a, b, *_ in links:
        next_of.setdefault(a, set()).add(b)
    out = []

    def walk(path):
        if len(path) > 1 and path[-1] in sinks:
            out.append(tuple(path))
        if len(path) <= cutoff:
            for b in sorted(next_of.get(path[-1], ())):
                if b not in path:
                    walk([*path, b])

    walk([source])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_against_search(spark, seed):
    rng = random.Random(seed)
    n = 8
    links = [(a, b, rng.choice([None, "data_dependency"]), rng.choice(["v", "w", None])) for a, b in itertools.permutations(range(n), 2) if rng.random() < 0.28]
    sources, sinks = {0, 3}, {3, 5, 7}
    nodes, edges = graph(spark, n, links, sources, sinks)
    built = taint.build_edges(edges)
    got = sorted(tuple(int(x[1:]) for x in r.path) for r in taint.simple_paths(nodes, built).collect())
    assert got == sorted(p for s in sources for p in brute_paths(links, s, sinks))
    reach = {(r.source, r.node) for r in taint.propagate(nodes, built).collect()}
    assert all((f"n{p[0]}", f"n{x}") in reach for p in got for x in p)
    strict = {(r.source, r.node) for r in taint.propagate(nodes, built, strict=True).collect()}
    assert strict <= reach


def test_edges_to_unknown_nodes_are_reported(spark):
    nodes, edges = graph(spark, 3, [(0, 1, None, None), (1, 9, None, None), (8, 1, None, None)], {0}, {1})
    good, lost = taint.known_edges(edges, nodes)
    assert (good.count(), lost.count()) == (1, 2)


def test_empty_graph(spark):
    nodes, edges = graph(spark, 0, [], set(), set())
    assert taint.simple_paths(nodes, taint.build_edges(edges)).count() == 0
    assert taint.propagate(nodes, taint.build_edges(edges)).count() == 0


def test_risk_level_truth_table(spark):
    f = taint.FACTOR
    cases = [
        (["critical", "gambling"], [], "HIGH"), (["direct", "financial"], [], "HIGH"), (["hash", "short"], [], "HIGH"), ([], [], "LOW"), (["weak"], ["admin", "complex"], "LOW"),
        (["weak"], ["role", "complex"], "MEDIUM"), (["weak"], ["user"], "LOW"), (["weak", "short"], ["user"], "MEDIUM"), (["critical"], [], "MEDIUM"), ([], ["complex"], "LOW"),
    ]
    for risks, softer, level in cases:
        df = spark.createDataFrame([([f[x] for x in risks], [f[x] for x in softer])], "r array<string>, s array<string>")
        assert df.select(taint.path_risk_level(F.col("r"), F.col("s")).alias("x")).first().x == level


def test_time_search_goes_on_past_undecided_nodes(spark):
    nodes = spark.createDataFrame(
        [("now and then", "x", []), ("now < 30", "x", []), ("block.timestamp > 2 days", "x", []), ("NOW 15", "x", []), ("hasRole(x)", "keccak", ["a", "b", "c"])],
        "code_snippet string, type string, used_vars array<string>",
    ).selectExpr("'c' AS contract_id", "code_snippet AS id", "'' AS label", "*")
    got = {r.id: r for r in taint.node_flags(nodes).collect()}
    assert [got[k].time for k in ("now and then", "now < 30", "block.timestamp > 2 days", "NOW 15")] == [None, "short", "long", None]
    assert got["hasRole(x)"].mixing and got["hasRole(x)"].access == "role"


def test_balance_split_and_shuffle_sizes(spark):
    e = spark.range(137).selectExpr("id AS contract_id", "CAST(id % 5 = 0 AS INT) AS label")
    b = ds.balance(e)
    counts = {r.label: r["count"] for r in b.groupBy("label").count().collect()}
    assert counts == {0: 28, 1: 28}
    flipped = ds.balance(e.selectExpr("contract_id", "1 - label AS label"))
    assert {r.label: r["count"] for r in flipped.groupBy("label").count().collect()} == {0: 28, 1: 109}
    parts = {r.split: r["count"] for r in ds.split(e).groupBy("split").count().collect()}
    assert parts == {"train": int(0.7 * 137), "validation": int(0.15 * 137), "test": 137 - int(0.7 * 137) - int(0.15 * 137)}
    assert sorted(r.place for r in ds.shuffle(e).collect()) == list(range(137))
    with pytest.raises(ValueError, match="both classes"):
        ds.balance(e.where("label = 0"))


def test_auc_equals_pairs(spark):
    rng = random.Random(2)
    for ties in (True, False):
        rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20 if ties else rng.random()) for _ in range(150)]
        pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert math.isclose(ev.auc_roc(spark.createDataFrame(rows, "label int, prob double")).first()[0], want)
    assert ev.auc_roc(spark.createDataFrame([(1, 0.5)], "label int, prob double")).first()[0] == 0.0


def test_thresholds(spark):
    none = spark.createDataFrame([(0, 0.9), (0, 0.1)], "label int, prob double")
    assert tuple(ev.best_threshold(none).first()) == (0.5, 0.0)
    some = spark.createDataFrame([(1, 0.3), (1, 0.45), (0, 0.2)], "label int, prob double")
    assert ev.best_threshold(some).first().threshold == 0.05 + 3 * 0.05
    again = spark.createDataFrame([(1, 0.45), (1, 0.6), (0, 0.2)], "label int, prob double")
    assert tuple(ev.aggressive_threshold(again, 0.5).first()) == (0.4, 1.0)
    assert ev.confusion(spark.createDataFrame([(1, 0.5)], "label int, prob double"), 0.5).first().fn == 1


def test_pad_one_hot_and_defaults(spark):
    df = spark.createDataFrame([([1, 2], 2, [0.5], 3), (list(range(25)), 25, [0.5], 12)], "s array<int>, n int, f array<float>, t int")
    seq, length = ds.pad_truncate(F.col("s"), F.col("n"))
    got = df.select(seq.alias("s"), length.alias("n"), ds.one_hot(F.col("f"), F.col("t")).alias("h")).collect()
    assert got[0].s == [1, 2] + [0] * 18 and got[0].n == 2 and got[0].h[1:] == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert got[1].s == list(range(20)) and got[1].n == 20 and sum(got[1].h[1:]) == 0


def test_classifier_separates(spark):
    rng = random.Random(1)
    rows = [(i, int(i % 10 == 0), [rng.gauss(3 if i % 10 == 0 else 0, 1), rng.gauss(0, 1)]) for i in range(400)]
    df = spark.createDataFrame(rows, "contract_id long, label int, features array<double>")
    scored = gf.score(gf.train_classifier(df), df)
    assert ev.auc_roc(scored.select("label", "prob")).first()[0] > 0.95


def test_read_and_write_contracts(spark, tmp_path):
    for folder, name, raw in (("safe", "a", b"now\r\nnow"), ("vulnerable", "b", b"\xe9 now"), ("vulnerable", "c", b"")):
        (tmp_path / "batch1" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "batch1" / folder / f"{name}.sol").write_bytes(raw)
    got = {r.contract_id: r for r in src.read_contracts(spark, str(tmp_path)).collect()}
    assert {k: (r.label, r.batch, r.code) for k, r in got.items()} == {"a": (0, "batch1", "now\nnow"), "b": (1, "batch1", "é now")}


def test_read_graphs_and_index(spark, tmp_path):
    (tmp_path / "x_semantic_graph.json").write_text('{"nodes": [{"id": "a", "is_source": true, "sources": ["now"]}], "edges": [{"source": "a", "target": "a"}, {"source": "a", "target": "a", "type": "t"}]}')
    (tmp_path / "index.json").write_text('{"entries": [{"contract_id": "x", "label": 1, "num_paths": 2}]}')
    nodes, edges = src.read_graphs(spark, str(tmp_path))
    assert nodes.first().contract_id == "x" and [r.ord for r in edges.collect()] == [0, 1]
    assert taint.build_edges(edges).first().type == "t"
    index = src.read_index(spark, {"b1": str(tmp_path / "index.json"), "b2": str(tmp_path / "none.json")})
    assert [tuple(r) for r in index.collect()] == [("x", 1, 2, "b1")]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "b1", [1, 2])], "contract_id string, batch string, paths array<int>")
    src.write_results(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().paths == [1, 2]


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    from randaudit.streaming import source_stream as st

    folder = tmp_path / "in" / "safe"
    folder.mkdir(parents=True)
    (folder / "a.sol").write_text("uint x = now + block.number;")
    stream = st.contract_stream(spark, str(tmp_path / "in"))
    st.write_hits(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = st.hits(src.read_contracts(spark, str(tmp_path / "in")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.select("node_id").collect()) == sorted(batch.select("node_id").collect())
    (folder / "b.sol").write_text("now")
    st.write_hits(st.contract_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("contract_id = 'b'").count() == 1


# --- the scan's shortcuts ---
def test_shortcuts_of_context_regexes_change_nothing(spark):
    import random
    import re

    from randaudit.functions import lexicon as lx
    from randaudit.operators import source_scan as scan

    rng = random.Random(5)
    parts = "keccak256 ( block. block.timestamp block.difficulty uint rand = % players.length winner 10 == 0 seed nonce random keccak require if > < + \n".split(" ")
    parts += ["mapping", "address", "bool", "modifier x(", "endtime", "msg.sender", ")", "abi.encodepacked", "abi.encode", "sha256", "- ", "* ", "\n", "é"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    regexes = [r.lower() for rs in lx.CONTEXTS.values() for r in rs] + lx.NESTED
    got = df.select("t", *[scan.holds(F.col("t"), r).alias(f"r{k}") for k, r in enumerate(regexes)]).collect()
    for k, r in enumerate(regexes):
        found = re.compile(r)
        assert [x[f"r{k}"] for x in got] == [bool(found.search(x.t)) for x in got], r


def test_the_last_function_of_a_name_stays(spark):
    from randaudit.operators import source_scan as scan

    code = "function a() { one } function b() {two} function a() public {three} constructor() { four } constructor() { five } function constructor() { six }"
    got = {(r.function, r.body.strip()) for r in scan.functions(spark.createDataFrame([(1, code), (2, "none"), (3, None)], "contract_id int, code string")).collect()}
    assert got == {("a", "three"), ("b", "two"), ("constructor", "four")}


def test_auc_of_crowded_scores(spark):
    import random

    from randaudit.operators import evaluate as ev

    rng = random.Random(2)
    rows = [(rng.randint(0, 1), 1e-6 * rng.random() if rng.random() < 0.9 else rng.choice([0.0, 0.5, 1.0])) for _ in range(600)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(ev.auc_roc(spark.createDataFrame(rows, "label int, prob double")).first().auc_roc - want) < 1e-12
    assert ev.auc_roc(spark.createDataFrame([(1, 0.5)], "label int, prob double")).first().auc_roc == 0.0


def test_records_with_many_paths_have_parts(spark):
    from randaudit.operators import taint

    nodes = spark.createDataFrame([("c", "s", True, False), ("c", "k", False, True), ("d", "x", False, False)], "contract_id string, id string, is_source boolean, is_sink boolean")
    reach = spark.createDataFrame([("c", "s", "s"), ("c", "s", "k")], "contract_id string, source string, node string")
    none = "risk_factors array<string>, mitigating_factors array<string>"
    paths = spark.createDataFrame(
        [("c", "s", "k", ["s", str(i), "k"], [], "HIGH" if i % 2 else "LOW", [], [], "a", "b", 3, False) for i in range(40)],
        f"contract_id string, source string, sink string, path array<string>, edges array<struct<from:string,to:string,type:string>>, risk_level string, {none}, source_type string, sink_type string, path_length int, contains_loop boolean",
    )
    got = taint.results(nodes, reach, paths, per_record=10).collect()
    assert sorted((r.contract, r.part) for r in got) == [("c", 0), ("c", 1), ("c", 2), ("c", 3), ("d", 0)]
    assert sorted(p.path[1] for r in got for p in r.paths) == sorted(map(str, range(40)))
    of_c = {(r.statistics.total_paths, r.statistics.high_risk_paths, r.summary.risk_distribution.LOW, r.statistics.tainted_sinks) for r in got if r.contract == "c"}
    assert of_c == {(40, 20, 20, 1)}


def test_contexts_from_pieces_equal_contexts_from_the_text(spark):
    import random

    from randaudit.operators import source_scan as scan

    rng = random.Random(7)
    words = ["now", "block.number", "😀", "é\n", "filler", "blockhash", "known", " ", "x" * 50]
    rows = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([0, 1, 40, 600, 2500])] + [(9, None)]
    df = spark.createDataFrame(rows, "contract_id int, code string")
    names = ["contract_id", "pattern", "position", "context", "base_risk"]
    want = scan.tokens(df).withColumn("context", scan.context()).select(names).collect()
    assert sorted(scan.token_contexts(df).select(names).collect()) == sorted(want) and len(want) > 500
