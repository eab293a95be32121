"""Queries of the taint operators on stand-in graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from randaudit.jobs.fixtures import view, with_views
from randaudit.operators import taint
from randaudit.sources.contracts import GRAPH, explode_graphs
from randaudit.sources.scratch import stored

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taint_node with the arrays of a graph document."""
    n = view(spark, sf_dir, "taint_node")
    return n.select(
        "contract_id", "id", "label", "type", "code_snippet", "is_source", "is_sink",
        F.when(F.col("is_source"), F.array("source_type")).alias("sources"),
        F.when(F.col("is_sink"), F.array("sink_type")).alias("sinks"),
        F.array_repeat(F.lit("u"), F.col("n_used_vars").cast("int")).alias("used_vars"),
        F.array(F.concat(F.lit("v"), F.col("p") % 3), F.concat(F.lit("v"), (F.col("p") + 1) % 3)).alias("defined_vars"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "taint_edge")


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge twice, with another type the second time, as a document may list it; a third kind has no type."""
    e = edges(spark, sf_dir)
    first = e.select("contract_id", "source", "target", "type", "var", F.lit(0).alias("ord"))
    again = e.select("contract_id", "source", "target", F.when(F.col("var") != "v0", F.lit("call")).alias("type"), F.when(F.col("var") != "v1", F.col("var")).alias("var"), F.lit(1).alias("ord"))
    return first.unionByName(again)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the edges between known nodes, stored once for loops that read them in every round."""
    n = stored(nodes(spark, sf_dir), "taint-nodes")
    return n, stored(taint.known_edges(edges(spark, sf_dir), n)[0], "taint-edges")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.simple_paths(*graph(spark, sf_dir))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return taint.assess(taint.simple_paths(n, e), n)


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- SQL ---
def _reach_sql(strict: bool = False) -> str:
    carries = "" if not strict else " AND (e.type <> 'data_dependency' OR e.var IN (concat('v', n.p % 3), concat('v', (n.p + 1) % 3)))"
    return f"""reach(contract_id, source, node) AS (SELECT contract_id, id, id FROM taint_node WHERE is_source
  UNION SELECT r.contract_id, r.source, e.target FROM reach r JOIN taint_edge e ON e.contract_id = r.contract_id AND e.source = r.node
    JOIN taint_node n ON n.contract_id = r.contract_id AND n.id = r.node{carries})"""


_FLAGS = """flags AS (SELECT contract_id, id, is_sink, (contains(lower(code_snippet), 'winner') OR contains(lower(label), 'lottery')) AS g,
  (type IN ('transfer', 'send') OR contains(lower(label), 'transfer')) AS f, (type IN ('keccak', 'sha256', 'sha3') AND n_used_vars > 2) AS m,
  CASE WHEN contains(lower(code_snippet), 'msg.sender == owner') THEN 'admin' WHEN contains(lower(code_snippet), 'role') THEN 'role' END AS a,
  CASE WHEN contains(code_snippet, '< 30') THEN 'short' WHEN contains(code_snippet, 'days') THEN 'long' END AS t FROM taint_node)"""
_PATHS = f"""{_FLAGS},
walk(contract_id, source, tail, path, steps, at_sink, g, f, m, a, t) AS (
  SELECT n.contract_id, n.id, n.id, [n.id], CAST([] AS VARCHAR[]), false, g, f, m, a, t FROM taint_node n JOIN flags x ON x.contract_id = n.contract_id AND x.id = n.id WHERE n.is_source
  UNION ALL SELECT w.contract_id, w.source, e.target, list_append(w.path, e.target), list_append(w.steps, concat(e.source, '>', e.target, ':', e.type)), x.is_sink,
    w.g OR x.g, w.f OR x.f, w.m OR x.m, coalesce(w.a, x.a), coalesce(w.t, x.t)
  FROM walk w JOIN taint_edge e ON e.contract_id = w.contract_id AND e.source = w.tail JOIN flags x ON x.contract_id = e.contract_id AND x.id = e.target
  WHERE len(w.path) <= 15 AND NOT list_contains(w.path, e.target)),
paths AS (SELECT w.contract_id, w.source, w.tail AS sink, w.path, w.steps, CAST(len(w.path) AS BIGINT) AS path_length, s.source_type, k.sink_type, g, f, m, a, t
  FROM walk w JOIN taint_node s ON s.contract_id = w.contract_id AND s.id = w.source JOIN taint_node k ON k.contract_id = w.contract_id AND k.id = w.tail WHERE at_sink)"""
_ASSESSED = f"""{_PATHS},
factors AS (SELECT *, list_filter([CASE WHEN source_type IN ('blockhash', 'difficulty', 'prevrandao') THEN 'Critical entropy source (blockhash/difficulty)' END,
    CASE WHEN source_type IN ('timestamp', 'blocknumber') THEN 'Weak entropy source (timestamp/blocknumber)' END, CASE WHEN sink_type = 'randomGeneration' AND g THEN 'Gambling/lottery context detected' END,
    CASE WHEN sink_type = 'randomGeneration' AND f THEN 'Direct financial impact' END, CASE WHEN path_length <= 3 THEN 'Direct path (≤2 nodes)' END, CASE WHEN t = 'short' THEN 'Short time window (<15 seconds)' END], lambda x: x IS NOT NULL) AS risks,
  list_filter([CASE WHEN path_length > 7 THEN 'Complex intermediate computations' END, CASE WHEN m THEN 'Proper entropy mixing detected' END, CASE WHEN a = 'admin' THEN 'Admin-only access control' END,
    CASE WHEN a = 'role' THEN 'Role-based access control' END, CASE WHEN t = 'long' THEN 'Long time window constraint' END], lambda x: x IS NOT NULL) AS softer FROM paths),
assessed AS (SELECT *, CASE WHEN list_contains(risks, 'Critical entropy source (blockhash/difficulty)') AND list_contains(risks, 'Gambling/lottery context detected') THEN 'HIGH'
  WHEN list_contains(risks, 'Direct path (≤2 nodes)') AND list_contains(risks, 'Direct financial impact') THEN 'HIGH' WHEN len(risks) = 0 THEN 'LOW'
  WHEN len(softer) > len(risks) AND list_contains(softer, 'Admin-only access control') THEN 'LOW' ELSE 'MEDIUM' END AS risk_level FROM factors)"""
_DISTRIBUTION = f"""WITH {_reach_sql()}, {_ASSESSED},
base AS (SELECT contract_id, count(*) FILTER (WHERE is_source) AS sources, count(*) FILTER (WHERE is_sink) AS sinks FROM taint_node GROUP BY contract_id),
ts AS (SELECT n.contract_id, count(*) AS tainted_sinks FROM taint_node n WHERE is_sink AND EXISTS (SELECT 1 FROM reach r WHERE r.contract_id = n.contract_id AND r.node = n.id) GROUP BY n.contract_id),
ps AS (SELECT contract_id, count(*) AS total_paths, count(*) FILTER (WHERE risk_level = 'HIGH') AS high, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk_level = 'LOW') AS low FROM assessed GROUP BY contract_id),
dist AS (SELECT contract_id, sources, sinks, coalesce(tainted_sinks, 0) AS tainted_sinks, coalesce(total_paths, 0) AS total_paths, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
  FROM base LEFT JOIN ts USING (contract_id) LEFT JOIN ps USING (contract_id))"""


def _rec(sql: str, *names: str) -> str:
    """with_views for SQL whose common table expressions are recursive."""
    return with_views("RECURSIVE" + sql, *names)


@query(with_views("""SELECT contract_id, count(*) AS n_nodes, (SELECT count(*) FROM taint_edge e WHERE e.contract_id = n.contract_id) AS n_edges,
count(*) FILTER (WHERE is_source) AS n_sources, count(*) FILTER (WHERE is_sink) AS n_sinks FROM taint_node n GROUP BY contract_id""", "taint_edge"))
def graph_counts(spark, sf_dir):
    return taint.graph_counts(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(with_views("SELECT contract_id, source, target, CASE WHEN var <> 'v0' THEN 'call' ELSE 'control_flow' END AS type, CASE WHEN var <> 'v1' THEN var ELSE '' END AS var FROM taint_edge", "taint_edge"))
def edges_collapsed(spark, sf_dir):
    return taint.build_edges(doubled(spark, sf_dir))


@query(_rec(f"WITH {_reach_sql()} SELECT contract_id, source, node FROM reach", "taint_edge"))
def taint_reach(spark, sf_dir):
    return taint.propagate(*graph(spark, sf_dir))


@query(_rec(f"WITH {_reach_sql(True)} SELECT contract_id, source, node FROM reach", "taint_edge"))
def taint_reach_strict(spark, sf_dir):
    return taint.propagate(*graph(spark, sf_dir), strict=True)


@query(_rec(f"WITH {_reach_sql()} SELECT contract_id, node, string_agg(source, ',' ORDER BY source) AS sources FROM reach GROUP BY ALL", "taint_edge"))
def node_taints(spark, sf_dir):
    found = taint.tainted_by(taint.propagate(*graph(spark, sf_dir)))
    return found.withColumn("sources", F.array_join("sources", ","))


@query(_rec(f"WITH {_reach_sql()} SELECT contract_id, count(DISTINCT n.id) AS tainted_sinks FROM taint_node n JOIN reach r USING (contract_id) WHERE n.is_sink AND r.node = n.id GROUP BY contract_id", "taint_edge"))
def tainted_sinks(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return taint.tainted_sinks(n, taint.propagate(n, e))


@query(_rec(f"""WITH {_reach_sql()} SELECT r.contract_id, r.source, r.node AS sink, s.source_type, k.sink_type FROM reach r JOIN taint_node s ON s.contract_id = r.contract_id AND s.id = r.source
JOIN taint_node k ON k.contract_id = r.contract_id AND k.id = r.node WHERE k.is_sink""", "taint_edge"))
def source_sink_pairs(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return taint.source_sink_pairs(n, taint.propagate(n, e))


@query(_rec(f"WITH {_PATHS} SELECT contract_id, source, sink, array_to_string(path, '>') AS path, path_length, false AS contains_loop FROM paths", "taint_edge"))
def taint_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("contract_id", "source", "sink", F.array_join("path", ">").alias("path"), *long("path_length"), "contains_loop")


@query(_rec(f"WITH {_PATHS} SELECT contract_id, array_to_string(path, '>') AS path, array_to_string(steps, ',') AS edges FROM paths", "taint_edge"))
def path_edges(spark, sf_dir):
    step = F.transform("edges", lambda e: F.concat(e["from"], F.lit(">"), e["to"], F.lit(":"), e["type"]))
    return _paths(spark, sf_dir).select("contract_id", F.array_join("path", ">").alias("path"), F.array_join(step, ",").alias("edges"))


@query(_rec(f"WITH {_ASSESSED} SELECT contract_id, array_to_string(path, '>') AS path, source_type, sink_type, array_to_string(risks, ';') AS risk_factors, array_to_string(softer, ';') AS mitigating_factors FROM assessed", "taint_edge"))
def path_factors(spark, sf_dir):
    return _assessed(spark, sf_dir).select("contract_id", F.array_join("path", ">").alias("path"), "source_type", "sink_type", *[F.array_join(c, ";").alias(c) for c in ("risk_factors", "mitigating_factors")])


@query(_rec(f"WITH {_ASSESSED} SELECT contract_id, array_to_string(path, '>') AS path, risk_level FROM assessed", "taint_edge"))
def path_risk(spark, sf_dir):
    return _assessed(spark, sf_dir).select("contract_id", F.array_join("path", ">").alias("path"), "risk_level")


def _distribution(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    paths, tainted = taint.searched(n, e)
    return taint.risk_distribution(n, tainted, taint.assess(paths, n))


@query(_rec(f"{_DISTRIBUTION} SELECT * FROM dist", "taint_edge"))
def risk_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir)


@query(_rec(f"""{_DISTRIBUTION} SELECT contract_id % 32 AS batch, contract_id, CAST(sum(sources) AS BIGINT) AS sources, CAST(sum(sinks) AS BIGINT) AS sinks, CAST(sum(tainted_sinks) AS BIGINT) AS tainted_sinks,
CAST(sum(total_paths) AS BIGINT) AS total_paths, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low FROM dist GROUP BY ROLLUP (contract_id % 32, contract_id)""", "taint_edge"))
def risk_totals(spark, sf_dir):
    return taint.corpus_totals(_distribution(spark, sf_dir), F.col("contract_id") % 32)


@query(_rec(f"""WITH {_ASSESSED} SELECT contract_id, source, sink, array_to_string(path, '>') AS path, CAST(rank AS BIGINT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY path_length, source, sink, path) AS rank FROM assessed WHERE risk_level = 'HIGH') WHERE rank <= 3""", "taint_edge"))
def top_high_risk_paths(spark, sf_dir):
    return taint.top_high_risk(_assessed(spark, sf_dir)).select("contract_id", "source", "sink", F.array_join("path", ">").alias("path"), *long("rank"))


@query(_rec(f"""{_DISTRIBUTION}, listed AS (SELECT contract_id, string_agg(concat(source, ' ', sink, ' ', array_to_string(path, '>'), ' ', array_to_string(steps, ','), ' ', risk_level, ' ', array_to_string(risks, ';'), ' ', array_to_string(softer, ';'), ' ',
  source_type, ' ', sink_type, ' ', path_length), '|' ORDER BY source, sink, path) AS paths FROM assessed GROUP BY contract_id)
SELECT contract_id AS contract, CAST(0 AS BIGINT) AS part, sources AS total_sources, sinks AS total_sinks, tainted_sinks, total_paths, high AS high_risk_paths, medium AS medium_risk_paths, low AS low_risk_paths,
coalesce(md5(paths), '') AS paths, total_paths AS summary_paths, concat(high, '/', medium, '/', low) AS risk_distribution FROM dist LEFT JOIN listed USING (contract_id)""", "taint_edge"))
def taint_results(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    paths, tainted = taint.searched(n, e)
    found = taint.results(n, tainted, taint.assess(paths, n))
    step = lambda s: F.concat(s["from"], F.lit(">"), s["to"], F.lit(":"), s["type"])
    text = F.transform("paths", lambda p: F.concat_ws(
        " ", p["source"], p["sink"], F.array_join(p["path"], ">"), F.array_join(F.transform(p["edges"], step), ","), p["risk_level"],
        F.array_join(p["risk_factors"], ";"), F.array_join(p["mitigating_factors"], ";"), p["source_type"], p["sink_type"], p["path_length"].cast("string"),
    ))
    paths = F.when(F.size("paths") > 0, F.md5(F.array_join(text, "|").cast("binary"))).otherwise("")
    spread = F.concat_ws("/", *[F.col(f"summary.risk_distribution.{level}") for level in ("HIGH", "MEDIUM", "LOW")])
    return found.select("contract", *long("part"), "statistics.*", paths.alias("paths"), F.col("summary.total_paths").alias("summary_paths"), spread.alias("risk_distribution"))


@query(with_views("""SELECT contract_id, CAST(count(*) AS BIGINT) AS n_nodes, (SELECT count(*) FROM taint_edge e WHERE e.contract_id = n.contract_id) AS n_edges, count(*) FILTER (WHERE is_source) AS n_sources,
count(*) FILTER (WHERE is_sink) AS n_sinks, string_agg(DISTINCT source_type, ',' ORDER BY source_type) FILTER (WHERE is_source) AS source_types FROM taint_node n GROUP BY contract_id""", "taint_edge"))
def graph_documents(spark, sf_dir):
    """Graph documents written as JSON text, parsed with the schema of the reader, and counted."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    listed = n.groupBy("contract_id").agg(F.collect_list(F.struct(*[c for c in n.columns if c != "contract_id"])).alias("nodes"))
    drawn = e.groupBy("contract_id").agg(F.collect_list(F.struct("source", "target", "type", "var")).alias("edges"))
    docs = listed.join(drawn, "contract_id", "left").select("contract_id", F.to_json(F.struct("nodes", "edges")).alias("json"))
    docs = stored(docs, "graph-documents").select("contract_id", F.from_json("json", GRAPH).alias("d")).select("contract_id", "d.*")
    got_nodes, got_edges = explode_graphs(docs)
    types = got_nodes.where("is_source").groupBy("contract_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("sources")[0])), ",").alias("source_types"))
    return taint.graph_counts(got_nodes, got_edges).join(types, "contract_id", "left")
