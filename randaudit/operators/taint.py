"""Taint over per-contract graphs: counts, edges, reach, simple paths, risk of paths.

Nodes are rows (contract_id, id, label, type, code_snippet, is_source, is_sink, sources, sinks, used_vars, defined_vars),
edges are rows (contract_id, source, target, type, var, ord). Loops advance all contracts at once: a round joins the
frontier with the edges, which are bucketed once, and leaves out what earlier rounds found, which is bucketed as well; so only the
frontier is shuffled. Its rows are stored, so lineage stays flat. A small frontier takes several steps in one round. Only the
number of rows found comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from randaudit.operators import row_graphs as rg
from randaudit.sources.scratch import Buckets, spread, stored

#: Most edges of a path.
CUTOFF = 15
#: Steps of a round while it starts from at most so many rows.
STEPS, SMALL = 3, 2_000_000

#: Words of a gambling context, and source types by strength.
GAMBLING = ["lottery", "winner", "random", "bet", "gambl", "prize", "jackpot", "luck", "dice", "coin"]
CRITICAL = ["blockhash", "difficulty", "prevrandao"]
WEAK = ["timestamp", "blocknumber"]

#: Texts of the risk factors.
FACTOR = {
    "critical": "Critical entropy source (blockhash/difficulty)",
    "weak": "Weak entropy source (timestamp/blocknumber)",
    "gambling": "Gambling/lottery context detected",
    "financial": "Direct financial impact",
    "direct": "Direct path (≤2 nodes)",
    "short": "Short time window (<15 seconds)",
    "hash": "Hash with all predictable inputs",
    "combined": "Multiple weak sources combined",
    "mixing": "Proper entropy mixing detected",
    "long": "Long time window constraint",
    "admin": "Admin-only access control",
    "role": "Role-based access control",
    "user": "User input mixed with entropy",
    "complex": "Complex intermediate computations",
}
KEY = ["contract_id"]


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """contract_id, n_nodes, n_edges, n_sources, n_sinks (G1)."""
    n = nodes.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_source").alias("n_sources"), F.count_if("is_sink").alias("n_sinks")
    )
    e = edges.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "contract_id", "left").select("contract_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_sources", "n_sinks")


def build_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target), the last by ord; type and var get their defaults."""
    filled = edges.withColumn("type", F.coalesce("type", F.lit("control_flow"))).withColumn("var", F.coalesce("var", F.lit("")))
    return filled.groupBy("contract_id", "source", "target").agg(F.max_by(F.struct("type", "var"), "ord").alias("e")).select("contract_id", "source", "target", "e.*")


def known_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends are both nodes, the others for the error report)."""
    ids = nodes.select("contract_id", "id")
    ends = ids.withColumnRenamed("id", "source"), ids.withColumnRenamed("id", "target")
    good = edges.join(ends[0], ["contract_id", "source"], "left_semi").join(ends[1], ["contract_id", "target"], "left_semi")
    lost_source = edges.join(ends[0], ["contract_id", "source"], "left_anti")
    lost_target = edges.join(ends[0], ["contract_id", "source"], "left_semi").join(ends[1], ["contract_id", "target"], "left_anti")
    return good, lost_source.unionByName(lost_target)


#: A contract whose nodes and links are together at most so many rows is searched in a row of its own; the ids of the larger
#: contracts are broadcast if they are at most so many, and joined by a shuffle otherwise.
REACH_ROWS, MANY_LARGE = 1280, 1_000_000


def propagate(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """contract_id, source, node: all nodes that a source reaches, itself included.

    With strict, a data dependency only carries taint if its variable is defined at its start (G4). Nodes without a contract or an id take no
    part. A contract that fits a row (its rows are counted first) is searched there: every node holds the set of sources that reach it
    as bits, which links hand on until nothing changes, so cycles need no care and ordinary contracts are shuffled once to be
    counted and once to meet. The others take looped_reach(). Both give the same, and the split is by contract.
    """
    nodes = nodes.where("contract_id is not null and id is not null")
    links = _carrying(nodes, edges, strict)
    starts = nodes.where("is_source").select("contract_id", F.col("id").alias("source"))
    # What no source stands in, or leads nowhere, needs no row: only sources and links count.
    parts = links.unionByName(starts.select("contract_id", F.col("source").alias("node"), F.lit(None).cast(links.schema["next"].dataType).alias("next")))
    parts = stored(parts, "taint-parts")
    large = stored(parts.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REACH_ROWS).select("contract_id"), "taint-large")
    many = large.count()
    if not many:
        return _reach_in_rows(parts)
    large = F.broadcast(large) if many <= MANY_LARGE else large
    wide = parts.join(large, "contract_id", "left_semi")
    found = looped_reach(wide.where("next is null").select("contract_id", F.col("node").alias("source")), wide.where("next is not null"))
    return _reach_in_rows(parts.join(large, "contract_id", "left_anti")).unionByName(found)


def _carrying(nodes: DataFrame, edges: DataFrame, strict: bool) -> DataFrame:
    """contract_id, node, next of the edges that carry taint."""
    links = edges.where("contract_id is not null and source is not null and target is not null")
    links = links.select("contract_id", F.col("source").alias("node"), F.col("target").alias("next"), "type", "var")
    if strict:
        defined = nodes.select("contract_id", F.col("id").alias("node"), "defined_vars")
        carries = (F.col("type") != "data_dependency") | F.array_contains("defined_vars", F.col("var"))
        links = links.join(defined, ["contract_id", "node"]).where(carries)
    return links.select("contract_id", "node", "next")


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _reach_in_rows(parts: DataFrame) -> DataFrame:
    """contract_id, source, node by contracts of bounded size; parts are links (node, next) and sources (next is null)."""
    link = F.when(F.col("next").isNotNull(), F.struct(F.col("node").alias("a"), F.col("next").alias("b")))
    met = parts.groupBy("contract_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("next").isNull(), F.col("node")))).alias("starts"), F.collect_set(link).alias("links")
    )
    met = met.where(F.size("starts") > 0).withColumn("names", F.array_sort(F.array_distinct(F.concat("starts", F.col("links.a"), F.col("links.b")))))
    place = lambda x: (F.array_position("names", x) - 1).cast("int")
    placed = F.transform("links", lambda x: F.struct(place(x["a"]).alias("a"), place(x["b"]).alias("b")))
    into = lambda ends, j: F.transform(F.filter(ends, lambda x: x["b"] == j), lambda x: x["a"])
    rows = met.select("contract_id", "starts", "names", _in_row(placed, lambda ends: F.transform("names", lambda n, j: into(ends, j))).alias("before"))
    rows = stored(rows, "taint-reach-rows").withColumn("word", F.explode(F.sequence(F.lit(0), ((F.size("starts") - 1) / 64).cast("int"))))

    own = F.slice("starts", F.col("word") * 64 + 1, F.lit(64))
    spot = lambda n: F.array_position(own, n)
    first = F.transform("names", lambda n: F.when(spot(n) > 0, _bit(spot(n) - 1)).otherwise(F.lit(0).cast("long")))
    passed = lambda bits: F.transform("before", lambda of, j: F.aggregate(of, F.get(bits, j), lambda x, i: x.bitwiseOR(F.get(bits, i))))
    state = lambda bits, moves: F.struct(bits.alias("bits"), moves.alias("moves"))
    round_of = lambda s: _in_row(passed(s["bits"]), lambda new: state(new, new != s["bits"]))
    settled = F.aggregate(F.sequence(F.lit(1), F.size("names")), state(first, F.lit(True)), lambda s, k: F.when(s["moves"], round_of(s)).otherwise(s), lambda s: s["bits"])
    held = spread(rows).select("contract_id", own.alias("own"), F.explode(F.arrays_zip(F.col("names").alias("node"), settled.alias("bits"))).alias("x"))
    reaching = F.filter("own", lambda s, k: F.col("x.bits").bitwiseAND(_bit(k)) != 0)
    return held.select("contract_id", F.explode(reaching).alias("source"), F.col("x.node").alias("node"))


def looped_reach(starts: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of propagate() for graphs of any size, a few links of all contracts a round: starts (contract_id, source), links (contract_id, node, next)."""
    key = ["contract_id", "source", "node"]
    start = starts.distinct().select("contract_id", "source", F.col("source").alias("node"), F.lit(0).alias("at"))
    with Buckets(starts.sparkSession) as buckets:
        links, _ = buckets.store(links.select("contract_id", "node", "next"), "taint-links", "contract_id", "node")
        front, path = buckets.store(start, "taint-reach", *key)
        seen, paths, done = front, [path], 0
        while n := front.count():
            # Of the frontier only its last layer goes on: what lies behind the others was found with them.
            layer, reached = front.where(F.col("at") == done), None
            for _ in range(STEPS if n <= SMALL else 1):
                done += 1
                layer = layer.join(links, ["contract_id", "node"]).select("contract_id", "source", F.col("next").alias("node")).distinct().withColumn("at", F.lit(done))
                reached = layer if reached is None else reached.unionByName(layer)
            nearest = reached.groupBy(*key).agg(F.min("at").alias("at"))
            front, path = buckets.store(nearest.join(seen, key, "left_anti"), "taint-reach", *key, dealt=True)
            seen, paths = seen.unionByName(front), [*paths, path]
    return starts.sparkSession.read.schema(front.schema).parquet(*paths).drop("at")


def tainted_by(reach: DataFrame) -> DataFrame:
    """contract_id, node, sources (sorted)."""
    return reach.groupBy("contract_id", "node").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def tainted_sinks(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """contract_id, tainted_sinks: sinks that some source reaches (G6); contracts without one are left out."""
    sinks = nodes.where("is_sink").select("contract_id", F.col("id").alias("node"))
    return sinks.join(reach, ["contract_id", "node"], "left_semi").groupBy("contract_id").agg(F.count(F.lit(1)).alias("tainted_sinks"))


def _first(column: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(column), F.lit(1)), F.lit("unknown"))


def source_sink_pairs(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """contract_id, source, sink, source_type, sink_type of every tainted sink of every source."""
    sources = nodes.where("is_source").select("contract_id", F.col("id").alias("source"), _first("sources").alias("source_type"))
    sinks = nodes.where("is_sink").select("contract_id", F.col("id").alias("sink"), _first("sinks").alias("sink_type"))
    return reach.withColumnRenamed("node", "sink").join(sinks, ["contract_id", "sink"]).join(sources, ["contract_id", "source"])


def node_flags(nodes: DataFrame) -> DataFrame:
    """What a node adds to the paths through it: gambling, financial, mixing, access, time."""
    return _flagged(nodes).select("contract_id", "id", "gambling", "financial", "mixing", "access", "time")


def _flagged(nodes: DataFrame) -> DataFrame:
    """nodes with node_flags()."""
    # Lower-cased once, not for each word.
    nodes = nodes.withColumns({"_code": F.lower(F.coalesce("code_snippet", F.lit(""))), "_label": F.lower(F.coalesce("label", F.lit("")))})
    code, low, name = F.coalesce("code_snippet", F.lit("")), F.col("_code"), F.col("_label")
    gambling = reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in GAMBLING for x in (low, name)])
    financial = F.coalesce(F.col("type").isin("transfer", "send"), F.lit(False)) | F.contains(name, F.lit("transfer"))
    mixing = F.coalesce(F.col("type").isin("keccak", "sha256", "sha3") & (F.size("used_vars") > 2), F.lit(False))
    access = F.when(F.contains(low, F.lit("onlyowner")) | F.contains(low, F.lit("msg.sender == owner")), "admin").when(F.contains(low, F.lit("role")), "role")
    timed = F.contains(code, F.lit("block.timestamp")) | F.contains(code, F.lit("now"))
    unit = F.contains(code, F.lit("days")) | F.contains(code, F.lit("hours")) | F.contains(code, F.lit("weeks"))
    span = F.when(timed & (F.contains(code, F.lit("15")) | F.contains(code, F.lit("< 30"))), "short").when(timed & F.contains(code, F.lit(">")) & unit, "long")
    return nodes.withColumns({"gambling": gambling, "financial": financial, "mixing": mixing, "access": access, "time": span}).drop("_code", "_label")


def distance_to_sink(nodes: DataFrame, edges: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """contract_id, id, far: edges from a node to the nearest sink, for nodes within the cutoff."""
    key, back = ["contract_id", "id"], edges.select("contract_id", F.col("target").alias("id"), F.col("source").alias("before"))
    with Buckets(nodes.sparkSession) as buckets:
        back, _ = buckets.store(back, "taint-back", *key)
        front, path = buckets.store(nodes.where("is_sink").select("contract_id", "id", F.lit(0).alias("far")), "taint-far", *key)
        seen, paths, far = front, [path], 0
        while far < cutoff and (n := front.count()):
            # Of the frontier only its last layer matters: what lies behind the others was found with them.
            layer, reached = front.where(F.col("far") == far), None
            for _ in range(min(cutoff - far, STEPS if n <= SMALL else 1)):
                far += 1
                layer = layer.join(back, key).select("contract_id", F.col("before").alias("id")).distinct().withColumn("far", F.lit(far))
                reached = layer if reached is None else reached.unionByName(layer)
            nearest = reached.groupBy(*key).agg(F.min("far").alias("far"))
            front, path = buckets.store(nearest.join(seen, key, "left_anti"), "taint-far", *key, dealt=True)
            seen, paths = seen.unionByName(front), [*paths, path]
    return nodes.sparkSession.read.schema(front.schema).parquet(*paths)


#: A contract of at most so many nodes and edges, and walks (no fewer than its partial paths, about 130 bytes each), is searched where its rows meet.
ROW_NODES, ROW_EDGES, ROW_WALKS = 256, 1024, 1_000_000


def _in_row(value: Column, make) -> Column:
    """make(value) with the value made once."""
    return F.get(F.transform(F.array(value), make), 0)


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """contract_id, id, target, type, bits, source_type, sink_type of nodes (target is null) and links, those of a contract next to each other in one partition."""
    types = {"source_type": _first("sources"), "sink_type": _first("sinks")}
    told = _flagged(nodes.where("contract_id is not null and id is not null").withColumns(types))
    flags = {"is_source": rg.SOURCE, "is_sink": rg.SINK, "gambling": rg.GAMBLING, "financial": rg.FINANCIAL, "mixing": rg.MIXING}
    kinds = [(F.col(c) == name, k << at) for c, (at, names) in (("access", rg.ACCESS), ("time", rg.TIME)) for k, name in enumerate(names) if name]
    bits = reduce(lambda a, b: a + b, [F.when(c, F.lit(value)).otherwise(0) for c, value in (*((F.col(c), v) for c, v in flags.items()), *kinds)])
    none = F.lit(None).cast("string")
    drawn = edges.where("contract_id is not null and source is not null and target is not null")
    node = told.select("contract_id", "id", none.alias("target"), none.alias("type"), bits.alias("bits"), *types)
    link = drawn.select("contract_id", F.col("source").alias("id"), "target", "type", F.lit(None).cast("int").alias("bits"), *[none.alias(c) for c in types])
    return node.unionByName(link).repartition("contract_id").sortWithinPartitions("contract_id")


#: What is stored of a path, besides contract_id; types are those of its edges.
FOUND = """source string, sink string, path array<string>, types array<string>, gambling boolean, financial boolean, mixing boolean,
access string, time string, path_length int, contains_loop boolean, source_type string, sink_type string"""


def searched(nodes: DataFrame, edges: DataFrame, cutoff: int = CUTOFF) -> tuple[DataFrame, DataFrame]:
    """(simple_paths(), tainted_sinks() of what propagate() gives) by one preparation, where edges are those between known nodes; the latter has zeros, too.

    A contract of few rows and walks is searched where its rows meet (row_graphs), many contracts at once and without a shuffle for each edge;
    rows are counted before they meet, walks before paths are made. What is found is stored, so it may be read more than once. The others take
    looped_paths(), those of many rows propagate(). Both ways give the same, and the split is by contract, so no path is found twice.
    """
    one = lambda df, n, e: df.select("contract_id", F.lit(n).alias("n"), F.lit(e).alias("e"))
    sizes = one(nodes, 1, 0).unionByName(one(edges, 0, 1)).groupBy("contract_id").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    large = stored(sizes.where(f"contract_id is not null and (n > {ROW_NODES} or e > {ROW_EDGES})").select("contract_id"), "taint-large")
    many = large.count()
    few = lambda ids, n: F.broadcast(ids) if n <= MANY_LARGE else ids
    fit = lambda df: df.join(few(large, many), "contract_id", "left_anti") if many else df
    rows, most = graph_rows(fit(nodes), fit(edges)), ROW_WALKS
    schema = T.StructType([rows.schema["contract_id"], *T.StructType.fromDDL(f"{FOUND}, walks double, tainted_sinks long")])
    arrow = to_arrow_schema(schema)
    found = stored(rows.mapInArrow(lambda batches: rg.searched(batches, cutoff, most, arrow), schema), "taint-found")
    edge = lambda kind, i: F.struct(F.get("path", i).alias("from"), F.get("path", i + 1).alias("to"), kind.alias("type"))
    told = found.where("path is not null").withColumn("edges", F.transform("types", edge)).drop("types", "walks", "tainted_sinks")
    about = found.where("walks is not null")
    tainted, wide = about.select("contract_id", "tainted_sinks"), about.where(F.col("walks") > most).select("contract_id").unionByName(large)
    if n := wide.count():
        mine = lambda df, ids, n: df.join(few(ids, n), "contract_id", "left_semi")
        others = mine(nodes, wide, n)
        told = told.unionByName(_typed(looped_paths(others, mine(edges, wide, n), cutoff), others))
        if many:
            others = mine(nodes, large, many)
            tainted = tainted.unionByName(tainted_sinks(others, propagate(others, mine(edges, large, many))))
    return told, tainted


def simple_paths(nodes: DataFrame, edges: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """contract_id, source, sink, path, edges, path_length, contains_loop, the flags of its nodes, source_type, sink_type.

    All simple paths of at most `cutoff` edges from a source to another node that is a sink; edges are as build_edges() gives them.
    """
    return searched(nodes, edges, cutoff)[0]


def looped_paths(nodes: DataFrame, edges: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """The paths of simple_paths() for graphs of any size, an edge of all contracts a round.

    A partial path grows once
    for all sinks, and only towards nodes from which a sink is still near enough; flags of nodes are folded in on the way.
    """
    far = distance_to_sink(nodes, edges, cutoff)
    flags = node_flags(nodes)
    about = flags.join(far, ["contract_id", "id"]).join(nodes.select("contract_id", "id", "is_sink"), ["contract_id", "id"])
    links = edges.select("contract_id", F.col("source").alias("tail"), F.col("target").alias("id"), F.col("type").alias("edge_type"))
    steps = links.join(about.withColumnsRenamed({c: f"next_{c}" for c in ("gambling", "financial", "mixing", "access", "time", "far", "is_sink")}), ["contract_id", "id"])
    start = nodes.where("is_source").select("contract_id", "id").join(flags.join(far, ["contract_id", "id"]), ["contract_id", "id"])
    none = F.array().cast("array<struct<from:string,to:string,type:string>>")
    kept = ["gambling", "financial", "mixing", "access", "time"]
    front = start.where(F.col("far") <= cutoff).select("contract_id", F.col("id").alias("source"), F.col("id").alias("tail"), F.array("id").alias("path"), none.alias("edges"), F.lit(False).alias("at_sink"), *kept)
    done, front = 0, stored(front, "taint-paths")
    out = front

    def grown(paths: DataFrame, steps: DataFrame, length: int) -> DataFrame:
        """The paths that are one edge longer, `length` edges."""
        near = F.lit(length) + F.col("next_far") <= cutoff
        edge = F.struct(F.col("tail").alias("from"), F.col("id").alias("to"), F.col("edge_type").alias("type"))
        return paths.join(steps, ["contract_id", "tail"]).where(near & ~F.array_contains("path", F.col("id"))).select(
            "contract_id",
            "source",
            F.col("id").alias("tail"),
            F.array_append("path", F.col("id")).alias("path"),
            F.array_append("edges", edge).alias("edges"),
            F.col("next_is_sink").alias("at_sink"),
            *[(F.col(c) | F.col(f"next_{c}")).alias(c) for c in ("gambling", "financial", "mixing")],
            *[F.coalesce(F.col(c), F.col(f"next_{c}")).alias(c) for c in ("access", "time")],
        )

    with Buckets(nodes.sparkSession) as buckets:
        steps, _ = buckets.store(steps, "taint-steps", "contract_id", "tail")
        while done < cutoff and not front.isEmpty():
            done += 1
            front = stored(grown(front, steps, done), "taint-paths")
            out = out.unionByName(front)
    ends = out.where("at_sink").withColumnRenamed("tail", "sink").drop("at_sink")
    return ends.withColumn("path_length", F.size("path")).withColumn("contains_loop", F.lit(False))


def _typed(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths with source_type, sink_type."""
    sources = nodes.where("is_source").select("contract_id", F.col("id").alias("source"), _first("sources").alias("source_type"))
    sinks = nodes.where("is_sink").select("contract_id", F.col("id").alias("sink"), _first("sinks").alias("sink_type"))
    return paths.join(sources, ["contract_id", "source"]).join(sinks, ["contract_id", "sink"])


def assess(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths with source_type, sink_type (where they have none yet), risk_factors, mitigating_factors, risk_level."""
    typed = paths if "source_type" in paths.columns else _typed(paths, nodes)
    random = F.col("sink_type") == "randomGeneration"

    def listed(*pairs: tuple[Column, str]) -> Column:
        return F.filter(F.array(*[F.when(c, F.lit(FACTOR[f])) for c, f in pairs]), lambda x: x.isNotNull())

    risks = listed(
        (F.col("source_type").isin(*CRITICAL), "critical"),
        (F.col("source_type").isin(*WEAK), "weak"),
        (random & F.col("gambling"), "gambling"),
        (random & F.col("financial"), "financial"),
        (F.col("path_length") <= 3, "direct"),
        (F.col("time") == "short", "short"),
    )
    softer = listed(
        (F.col("path_length") > 7, "complex"),
        (F.col("mixing"), "mixing"),
        (F.col("access") == "admin", "admin"),
        (F.col("access") == "role", "role"),
        (F.col("time") == "long", "long"),
    )
    told = typed.withColumn("risk_factors", risks).withColumn("mitigating_factors", softer)
    return told.withColumn("risk_level", path_risk_level(F.col("risk_factors"), F.col("mitigating_factors")))


def path_risk_level(risks: Column, softer: Column) -> Column:
    """HIGH, MEDIUM or LOW."""
    has = lambda f, among=risks: F.array_contains(among, F.lit(FACTOR[f]))
    high = (has("critical") & has("gambling")) | (has("direct") & has("financial")) | (has("hash") & has("short"))
    low = (
        (F.size(risks) == 0)
        | ((F.size(softer) > F.size(risks)) & has("admin", softer))
        | (has("weak") & has("user", softer) & (F.size(risks) <= 1))
    )
    return F.when(high, "HIGH").when(low, "LOW").otherwise("MEDIUM")


def risk_distribution(nodes: DataFrame, reach: DataFrame, assessed: DataFrame) -> DataFrame:
    """contract_id, sources, sinks, tainted_sinks, total_paths, high, medium, low of every contract (G19). reach may be counted already (tainted_sinks)."""
    base = nodes.groupBy("contract_id").agg(F.count_if("is_source").alias("sources"), F.count_if("is_sink").alias("sinks"))
    levels = [F.count_if(F.col("risk_level") == level).alias(level.lower()) for level in ("HIGH", "MEDIUM", "LOW")]
    paths = assessed.groupBy("contract_id").agg(F.count(F.lit(1)).alias("total_paths"), *levels)
    tainted = reach if "tainted_sinks" in reach.columns else tainted_sinks(nodes, reach)
    every = base.join(tainted, "contract_id", "left").join(paths, "contract_id", "left")
    return every.select("contract_id", "sources", "sinks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tainted_sinks", "total_paths", "high", "medium", "low")])


#: Paths of one record at most, about: a contract with more has several records, told apart by part.
RECORD_PATHS = 10_000


def results(nodes: DataFrame, reach: DataFrame, assessed: DataFrame, per_record: int = RECORD_PATHS) -> DataFrame:
    """contract, part, statistics, paths, summary: the record of each contract as it is written.

    statistics and summary are those of the whole contract. paths are sorted; the paths of a contract with more than
    per_record of them are dealt over parts, so that no record grows without bound.
    """
    path = F.struct(
        "source", "sink", "path", "edges", "risk_level", "risk_factors", "mitigating_factors", "source_type", "sink_type", "path_length", "contains_loop"
    )
    # Read twice: to be counted, and to be dealt.
    assessed = assessed.select("contract_id", "risk_level", path.alias("p"))
    parts = F.greatest(F.ceil(F.col("total_paths") / per_record), F.lit(1)).cast("int")
    of = stored(risk_distribution(nodes, reach, assessed).withColumn("parts", parts), "taint-distribution")
    split = of.where("parts > 1").select("contract_id", "parts")
    many = split.count()
    dealt = assessed.select("contract_id", F.lit(0).alias("part"), "p")
    if many:
        # Only contracts with several parts have rows here, so others need no shuffle to meet their number.
        numbered = assessed.join(F.broadcast(split) if many <= MANY_LARGE else split, "contract_id", "left")
        dealt = numbered.select("contract_id", F.pmod(F.xxhash64("p.path"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "p")
    listed = dealt.groupBy("contract_id", "part").agg(F.sort_array(F.collect_list("p")).alias("paths"))
    each = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(listed, ["contract_id", "part"], "left")
    names = {"sources": "total_sources", "sinks": "total_sinks", "high": "high_risk_paths", "medium": "medium_risk_paths", "low": "low_risk_paths"}
    counters = [F.col(c).alias(names.get(c, c)) for c in ("sources", "sinks", "tainted_sinks", "total_paths", "high", "medium", "low")]
    spread = F.struct(*[F.col(level.lower()).alias(level) for level in ("HIGH", "MEDIUM", "LOW")])
    none = F.array().cast(listed.schema["paths"].dataType)
    return each.select(
        F.col("contract_id").alias("contract"), "part", F.struct(*counters).alias("statistics"), F.coalesce("paths", none).alias("paths"),
        F.struct("total_paths", spread.alias("risk_distribution")).alias("summary"),
    )


def corpus_totals(distribution: DataFrame, batch: Column) -> DataFrame:
    """batch, contract_id and the sums of the distribution for contracts, batches and the whole corpus, by rollup."""
    sums = [F.sum(c).alias(c) for c in ("sources", "sinks", "tainted_sinks", "total_paths", "high", "medium", "low")]
    return distribution.withColumn("batch", batch).rollup("batch", "contract_id").agg(*sums)


def top_high_risk(assessed: DataFrame, n: int = 3) -> DataFrame:
    """The first n HIGH paths of each contract, shortest first, with their rank."""
    order = Window.partitionBy("contract_id").orderBy("path_length", "source", "sink", "path")
    return assessed.where("risk_level = 'HIGH'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
