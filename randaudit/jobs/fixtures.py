"""Stand-in views on the driver's tables: contracts, graphs, scores. Plain SQL that Spark and DuckDB take alike.

`{documents}` and the like name tables. Braces of contract text are written as chr(123) and chr(125).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from randaudit.sources.scratch import spread

CONTRACT_SOURCE = """
SELECT doc_id AS contract_id, source AS batch, concat('pragma solidity ',
    CASE doc_id % 5 WHEN 0 THEN '^0.4.24' WHEN 1 THEN '>=0.5.0 <0.7.0' WHEN 2 THEN '0.6' WHEN 3 THEN '>0.4.22 <0.6.0' ELSE '^0.5.25' END, ';', chr(10),
    'contract C ', chr(123), chr(10), CASE WHEN doc_id % 7 = 0 THEN concat('uint seed = block.timestamp;', chr(10)) ELSE '' END,
    'function play(uint a) public ', chr(123), chr(10),
    replace(replace(replace(replace(replace(replace(replace(text,
      ' the ', ' block.timestamp '),
      ' of ', ' keccak256(block.number, block.difficulty) % 10 == 0 '),
      ' and ', ' now '),
      ' de ', ' uint(blockhash '),
      ' is ', ') require(msg.sender == owner) '),
      ' to ', ' endTime '),
      ' la ', ' block.gaslimit + block.coinbase '),
    chr(10), chr(125), chr(10), chr(125)) AS code
FROM {documents}"""

TAINT_NODE = """
SELECT contract_id, concat('n', lpad(CAST(id AS VARCHAR(10)), 3, '0')) AS id, p, rk, p % 6 = 0 AS is_source, p % 5 = 1 AS is_sink,
    CASE p % 4 WHEN 0 THEN 'blockhash' WHEN 2 THEN 'timestamp' ELSE 'gaslimit' END AS source_type,
    CASE WHEN p % 2 = 0 THEN 'randomGeneration' ELSE 'valueTransfer' END AS sink_type,
    CASE p % 7 WHEN 0 THEN 'keccak' WHEN 1 THEN 'transfer' WHEN 2 THEN 'sha256' WHEN 3 THEN 'send' ELSE 'assign' END AS type,
    p % 5 AS n_used_vars,
    CASE p % 11 WHEN 0 THEN 'Lottery draw' WHEN 1 THEN 'doTransfer' ELSE 'step' END AS label,
    CASE p % 13 WHEN 0 THEN 'require(msg.sender == owner)' WHEN 1 THEN 'hasRole(x)' WHEN 2 THEN 'block.timestamp < 30'
      WHEN 3 THEN 'block.timestamp > 2 days' WHEN 4 THEN 'winner = 1' ELSE 'x = y' END AS code_snippet
FROM (SELECT contract_id, id, p, row_number() OVER (PARTITION BY contract_id ORDER BY id) AS rk
      FROM (SELECT l_orderkey - l_orderkey % 4 AS contract_id, (l_orderkey % 4) * 7 + l_linenumber AS id, min(l_partkey) AS p
            FROM {lineitem} GROUP BY l_orderkey - l_orderkey % 4, (l_orderkey % 4) * 7 + l_linenumber) g) r"""

TAINT_EDGE = """
SELECT a.contract_id, a.id AS source, b.id AS target,
    CASE WHEN (a.p + b.p) % 2 = 0 THEN 'data_dependency' ELSE 'control_flow' END AS type, concat('v', CAST(b.p % 3 AS VARCHAR(10))) AS var
FROM {taint_node} a JOIN {taint_node} b ON a.contract_id = b.contract_id
  AND (b.rk = a.rk + 1 OR (b.rk = a.rk + 2 AND (a.p + b.p) % 3 = 0) OR (b.rk = a.rk - 3 AND (a.p + b.p) % 7 = 0))"""

SCORED = """
SELECT d.doc_id AS contract_id, CAST(l.quality AS INT) AS label, CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100 AS prob
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

ENTRIES = """
SELECT d.doc_id AS contract_id, d.source AS batch, CAST(l.quality AS INT) AS label, d.doc_id % 4 AS num_paths,
    d.doc_id % 11 <> 0 AS has_graph, d.doc_id % 13 <> 0 AS has_paths
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

FLIPPED = "SELECT contract_id, batch, 1 - label AS label, num_paths FROM {entries} WHERE has_graph AND has_paths"

VIEWS = {
    "contract_source": CONTRACT_SOURCE,
    "taint_node": TAINT_NODE,
    "taint_edge": TAINT_EDGE,
    "scored": SCORED,
    "entries": ENTRIES,
    "flipped": FLIPPED,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view, or a table of sf_dir, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    if name == "contract_source":
        return spark.sql(sql, documents=spread(view(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views (and those they need) as common table expressions before it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
            if n in VIEWS:
                add(n)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in needed]
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("RECURSIVE") else ""
    sql = sql.lstrip()[len("RECURSIVE") :] if recursive else sql
    rest = sql.lstrip()
    joiner = ", " + rest[4:].lstrip() if rest.upper().startswith("WITH") else "\n" + rest
    return f"WITH {recursive}" + ",\n".join(parts) + joiner
