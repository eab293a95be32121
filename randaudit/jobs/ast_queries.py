"""Queries of the AST operators and of the sources, and their SQL.

No driver table holds ASTs, so documents are built from supplier rows by one SQL expression that both engines take.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from randaudit.jobs.fixtures import view
from randaudit.operators import ast_flatten as af
from randaudit.sources import contracts as src

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_UINT = {"nodeType": "ElementaryTypeName", "name": "uint@BITS@"}
_USER = {"nodeType": "UserDefinedTypeName", "pathNode": {"name": "Token@ID@"}}
_MAP = {"nodeType": "Mapping", "keyType": {"nodeType": "ElementaryTypeName", "name": "address"}, "valueType": {"nodeType": "ArrayTypeName", "baseType": _USER}}


def _parameter(name: str, kind: dict, **more) -> dict:
    return {"name": name, "id": 7, "typeName": kind} | more


_MODERN = {
    "file_name": "s@ID@.sol",
    "nodes": [
        {"nodeType": "PragmaDirective", "id": 1},
        {"nodeType": "ImportDirective", "id": 2},
        {
            "nodeType": "ContractDefinition", "name": "C@ID@", "id": 10, "contractKind": "@KIND@", "abstract": True,
            "baseContracts": [{"baseName": {"name": "Base@KIND@", "id": 3}}, {"baseName": {"name": "Owned", "id": 4}}],
            "nodes": [
                {"nodeType": "VariableDeclaration", "name": "total", "id": 11, "stateVariable": True, "visibility": "public", "constant": True, "typeName": _UINT, "value": {"v": 1}},
                {"nodeType": "VariableDeclaration", "name": "book", "id": 12, "stateVariable": True, "visibility": "internal", "mutability": "immutable", "typeName": _MAP},
                {"nodeType": "VariableDeclaration", "name": "local", "id": 13, "stateVariable": False, "visibility": "internal", "typeName": _UINT},
                {"nodeType": "FunctionDefinition", "name": "play", "id": 14, "kind": "function", "visibility": "public", "stateMutability": "view",
                 "parameters": {"parameters": [_parameter("a", _UINT, storageLocation="memory"), _parameter("b", _MAP)]},
                 "returnParameters": {"parameters": [_parameter("", {"typeString": "tuple()"})]}, "modifiers": [{"modifierName": {"name": "onlyOwner"}}], "body": {"x": 1}},
                {"nodeType": "FunctionDefinition", "name": "stop", "id": 22, "kind": "function", "visibility": "public", "stateMutability": "view", "body": None},
                {"nodeType": "FunctionDefinition", "id": 15, "kind": "constructor", "visibility": "public", "stateMutability": "nonpayable", "implemented": False},
                {"nodeType": "FunctionDefinition", "name": "play", "id": 16, "kind": "function", "visibility": "@VIS@", "stateMutability": "pure", "virtual": True, "overrides": [{"path": "Base@KIND@"}, {"path": "Owned"}],
                 "parameters": {"parameters": [_parameter("c", _USER)]}, "body": {"x": 2}},
                {"nodeType": "ModifierDefinition", "name": "onlyOwner", "id": 17, "virtual": True, "overrides": [{"path": "Owned"}], "body": {"y": "@VIS@"}, "parameters": {"parameters": [_parameter("who", _USER)]}},
                {"nodeType": "EventDefinition", "name": "Won", "id": 18, "anonymous": True, "parameters": {"parameters": [_parameter("by", _UINT, indexed=True), _parameter("n", _UINT)]}},
                {"nodeType": "StructDefinition", "name": "Bet", "id": 19, "visibility": "public", "members": [_parameter("size", _UINT), _parameter("of", _USER, id=23)]},
                {"nodeType": "EnumDefinition", "name": "State", "id": 20, "members": [{"name": "Open"}, {"name": "Closed@KIND@"}]},
                {"nodeType": "ErrorDefinition", "name": "Broke", "id": 21, "parameters": {"parameters": [_parameter("why", _UINT)]}},
            ],
        },
    ],
}
_LEGACY = {
    "children": [
        {"name": "PragmaDirective", "id": 1},
        {
            "name": "ContractDefinition", "id": 30, "attributes": {"name": "L@ID@", "contractKind": "@KIND@", "baseContracts": [None, {"name": "Old", "id": 5}, {"id": 6}]},
            "children": [
                {"name": "VariableDeclaration", "id": 31, "attributes": {"name": "pot", "stateVariable": True, "type": "uint@BITS@", "visibility": "public", "constant": True, "value": "1"}},
                {"name": "VariableDeclaration", "id": 32, "attributes": {"name": "tmp", "type": "uint8"}},
                {"name": "FunctionDefinition", "id": 33, "attributes": {"name": "draw", "visibility": "@VIS@", "modifiers": ["m1"]},
                 "children": [{"name": "ParameterList", "children": [{"name": "VariableDeclaration", "id": 34, "attributes": {"name": "x", "type": "address"}}, {"name": "Other"}]},
                              {"name": "ParameterList", "children": [{"name": "VariableDeclaration", "id": 35, "attributes": {"name": "ret", "type": "bool"}}]}, {"name": "Block"}]},
                {"name": "FunctionDefinition", "attributes": {"kind": "constructor"}},
                {"name": "ModifierDefinition", "id": 36, "attributes": {"name": "once"}, "children": [{"name": "Block", "id": 41}]},
                {"name": "EventDefinition", "id": 37, "attributes": {"name": "Paid", "anonymous": False}},
                {"name": "StructDefinition", "id": 38, "attributes": {"name": "Slot"}},
                {"name": "EnumDefinition", "id": 39, "attributes": {"name": "Phase"}},
                {"name": "ErrorDefinition", "id": 40, "attributes": {"name": "Never"}},
            ],
        },
    ]
}


def _filled(template: dict) -> str:
    """SQL that fills a template; braces stay literal, quotes don't occur."""
    text = "'" + json.dumps(template, sort_keys=True) + "'"
    for mark, value in (
        ("@ID@", "CAST(s_suppkey AS VARCHAR(20))"),
        ("@KIND@", "CASE WHEN s_suppkey % 2 = 0 THEN 'contract' ELSE 'library' END"),
        ("@VIS@", "CASE WHEN s_suppkey % 3 = 0 THEN 'external' ELSE 'internal' END"),
        ("@BITS@", "CAST(8 * (1 + s_suppkey % 32) AS VARCHAR(20))"),
    ):
        text = f"replace({text}, '{mark}', {value})"
    return text


AST_JSON = f"CASE s_suppkey % 4 WHEN 3 THEN {_filled(_LEGACY)} WHEN 2 THEN '{{\"other\": 1}}' ELSE {_filled(_MODERN)} END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "supplier").select(F.concat(F.lit("dir/s"), F.col("s_suppkey"), F.lit(".json")).alias("path"), F.expr(AST_JSON).alias("json"))


def asts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.parse_asts(documents(spark, sf_dir))


# --- SQL ---
_DOC = f"""d AS (SELECT concat('s', s_suppkey, '.sol') AS file_name, CAST({AST_JSON} AS JSON) AS j FROM supplier),
items AS (SELECT file_name, (j->'nodes') IS NULL AS legacy, unnest(CAST(coalesce(j->'nodes', j->'children') AS JSON[])) AS item FROM d),
kinds AS (SELECT *, CASE WHEN legacy THEN item->>'name' ELSE item->>'nodeType' END AS kind FROM items),
cons AS (SELECT file_name, legacy, coalesce(CASE WHEN NOT legacy THEN item->>'name' END, item->'attributes'->>'name') AS contract, item FROM kinds WHERE kind = 'ContractDefinition'),
inner_all AS (SELECT file_name, contract, legacy, unnest(CAST(coalesce(CASE WHEN legacy THEN item->'children' ELSE item->'nodes' END, '[]') AS JSON[])) AS node,
  unnest(range(CAST(json_array_length(CASE WHEN legacy THEN item->'children' ELSE item->'nodes' END) AS BIGINT))) AS pos FROM cons),
inners AS (SELECT *, CASE WHEN legacy THEN node->>'name' ELSE node->>'nodeType' END AS kind FROM inner_all)"""
_T1 = "CASE ({t}->>'nodeType') WHEN 'ElementaryTypeName' THEN {t}->>'name' WHEN 'UserDefinedTypeName' THEN coalesce({t}->'pathNode'->>'name', {t}->>'name') ELSE coalesce({t}->>'typeString', 'unknown') END"


def _type_sql(t: str) -> str:
    """Type names of the depths that the documents hold."""
    one = lambda x: _T1.format(t=x)
    two = lambda x: f"CASE {x}->>'nodeType' WHEN 'ArrayTypeName' THEN concat({one(f'({x}->{lit('baseType')})')}, '[]') ELSE {one(x)} END"
    return f"CASE ({t}->>'nodeType') WHEN 'Mapping' THEN concat('mapping(', {two(f'({t}->{lit('keyType')})')}, ' => ', {two(f'({t}->{lit('valueType')})')}, ')') ELSE {two(t)} END"


def lit(text: str) -> str:
    return f"'{text}'"


_PARAMS = f"""params AS (SELECT file_name, contract, kind, pos, list, k, p->>'name' AS name, {_type_sql("(p->'typeName')")} AS type, CAST(p->>'id' AS BIGINT) AS id, coalesce(p->>'storageLocation', 'default') AS storage_location,
    coalesce(CAST(p->>'indexed' AS BOOLEAN), false) AS indexed
  FROM (SELECT file_name, contract, kind, pos, list, unnest(CAST(ps AS JSON[])) AS p, unnest(range(CAST(json_array_length(ps) AS BIGINT))) AS k FROM (
    SELECT file_name, contract, kind, pos, 'parameters' AS list, node->'parameters'->'parameters' AS ps FROM inners WHERE NOT legacy UNION ALL
    SELECT file_name, contract, kind, pos, 'returns', node->'returnParameters'->'parameters' FROM inners WHERE NOT legacy UNION ALL
    SELECT file_name, contract, kind, pos, 'members', node->'members' FROM inners WHERE NOT legacy)))"""
_FUN = f"""funs AS (SELECT * FROM (SELECT file_name, contract, legacy, pos, node, CASE WHEN legacy THEN coalesce(node->'attributes'->>'name', 'unnamed')
    ELSE coalesce(node->>'name', CASE WHEN (node->>'kind') = 'constructor' THEN 'constructor' ELSE 'fallback' END) END AS name FROM inners WHERE kind = 'FunctionDefinition')
  QUALIFY row_number() OVER (PARTITION BY file_name, contract, name ORDER BY pos DESC) = 1)"""


@query(f"""WITH {_DOC} SELECT file_name, contract, CASE WHEN legacy THEN coalesce(CAST(item->>'id' AS BIGINT), 0) ELSE CAST(item->>'id' AS BIGINT) END AS id,
CASE WHEN legacy THEN coalesce(item->'attributes'->>'contractKind', 'contract') ELSE item->>'contractKind' END AS type, coalesce(CAST(item->>'abstract' AS BOOLEAN), false) AS abstract,
CASE WHEN legacy THEN 'Old:5,Unknown:6' ELSE concat(item->'baseContracts'->0->'baseName'->>'name', ':3,Owned:4') END AS inheritance FROM cons""")
def ast_contracts(spark, sf_dir):
    bases = F.array_join(F.transform("inheritance", lambda b: F.concat_ws(":", b["name"], b["id"])), ",")
    return af.contracts(asts(spark, sf_dir)).withColumn("inheritance", bases)


@query(f"""WITH {_DOC}, {_FUN} SELECT file_name, contract, name, CASE WHEN legacy THEN coalesce(CAST(node->>'id' AS BIGINT), 0) ELSE CAST(node->>'id' AS BIGINT) END AS id,
CASE WHEN legacy THEN coalesce(node->'attributes'->>'kind', 'function') ELSE node->>'kind' END AS kind, CASE WHEN legacy THEN coalesce(node->'attributes'->>'visibility', 'internal') ELSE node->>'visibility' END AS visibility,
CASE WHEN legacy THEN 'nonpayable' ELSE node->>'stateMutability' END AS state_mutability, coalesce(CAST(node->>'virtual' AS BOOLEAN), false) AS virtual,
CASE WHEN legacy THEN coalesce(node->'attributes'->'modifiers'->>0, '') ELSE coalesce(node->'modifiers'->0->'modifierName'->>'name', '') END AS modifiers,
coalesce(CASE WHEN legacy THEN '' ELSE (SELECT string_agg(CAST(o AS VARCHAR), ',') FROM (SELECT unnest(CAST(coalesce(node->'overrides', '[]') AS JSON[])) AS o)) END, '') AS override,
CASE WHEN legacy AND name = 'draw' THEN '{{"name":"Block"}}' ELSE nullif(CAST(node->'body' AS VARCHAR), 'null') END AS body, coalesce(CAST(node->>'implemented' AS BOOLEAN), true) AS implemented FROM funs""")
def ast_functions(spark, sf_dir):
    return af.functions(asts(spark, sf_dir)).drop("parameters", "returns").withColumn("modifiers", F.array_join("modifiers", ",")).withColumn("override", F.array_join("override", ","))


@query(f"""WITH {_DOC}, {_FUN}, {_PARAMS} SELECT f.file_name, f.contract, f.name AS function, list, k AS pos, p.name, p.type, p.id, storage_location FROM funs f JOIN params p ON p.file_name = f.file_name AND p.contract = f.contract AND p.pos = f.pos
UNION ALL SELECT file_name, contract, name, 'parameters', 0, 'x', 'address', 34, 'default' FROM funs WHERE legacy AND name = 'draw'""")
def ast_parameters(spark, sf_dir):
    f = af.functions(asts(spark, sf_dir))
    lists = [f.select("file_name", "contract", F.col("name").alias("function"), F.lit(c).alias("list"), F.posexplode(c).alias("pos", "p")) for c in ("parameters", "returns")]
    return lists[0].unionByName(lists[1]).select("file_name", "contract", "function", "list", F.col("pos").cast("long").alias("pos"), "p.name", "p.type", "p.id", "p.storage_location")


@query(f"""WITH {_DOC}, {_PARAMS} SELECT i.file_name, i.contract, i.kind, coalesce(CASE WHEN legacy THEN node->'attributes'->>'name' ELSE node->>'name' END, '') AS name, CAST(node->>'id' AS BIGINT) AS id,
CASE WHEN i.kind IN ('ModifierDefinition', 'StructDefinition') THEN coalesce(node->>'visibility', 'internal') END AS visibility,
CASE WHEN i.kind = 'ModifierDefinition' THEN coalesce(CAST(node->>'virtual' AS BOOLEAN), false) WHEN i.kind = 'EventDefinition' THEN coalesce(CAST(node->>'anonymous' AS BOOLEAN), false) END AS flag,
CASE WHEN i.kind = 'ModifierDefinition' THEN coalesce(CAST(node->'overrides'->0 AS VARCHAR), '') END AS override,
CASE WHEN i.kind = 'ModifierDefinition' THEN coalesce(CAST(node->'body' AS VARCHAR), CAST(node->'children'->0 AS VARCHAR)) END AS body,
coalesce((SELECT string_agg(CASE WHEN i.kind = 'EnumDefinition' THEN p.name WHEN i.kind = 'StructDefinition' THEN concat_ws(' ', p.name, p.type, p.id)
  ELSE concat_ws(' ', p.name, p.type, p.id, storage_location, CASE WHEN indexed THEN 'true' ELSE 'false' END) END, ',' ORDER BY k) FROM params p
  WHERE p.file_name = i.file_name AND p.contract = i.contract AND p.pos = i.pos), '') AS members
FROM inners i WHERE i.kind IN ('ModifierDefinition', 'EventDefinition', 'StructDefinition', 'EnumDefinition', 'ErrorDefinition') AND NOT (legacy AND i.kind = 'ErrorDefinition')""")
def ast_members(spark, sf_dir):
    text = F.transform("members", lambda m: F.concat_ws(" ", m["name"], m["type"], m["id"].cast("string"), m["storage_location"], m["indexed"].cast("string")))
    return af.other_members(asts(spark, sf_dir)).withColumn("members", F.array_join(text, ",")).withColumn("override", F.array_join("override", ","))


@query(f"""WITH {_DOC} SELECT file_name, contract, CASE WHEN legacy THEN node->'attributes'->>'name' ELSE node->>'name' END AS name, CAST(node->>'id' AS BIGINT) AS id,
CASE WHEN legacy THEN node->'attributes'->>'type' ELSE {_type_sql("(node->'typeName')")} END AS type, CASE WHEN legacy THEN node->'attributes'->>'visibility' ELSE node->>'visibility' END AS visibility,
coalesce(CAST(coalesce(node->>'constant', node->'attributes'->>'constant') AS BOOLEAN), false) AS constant, coalesce((node->>'mutability') = 'immutable', false) AS immutable,
CAST(coalesce(node->'value', node->'attributes'->'value') AS VARCHAR) AS initial_value
FROM inners WHERE kind = 'VariableDeclaration' AND coalesce(CAST(coalesce(node->>'stateVariable', node->'attributes'->>'stateVariable') AS BOOLEAN), false)""")
def ast_state_variables(spark, sf_dir):
    return af.state_variables(asts(spark, sf_dir))


@query(f"WITH {_DOC}, {_PARAMS} SELECT type, count(*) AS n FROM params WHERE kind <> 'EnumDefinition' GROUP BY type")
def ast_type_names(spark, sf_dir):
    nodes = af.members(asts(spark, sf_dir)).where(~F.col("legacy"))
    lists = F.concat(*[af._or_empty(af._get("node", p, "array<variant>")) for p in ("$.parameters.parameters", "$.returnParameters.parameters", "$.members")])
    each = nodes.where("kind <> 'EnumDefinition'").select(F.explode(lists).alias("p"))
    return each.groupBy(af.type_name(af._get("p", "$.typeName", "variant")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('s', s_suppkey, '.sol') AS file_name, CASE WHEN s_suppkey % 4 = 2 THEN 'unknown format' END AS error, CAST(CASE WHEN s_suppkey % 4 IN (0, 1) THEN 1 ELSE 0 END AS BIGINT) AS n_imports, CAST(CASE WHEN s_suppkey % 4 = 2 THEN 0 ELSE 1 END AS BIGINT) AS n_pragmas FROM supplier")
def ast_directives(spark, sf_dir):
    found = asts(spark, sf_dir)
    errors = af.unknown_format(found).withColumn("error", F.lit("unknown format"))
    every = found.select("file_name").join(errors, "file_name", "left").join(af.imports_and_pragmas(found), "file_name", "left")
    return every.select("file_name", "error", F.coalesce("n_imports", F.lit(0)).alias("n_imports"), F.coalesce("n_pragmas", F.lit(0)).alias("n_pragmas"))


@query(f"""WITH {_DOC} SELECT file_name, CAST(row_number() OVER (PARTITION BY file_name ORDER BY CAST(item->>'id' AS BIGINT)) - 1 AS BIGINT) AS pos, kind, CAST(item->>'id' AS BIGINT) AS id, CAST(item AS VARCHAR) AS node
FROM kinds WHERE kind IN ('ImportDirective', 'PragmaDirective')""")
def ast_directive_records(spark, sf_dir):
    return af.directives(asts(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT concat('c', doc_id) AS contract_id, source AS batch, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS label, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS md5 FROM documents""")
def decode_contracts(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 2 == 0, "vulnerable").otherwise("safe")
    # Odd documents are stored as Latin-1 bytes where that loses nothing; even ones as UTF-8.
    latin = F.encode("text", "ISO-8859-1")
    content = F.when((F.col("doc_id") % 2 == 1) & (F.decode(latin, "ISO-8859-1") == F.col("text")), latin).otherwise(F.encode("text", "UTF-8"))
    files = docs.select(F.concat_ws("/", F.lit("file:/data"), "source", folder, F.concat(F.lit("c"), "doc_id", F.lit(".sol"))).alias("path"), content.alias("content"))
    done = src.from_bytes(files)
    return done.select("contract_id", "batch", F.col("label").cast("long").alias("label"), F.length("code").cast("long").alias("n_chars"), F.md5(F.col("code").cast("binary")).alias("md5"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS file, 'error' AS status, 'broken JSON' AS error, 'N/A' AS version, CAST(1 AS BIGINT) AS n FROM documents WHERE doc_id % 17 = 0
UNION ALL SELECT NULL, CASE WHEN doc_id % 17 = 0 THEN 'error' ELSE 'success' END, NULL, NULL, count(*) FROM documents GROUP BY 2""")
def quarantine_report(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("{"), F.col("text"))).otherwise(F.concat(F.lit('{"n": '), F.col("doc_id"), F.lit("}")))
    parsed = docs.select(F.col("doc_id").cast("string").alias("file"), F.try_parse_json(text).alias("v"))
    attempts = parsed.select("file", F.when(F.col("v").isNull(), "broken JSON").alias("error"), F.lit("N/A").alias("version"))
    errors, counts = src.error_report(attempts)
    listed = errors.select("file", F.lit("error").alias("status"), "error", "version", F.lit(1).cast("long").alias("n"))
    return listed.unionByName(counts, allowMissingColumns=True)


@query("""WITH f AS (SELECT source AS directory, concat('c', lpad(CAST(doc_id AS VARCHAR), 8, '0'), CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.sol' END) AS name FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY directory, ends_with(name, '.sol') ORDER BY name) AS k FROM f)
SELECT directory, count(*) AS n_items, count(*) FILTER (WHERE ends_with(name, '.sol')) AS n_contracts, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE k <= 5 AND ends_with(name, '.sol')), '') AS sample,
greatest(count(*) FILTER (WHERE ends_with(name, '.sol')) - 5, 0) AS more FROM k GROUP BY directory""")
def directory_profile(spark, sf_dir):
    name = F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".sol"))
    files = view(spark, sf_dir, "documents").select(F.col("source").alias("directory"), name.alias("name"))
    return src.directory_profile(files).withColumn("sample", F.array_join("sample", ",")).withColumn("more", F.col("more").cast("long"))
